import pytest
from pyspark.sql import functions as F

NASTY = [
    (None, "a null id with quite a few words in it"),
    (1, None),
    (2, ""),
    (3, " \n\t\r "),
    (4, "one two three four five six seven eight nine ten eleven twelve\nsecond line of it\nthird line of it\nfourth line"),
    (5, "one two three four five six seven eight nine ten eleven twelve\nsecond line of it\nthird line of it\nfourth line"),
    (6, "same row"),
    (6, "same row"),
    (7, "same id, first text of it that has some words"),
    (7, "same id, second text which is another one altogether"),
    (8, "ü" * 3000 + " x" * 3000 + "\n\n\n\n" + "long " * 60000),
    (9, "Y0U 1D10T! you are an idiot, you id*ot, IDIOT... <|endoftext|> <s> ▁▁  ▁ x\x00y\x1c\x85z"),
]
# Names that operators use themselves.
CLASHING = ["row", "id", "features", "features_", "score", "prediction", "label", "key", "lines", "at", "node", "n", "ids", "held", "block", "unwanted", "wanted", "_n_lines", "_n_removed"]


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and extra columns with clashing names."""
    docs = spark.createDataFrame(NASTY, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit(f"keep {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(nasty):
    return nasty.where("false")


@pytest.fixture(scope="session")
def some_labels(spark):
    rows = [(k, k % 2, 1 - k % 2) for k in range(10)] + [(None, 1, 0), (4, None, None), (5, 1, 0), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
