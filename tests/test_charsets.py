"""Charset detection: held-out accuracy on texts of 200 bytes and more, defined cases, counts against plain Python."""

import codecs
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from askloom.operators import charsets

LEAST = 0.98


@F.pandas_udf(BinaryType())
def encoded(text: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([t.encode(c) for t, c in zip(text, charset)])


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def detector(docs):
    return charsets.Detector(charsets.learn_pairs(docs.filter("doc_id % 2 = 0")))


def test_held_out_texts(docs, detector):
    each = F.explode(F.array(*map(F.lit, charsets.CHARSETS))).alias("charset")
    unseen = docs.filter("doc_id % 2 = 1").select("text", each).withColumn("content", encoded("text", "charset"))
    done = unseen.withColumn("right", detector.decode_detected(F.col("content")) == F.col("text"))
    got = {r["charset"]: (r["right"], r["n"]) for r in done.filter("octet_length(text) >= 200").groupBy("charset").agg(F.count_if("right").alias("right"), F.count("*").alias("n")).collect()}
    assert set(got) == set(charsets.CHARSETS)
    assert all(right >= LEAST * n for right, n in got.values()), got


def test_pair_counts(spark):
    texts = ["", None, "aé", "éa!", "日本"]
    got = {(r["charset"], r["pair"]): r["n"] for r in charsets.learn_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), charsets=("cp1252", "utf-16-le")).collect()}
    want = Counter()
    for t in texts:
        for c in ("cp1252", "utf-16-le"):
            if t and not (c == "cp1252" and "日" in t):
                b = t.encode(c)
                want.update((c, (k % 2) * 65536 + b[k] * 256 + b[k + 1]) for k in range(len(b) - 1))
    assert got == dict(want)


def test_slices_do_not_change_pairs(monkeypatch):
    content = "Überprüfung é".encode("cp1252") * 7
    whole = [int(x) for part in charsets._pairs(content) for x in part]
    monkeypatch.setattr(charsets, "SLICE", 4)
    assert [int(x) for part in charsets._pairs(content) for x in part] == whole


def test_defined_cases(spark, detector):
    long = "Müller und Söhne über Größe " * 40_000
    cases = {
        1: (None, None, None, None),
        2: (b"", None, "utf-8", ""),
        3: (b"plain", "cp850", "utf-8", "plain"),
        4: (codecs.BOM_UTF8 + "é".encode(), None, "utf-8-sig", "é"),
        5: (codecs.BOM_UTF16_BE + "é".encode("utf-16-be"), None, "utf-16", "é"),
        6: (b"\xe9", "cp1252", None, "é"),
        7: (b"\xe9", None, None, "�"),
        8: (long.encode("mac-roman"), "utf-8", "mac-roman", long),
        9: (b"\0", None, None, "\0"),
    }
    df = spark.createDataFrame([(k, *v[:2]) for k, v in cases.items()], "id int, content binary, declared string")
    got = df.select("id", detector.detect(F.col("content")).alias("c"), detector.decode_detected(F.col("content"), F.col("declared")).alias("t")).collect()
    assert {r["id"]: (r["c"], r["t"]) for r in got} == {k: v[2:] for k, v in cases.items()}


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "text string")
    detector = charsets.Detector(charsets.learn_pairs(empty))
    row = spark.createDataFrame([(bytearray("é".encode("cp1252") * 3),)], "b binary").select(detector.detect(F.col("b"))).first()
    assert row[0] in charsets.CHARSETS


def test_detecting_and_decoding_is_one_visit_to_python(docs, detector):
    read = docs.select(detector.decode_detected(F.encode("text", "utf-16be"), F.lit("cp1252")).alias("got"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
