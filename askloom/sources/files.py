"""File sources: crawled pages, text folders, answer uploads, sitemaps, raw bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from askloom.functions import text as T
from askloom.functions import urls as U
from askloom.functions.qa import ANSWER_WORD, split_qa_marker

# Limits of the upload gate and the text archive.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MIN_ANSWER_CHARS = 50
MIN_SCRIPT_CHARS = 50
MIN_ARCHIVE_CHARS = 40


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages; an empty body counts as failed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    status = F.when(F.coalesce("html", F.lit("")) == "", F.lit("failed")).otherwise(F.lit("read"))
    return pages.withColumn("status", status)


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files below a folder as ``path, length, content``; one row per file, read where the task runs."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.load(folder).select("path", "length", "content")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_text_dir(spark: SparkSession, folder: str, source: str, **options) -> DataFrame:
    """Records of the text files below a folder."""
    return text_records(read_files(spark, folder, "*.txt"), source, **options)


def text_records(
    files: DataFrame, source: str, min_len: int = MIN_ARCHIVE_CHARS, marker: str = ANSWER_WORD, base: str = "file://pdf"
) -> DataFrame:
    """One record per file ``path, content``; files with too little text are left out."""
    docs = files.select(
        _name(F.col("path")).alias("name"), T.normalize_text(decode_bytes(F.col("content"), F.lit("utf-8"))).alias("body")
    )
    split = docs.filter(F.length("body") >= min_len).select("name", split_qa_marker(F.col("body"), marker).alias("s"))
    return split.select(
        "s.question",
        "s.answer",
        F.lit(source).alias("source"),
        U.canonical_url(F.concat(F.lit(base + "/"), "name")).alias("url"),
        F.lit("pdf").alias("category"),
        F.lit(None).cast("string").alias("date"),
    )


def gate_upload_files(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES, min_len: int = MIN_ANSWER_CHARS) -> DataFrame:
    """``name, body, reason``: the cleaned text of each upload, or why it is rejected.

    ``.pdf`` rows carry text extracted beforehand; their text must be mostly readable Arabic script.
    """
    suffix = F.lower(F.regexp_extract(_name(F.col("path")), r"(\.[^.]+)\z", 1))
    known = files.select(_name(F.col("path")).alias("name"), "length", suffix.alias("suffix"), "content")
    # Bytes that are no UTF-8 are dropped, not replaced; a replacement character of the file's own is set aside meanwhile.
    own, aside = F.lit("\ufffd"), F.lit("\ufdd0")
    valid = F.make_valid_utf8(F.replace(F.col("content").cast("string"), own, aside))
    text = F.replace(F.replace(valid, own, F.lit("")), aside, own)
    usable = F.col("suffix").isin(".pdf", ".txt") & (F.col("length") <= max_bytes)
    cleaned = known.withColumn("body", F.when(usable, T.dedupe_lines(T.normalize_text(text))))
    reason = (
        F.when(~F.col("suffix").isin(".pdf", ".txt"), F.lit("only pdf or txt files"))
        .when(F.col("length") > max_bytes, F.lit("file too large"))
        .when((F.col("suffix") == ".pdf") & (F.regexp_count("body", F.lit(T.ARABIC_BLOCK)) < MIN_SCRIPT_CHARS), F.lit("text not readable"))
        .when(F.length("body") < min_len, F.lit("text too short"))
    )
    return cleaned.withColumn("reason", reason).select("name", "body", "reason")


def sitemap_urls(docs: DataFrame, keep, roots: Column) -> DataFrame:
    """Distinct canonical page URLs of sitemaps ``doc_url, body``.

    ``roots`` marks the documents to start from; ``.xml`` entries name further maps and are followed one level.
    """
    locs = F.regexp_extract_all("body", F.lit(r"(?s)<loc>(.*?)</loc>"), F.lit(1))
    entries = docs.select("doc_url", roots.alias("is_root"), F.explode(locs).alias("loc"))
    entries = entries.select("doc_url", "is_root", T.normalize_text(F.col("loc")).alias("loc")).filter(F.col("loc") != "")
    is_map = F.endswith(F.lower("loc"), F.lit(".xml"))
    top = entries.filter("is_root")
    subs = top.filter(is_map).select(F.col("loc").alias("doc_url")).distinct()
    nested = entries.join(subs, "doc_url", "left_semi").select("loc")
    found = top.filter(~is_map).select("loc").unionByName(nested)
    urls = found.select(U.canonical_url(F.col("loc")).alias("url")).distinct()
    return urls.filter(keep(F.col("url")))


NATIVE = ("utf-8", "utf8", "us-ascii", "ascii")


def decode_other(content: bytes, charset: str | None) -> str | None:
    """Text by a charset that Spark does not decode, UTF-8 where it is unknown; NULL for those that it does."""
    if charset is None or charset.lower() in NATIVE:
        return None
    try:
        return content.decode(charset.lower(), errors="replace")
    except LookupError:
        return content.decode("utf-8", errors="replace")


@F.pandas_udf(StringType())
def _decode_other(content: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode_other(bytes(b), cs) for b, cs in zip(content, charset)], dtype=object)


def decode_bytes(content: Column, charset: Column) -> Column:
    """Text of raw bytes by declared charset, UTF-8 when none is declared; bad bytes become U+FFFD.

    UTF-8 is decoded natively. Other charsets go to Python; UTF-8 rows travel there as NULL.
    """
    cs = F.lower(F.coalesce(charset, F.lit("utf-8")))
    native = cs.isin(*NATIVE)
    return F.coalesce(
        F.when(native, F.make_valid_utf8(content.cast("string"))),
        _decode_other(F.when(~native, content), F.when(~native, cs)),
    )
