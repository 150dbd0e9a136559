"""Line deduplication by overlapping windows of three consecutive lines.

Every window of three lines is hashed (two 64-bit hashes of the lines, blanks at their ends left out). A window that occurs
more than once in the corpus keeps its first occurrence, by (document id, text hash, position); every later one covers its
three lines, and the union of covered lines is removed. Windows of nothing but blank lines don't count.

Defined cases: a text with fewer than three lines has no window and stays; NULL text stays NULL with 0 lines; a NULL id sorts
first; a text all of whose lines are covered becomes empty. Rows with equal id and equal text are one document and get
the same result, once for each row. Extra columns pass through, whatever their names.

Only windows that occur more than once are joined, on their hashes, from a written table: both sides are plain exchanges, so
adaptive execution splits a window that a large part of the corpus shares. Counting is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm.tables import fresh, staged

BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """id, key, at and two hashes of every window of ``size`` lines; ``docs`` has id, key and text."""
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS)))
    with_lines = docs.select("id", "key", trimmed.alias("lines")).where(F.size("lines") >= size)
    first = F.sequence(F.lit(0), F.size("lines") - F.lit(size))

    def window(p: Column) -> Column:
        lines = [F.element_at("lines", p + F.lit(k + 1)) for k in range(size)]
        return F.struct(
            p.alias("at"),
            (F.greatest(*[F.length(x) for x in lines]) > 0).alias("counts"),
            F.xxhash64(*lines).alias("h1"),
            F.xxhash64(F.lit("second"), *reversed(lines)).alias("h2"),
        )

    return with_lines.select("id", "key", F.inline(F.transform(first, window))).where("counts").drop("counts")


def covered(docs: DataFrame, size: int = 3) -> DataFrame:
    """id, key and the positions at which a later occurrence of a window begins, per document that has any."""
    every = windows(docs, size)
    repeated = every.groupBy("h1", "h2").agg(F.min(F.struct("id", "key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = staged(repeated.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first"), "windows")
    later = every.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & ~F.struct("id", "key", "at").eqNullSafe(F.col("first")))
    return later.groupBy("id", "key").agg(F.collect_set("at").alias("starts"))


def count_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the two columns that ``dedup_lines`` adds: _n_lines and _n_removed, with underscores behind them where ``docs`` has these."""
    return fresh(docs, "_n_lines"), fresh(docs, "_n_removed")


def dedup_lines(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with later occurrences removed from the text, and two columns at the end (see ``count_names``)."""
    text = F.col(f"`{text_column}`")
    keyed = F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("key")
    hits = covered(docs.select(*keyed, text.alias("text")).where(text.contains("\n")), size)
    whole = docs.select(F.struct("*").alias("row"), *keyed)
    hits = hits.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), "starts")
    joined = whole.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + F.lit(size - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - F.lit(1)), "gone")
    kept = F.array_join(F.transform(left, lambda p: F.element_at("lines", p + F.lit(1))), "\n")
    old = F.col("row").getField(text_column)
    joined = joined.withColumn("lines", _lines(old)).withColumn("gone", gone)
    text = F.when(F.col("starts").isNull(), old).otherwise(kept).alias(text_column)
    columns = [text if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    n_lines = F.when(old.isNull(), 0).otherwise(F.size("lines"))
    n_removed = F.when(F.col("starts").isNull(), 0).otherwise(F.size("gone"))
    return joined.select(*columns, *(c.alias(name) for c, name in zip((n_lines, n_removed), count_names(docs), strict=True)))


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM d WHERE len(lines) >= 3),
w AS (
  SELECT doc_id, pos, trim(lines[pos], ' ' || chr(9) || chr(13)) AS a, trim(lines[pos + 1], ' ' || chr(9) || chr(13)) AS b,
         trim(lines[pos + 2], ' ' || chr(9) || chr(13)) AS c
  FROM l
),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w WHERE length(a || b || c) > 0
  ) WHERE k > 1
),
gone AS (SELECT DISTINCT doc_id, pos + o AS pos FROM later, (SELECT unnest([0, 1, 2]) AS o)),
each AS (SELECT doc_id, pos, lines[pos] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM d)),
kept AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (g.pos IS NULL), '') AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed, k.text AS text
FROM d LEFT JOIN kept k USING (doc_id)
"""
