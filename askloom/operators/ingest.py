"""Ingest: append once per URL, dead letters, publishing, role and domain gates, schema conformance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import blank_to_null, contains_any, cut, let, strip

STATUSES = ("inserted", "skipped", "failed", "parsed_none")


def upsert_by_url(incoming: DataFrame, store: DataFrame, order_by: str = "seq", key: str = "url") -> DataFrame:
    """Every incoming row with ``status`` ``inserted`` (first of its URL, URL not stored) or ``skipped``.

    The winner of a URL is found by a map-side combined minimum. The verdict is joined back on
    ``(url, order)``, so a URL that holds a large share of the rows is spread over all partitions.
    ``order_by`` must be unique within a URL.
    """
    first = incoming.groupBy(key).agg(F.min(order_by).alias(order_by))
    new = first.join(store.select(key), key, "left_anti").withColumn("is_new", F.lit(True))
    status = F.when(F.col("is_new"), F.lit("inserted")).otherwise(F.lit("skipped"))
    return incoming.join(new, [key, order_by], "left").withColumn("status", status).drop("is_new")


def dead_letter(df: DataFrame, width: int | None = None) -> DataFrame:
    """Failed and unparsable rows as ``url, source, error``; ``width`` cuts the error text if given."""
    bad = df.filter(F.col("status").isin("failed", "parsed_none"))
    return bad.select("url", "source", cut(F.col("error"), width).alias("error"))


def dry_run(df: DataFrame) -> DataFrame:
    """What a run would do: rows per status, nothing written."""
    return df.groupBy("status").agg(F.count("*").alias("n"))


def ingest_stats(df: DataFrame, by: str = "source", statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Rows per source and status as columns; an absent status counts zero."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return df.groupBy(by).agg(*counts)


def stored_name(explicit: Column, role: Column, reviewer_name: Column, width: int | None = None) -> Column:
    """Source name kept with a manual entry."""
    fallback = F.when(role == "admin", F.lit("Admin")).otherwise(F.coalesce(blank_to_null(reviewer_name, width), F.lit("Reviewer")))
    return F.coalesce(blank_to_null(explicit, width), fallback)


def search_name(explicit: Column, width: int | None = None) -> Column:
    """Source name under which a manual entry is searchable."""
    return F.coalesce(blank_to_null(explicit, width), F.lit("Admin Entry"))


def publish_record(rows: DataFrame, prefix: str, as_of: str, source_width: int | None = None, category_width: int | None = None) -> DataFrame:
    """Published manual rows in corpus form; the URL ``prefix://id`` is their key and is never cut."""
    published = rows.filter(F.col("status") == "published")
    return published.select(
        strip(F.col("question")).alias("question"),
        strip(F.col("answer")).alias("answer"),
        cut(F.coalesce("source", F.lit("")), source_width).alias("source"),
        F.concat(F.lit(f"{prefix}://"), F.col("id").cast("string")).alias("url"),
        blank_to_null(F.col("category"), category_width).alias("category"),
        F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyy-MM-dd").alias("date"),
    )


def with_published(corpus: DataFrame, published: DataFrame) -> DataFrame:
    """Corpus and published rows together."""
    return corpus.unionByName(published, allowMissingColumns=True)


def back_reference(rows: DataFrame, corpus: DataFrame, prefix: str) -> DataFrame:
    """Manual rows with the corpus URL they were mirrored to, NULL for drafts."""
    keyed = rows.withColumn("record_url", F.concat(F.lit(f"{prefix}://"), F.col("id").cast("string")))
    marks = corpus.select(F.col("url").alias("record_url"), F.lit(True).alias("found"))
    joined = keyed.join(marks, "record_url", "left")
    return joined.withColumn("record_url", F.when(F.col("found"), F.col("record_url"))).drop("found")


def role_gate(rows: DataFrame, users: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Rows with ``reason`` NULL when the acting user may write, else why not.

    An administrator needs the role; a reviewer needs the role and a profile; answers to a question
    (``assigned_to`` present) need the profile that the question is assigned to.
    """
    profiles = reviewers.select(F.col("user_id").alias("actor_id"), F.col("id").alias("profile_id"))
    actors = users.select(F.col("id").alias("actor_id"), F.col("role").alias("actor_role")).join(profiles, "actor_id", "left")
    joined = rows.join(actors, "actor_id", "left")
    role, claimed = F.col("actor_role"), F.col("claimed_role")
    reason = (
        F.when(role.isNull(), F.lit("user not found"))
        .when(role != claimed, F.lit("forbidden"))
        .when((claimed == "reviewer") & F.col("profile_id").isNull(), F.lit("profile not found"))
        .when(
            (claimed == "reviewer") & F.col("assigned_to").isNotNull() & (F.col("assigned_to") != F.col("profile_id")),
            F.lit("not assigned"),
        )
    )
    return joined.withColumn("reason", reason).drop("actor_role", "profile_id")


@dataclass(frozen=True)
class Domain:
    """Allowed values, length range or presence of one column."""

    column: str
    values: tuple[str, ...] | None = None
    length: tuple[int, int] | None = None
    required: bool = False

    def violated(self) -> Column:
        c = F.col(self.column)
        bad = F.lit(False)
        if self.values is not None:
            bad = bad | ~c.isin(*self.values)
        if self.length is not None:
            bad = bad | ~F.length(c.cast("string")).between(*self.length)
        if self.required:
            bad = bad | c.isNull()
        return F.coalesce(bad, F.lit(False))


# Domains of the request fields.
QUESTION_STATUS = ("pending", "reviewing", "answered", "published", "rejected")
DOMAINS = {
    "question": (Domain("question_text", length=(20, 2000), required=True),),
    "question_status": (Domain("status", values=QUESTION_STATUS, required=True),),
    "priority": (Domain("priority", values=("normal", "high", "urgent")),),
    "manual": (
        Domain("question", length=(20, 50_000), required=True),
        Domain("answer", length=(50, 500_000), required=True),
        Domain("category", length=(0, 200)),
        Domain("source_name", length=(0, 200)),
        Domain("pdf_url", length=(0, 500)),
        Domain("status", values=("draft", "published")),
    ),
    "answer": (Domain("answer_text", length=(50, 500_000), required=True), Domain("category", length=(0, 512))),
    "subscription": (
        Domain("plan", values=("free", "monthly", "yearly"), required=True),
        Domain("status", values=("active", "expired", "cancelled"), required=True),
    ),
    "donation": (
        Domain("currency", values=("PKR", "USD"), required=True),
        Domain("payment_method", values=("stripe", "jazzcash", "easypaisa", "manual"), required=True),
    ),
    "language": (Domain("language", values=("ur", "en", "ar")),),
}


def domain_check(df: DataFrame, rules: Sequence[Domain]) -> DataFrame:
    """Rows with ``reason``: the offending columns joined by ``;``, empty when the row is valid."""
    marks = [F.when(r.violated(), F.lit(r.column)) for r in rules]
    return df.withColumn("reason", F.concat_ws(";", *marks))


def quality_gate(df: DataFrame, min_q: int | Column = 20, min_a: int | Column = 50, distinct: bool | Column = True) -> DataFrame:
    """Rows with ``reason`` NULL when question and answer are good enough."""
    must_differ = F.lit(distinct) if isinstance(distinct, bool) else distinct

    def reason(p: Column) -> Column:
        q, a = p["q"], p["a"]
        return (
            F.when((q == "") | (a == ""), F.lit("empty"))
            .when(F.length(q) < min_q, F.lit("question too short"))
            .when(F.length(a) < min_a, F.lit("answer too short"))
            .when(must_differ & (q == a), F.lit("question equals answer"))
        )

    # Bound once: a filter on the reason is pushed below the projections and would repeat their work per mention.
    pair = F.struct(F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    return df.withColumn("reason", let(pair, reason))


def noise_condition(source: str, markers: Sequence[str]) -> Column:
    # NULL sources and questions are no noise; they must survive the deletion.
    return F.coalesce((F.col("source") == source) & contains_any(F.col("question"), markers), F.lit(False))


def noise_rows(df: DataFrame, source: str, markers: Sequence[str]) -> DataFrame:
    return df.filter(noise_condition(source, markers))


def noise_delete(df: DataFrame, source: str, markers: Sequence[str]) -> DataFrame:
    return df.filter(~noise_condition(source, markers))


def noise_report(df: DataFrame, source: str, markers: Sequence[str], delete: bool = True) -> DataFrame:
    """One row: matched, deleted and remaining rows of the source."""
    matched = F.count_if(noise_condition(source, markers))
    of_source = F.count_if(F.col("source") == source)
    return df.agg(
        matched.alias("matched"),
        (matched if delete else F.lit(0).cast("long")).alias("deleted"),
        (of_source - matched if delete else of_source).alias("remaining"),
    )


def conform_schema(df: DataFrame, target: dict[str, tuple[str, object]]) -> DataFrame:
    """Add the columns of ``target`` (name -> type, default) that are missing; existing ones stay as they are."""
    have = set(df.columns)
    added = {n: F.lit(default).cast(dtype) for n, (dtype, default) in target.items() if n not in have}
    return df.withColumns(added) if added else df


def verify_schema(tables: dict[str, DataFrame], expected: dict[str, Sequence[str]]) -> DataFrame:
    """Missing tables and columns. Reads schemas only, no data."""
    spark = next(iter(tables.values())).sparkSession
    want = [(t, c) for t, cols in expected.items() for c in (None, *cols)]
    have = [(t, c) for t, df in tables.items() for c in (None, *df.columns)]
    schema = "table_name string, column_name string"
    left, right = spark.createDataFrame(want, schema), spark.createDataFrame(have, schema)
    gone = left.join(
        right, (left.table_name == right.table_name) & left.column_name.eqNullSafe(right.column_name), "left_anti"
    )
    lost = gone.filter(F.col("column_name").isNull()).select("table_name")
    # A missing table is one problem, not one per column.
    return gone.filter(F.col("column_name").isNull()).unionByName(
        gone.filter(F.col("column_name").isNotNull()).join(lost, "table_name", "left_anti")
    )
