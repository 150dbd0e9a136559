"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once: the participant's own turns as the assistant's,
all others as named users', with a mask that is 1 on the participant's own content (what a model would be trained on) and 0
elsewhere. Turns of ``shared`` speakers (the system's) stand in every rendering under their own role, and are no participants.

A rendering is a sequence of segments, one row per (conversation, perspective, turn): header, content and end mark, with the
character span of the segment and of its content in the whole rendering. Rows keep a conversation of any length out of a
single value; ``texts`` joins the segments of conversations whose length the caller knows to be bounded. All turns are
range-partitioned by their order and numbered, so a conversation that holds a large part of all rows is spread over many tasks, whatever its
turn numbers (only turns alike in number, role and first 32 characters stay together, in a sort that spills). Offsets are running sums in two
levels: within blocks of at most ``BLOCK`` turns, and over the blocks' totals. They are made once for a conversation, with all speakers as users; a
perspective's own turns before a turn, counted, times the difference of the two headers gives its own. Contents are shuffled twice and meet
the participants last, ``CHUNK`` of these in an array.

Order within a conversation: turn (NULL first), then role, then text. Defined cases: a NULL role is the speaker ``unknown``;
NULL text is an empty content; repeated rows are turns each, in any order (they are alike); a NULL conversation id is one
conversation; a conversation of shared turns only has no rows; an empty table gives no rows. A header is made of the
speaker's name, lower-cased, with runs of characters other than letters, digits, ``_`` and ``-`` as one ``_``, so no name can end a header. Speakers are
told apart by their roles as given: where several of a conversation get the same name, all but the first by role have ``#2``, ``#3`` and so on behind
it. Shared speakers are known by the name. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askloom.llm.tables import staged

BLOCK = 64
CHUNK = 256
FEW_ROWS = 100_000
START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def speaker_name(role: Column) -> Column:
    """A name that is safe in a header."""
    name = F.regexp_replace(F.lower(F.coalesce(role, F.lit("unknown"))), r"[^\p{L}\p{N}_-]+", "_")
    return F.when(name == "", "unknown").otherwise(name)


def _header(role: Column, name: Column | None = None) -> Column:
    named = F.lit("") if name is None else F.coalesce(F.concat(F.lit(" name="), name), F.lit(""))
    return F.concat(F.lit(START), role, named, F.lit(MIDDLE))


def _participants(turns: DataFrame, is_shared: Column) -> DataFrame:
    """key, given, speaker, perspective, nth (of its name), chunk: the participants of every conversation."""
    people = turns.where(~is_shared).select("key", "given", "speaker").distinct()
    people = people.withColumn("nth", F.row_number().over(Window.partitionBy("key", "speaker").orderBy("given")))
    people = people.withColumn("perspective", F.when(F.col("nth") > 1, F.concat("speaker", F.lit("#"), "nth")).otherwise(F.col("speaker")))
    place = F.row_number().over(Window.partitionBy("key").orderBy("perspective"))
    return staged(people.withColumn("chunk", F.floor((place - 1) / CHUNK)), "participants")


def segments(conversations: DataFrame, shared: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, position, role, name, content, segment, start, content_start, content_end, mask."""
    turns = conversations.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("given"),
        speaker_name(F.col("role")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    is_shared = F.col("speaker").isin(*shared)
    people = _participants(turns, is_shared)
    # Only speakers whose name another one has need a new one.
    renamed = people.where("nth > 1").select("key", "given", F.col("perspective").alias("new_name"))
    renamed = F.broadcast(renamed) if renamed.count() <= FEW_ROWS else renamed
    turns = turns.join(renamed, ["key", "given"], "left").withColumn("speaker", F.coalesce("new_name", "speaker"))

    # Order: contents are cut for the ranges, because samples of these go to the driver; beginnings sort as the whole texts do.
    ranged = turns.repartitionByRange("key", "turn", "speaker", F.substring("content", 1, 32))
    ranged = ranged.sortWithinPartitions("key", "turn", "speaker", "content")
    # The numbers depend on the ranges, so they are written once.
    at = F.monotonically_increasing_id()
    turns = staged(ranged.select("conv_id", "key", "speaker", "content", at.alias("at")), "turns").withColumn("block", F.floor(F.col("at") / BLOCK))
    header = F.when(is_shared, _header(F.col("speaker"))).otherwise(_header(F.lit("user"), F.col("speaker")))
    turns = turns.withColumn("size", F.length(header) + F.length("content") + len(END))

    # What precedes each block: sizes and turns of the conversation, and each participant's own turns.
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("key", "block").agg(F.sum("size").alias("sizes"), F.count("*").alias("turns")).select(
        "key",
        "block",
        F.coalesce(F.sum("sizes").over(earlier), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
    )
    own = turns.groupBy("key", "block", F.col("speaker").alias("perspective")).agg(F.count("*").alias("own"))
    own_earlier = Window.partitionBy("key", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    views = blocks.join(people.select("key", "perspective", "chunk"), "key").join(own, ["key", "block", "perspective"], "left")
    views = views.withColumn("own_before", F.coalesce(F.sum("own").over(own_earlier), F.lit(0)))
    views = views.groupBy("key", "block", "chunk", "size_before", "turns_before").agg(F.collect_list(F.struct("perspective", "own_before")).alias("views"))

    # Contents meet the participants last, as arrays, and are multiplied where they lie.
    inside = Window.partitionBy("key", "block").orderBy("at")
    through = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("size_through", F.sum("size").over(through)).withColumn("turns_through", F.row_number().over(inside))
    rows = rows.withColumn("spoken", F.collect_list("speaker").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rendered = rows.join(views, ["key", "block"]).select("*", F.explode("views").alias("view")).select("*", "view.*")
    is_own = F.col("speaker") == F.col("perspective")
    n_own = F.col("own_before") + F.size(F.filter("spoken", lambda s: s == F.col("perspective")))
    shorter = F.length(_header(F.lit("assistant"))) - F.length(_header(F.lit("user"), F.col("perspective")))
    rendered = (
        rendered.withColumn("role", F.when(is_shared, F.col("speaker")).when(is_own, "assistant").otherwise("user"))
        .withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
        .withColumn("header", _header(F.col("role"), F.col("name")))
        .withColumn("start", F.col("size_before") + F.col("size_through") - F.col("size") + n_own * shorter)
    )
    return rendered.select(
        "conv_id",
        "perspective",
        (F.col("turns_before") + F.col("turns_through") - 1).alias("position"),
        "role",
        "name",
        "content",
        F.concat("header", "content", F.lit(END)).alias("segment"),
        "start",
        (F.col("start") + F.length("header")).alias("content_start"),
        (F.col("start") + F.length("header") + F.length("content")).alias("content_end"),
        is_own.cast("int").alias("mask"),
    )


def texts(rendered: DataFrame) -> DataFrame:
    """conv_id, perspective, text and masked spans of each rendering; for conversations of bounded length only."""
    rows = F.array_sort(F.collect_list(F.struct("position", "segment", "content_start", "content_end", "mask")))
    grouped = rendered.groupBy("conv_id", "perspective").agg(rows.alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["mask"] == 1), lambda r: F.struct(r["content_start"].alias("start"), r["content_end"].alias("end")))
    return grouped.select("conv_id", "perspective", F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("text"), spans.alias("spans"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(text, '') AS content,
         CASE WHEN s = '' THEN 'unknown' ELSE s END AS speaker
  FROM (SELECT *, regexp_replace(lower(coalesce(role, 'unknown')), '[^\p{L}\p{N}_-]+', '_', 'g') AS s FROM conversations)
),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.content,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name,
         CAST(speaker = perspective AS INTEGER) AS mask
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
),
h AS (SELECT *, '<|' || role || coalesce(' name=' || name, '') || '|>' || chr(10) AS header FROM r),
z AS (SELECT *, length(header) + length(content) + 8 AS size FROM h),
o AS (
  SELECT *, row_number() OVER w - 1 AS position,
         sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM z WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content)
)
SELECT conv_id, perspective, position, role, name, content, header || content || '<|end|>' || chr(10) AS segment,
       CAST(start AS BIGINT) AS start, CAST(start + length(header) AS BIGINT) AS content_start,
       CAST(start + length(header) + length(content) AS BIGINT) AS content_end, mask
FROM o
"""
