"""N-gram Jaccard join: linked documents and their components, exact, by prefix lists and set relations.

A document's set holds its distinct shingles of ``size`` consecutive lower-cased words. Documents of equal sets form one class, found by a 128-bit
signature of the set; only one document of each class goes on. Shingles have one global order: rarer ones first, by counts of
all documents in 2**22 hash buckets (any order is right, this one keeps common passages out of the lists). Two sets with
Jaccard similarity of at least t share a shingle among the first n - ceil(t n) + 1 of each, so lists of these prefixes hold all links.

Set-relation skipping works at two levels, both from answers for one set that serve the sets related to it.

1. Each list is answered first for its leader only, the set with the most common prefix: members are compared with the leader, which costs
   one comparison a member. Members found linked to a common set take over its component.
2. What is left is derived from those answers: within a list, members of one component need no comparison with each other.
   Lists are cut into blocks of one component by size and by position, and each block carries the range of its sizes and the furthest
   reach of its positions. Pairs of blocks of one component, or out of each other's sizes, or whose positions leave too few shingles behind, are skipped whole; only
   members of the pairs left are compared. A link between two components is never skipped, so components are exact.

So a group of near copies, however large, costs its size and not its square. Comparisons are exact on 64-bit shingle hashes.

Defined cases: NULL or empty texts have an empty set and link with nothing; a text with fewer than ``size`` words has one
shingle of all its words; a NULL id takes no part and has a NULL component; rows that share an id are one document, linked by any of its
texts. Extra columns are ignored. Nothing is capped; lists of any length are joined by tables that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm import words
from askloom.llm.components import connected_components
from askloom.llm.tables import fresh, staged

BUCKET_BITS = 22
CHUNK = 1 << 16
SLICE = 2 << 20
BAND = 0.02
BROADCAST_ROWS = 400_000  # of two longs, about 20 MB


def shingles(w: words.Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    n = max(len(w.hashes) - size + 1, 0)
    runs = np.zeros(n, np.uint64)
    for k in range(size):
        runs = words.mix(runs * np.uint64(31) + w.hashes[k : k + n])
    out = []
    for begin, end in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        if end - begin >= size:
            out.append(np.unique(runs[begin : end - size + 1]))
        elif end > begin:
            whole = np.zeros(1, np.uint64)
            for h in w.hashes[begin:end]:
                whole = words.mix(whole * np.uint64(31) + h)
            out.append(words.mix(whole + np.uint64(end - begin)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's hashes, independent of their order."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(flat ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def describe(docs: DataFrame, size: int) -> DataFrame:
    """Per document id, n, s1, s2; and per task its shingle counts by bucket, in chunks (chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        names = ["id", "n", "s1", "s2", "chunk", "counts"]
        for part in (p for b in batches for p in words.slices(b, most=SLICE)):
            sets = shingles(words.batch_words(part), size)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            buckets, held = np.unique(flat >> np.uint64(64 - BUCKET_BITS), return_counts=True)
            counts[buckets.astype(np.int64)] += held.astype(np.uint32)
            s1, s2 = _signature(sets)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.record_batch([part.column("id"), n, pa.array(s1), pa.array(s2), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if counts.any():
            held = np.minimum(counts, 255).astype(np.uint8).reshape(-1, CHUNK)
            null = pa.nulls(len(held), pa.int64())
            yield pa.record_batch([null, null, null, null, pa.array(range(len(held)), pa.int32()), pa.array([c.tobytes() for c in held], pa.binary())], names)

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, chunk int, counts binary")


def _summed(chunks: DataFrame) -> DataFrame:
    """Sums of the chunks' counts in each partition; at most one row a chunk and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                raw = c.as_buffer()
                held = np.frombuffer(raw, np.uint8 if raw.size == CHUNK else np.uint64)
                total[k] = held + (total[k] if k in total else np.zeros(CHUNK, np.uint64))
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["chunk", "counts"])

    return chunks.mapInArrow(run, "chunk int, counts binary")


def bucket_levels(chunks: DataFrame) -> np.ndarray:
    """Logarithmic level (quarters of an octave) of the number of documents by bucket: a table of 4 MB, summed in two steps.

    A task counts up to 255 in a bucket, which is common enough already.
    """
    parts = _summed(chunks.repartition(16, "chunk", F.pmod(F.xxhash64("counts"), F.lit(8))))
    out = np.zeros(((1 << BUCKET_BITS) // CHUNK, CHUNK), np.uint8)
    for r in _summed(parts.repartition(8, "chunk")).toLocalIterator():
        out[r["chunk"]] = np.minimum(4 * np.log2(np.frombuffer(r["counts"], np.uint64).astype(float) + 1), 255)
    return out.ravel()


def prefix_lists(docs: DataFrame, size: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """h, node, at, common: the shingles of each document's prefix.

    ``at`` holds the set's size (upper 32 bits) and the shingle's position; ``common`` is the mean level of the prefix, highest
    for the documents in the middle of a group of near copies, which have the fewest shingles of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in words.slices(b, most=SLICE)):
            sets = shingles(words.batch_words(part), size)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            h, node, at, common = [], [], [], []
            for i, s in enumerate(sets):
                n = len(s)
                if n:
                    p = n - -(-num * n // den) + 1
                    level = levels[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    # s is sorted, so a stable sort by level breaks ties by hash: the same order everywhere.
                    order = np.argsort(level, kind="stable")[:p]
                    h.append(s[order])
                    common.append(np.full(p, level[order].mean(), np.int16))
                    node.append(np.full(p, ids[i], np.int64))
                    at.append((n << 32) + np.arange(p, dtype=np.int64))
            if h:
                yield pa.record_batch([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(at)), pa.array(np.concatenate(common))], ["h", "node", "at", "common"])

    return docs.mapInArrow(run, "h long, node long, at long, common short")


def _semi(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (a written table): broadcast up to a counted size, a shuffle join beyond it."""
    ids = ids.select(F.col("node").alias("wanted"))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, F.col("id") == F.col("wanted"), "left_semi")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in words.slices(b, most=SLICE)):
            sets = shingles(words.batch_words(part), size)
            yield pa.record_batch([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "held"])

    return docs.mapInArrow(run, "node long, held binary")


def _compared(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of the pairs whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def compare(docs: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The linked ones of the written pairs (a, b), written. Texts of the nodes in pairs are read again, others stay unread past their id."""
    nodes = staged(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "compared-nodes")
    held = staged(_sets(_semi(docs, nodes), size), "compared-sets")
    with_b = pairs.join(held.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    with_both = with_b.join(held.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
    return staged(_compared(with_both, num, den).distinct(), "links")


def _n(at: Column) -> Column:
    return F.shiftright(at, 32)


def _left(at: Column) -> Column:
    """Shingles from this position to the end of the set."""
    return _n(at) - at.bitwiseAND(0xFFFFFFFF)


def _band(x: Column) -> Column:
    return F.floor(F.log(x.cast("double")) / BAND).cast("int")


def _fit(n1: Column, n2: Column, left1: Column, left2: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can be linked when their first common shingle leaves so many behind."""
    sizes = (n1 * den >= n2 * num) & (n2 * den >= n1 * num)
    return sizes & (F.least(left1, left2) * (num + den) >= (n1 + n2) * num)


def links(docs: DataFrame, nodes: DataFrame, size: int, num: int, den: int, levels: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Links that suffice for the components of ``docs`` (id, text), and the components of nodes that have links.

    ``nodes`` names the ids that are not to be looked at, as they are copies of others.
    """
    lists = staged(prefix_lists(_drop(docs, nodes, F.col("id")), size, num, den, levels), "prefix-lists")
    leader = F.min(F.struct(-F.col("common"), F.col("at"), F.col("node"))).alias("leader")
    leaders = lists.groupBy("h").agg(leader, F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    leaders = staged(leaders.select(F.col("h").alias("lh"), F.col("leader.at").alias("leader_at"), F.col("leader.node").alias("leader")), "leaders")
    shared = staged(lists.join(leaders, F.col("h") == F.col("lh")).drop("lh", "common"), "shared-lists")
    near = _fit(_n(F.col("at")), _n(F.col("leader_at")), _left(F.col("at")), _left(F.col("leader_at")), num, den)
    first = shared.where((F.col("node") != F.col("leader")) & near)
    first = staged(first.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    found = compare(docs, first, size, num, den)
    labels = staged(connected_components(found, "a", "b"), "labels")

    # Blocks: one component of a list, sizes and reaches within BAND of each other. The band only groups; sizes and reaches decide.
    labelled = shared.join(labels, "node", "left").select("h", "node", "at", F.coalesce("label", "node").alias("label"))
    labelled = labelled.withColumn("band", _band(_n(F.col("at"))) * 100_000 + _band(_left(F.col("at"))))
    labelled = staged(labelled, "labelled-lists")
    mixed = labelled.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
    reach = [F.min(_n(F.col("at"))).alias("n_low"), F.max(_n(F.col("at"))).alias("n_high"), F.max(_left(F.col("at"))).alias("left")]
    blocks = staged(labelled.join(mixed, "h").groupBy("h", "label", "band").agg(*reach), "blocks")
    one, two = blocks.alias("one"), blocks.alias("two")
    possible = (
        (F.col("one.h") == F.col("two.h"))
        & (F.col("one.label") < F.col("two.label"))
        & (F.col("one.n_high") * den >= F.col("two.n_low") * num)
        & (F.col("two.n_high") * den >= F.col("one.n_low") * num)
        & (F.least("one.left", "two.left") * (num + den) >= (F.col("one.n_low") + F.col("two.n_low")) * num)
    )
    met = one.join(two, possible).select(
        F.col("one.h").alias("h"), F.col("one.label").alias("l1"), F.col("one.band").alias("b1"), F.col("two.label").alias("l2"), F.col("two.band").alias("b2")
    )
    left = labelled.select("h", F.col("label").alias("l1"), F.col("band").alias("b1"), F.col("node").alias("a"), F.col("at").alias("at1"))
    right = labelled.select("h", F.col("label").alias("l2"), F.col("band").alias("b2"), F.col("node").alias("b"), F.col("at").alias("at2"))
    rest = met.join(left, ["h", "l1", "b1"]).join(right, ["h", "l2", "b2"])
    rest = rest.where(_fit(_n(F.col("at1")), _n(F.col("at2")), _left(F.col("at1")), _left(F.col("at2")), num, den))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    seen = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = staged(rest.join(seen, ["a", "b"], "left_anti"), "pairs")
    return found.unionByName(compare(docs, rest, size, num, den)), labels


def join(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, n_shingles, component_id, n_copies of every row of ``docs``.

    Two documents link when den * |intersection| >= num * |union|. component_id is the least id reachable by links;
    n_copies counts the rows that have the same set.
    """
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    described = staged(describe(texts, size), "sets")
    sets = described.where("n IS NOT NULL").select("id", "n", "s1", "s2")
    levels = bucket_levels(described.where("counts IS NOT NULL").select("chunk", "counts"))
    classes = sets.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("node"), F.count("*").alias("n_copies"))
    classes = staged(classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "node", "n_copies"), "classes")
    of_class = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") > 0) & F.col("id").isNotNull()
    member = staged(sets.join(classes, of_class, "left").select("id", "n", "node", "n_copies"), "members")
    # An id with several texts belongs to several classes, all of which it links.
    least = member.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a < high").select(F.col("id").alias("of"), "a")
    several = member.join(least, F.col("id") == F.col("of")).where("node > a").select("a", F.col("node").alias("b")).distinct()
    copies = staged(member.where("id <> node").select(F.col("id").alias("node")).join(classes.select("node"), "node", "left_anti").distinct(), "copies")
    usable = texts.where("id IS NOT NULL")
    found, _ = links(usable, copies, size, num, den, levels)
    final = staged(connected_components(found.unionByName(several), "a", "b"), "components").withColumnRenamed("node", "l_node")
    out = member.join(final, F.col("node") == F.col("l_node"), "left")
    return out.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.coalesce("label", "node", "id").alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_per_group(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the least id of each component.

    Rows with empty sets or NULL ids stay. Of rows that share a kept id and have words, the one whose text has the least hash stays.
    """
    joined = staged(join(docs.select(id_column, text_column), size, num, den, id_column, text_column), "groups")
    ids = F.col(f"`{id_column}`")
    worded = joined.where(ids.isNotNull() & (F.col("n_shingles") > 0))
    gone = staged(worded.where(ids != F.col("component_id")).select(ids.alias("node")).distinct(), "dropped")
    kept = _drop(docs, gone, ids)
    same = fresh(docs, "same")
    repeated = staged(worded.groupBy(ids.alias(same)).count().where("count > 1").select(same), "repeated")
    if not repeated.take(1):
        return kept
    text = F.col(f"`{text_column}`")
    has_words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "") != ""
    several = kept.join(repeated, ids == F.col(same), "left_semi")
    first = several.where(has_words).groupBy(ids.alias(same)).agg(F.min_by(F.struct("*"), F.xxhash64(text)).alias("kept"))
    return kept.join(repeated, ids == F.col(same), "left_anti").unionByName(several.where(~has_words)).unionByName(first.select("kept.*"))


def _drop(docs: DataFrame, ids: DataFrame, id_column: Column) -> DataFrame:
    """Rows of ``docs`` whose id is not in the written ``ids``: a broadcast up to a counted size, a shuffle join beyond it."""
    unwanted = fresh(docs, "unwanted")
    ids = ids.select(F.col("node").alias(unwanted))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, id_column == F.col(unwanted), "left_anti")


# Documents linked at 85 hundredths on four-word shingles.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(words) - 3) + 1),
         lambda i: array_to_string(list_slice(words, i, i + 3), ' '))) END AS shingles
  FROM w
),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id
"""
