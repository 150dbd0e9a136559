"""Alignment of two tokenizers over a corpus, and how many documents hold each linked pair of tokens, by external spill counting.

Side A is a byte-level BPE (a ``tokenizers`` file) over a blank and the text, side B a merge-type sentencepiece model over the text, which
adds that blank itself. Tokens of both sides cover the same bytes; offsets where both have a token end cut them into groups, and
an A and a B token that share a byte are linked.

Libraries encode whole texts. The rest of a block of documents is array work: token ends of both sides are offsets into the
block's bytes; every end of either side closes one overlap, so the merged ends are the links in order, and those that both sides
have close the groups.

Counting. A block of documents is a run:

1. its (pair, document, times) records are radix-partitioned by the A id, sorted by (A id, B id, document) and written as zstd columns, one
   row a (run, radix): keys as differences, documents a key, documents, times. This table is all that leaves the encoding tasks.
2. keys and documents a key of a radix are merged ``FAN_IN`` runs at a time by a heap, level by level until one run is left. Keys
   come out A id first, so the last merge also knows each A id's highest count when it leaves that id.
3. the merged counts of a radix meet its runs again, ``RUNS_A_TASK`` at a time; each run adds up for every document what its links
   contribute, and the contributions of a run's radixes are added up beside the documents' own figures.

No task holds more than ``FAN_IN`` or ``RUNS_A_TASK`` rows of one radix, whatever share of the corpus one token has. A radix's counts are
bounded by the pairs that occur, not by the corpus. All tables lie in the shared checkpoint folder.

Rows count as documents each, repeated rows and ids too. NULL and empty texts, and texts that one side does not give back byte for
byte (a U+2581 becomes a blank), have no tokens: zeros and an empty groups column; they count for no pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.tables import staged

MARK = "▁"
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 20_000
RADIXES = 32
FAN_IN = 64
RUNS_A_TASK = 256
ENCODED_AT_ONCE = 1 << 18


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers, the bytes of their tokens, and their ids as text with what may follow them in a group."""

    def __init__(self, a_content: bytes, b_content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_content.decode()), SentencePieceProcessor(model_proto=b_content)
        self.a.encode_special_tokens = True
        of, vocabulary = byte_of_character(), json.loads(a_content)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, k in vocabulary.items():
            if set(t) <= of.keys():
                self.a_bytes[k] = bytes(map(of.__getitem__, t))
        names = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(names)]
        self.quick = self._quick(json.loads(a_content), of)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.written = [f"{k}{c}" for k in range(len(self.a_bytes)) for c in ",|"] + [f"{k}{c}" for k in range(len(self.b_bytes)) for c in ",;"]

    def _quick(self, spec: dict, of: dict[str, int]):
        """A quicker encoder of the same tokens for texts below U+0250, or None.

        It merges neighbours by the id of their joint text, side A by its list of pairs. Both make the same merges if ids follow the list and every
        token alone is merged to itself: two neighbours that the list lacks, though their joint text is a token, would
        be a stage of that token's own merging, which then could not end in the token.
        """
        import tiktoken
        from public_tokenizers import PATTERN

        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        tokens = [*of, *("".join(m) for m in pairs)]
        ids = [spec["model"]["vocab"].get(t, -1) for t in tokens]
        before = spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not plain or min(ids) < 0 or ids[256:] != sorted(set(ids[256:])) or any([x.id for x in self.a.model.tokenize(t)] != [k] for t, k in zip(tokens, ids, strict=True)):
            return None
        ranks = {bytes(map(of.__getitem__, t)): k for t, k in zip(tokens, ids, strict=True)}
        return tiktoken.Encoding("side A", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        """A's ids of a blank and each text."""
        quick = [self.quick is not None and max(t, default="") < "\u0250" for t in texts]
        rest = iter(self.a.encode_batch([" " + t for t, q in zip(texts, quick, strict=True) if not q], add_special_tokens=False))
        return [self.quick(" " + t) if q else next(rest).ids for t, q in zip(texts, quick, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides; none for texts that are empty or that a side does not give back."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= ENCODED_AT_ONCE):
                size += len(texts[end])
                end += 1
            part = texts[begin:end]
            for text, a, b in zip(part, self.a_ids(part), self.b.encode(part, num_threads=1), strict=True):
                raw = (" " + text).encode()
                same = text and b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
                yield (a, b) if same else ([], [])
            begin = end


@lru_cache(maxsize=2)
def load(a_content: bytes, b_content: bytes) -> Sides:
    return Sides(a_content, b_content)


def packed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.astype(kind).tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return packed(np.diff(keys, prepend=0), "<u8")


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "<u8").astype(np.int64))


FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUN = "run long, radix int, n_docs int, keys binary, spans binary, docs binary, times binary"


def block_rows(texts: list[str], sides: Sides, run: int, keep_groups: bool) -> tuple[list[dict], list[dict]]:
    """Figures of a block's documents, and its run: one row for each radix."""
    n_a, n_b, a, b = [], [], [], []
    for a_ids, b_ids in sides.encode(texts):
        n_a.append(len(a_ids))
        n_b.append(len(b_ids))
        a.append(np.array(a_ids, np.int32))
        b.append(np.array(b_ids, np.int32))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    a_end, b_end = np.cumsum(sides.a_size[a]), np.cumsum(sides.b_size[b])
    ends = np.concatenate([a_end, b_end])
    ends.sort(kind="stable")  # two ascending runs
    ends = ends[np.diff(ends, prepend=0) > 0]
    at_a, at_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
    closes_a, closes_b = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    closes_a[at_a] = closes_b[at_b] = 1
    both = closes_a & closes_b
    # Of every link: its A token, its B token, its group.
    of_a, of_b, group = (np.cumsum(x) - x for x in (closes_a, closes_b, both))
    doc = np.repeat(np.arange(len(texts)), n_a)[of_a]
    n_groups, n_links = (np.bincount(d, minlength=len(texts)).tolist() for d in (doc[both > 0], doc))

    # Tokens of A and B as text in the order of the groups: all of A, then all of B of a group.
    shared = np.flatnonzero(both)
    a_before, b_before = (np.concatenate([[0], np.cumsum(x)[shared]]) for x in (closes_a, closes_b))
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + b_before[group[at_a]]] = 2 * a + both[at_a]
    code[np.arange(len(b)) + a_before[group[at_b] + 1]] = 2 * (len(sides.a_bytes) + b) + both[at_b]
    figures, begin = [], 0
    for k in range(len(texts)):
        end = begin + n_a[k] + n_b[k]
        groups = "".join(map(sides.written.__getitem__, code[begin:end].tolist()))[:-1]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        row = {"n_a": n_a[k], "n_b": n_b[k], "n_groups": n_groups[k], "n_links": n_links[k], "groups_sha256": digest}
        figures.append(row | ({"groups": groups} if keep_groups else {}))
        begin = end

    # Every (radix, A id, B id, document) as one number, which is below 2 ** 63 for vocabularies under a million.
    n_docs, b_ids = len(texts), len(sides.b_bytes)
    unit = a[of_a]
    records = ((unit % RADIXES * len(sides.a_bytes) + unit) * b_ids + b[of_b]) * n_docs + doc
    records.sort()
    first = np.flatnonzero(np.diff(records, prepend=-1))
    times = np.diff(first, append=len(records))
    pairs, doc = np.divmod(records[first], n_docs)
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    spans = np.diff(first, append=len(pairs))
    sided, b_id = np.divmod(pairs[first], b_ids)
    radix, a_id = np.divmod(sided, len(sides.a_bytes))
    pair = a_id << 32 | b_id
    out, edges, begin = [], np.searchsorted(radix, np.arange(RADIXES + 1)), np.concatenate([[0], np.cumsum(spans)])
    for r in range(RADIXES):
        lo, hi = edges[r], edges[r + 1]
        if lo < hi:
            a, b = begin[lo], begin[hi]
            columns = {"keys": packed_keys(pair[lo:hi]), "spans": packed(spans[lo:hi], "<u4"), "docs": packed(doc[a:b], "<u2"), "times": packed(times[a:b], "<u4")}
            out.append({"run": run, "radix": r, "n_docs": n_docs} | columns)
    return figures, out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in blocks of about ``BLOCK_BYTES``, ``BLOCK_ROWS`` rows at most; a longer text is a block of its own."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, value in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            text = value.as_py() or ""
            if texts and (size + len(text) > BLOCK_BYTES or len(texts) == BLOCK_ROWS):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


def runs(docs: DataFrame, a_content: bytes, b_content: bytes, id_column: str = "doc_id", text_column: str = "text", keep_groups: bool = False) -> DataFrame:
    """The runs' rows, and a row with radix -1 for each run that holds its documents' figures."""
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    figures = f"id {source.schema['id'].dataType.simpleString()}, {FIGURES}" + ", groups string" * keep_groups
    schema = f"{RUN}, figures array<struct<{', '.join(':'.join(f.split(' ')) for f in figures.split(', '))}>>"
    arrow = source.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, part = load(a_content, b_content), TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(blocks(batches)):
            number = part << 32 | k
            figures, rows = block_rows(texts, sides, number, keep_groups)
            own = [{"id": i} | f for i, f in zip(ids, figures, strict=True)]
            yield pa.RecordBatch.from_pylist([*rows, {"run": number, "radix": -1, "n_docs": len(texts), "figures": own}], arrow)
            del figures, rows, own
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def merged(streams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int], list[int]]:
    """Keys of sorted runs in order, the sum of each one's counts, and the highest sum of the key's A id."""
    keys, counts, best = [], [], []
    records = heapq.merge(*(zip(k.tolist(), c.tolist(), strict=True) for k, c in streams))
    for _, side in groupby(records, lambda r: r[0] >> 32):
        begin = len(keys)
        last = -1
        for key, n in side:
            if key == last:
                counts[-1] += n
            else:
                keys.append(key)
                counts.append(n)
                last = key
        best += [max(counts[begin:])] * (len(keys) - begin)
    return keys, counts, best


def totals(table: DataFrame, n_runs: int) -> DataFrame:
    """radix, keys, counts, best: the documents of every pair of a radix, and the highest count of its A id."""

    def merge(group: pa.Table) -> pa.Table:
        streams = [(unpacked_keys(k), unpacked(c, "<u8")) for k, c in zip(group["keys"].to_pylist(), group["counts"].to_pylist(), strict=True)]
        keys, counts, best = (np.array(x, np.int64) for x in merged(streams))
        columns = {"radix": group["radix"][:1], "run": group["part"][:1], "keys": [packed_keys(keys)], "counts": [packed(counts, "<u8")], "best": [packed(best, "<u8")]}
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, pa.binary()) for k, v in columns.items()})

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [packed(unpacked(s, "<u4"), "<u8") for s in batch.column("spans").to_pylist()]
            yield pa.record_batch([batch.column("radix"), batch.column("run"), batch.column("keys"), pa.array(counts, pa.binary())], ["radix", "run", "keys", "counts"])

    level = table.where("radix >= 0").select("radix", "run", "keys", "spans").mapInArrow(widen, "radix int, run long, keys binary, counts binary")
    groups = n_runs
    while True:
        groups = -(-groups // FAN_IN)
        part = F.pmod(F.xxhash64("run"), F.lit(max(groups, 1)))
        grouped = level.select("radix", "keys", "counts", part.alias("part")).groupBy("radix", "part")
        level = grouped.applyInArrow(merge, "radix int, run long, keys binary, counts binary, best binary")
        if groups <= 1:
            return level.select("radix", "keys", "counts", "best")
        level = staged(level, "pair-counts")


def contributions(table: DataFrame, counted: DataFrame, n_runs: int) -> DataFrame:
    """run, n_best, count_sum (vectors over the run's documents) of every run and radix."""
    slots = -(-n_runs // RUNS_A_TASK)

    def back(runs: pa.Table, counted: pa.Table) -> pa.Table:
        out = {"run": [], "n_best": [], "count_sum": []}
        if runs.num_rows:
            keys, (count, best) = unpacked_keys(counted["keys"][0].as_py()), (unpacked(counted[c][0].as_py(), "<u8").astype(np.int64) for c in ("counts", "best"))
            for row in (r for batch in runs.to_batches(max_chunksize=16) for r in batch.to_pylist()):
                at = np.repeat(np.searchsorted(keys, unpacked_keys(row["keys"])), unpacked(row["spans"], "<u4"))
                doc, times = unpacked(row["docs"], "<u2"), unpacked(row["times"], "<u4").astype(np.int64)
                sums, highest = np.zeros(row["n_docs"], np.int64), np.zeros(row["n_docs"], np.int64)
                np.add.at(sums, doc, times * count[at])
                np.add.at(highest, doc, times * (count[at] == best[at]))
                for column, value in zip(out.values(), (row["run"], packed(highest, "<u8"), packed(sums, "<u8")), strict=True):
                    column.append(value)
        return pa.table({"run": pa.array(out["run"], pa.int64()), "n_best": pa.array(out["n_best"], pa.binary()), "count_sum": pa.array(out["count_sum"], pa.binary())})

    left = table.where("radix >= 0").select("run", "radix", "n_docs", "keys", "spans", "docs", "times")
    left = left.withColumn("slot", F.pmod(F.xxhash64("run"), F.lit(max(slots, 1))))
    right = counted.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(slots, 1) - 1).cast("long"))))
    both = left.groupBy("radix", "slot").cogroup(right.groupBy("radix", "slot"))
    return both.applyInArrow(back, "run long, n_best binary, count_sum binary")


def align(docs: DataFrame, a_content: bytes, b_content: bytes, id_column: str = "doc_id", text_column: str = "text", keep_groups: bool = False) -> DataFrame:
    """``id_column``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    n_best counts links whose pair lies in as many documents as any pair of its A id, count_sum adds the documents of every link's
    pair. ``keep_groups`` adds groups: the groups as ``a1,a2|b1;a3|b2,b3``.
    """
    table = staged(runs(docs, a_content, b_content, id_column, text_column, keep_groups), "pair-runs")
    per_run = table.where("radix = -1").select("run", "figures")
    n_runs = per_run.count()
    counted = staged(totals(table, n_runs), "pair-totals")
    added = contributions(table, counted, n_runs)

    def total(group: pa.Table) -> pa.Table:
        best, sums = (sum(unpacked(raw, "<u8") for raw in group[c].to_pylist()).astype(np.int64) for c in ("n_best", "count_sum"))
        vectors = [pa.array([v], pa.list_(pa.int64())) for v in (best, sums)]
        return pa.table({"run": group["run"][:1], "n_best": vectors[0], "count_sum": vectors[1]})

    vectors = added.groupBy("run").applyInArrow(total, "run long, n_best array<long>, count_sum array<long>")
    none = F.array().cast("array<long>")  # a run without any link
    added = [F.coalesce(c, none).alias(c) for c in ("n_best", "count_sum")]
    rows = per_run.join(vectors, "run", "left").select("figures", *added).select(F.inline(F.arrays_zip("figures", "n_best", "count_sum")))
    return rows.select(
        F.col("figures.id").alias(id_column),
        *[f"figures.{c}" for c in ("n_a", "n_b", "n_groups", "n_links")],
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")],
        "figures.groups_sha256",
        *["figures.groups"] * keep_groups,
    )


def pair_counts(docs: DataFrame, a_content: bytes, b_content: bytes, text_column: str = "text") -> DataFrame:
    """a_id, b_id, n_documents, best (whether no pair of the A id lies in more documents) of every linked pair."""
    table = staged(runs(docs.withColumn("_none", F.lit(None).cast("long")), a_content, b_content, "_none", text_column), "pair-runs")
    counted = totals(table, table.where("radix = -1").count())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            keys, count, best = unpacked_keys(row["keys"]), *(unpacked(row[c], "<u8").astype(np.int64) for c in ("counts", "best"))
            yield pa.RecordBatch.from_pydict({"a_id": keys >> 32, "b_id": keys & 0xFFFFFFFF, "n_documents": count, "best": count == best})

    return counted.mapInArrow(rows, "a_id long, b_id long, n_documents long, best boolean")
