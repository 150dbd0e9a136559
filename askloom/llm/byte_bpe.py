"""Byte-level BPE over the ranks of a tiktoken file: exact encoding and decoding, in Arrow batches.

A text is cut by the tokenizer's pattern; every match is encoded on its own. A match that is a vocabulary entry is that
token. Any other is merged by a segment tree over its byte positions: leaf p holds the rank of the pair that starts at p,
an inner node the least value below it, ties to the left, so the root names the leftmost pair of least rank. A merge
rewrites three leaves (the merged pair, its live neighbour on the left, and the consumed position) and their ancestors,
which costs a logarithm of the match's length. Short matches go through the tree many at a time (``merge_many``), long ones alone
(``merge_one``); both make the same merges. A bounded table of the vocabulary keeps what short matches gave before.

NULL and empty texts have no tokens, and decode to empty bytes. Every byte sequence that ``ids`` name decodes exactly.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.words import slices

NONE = np.iinfo(np.int64).max
LEAF_NONE = np.iinfo(np.int32).max
TREE_WIDTH = 64  # longest match, in bytes, that is merged together with others
KEPT_MATCHES = 300_000
GROUP_BYTES = 1 << 20
LONGEST_KEPT = 48


def vocabulary(content: bytes) -> dict[bytes, int]:
    """Ranks of the tokens of a tiktoken file."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)}


class Ranks:
    """Vocabulary of a tiktoken file, with the rank of every pair of tokens that is a token together."""

    def __init__(self, content: bytes):
        self.rank = vocabulary(content)
        # Encoded ids of matches met before, as little-endian bytes. A match's ids don't depend on the pattern that found it.
        self.known: dict[str, bytes] = {}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pair: dict[int, int] = {}
        for token, r in self.rank.items():
            for k in range(1, len(token)):
                left, right = self.rank.get(token[:k]), self.rank.get(token[k:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = r
        self._table()

    def _table(self) -> None:
        """Open addressing over the pairs, for lookups of many pairs at once."""
        self.bits = max(4, (2 * len(self.pair)).bit_length())
        keys = np.fromiter(self.pair.keys(), np.int64, len(self.pair))
        values = np.fromiter(self.pair.values(), np.int64, len(self.pair))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where the pair is no token."""
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out


@lru_cache(maxsize=2)
def load(content: bytes) -> Ranks:
    return Ranks(content)


@lru_cache(maxsize=2)
def tokens(content: bytes) -> dict[int, bytes]:
    return {r: t for t, r in vocabulary(content).items()}


def merge_many(matches: list[bytes], width: int, ranks: Ranks) -> list[np.ndarray]:
    """Ids of matches of 2 to ``width`` bytes, a power of two: one tree per match, all advanced one merge at a time.

    Tables are flat, one run of cells per match; position ``width`` stands for the end on either side.
    """
    n, cells = len(matches), width + 1
    lengths = np.fromiter(map(len, matches), np.int32, n)
    inside = np.arange(width, dtype=np.int32) < lengths[:, None]
    held = np.zeros((n, width), np.uint8)
    held[inside] = np.frombuffer(b"".join(matches), np.uint8)
    ids = np.full((n, cells), -1, np.int64)
    ids[:, :width] = np.where(inside, ranks.byte[held], -1)
    after = np.full((n, cells), width, np.int32)
    after[:, : width - 1] = np.where(inside[:, 1:], np.arange(1, width, dtype=np.int32), width)
    before = np.full((n, cells), width, np.int32)
    before[:, 1:width] = np.arange(width - 1, dtype=np.int32)
    tree = np.full((n, 2 * width), LEAF_NONE, np.int32)

    def value(left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Leaf of the pair: rank, then position."""
        rank = ranks.of_pairs(left, right)  # a pair with an id of -1 is in no vocabulary
        return np.where(rank < NONE, rank * width + position, LEAF_NONE)

    rows, places = np.nonzero(inside[:, 1:])
    tree[rows, width + places] = value(ids[rows, places], ids[rows, places + 1], places)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
    live = np.flatnonzero(tree[1 :: 2 * width] < LEAF_NONE)
    while len(live):
        at, top = live * cells, live * (2 * width)
        rank, p = np.divmod(tree[top + 1], width)
        gone = after[at + p]
        right, left = after[at + gone], before[at + p]
        ids[at + p], ids[at + gone] = rank, -1
        after[at + p], before[at + right] = right, p
        tree[top + width + gone] = LEAF_NONE
        tree[top + width + p] = value(rank.astype(np.int64), ids[at + right], p)
        has = np.flatnonzero(left < width)
        tree[top[has] + width + left[has]] = value(ids[at[has] + left[has]], rank[has].astype(np.int64), left[has])
        up = [width + gone, width + p, width + np.where(left < width, left, p)]
        for _ in range(width.bit_length() - 1):
            up = [u >> 1 for u in up]
            for u in up:
                below = top + 2 * u
                tree[top + u] = np.minimum(tree[below], tree[below + 1])
        live = live[tree[top + 1] < LEAF_NONE]
    ids = ids.reshape(n, cells)[:, :width]
    kept = ids >= 0
    return np.split(ids[kept], np.cumsum(kept.sum(1))[:-1])


def merge_one(match: bytes, ranks: Ranks) -> list[int]:
    """Ids of one match of any length, by one tree."""
    n = len(match)
    width = 1 << max(1, (n - 1).bit_length())
    ids, pair = [int(ranks.byte[b]) for b in match], ranks.pair
    after, before = list(range(1, n + 1)), list(range(-1, n))
    none = (NONE, 0)
    tree = [none] * (2 * width)
    for p in range(n - 1):
        tree[width + p] = (pair.get(ids[p] << 32 | ids[p + 1], NONE), p)
    for u in range(width - 1, 0, -1):
        tree[u] = min(tree[2 * u], tree[2 * u + 1])

    def put(p: int, leaf: tuple[int, int]) -> None:
        u = width + p
        tree[u] = leaf
        while u > 1:
            u >>= 1
            least = min(tree[2 * u], tree[2 * u + 1])
            if tree[u] == least:
                break
            tree[u] = least

    while tree[1][0] < NONE:
        rank, p = tree[1]
        gone = after[p]
        right, left = after[gone], before[p]
        ids[p], ids[gone] = rank, -1
        after[p], before[right] = right, p
        put(gone, none)
        put(p, (pair.get(rank << 32 | ids[right], NONE), p) if right < n else none)
        if left >= 0:
            put(left, (pair.get(ids[left] << 32 | rank, NONE), left))
    return [i for i in ids if i >= 0]


def encode_matches(matches: list[str], ranks: Ranks) -> dict[str, bytes]:
    """Ids of distinct matches, as little-endian unsigned 32-bit integers."""
    out, by_width = {}, {}
    for m in matches:
        raw = m.encode()
        whole = ranks.rank.get(raw)
        if whole is not None:
            out[m] = whole.to_bytes(4, "little")
        elif len(raw) <= TREE_WIDTH:
            by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((m, raw))
        else:
            out[m] = np.array(merge_one(raw, ranks), "<u4").tobytes()
    for width, group in by_width.items():
        for k in range(0, len(group), 8192):
            part = group[k : k + 8192]
            for (m, _), ids in zip(part, merge_many([raw for _, raw in part], width, ranks), strict=True):
                out[m] = ids.astype("<u4").tobytes()
    return out


def encode_texts(texts: list[str], ranks: Ranks, pattern: str, group_bytes: int = GROUP_BYTES) -> Iterator[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit integers."""
    import regex

    find, known = regex.compile(pattern).findall, ranks.known
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= group_bytes):
            size += len(texts[end])
            end += 1
        found = [find(t) for t in texts[begin:end]]
        new = set().union(*found) - known.keys()
        if len(known) + len(new) > KEPT_MATCHES:
            known.clear()
            new = set().union(*found)
        known.update(encode_matches(list(new), ranks))
        for matches in found:
            yield b"".join(map(known.__getitem__, matches))
        for m in new:
            if len(m) > LONGEST_KEPT:
                del known[m]
        begin = end


def encode(docs: DataFrame, content: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, n_tokens and ids (BINARY, little-endian unsigned 32-bit integers) of every text.

    ``content`` is the content of a tiktoken file, ``pattern`` cuts a text. Repeated rows are encoded each.
    """
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, most=GROUP_BYTES)):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = list(encode_texts(texts, load(content), pattern))
            yield pa.record_batch([part.column("id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_column)


def decoded_bytes(ids: bytes, token: dict[int, bytes]) -> bytes:
    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def round_trip(docs: DataFrame, content: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What ``encode`` and ``decode`` give one after the other, in one pass of one worker."""
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, token = load(content), tokens(content)
        for part in (p for batch in batches for p in slices(batch, most=GROUP_BYTES)):
            ids = list(encode_texts([t or "" for t in part.column("text").to_pylist()], ranks, pattern))
            decoded = [decoded_bytes(i, token) for i in ids]
            columns = [part.column("id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
            yield pa.record_batch(columns, ["id", "n_tokens", "ids", "decoded"])
            del ids, decoded, columns
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, content: bytes) -> DataFrame:
    """The given columns and decoded (BINARY): the bytes that ``ids`` stand for. NULL ids decode to NULL."""
    kind = f"{encoded.schema.simpleString()[7:-1]},decoded:binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens(content)
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            texts = [None if i is None else decoded_bytes(i, token) for i in raw]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, kind)


def digests(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and sha-256 of the ids and of the decoded bytes, of every text."""
    both = round_trip(docs, content, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
