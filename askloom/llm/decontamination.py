"""Benchmark decontamination: SimHash windows of the items' size, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are lower-cased runs of letters, digits and non-ASCII characters, so case and punctuation don't matter; a shingle is five consecutive words (all of an
item's, if it has fewer). A window of a text is as many words as an item has.

Candidates come from SimHash fingerprints of 64 bits over ``WINDOW`` words. A text has one at every position. An item has them at its key shingles: its
heaviest ones, as many as hold more than 1 - ``THRESHOLD`` of its weight together. A window without any of them shares less than ``THRESHOLD`` of
the item's weight, so every window at or above the threshold keeps a key shingle unchanged, with a fingerprint at distance 0: none is
missed, wherever and however often it was edited. Fingerprints within Hamming distance ``RADIUS`` are all found by multi-index
blocks: cut into RADIUS + 1 blocks of bits, two such fingerprints agree in one block at least.

Verification is exact: weighted Jaccard similarity of the shingle multisets of the item and of every item-sized window of the text that
holds a hit; weights are inverse shares of the items that hold the shingle. A match has a similarity of at least ``THRESHOLD``, and
the best window, the first of equal ones, is reported.

The index of items is read by every task only while it has at most ``INDEX_ITEMS`` items; a larger benchmark is cut into
parts of about that many, which pass the driver one at a time, and texts pass once for each part. Weights are over all items, however they
are cut, so the parts don't change results. Texts are never shuffled by matching and long texts are handled whole.

An item with fewer than ``LEAST_WORDS`` words matches only windows with all of its shingles and no others, which are looked up by hash.

Defined cases: NULL or empty texts and items match nothing; an item with a NULL id is an item like others; items of equal words match all alike, and every item of them is reported; repeated rows of a document are reported
each; with no items, nothing is contaminated. Extra columns pass through ``clean_documents`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import words
from askloom.llm.tables import fresh, staged

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 3
WINDOWS = (4, 8, 16, 32, 64, 128)
WINDOW = 4  # words of a fingerprint; at most SHINGLE, so that an unchanged shingle has it whole
LEAST_WORDS = 8
ROUNDING = 1e-9  # sums of weights in different order differ by less
RUN = 1 << 18  # positions fingerprinted at once
INDEX_ITEMS = 5_000
SLICE = 2 << 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def bare(batch: pa.RecordBatch, column: str = "text") -> words.Words:
    """Words of letters, digits and non-ASCII bytes."""
    data, offsets = words.buffers(batch.column(column))
    return words.words_of(np.where(_WORD[data], data, np.uint8(32)), offsets)


def simhash(hashes: np.ndarray, windows: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """Fingerprints of the windows ``hashes[s : s + size]`` for each (starts, size): bit b is set where more than half of the words' hashes have it."""
    # Sums over windows of doubling length; sizes are powers of two below 256, so a byte holds each count.
    sums = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), bitorder="little").reshape(-1, 64)
    wanted = {size: k for k, (_, size) in enumerate(windows)}
    out, length = [np.zeros(0, np.uint64)] * len(windows), 1
    while length <= min(max(wanted, default=0), len(hashes)):
        if length in wanted:
            over = sums[windows[wanted[length]][0]] > length // 2
            out[wanted[length]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
        sums, length = sums[:-length] + sums[length:], 2 * length
    return out


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``size`` words; of all words, if there are fewer."""
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = words.mix(out * np.uint64(31) + hashes[k : k + n])
    return out if size else out[:0]


def weighted_jaccard(a: np.ndarray, b: np.ndarray, weight) -> float:
    """Sum of w * min(count) over sum of w * max(count), over the distinct shingles of both."""
    both, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = np.bincount(index[: len(a)], minlength=len(both)), np.bincount(index[len(a) :], minlength=len(both))
    w = weight(both)
    total = (w * np.maximum(in_a, in_b)).sum()
    return float((w * np.minimum(in_a, in_b)).sum() / total) if total else 0.0


@dataclass
class Index:
    """Items ready for search; built on each worker from the items' ids and word hashes.

    ``shares`` are, for a part of a benchmark, its shingles in order, in how many items of the whole each is, and the number of all items.
    """

    item_ids: list[int]
    items: list[np.ndarray]
    shares: tuple[np.ndarray, np.ndarray, int] | None = None

    def __post_init__(self):
        self.shingles = [shingle_hashes(h) for h in self.items]
        if self.shares is None:
            held = np.concatenate([np.unique(s) for s in self.shingles]) if self.items else np.zeros(0, np.uint64)
            self.known, counts = np.unique(held, return_counts=True)
            self.total = len(self.items)
        else:
            self.known, counts, self.total = self.shares
        self.weights = np.log1p(self.total / counts) if len(counts) else np.zeros(0)
        self.prints, self.owner, self.tables = self._fingerprints()
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in {len(h) for h in self.items} & set(range(1, LEAST_WORDS)):
            members = np.array([k for k, h in enumerate(self.items) if len(h) == m])
            keys = np.concatenate([window_keys(self.items[k], m) for k in members])
            order = np.argsort(keys, kind="stable")
            self.short[m] = keys[order], members[order]

    def _fingerprints(self) -> tuple[np.ndarray, np.ndarray, list]:
        """Fingerprints at the items' key shingles, the items they are of, and the tables of their blocks."""
        prints, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, h in enumerate(self.items):
            if len(h) >= LEAST_WORDS:
                at = key_shingles(self.shingles[k], self.weight)
                prints.append(simhash(h, [(at, WINDOW)])[0])
                owner.append(np.full(len(at), k))
        prints, tables = np.concatenate(prints), []
        for shift, width in bit_blocks():
            key = (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            order = np.argsort(key, kind="stable")
            held = np.zeros(1 << width, bool)
            held[key.astype(np.int64)] = True
            tables.append((key[order], order, held))
        return prints, np.concatenate(owner), tables

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        """Shingles of no item weigh as much as those of one item."""
        if not len(self.known):
            return np.ones(len(shingles))
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weights[at], np.log1p(self.total))


def window_keys(hashes: np.ndarray, m: int) -> np.ndarray:
    """Hash of the multiset of shingles of every run of ``m`` words."""
    shingles = words.mix(shingle_hashes(hashes, min(m, SHINGLE)))
    size = max(m - SHINGLE + 1, 1)
    n = len(hashes) - m + 1
    return sum((shingles[k : k + n] for k in range(size)), np.zeros(n, np.uint64)) if n > 0 else shingles[:0]


def match_short(w: words.Words, index: Index) -> list[tuple[int, int, float, int, int]]:
    """First match of every text and item of fewer than LEAST_WORDS words."""
    out = []
    for m, (keys, members) in index.short.items():
        own = window_keys(w.hashes, m)
        low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
        place = np.flatnonzero(high > low)
        text = np.searchsorted(w.at, place, "right") - 1
        inside = place + m <= w.at[text + 1]
        place, text = place[inside], text[inside]
        _, first = np.unique(np.stack([text, low[place]]), axis=1, return_index=True)
        for p, t in zip(place[first].tolist(), text[first].tolist(), strict=True):
            out += [(t, int(k), 1.0, p - int(w.at[t]), m) for k in members[low[p] : high[p]]]
    return out


def key_shingles(shingles: np.ndarray, weight) -> np.ndarray:
    """First positions of the heaviest distinct shingles that hold more than 1 - THRESHOLD of the item's weight together."""
    known, first, counts = np.unique(shingles, return_index=True, return_counts=True)
    held = weight(known) * counts
    order = np.lexsort((first, -held))
    enough = np.searchsorted(np.cumsum(held[order]), (1 - THRESHOLD + ROUNDING) * held.sum(), "right") + 1
    return first[order[:enough]]


def bit_blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that make up 64 bits."""
    edges = np.linspace(0, 64, radius + 2).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:], strict=False)]


def near_pairs(prints: np.ndarray, index: tuple, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All (text fingerprint, item fingerprint) pairs within ``radius``, as indexes, each once."""
    known, _, _, _, tables = index
    found = []
    for (shift, width), (keys, order, held) in zip(bit_blocks(radius), tables, strict=True):
        key = (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        hit = np.flatnonzero(held[key.astype(np.int64)])
        if len(hit):
            low, high = np.searchsorted(keys, key[hit]), np.searchsorted(keys, key[hit], "right")
            n = high - low
            left = np.repeat(hit, n)
            right = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[left] ^ known[right]) <= radius
            found.append(left[near] * len(known) + right[near])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // max(len(known), 1), both % max(len(known), 1)


def best_window(shingles: np.ndarray, hits: np.ndarray, n_words: int, item: np.ndarray, m: int, weight) -> tuple[float, int]:
    """Similarity and first word of the best window of ``m`` words that holds a hit; ``shingles`` are the text's, ``item`` the item's."""
    size, last = len(item), max(n_words - m, 0)
    known, counts = np.unique(item, return_counts=True)
    known_weight = weight(known)
    best = (0.0, 0)
    for run in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * size) + 1):
        low, high = max(int(run[0]) - size + 1, 0), min(int(run[-1]), last)
        low = min(low, high)
        some = shingles[low : high + size]
        k = np.minimum(np.searchsorted(known, some), len(known) - 1)
        at = np.flatnonzero(known[k] == some)
        k = k[at]
        # A shingle counts in the windows that have it among its first ``counts`` ones.
        order = np.lexsort((at, k))
        group = k[order]
        rank = np.arange(len(order)) - np.searchsorted(group, group)
        begin = np.zeros(len(order), np.int64)
        late = rank >= counts[group]
        begin[late] = at[order][np.flatnonzero(late) - counts[group[late]]] + 1
        begin, end = np.maximum(begin, at[order] - size + 1), at[order] + 1
        n = high - low + 1
        change = np.bincount(np.minimum(begin, n), known_weight[group], n + 1) - np.bincount(np.minimum(end, n), known_weight[group], n + 1)
        shared = np.cumsum(change)[:n]
        total = np.concatenate([[0.0], np.cumsum(weight(some))])
        own = total[np.minimum(np.arange(n) + size, len(some))] - total[np.minimum(np.arange(n), len(some))]
        near = shared / (own + (known_weight * counts).sum() - shared)
        first = int(np.flatnonzero(near >= near.max() - ROUNDING)[0])
        if near[first] >= THRESHOLD - ROUNDING and near[first] > best[0] + ROUNDING:
            got = weighted_jaccard(some[first : first + size], item, weight)
            if got >= THRESHOLD:
                best = (got, low + first)
    return best


def match_texts(w: words.Words, index: Index) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of the best match of every text and item at or above the threshold."""
    shingles = shingle_hashes(w.hashes) if len(w.hashes) >= SHINGLE else w.hashes[:0]
    hits = []
    for a in range(0, len(shingles), RUN):
        (own,) = simhash(w.hashes[a : a + RUN + WINDOW - 1], [(np.arange(min(RUN, len(shingles) - a)), WINDOW)])
        left, right = near_pairs(own, (index.prints, None, None, None, index.tables))
        hits.append(np.stack([left + a, index.owner[right]]))
    place, item = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
    text = np.searchsorted(w.at, place, "right") - 1
    inside = place + SHINGLE <= w.at[text + 1]
    found = np.unique(np.stack([text, item, place])[:, inside], axis=1)
    out = []
    for pair in np.split(found, np.flatnonzero(np.diff(found[:2], axis=1).any(0)) + 1, axis=1) if found.size else []:
        t, k, m = int(pair[0, 0]), int(pair[1, 0]), len(index.items[pair[1, 0]])
        begin, end = int(w.at[t]), int(w.at[t + 1])
        got, first = best_window(shingles[begin : end - SHINGLE + 1], pair[2] - begin, end - begin, index.shingles[k], m, index.weight)
        if got:
            out.append((t, k, got, first, m))
    return sorted(out + match_short(w, index))


def hashed_items(texts: pa.Array) -> list[np.ndarray]:
    """Word hashes of each item."""
    w = bare(pa.record_batch([texts], ["text"]))
    return [w.hashes[w.at[i] : w.at[i + 1]] for i in range(len(texts))]


def shingle_rows(items: DataFrame) -> DataFrame:
    """s: every distinct shingle of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch, most=SLICE):
                held = [np.unique(shingle_hashes(h)) for h in hashed_items(some.column("text"))]
                yield pa.record_batch([pa.array(np.concatenate(held).view(np.int64))], ["s"])

    return items.select("text").mapInArrow(run, "s long")


def item_parts(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[int, Iterator[tuple]]:
    """The number of parts of about INDEX_ITEMS items, and what Index takes for each, one at a time."""
    chosen = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    rows = chosen.limit(INDEX_ITEMS + 1).toArrow()
    if len(rows) <= INDEX_ITEMS:
        texts = rows["text"].combine_chunks()
        return min(len(rows), 1), iter([(rows["id"].to_pylist(), hashed_items(texts))] if len(rows) else [])
    table = staged(chosen.withColumn("row", F.monotonically_increasing_id()), "op6-items")
    total = table.count()
    n = -(-total // INDEX_ITEMS)
    shares = staged(shingle_rows(table).groupBy("s").agg(F.count("*").alias("n")), "op6-shares")

    def each() -> Iterator[tuple]:
        for k in range(n):
            part = table.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k)
            rows = part.select("id", "text").toArrow()
            if len(rows):
                held = shingle_rows(part).distinct().join(shares, "s").toArrow()
                known, counts = held["s"].to_numpy().view(np.uint64), held["n"].to_numpy()
                order = np.argsort(known)
                yield rows["id"].to_pylist(), hashed_items(rows["text"].combine_chunks()), (known[order], counts[order], total)

    return n, each()


def matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, item_id, similarity and the matched span (first word, number of words, its text)."""
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"{id_column} {kind}, item_id long, similarity double, first_word long, n_words long, passage string"
    found = None
    n_parts, parts = item_parts(items)
    for part in parts:

        def run(batches: Iterator[pa.RecordBatch], held=part) -> Iterator[pa.RecordBatch]:
            index = Index(*held)
            for batch in batches:
                for some in words.slices(batch, most=SLICE):
                    w, (raw, _) = bare(some), words.buffers(some.column("text"))
                    rows = match_texts(w, index)
                    spans = [raw[w.starts[w.at[t] + s] : w.ends[w.at[t] + s + min(m, w.at[t + 1] - w.at[t]) - 1]].tobytes().decode() for t, _, _, s, m in rows]
                    columns = [some.column("id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([index.item_ids[r[1]] for r in rows], pa.int64())]
                    columns += [pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())]
                    yield pa.record_batch([*columns, pa.array(spans, pa.string())], [id_column, "item_id", "similarity", "first_word", "n_words", "passage"])

        one = source.mapInArrow(run, schema)
        if n_parts > 1:  # written, so that the driver needn't keep the part
            one = staged(one, "op6-matches")
        found = one if found is None else found.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean_documents(docs: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text matches no item."""
    n_parts, parts = item_parts(items)
    text, unwanted = F.col(f"`{text_column}`"), None
    for part in parts:

        def keep(batches: Iterator[pa.RecordBatch], held=part) -> Iterator[pa.RecordBatch]:
            index = Index(*held)
            for batch in batches:
                for some in words.slices(batch, text_column, SLICE):
                    hit = {r[0] for r in match_texts(bare(some, text_column), index)}
                    yield some.take(pa.array([i for i in range(some.num_rows) if i not in hit], pa.int64()))

        def digests(batches: Iterator[pa.RecordBatch], held=part) -> Iterator[pa.RecordBatch]:
            index = Index(*held)
            for batch in batches:
                for some in words.slices(batch, most=SLICE):
                    hit = sorted({r[0] for r in match_texts(bare(some), index)})
                    yield pa.record_batch([pa.array([hashlib.sha256(some.column("text")[i].as_py().encode()).hexdigest() for i in hit], pa.string())], ["digest"])

        if n_parts == 1:
            return docs.mapInArrow(keep, docs.schema)
        # Equal texts match alike, so a part leaves the digests of its matched texts, and documents are written by none.
        one = staged(docs.select(text.alias("text")).mapInArrow(digests, "digest string"), "op6-unwanted")
        unwanted = one if unwanted is None else unwanted.unionByName(one)
    if unwanted is None:
        return docs
    name = fresh(docs, "digest")
    keyed = docs.withColumn(name, F.sha2(text.cast("binary"), 256))
    return keyed.join(unwanted.distinct().withColumnRenamed("digest", name), name, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
