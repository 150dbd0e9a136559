"""Hashed maximum-entropy language model with a class-factored softmax and n-gram evidence that grows with the corpus.

P(token | history) is a gated sum of four distributions over tokens:

* classes: P(class | history) P(token | class). The classes are the ``SINGLES`` most frequent tokens, one each, and ``TAILS`` classes by the hash
  of a token's last three bytes, so unseen tokens have a class too. P(class | history) is a softmax over hashed features of the
  history: the previous token (bigram), the one before it (skip), and both (trigram). P(token | class) is relative frequency, with one
  added to every count and one place for tokens that the class has not seen.
* the token's share of what followed the previous token, the previous two tokens, and the token before the previous one (skip) in
  all learning texts. These are counts of every n-gram of the corpus, by a hash of ``GRAM_BITS`` bits; nothing is left out.

The gate is a softmax too, over features of the history alone: its two tokens, and how often each of its n-grams occurs. A history that never
occurs has no gate. So over known tokens and the places for unseen ones the probabilities of a history sum to 1.

Work runs on blocks of about ``BLOCK`` bytes of text, written once: local vocabulary, counts and token numbers. A block sends its distinct tokens
and n-grams with their counts, packed, to the ranges of the key space, about ``PART`` entries each, and gets the corpus counts back, in the same
order; no vocabulary is gathered anywhere. Class weights, then the gate, are trained by rounds of distributed gradient updates:
on every block AdaGrad steps from the round's weights, which are then averaged, feature by feature, by how often each block saw the feature.
So scores depend on the blocks, but not on cores or tasks. The gate judges a learned token without its own occurrence (leave one out). Every learning text
takes part in every round. What the driver holds has fixed size: class weights, gate, frequent tokens, sums by class.

Defined cases: NULL and empty texts are the end token alone; a NULL id is scored but neither learned from nor held out; repeated rows count
and are scored each; without learning texts, base_score is 0 and all classes are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm import words
from askloom.llm.tables import fold_of, staged

BLOCK = 4 << 20
FREQUENT = 1024  # tokens with a history symbol of their own
SINGLES = 16
TAILS = 48
CLASSES = SINGLES + TAILS
SYMBOLS = FREQUENT + TAILS + 1  # the last one stands before the first token
PAIR_ROWS = 1 << 13
ROWS = 2 * SYMBOLS + PAIR_ROWS
GRAM_BITS = 48
PART = 1 << 22  # entries of a key range
EXPERTS = 4  # classes, bigram, trigram, skip
LEVELS = 48  # of a history's count, by powers of two
GATE_ROWS = 2 * SYMBOLS + 3 * LEVELS
# The gate features of a token's two tokens before it and of its three histories' levels, from and to.
GATE_RANGES = [(0, SYMBOLS), (SYMBOLS, 2 * SYMBOLS), *((2 * SYMBOLS + k * LEVELS, 2 * SYMBOLS + (k + 1) * LEVELS) for k in range(3))]
GATE_STARTS = np.array([[begin] for begin, _ in GATE_RANGES])
ROUNDS = 2
RATE = 0.15
BATCH = 8192
HISTORIES = 1024  # whose logits stay in a core's cache

END_HASH = words.mix(np.array([0x5851F42D4C957F2D], np.uint64))[0]
END_TAIL = 0
START = words.mix(np.array([0x14057B7EF767814F], np.uint64))[0]
FACTORS = words.mix(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)


def tail_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of words by their last three bytes, lower-cased."""
    code = np.zeros(len(starts), np.uint64)
    for k in (1, 2, 3):
        at = ends - k
        code = code * np.uint64(257) + np.where(at >= starts, words.LOWER[data[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (words.mix(code) % np.uint64(TAILS)).astype(np.uint8)


def _block(ids: list, held: list, texts: pa.Array, number: int) -> pa.RecordBatch:
    """One row: documents, tokens as numbers of the block's vocabulary (frequent ones first), and the vocabulary."""
    w = words.words_of(*words.buffers(texts))
    n_words = np.diff(w.at)
    n = n_words + 1
    last = np.cumsum(n) - 1
    hashes = np.full(int(n.sum()), END_HASH, np.uint64)
    is_word = np.ones(len(hashes), bool)
    is_word[last] = False
    hashes[is_word] = w.hashes
    learn = np.repeat(np.array([h is False for h in held], bool), n)
    codes = pa.array(hashes).dictionary_encode()  # a hash table: far less work than to sort all tokens
    local, known = codes.indices.to_numpy(), codes.dictionary.to_numpy()
    first = np.empty(len(known), np.int64)
    first[local[::-1]] = np.arange(len(local))[::-1]
    order = np.argsort(known)
    order = order[np.argsort(-np.bincount(local, minlength=len(known))[order], kind="stable")]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    local, known, first = place[local], known[order], first[order]
    counts = np.bincount(local[learn], minlength=len(known))
    before_end = last[(n > 1) & learn[last]] - 1
    lasts = np.bincount(local[before_end], minlength=len(known))
    tails = np.full(len(known), END_TAIL, np.uint8)
    word_at = np.cumsum(is_word) - 1
    real = is_word[first]
    chosen = word_at[first[real]]
    tails[real] = tail_class(w.data, w.starts[chosen], w.ends[chosen])
    row = {
        "block": pa.array([number], pa.int64()),
        "ids": pa.array([ids], pa.list_(pa.int64())),
        "held": pa.array([held], pa.list_(pa.bool_())),
        "n": pa.array([n.astype(np.int64)], pa.list_(pa.int64())),
        "tokens": pa.array([pa.compress(local.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
        "vocabulary": pa.array([known.tobytes()], pa.binary()),
        "counts": pa.array([counts.astype("<u4").tobytes()], pa.binary()),
        "lasts": pa.array([lasts.astype("<u4").tobytes()], pa.binary()),
        "tails": pa.array([tails.tobytes()], pa.binary()),
    }
    return pa.record_batch(list(row.values()), list(row))


BLOCK_SCHEMA = "block long, ids array<long>, held array<boolean>, n array<long>, tokens binary, vocabulary binary, counts binary, lasts binary, tails binary"


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of ``docs`` (id, text, held). A task's blocks are numbered by it, so the table must be written once and read from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in words.slices(batch, most=size):
                if part.num_rows:
                    yield _block(part.column("id").to_pylist(), part.column("held").to_pylist(), part.column("text"), number)
                    number += 1

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _tokens(packed: pa.Buffer, n: np.ndarray) -> np.ndarray:
    """Token numbers of a block whose texts have ``n`` tokens; they are kept byte plane by byte plane, compressed."""
    total = int(n.sum())
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * total, codec="zstd"), np.uint8).reshape(4, total)
    return _joined(planes).view(np.int64)


def _joined(planes: np.ndarray) -> np.ndarray:
    """Integers of byte planes, the lowest first; the upper ones are mostly empty."""
    out = planes[0].astype(np.uint64)
    for k, plane in enumerate(planes[1:], 1):
        if plane.any():
            out |= plane.astype(np.uint64) << np.uint64(8 * k)
    return out


def _pack(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Unsigned integers, byte plane by byte plane of each column, compressed."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(columns, widths, strict=True)]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(packed: pa.Buffer, n: int, widths: list[int]) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=n * sum(widths), codec="zstd"), np.uint8)
    out, at = [], 0
    for w in widths:
        out.append(_joined(raw[at : at + n * w].reshape(w, n)))
        at += n * w
    return out


def before(values: np.ndarray, n: np.ndarray, start: int | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Values of the token before each token and of the one before that; ``start`` where its text has none."""
    first = np.cumsum(n) - n
    one, two = np.empty_like(values), np.empty_like(values)
    one[1:], two[2:] = values[:-1], values[:-2]
    two[:2] = start
    one[first] = two[first] = start
    two[first[n > 1] + 1] = start
    return one, two


def gram_keys(kind: int, vocabulary: np.ndarray, local: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Key of every token's n-gram: with the token before it (1), the two before it (2), or the one before that (3, skip).

    Keys are hashes of ``GRAM_BITS`` bits of the words' own hashes; there are as many as the corpus has different n-grams.
    """
    h = vocabulary[local]
    one, two = before(h, n, START)
    key = words.mix(two * FACTORS[2] + h) if kind == 3 else words.mix(one * FACTORS[0] + h)
    return (words.mix(key * FACTORS[1] + two) if kind == 2 else key) >> np.uint64(64 - GRAM_BITS)


def distinct(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how many of each are learned."""
    both = np.sort(keys << np.uint64(1) | learn)
    key = both >> np.uint64(1)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[begin], np.add.reduceat((both & np.uint64(1)).astype(np.int64), begin)


def spread(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For every key its count, where ``counts`` has one for each of the different keys, in order."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), counts.dtype)
    out[order] = counts[np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))]
    return out


REQUEST_SCHEMA = "part long, block long, n int, packed binary"
SINGLE = [8, 4, 4, 1]  # bytes of a request's keys, counts, counts as last word, and tail class
GRAM = [8, 4]


def requests(table: DataFrame, kind: int, parts: int) -> DataFrame:
    """For every block and key range one row with the block's keys of that range, in order, and their counts in it. Kind 0 is single tokens."""
    bits, widths = (GRAM_BITS, GRAM) if kind else (64, SINGLE)
    source = ["block", "held", "n", "tokens", "vocabulary"] if kind else ["block", "vocabulary", "counts", "lasts", "tails"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in source}
                vocabulary = np.frombuffer(row["vocabulary"].as_buffer(), np.uint64)
                if kind:
                    n, learn = np.array(row["n"].as_py(), np.int64), [h is False for h in row["held"].as_py()]
                    columns = distinct(gram_keys(kind, vocabulary, _tokens(row["tokens"].as_buffer(), n), n), np.repeat(np.array(learn, bool), n))
                else:
                    order = np.argsort(vocabulary)
                    counts = [np.frombuffer(row[c].as_buffer(), "<u4")[order] for c in ("counts", "lasts")]
                    columns = (vocabulary[order], *counts, np.frombuffer(row["tails"].as_buffer(), np.uint8)[order])
                edges = _edges(columns[0], parts, bits)
                used = np.flatnonzero(np.diff(edges))
                data = []
                for p in used:
                    own = [c[edges[p] : edges[p + 1]] for c in columns]
                    data.append(_pack([np.diff(own[0], prepend=np.uint64(0)), *own[1:]], widths))
                block = np.full(len(used), row["block"].as_py())
                yield pa.record_batch([*map(pa.array, (used, block, np.diff(edges)[used].astype(np.int32))), pa.array(data, pa.binary())], ["part", "block", "n", "packed"])

    return table.select(*source).mapInArrow(run, REQUEST_SCHEMA)


def _edges(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the key space begins in the ordered ``keys``."""
    bounds = np.array([(k << bits) // parts for k in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


STATS = "tail_tokens array<long>, tail_types array<long>, top_h array<long>, top_n array<long>, top_tail array<int>"
ANSWER_SCHEMA = f"of long, kind int, part long, n int, totals binary, {STATS}"


def answers(asked: DataFrame, kind: int) -> DataFrame:
    """The corpus counts of every request's keys, in its order. With single tokens, the range's sums by tail class and its most frequent tokens.

    A group is one range of keys: about ``PART`` entries, a frequent key having one entry a block, however often it occurs.
    """

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        n = group["n"].to_numpy()
        rows = [_unpack(b.as_buffer(), k, GRAM if kind else SINGLE) for b, k in zip(group["packed"], n, strict=True)]
        keys, index = np.unique(np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in rows]), return_inverse=True)
        counts = range(1, 2 if kind else 3)
        totals = [np.bincount(index, weights=np.concatenate([r[c] for r in rows]).astype(float), minlength=len(keys)).astype(np.int64) for c in counts]
        at = np.concatenate([[0], np.cumsum(n)])
        data = [_pack([t[index[a:b]] for t in totals], [6 for _ in totals]) for a, b in zip(at[:-1], at[1:], strict=True)]
        stats = [[None] * len(n) for _ in range(5)]
        if kind == 0:
            tail = np.empty(len(keys), np.int64)
            tail[index] = np.concatenate([r[3] for r in rows]).astype(np.int64)
            seen = np.flatnonzero(totals[0])
            top = seen[np.lexsort((keys[seen], -totals[0][seen]))[:FREQUENT]]
            sums = np.bincount(tail, weights=totals[0], minlength=TAILS).astype(np.int64), np.bincount(tail[seen], minlength=TAILS)
            for column, value in zip(stats, (*sums, keys[top].view(np.int64), totals[0][top], tail[top]), strict=True):
                column[0] = value.tolist()
        where = pa.array(np.full(len(n), kind, np.int32)), pa.array(np.full(len(n), key[0].as_py())), pa.array(n.astype(np.int32))
        lists = [pa.array(c, pa.list_(pa.int32() if k == 4 else pa.int64())) for k, c in enumerate(stats)]
        names = ["of", "kind", "part", "n", "totals", "tail_tokens", "tail_types", "top_h", "top_n", "top_tail"]
        return pa.table([group["block"], *where, pa.array(data, pa.binary()), *lists], names)

    return asked.groupBy("part").applyInArrow(answer, ANSWER_SCHEMA)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are deleted as soon as its table is written, so that its steps don't add up on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


COUNTED_SCHEMA = "block long, ids array<long>, held array<boolean>, n array<long>, tokens binary, tails binary, symbols binary, totals binary, hits binary"


def counted(table: DataFrame) -> tuple[DataFrame, Tables]:
    """The written blocks with corpus counts in place of their words: of every token of the vocabulary (all, and as last word), and of every token's n-grams.

    The kinds of n-grams are counted one after another, each in a shuffle of its own.
    """
    size = table.agg(F.sum(F.length("tails")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    with shuffles_dropped(table.sparkSession):
        found = []
        for kind in range(EXPERTS):
            parts = max(1, -(-(size[min(kind, 1)] or 0) // PART))
            found.append(staged(answers(requests(table, kind, parts), kind), "lm-answers"))
        tables = count_tables(found[0])
        every = found[0].select("of", "kind", "part", "n", "totals")
        for f in found[1:]:
            every = every.unionByName(f.select("of", "kind", "part", "n", "totals"))
        # As many answers as key ranges, all together as long as the block's own keys.
        by_block = every.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("kind", "part", "n", "totals"))).alias("answers"))
        joined = table.drop("counts", "lasts").join(by_block, F.col("block") == F.col("of"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    vocabulary, tails = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("vocabulary", np.uint64), ("tails", np.uint8)))
                    n = np.array(batch.column("n")[i].as_py(), np.int64)
                    local = _tokens(batch.column("tokens")[i].as_buffer(), n)
                    got: list[list[np.ndarray]] = [[], [], [], [], []]  # counts as last word come last
                    for a in batch.column("answers")[i].values:
                        kind = a["kind"].as_py()
                        values = _unpack(a["totals"].as_buffer(), a["n"].as_py(), [6] if kind else [6, 6])
                        for k, v in zip((kind,) if kind else (0, 4), values, strict=True):
                            got[k].append(v)
                    answered = [np.concatenate(g) for g in got]
                    place = np.empty(len(vocabulary), np.int64)
                    place[np.argsort(vocabulary)] = np.arange(len(vocabulary))
                    hits = []
                    for kind in range(1, EXPERTS):
                        hits.append(spread(answered[kind], gram_keys(kind, vocabulary, local, n)))
                    data = tables.symbols(vocabulary, tails).astype("<u2").tobytes(), _pack([answered[0][place], answered[4][place]], [6, 6]), _pack(hits, [6] * len(hits))
                    one = batch.slice(i, 1)
                    yield pa.record_batch([*(one.column(c) for c in KEPT), *(pa.array([d], pa.binary()) for d in data)], [*KEPT, "symbols", "totals", "hits"])

        return staged(joined.mapInArrow(run, COUNTED_SCHEMA), "lm-counted"), tables


KEPT = ["block", "ids", "held", "n", "tokens", "tails"]


@dataclass
class Tables:
    """What all tasks need, of fixed size: frequent tokens (sorted hashes and their ranks) and sums by class."""

    hashes: np.ndarray
    ranks: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    tokens: int
    types: int

    def symbols(self, vocabulary: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """History symbol of each token: its rank among the frequent ones, or its tail class."""
        out = FREQUENT + tails.astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, vocabulary), len(self.hashes) - 1)
            hit = self.hashes[at] == vocabulary
            out[hit] = self.ranks[at[hit]]
        return out


def class_of(symbols: np.ndarray, tails: np.ndarray) -> np.ndarray:
    return np.where(symbols < SINGLES, symbols, SINGLES + tails.astype(np.int64))


def count_tables(singles: DataFrame) -> Tables:
    packed = singles.where("tail_tokens IS NOT NULL")
    top = packed.select(F.explode(F.arrays_zip("top_h", "top_n", "top_tail")).alias("t")).select("t.*")
    top = top.orderBy(F.desc("top_n"), "top_h").limit(FREQUENT).collect()
    hashes = np.array([r["top_h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    by_tail = packed.select(F.posexplode(F.arrays_zip("tail_tokens", "tail_types")).alias("tail", "s"))
    for r in by_tail.groupBy("tail").agg(F.sum("s.tail_tokens").alias("n"), F.sum("s.tail_types").alias("v")).collect():
        tokens[SINGLES + r["tail"]], types[SINGLES + r["tail"]] = r["n"], r["v"]
    total, kinds = int(tokens.sum()), int(types.sum())
    for rank, r in enumerate(top[:SINGLES]):
        tokens[rank], types[rank] = r["top_n"], 1
        tokens[SINGLES + r["top_tail"]] -= r["top_n"]
        types[SINGLES + r["top_tail"]] -= 1
    return Tables(hashes[order], order, tokens, types, total, kinds)


def histories(local: np.ndarray, n: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Number of the history of each token: the symbols of the two tokens before it in its text."""
    one, two = before(symbols[local], n, SYMBOLS - 1)
    return one * SYMBOLS + two


def different(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different histories in order, and the place of each token's among them: by a table of all histories, as tokens are many."""
    there = np.zeros(SYMBOLS * SYMBOLS, bool)
    there[history] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[history]


def feature_rows(history: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each history: bigram, skip and trigram feature."""
    one, two = np.divmod(history, SYMBOLS)
    pair = (words.mix(history.astype(np.uint64)) % np.uint64(PAIR_ROWS)).astype(np.int64)
    return np.stack([one, SYMBOLS + two, 2 * SYMBOLS + pair])


def class_logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of all classes less their highest, the highest, and the logarithm of the sum of their powers."""
    logits = weights.take(rows[0], axis=0)
    logits += weights.take(rows[1], axis=0)
    logits += weights.take(rows[2], axis=0)
    logits += bias
    highest = logits.max(1, keepdims=True)
    logits -= highest
    return logits, highest, np.log(np.exp(logits).sum(1, keepdims=True))


def train_block(history: np.ndarray, classes: np.ndarray, weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, bias: np.ndarray) -> None:
    """One pass of AdaGrad over the block's (history, class) counts, in place."""
    pairs, counts = np.unique((history * CLASSES + classes).astype(np.uint32), return_counts=True)
    owners, cls = np.divmod(pairs.astype(np.int64), CLASSES)
    begin = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    known, edges = owners[begin], np.append(begin, len(owners))
    # Batches in a fixed mixed order, so that a batch isn't one word's histories.
    order = np.argsort(words.mix(known.astype(np.uint64)))
    for a in range(0, len(order), BATCH):
        some = order[a : a + BATCH]
        rows = feature_rows(known[some])
        lengths = edges[some + 1] - edges[some]
        source = np.repeat(edges[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        error = np.zeros((len(some), CLASSES), np.float32)
        error[np.repeat(np.arange(len(some)), lengths), cls[source]] = -counts[source].astype(np.float32)
        totals = -error.sum(1, keepdims=True)
        for b in range(0, len(some), HISTORIES):
            logits, _, log_sum = class_logits(weights, bias, rows[:, b : b + HISTORIES])
            logits -= log_sum
            np.exp(logits, out=logits)
            logits *= totals[b : b + HISTORIES]
            error[b : b + HISTORIES] += logits
        for r in rows:
            by = np.argsort(r.astype(np.uint16), kind="stable")  # of two bytes: counted, not compared
            sorted_rows = r[by]
            begin = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
            touched = sorted_rows[begin]
            gradient = np.add.reduceat(error[by], begin, axis=0)
            moved = squares[touched] + gradient**2
            squares[touched] = moved
            moved += 1.0
            gradient *= RATE
            gradient /= np.sqrt(moved, out=moved)
            weights[touched] -= gradient
            seen[touched] += np.add.reduceat(totals[by, 0], begin)


def train_round(table: DataFrame, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights after one pass over every block, averaged by what each block has seen of a feature.

    Every block starts at the round's weights, so the result doesn't depend on how blocks fall into tasks.
    """
    step = 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(weights.shape), np.zeros(ROWS)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() for c in ("tokens", "symbols", "tails")}
                tails, symbols = np.frombuffer(row["tails"], np.uint8), np.frombuffer(row["symbols"], "<u2").astype(np.int64)
                n = np.array(batch.column("n")[i].as_py(), np.int64)
                local = _tokens(row["tokens"], n)
                learn = np.repeat(np.array([h is False for h in batch.column("held")[i].as_py()], bool), n)
                if learn.any():
                    own, squares, here = weights.copy(), np.zeros_like(weights), np.zeros(ROWS)
                    train_block(histories(local, n, symbols)[learn], class_of(symbols, tails)[local][learn], own, squares, here, bias)
                    total += own * here[:, None]
                    seen += here
        if seen.any():
            scaled = np.concatenate([total, seen[:, None]], axis=1).astype(np.float32)
            parts = [scaled[a : a + step].tobytes() for a in range(0, ROWS, step)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, s in zip(batch.column("part").to_pylist(), batch.column("sums"), strict=True):
                total[k] = np.frombuffer(s.as_buffer(), np.float32) + total.get(k, np.float32(0))
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["part", "sums"])

    schema = "part int, sums binary"
    # One copy of the weights comes from every task, so there are about as many tasks as cores.
    tasks = 2 * table.sparkSession.sparkContext.defaultParallelism
    passed = table.select("n", "held", "tokens", "symbols", "tails").coalesce(tasks).mapInArrow(run, schema)
    summed = passed.repartition(16, "part", F.pmod(F.xxhash64("sums"), F.lit(8))).mapInArrow(add, schema).repartition(8, "part").mapInArrow(add, schema)
    out = weights.copy()
    for r in summed.collect():
        sums = np.frombuffer(r["sums"], np.float32).reshape(-1, CLASSES + 1)
        hit = np.flatnonzero(sums[:, -1] > 0)
        out[r["part"] * step + hit] = sums[hit, :-1] / sums[hit, -1:]
    return out


def class_scores(local: np.ndarray, n: np.ndarray, counts: np.ndarray, symbols: np.ndarray, tails: np.ndarray, tables: Tables, weights: np.ndarray, bias: np.ndarray, own: int = 0) -> np.ndarray:
    """log P(class | history) + log P(token | class) of every token; ``own`` occurrences of the token itself are taken off its count."""
    classes = class_of(symbols, tails)
    sums = (tables.class_tokens + tables.class_types + 1.0)[classes] - own
    inside = np.log(np.maximum(counts + 1.0 - own, 1.0) / np.maximum(sums, 1.0))
    inside[symbols < SINGLES] = 0.0  # a class of one token
    token_class = classes[local]
    known, index = different(histories(local, n, symbols))
    rows = feature_rows(known)
    highest, log_sum = np.empty(len(known), np.float32), np.empty(len(known), np.float32)
    for a in range(0, len(known), HISTORIES):
        some = slice(a, a + HISTORIES)
        _, top, total = class_logits(weights, bias, rows[:, some])
        highest[some], log_sum[some] = top[:, 0], total[:, 0]
    # A token needs one of its history's logits only.
    flat, cells = weights.ravel(), rows * CLASSES
    of_class = flat.take(cells[0][index] + token_class)
    of_class += flat.take(cells[1][index] + token_class)
    of_class += flat.take(cells[2][index] + token_class)
    of_class += bias[token_class]
    of_class -= highest[index]
    of_class -= log_sum[index]
    return of_class + inside[local]


@dataclass
class Evidence:
    """What the corpus says of each token: shares of it after its histories, how often these occur, and the gate's features."""

    shares: np.ndarray  # tokens x EXPERTS, the first one from the classes; laid out kind by kind
    there: np.ndarray  # which of them have a history at all; laid out in the same way
    rows: np.ndarray  # gate features x tokens

    def of(self, some: np.ndarray) -> Evidence:
        return Evidence(self.shares.T.take(some, axis=1).T, self.there.T.take(some, axis=1).T, self.rows.take(some, axis=1))


def evidence(local: np.ndarray, n: np.ndarray, counts: np.ndarray, lasts: np.ndarray, grams: list[np.ndarray], symbols: np.ndarray, by_class: np.ndarray, texts: int, own: int = 0) -> Evidence:
    """Shares of every token among what followed its histories; with ``own`` = 1 its own occurrence is left out of all counts."""
    first = np.cumsum(n) - n
    second = first[n > 1] + 1
    # A word is followed by a token wherever it occurs, a pair of words as well; a text's first token follows its beginning.
    # The token before the previous one is a word that something follows but the end.
    seen = np.empty((3, len(local)), np.int64)
    seen[0, 1:], seen[1, 1:] = counts[local[:-1]], grams[0][:-1]
    seen[2, 2:] = (counts - lasts)[local[:-2]]
    seen[0, first], seen[1, first] = texts, 0
    seen[2, first] = seen[2, second] = 0
    there, shares = np.ones((EXPERTS, len(local)), bool), np.empty((EXPERTS, len(local)))
    np.exp(by_class, out=shares[0])
    rows = np.empty((len(GATE_RANGES), len(local)), np.int64)
    rows[0], rows[1] = before(symbols[local], n, SYMBOLS - 1)
    rows[1] += SYMBOLS
    for a in range(0, len(local), BATCH):
        some = slice(a, a + BATCH)
        known = np.maximum(seen[:, some] - own, 0)
        hits = np.maximum(np.stack([g[some] for g in grams]) - own, 0)
        np.greater(known, 0, out=there[1:, some])
        shares[1:, some] = np.minimum(hits, known) / np.maximum(known, 1)  # 0 for a history that never occurs
        # The level is the number of binary digits, as the exponent of a double has it; 0 for 0.
        level = np.clip((known.astype(float).view(np.int64) >> 52) - 1022, 0, LEVELS - 1)
        np.add(level, GATE_STARTS[2:], out=rows[2:, some])
    return Evidence(shares.T, there.T, rows)


def gate_of(gate: np.ndarray, rows: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Softmax over the kinds of evidence that a history has; kinds x tokens, as ``there`` is."""
    logits = gate.take(rows[0], axis=0)
    for r in rows[1:]:
        logits += gate.take(r, axis=0)
    out = np.where(there, np.ascontiguousarray(logits.T), -np.inf)
    out -= out.max(0)
    np.exp(out, out=out)
    out /= out.sum(0)
    return out


def gate_gradient(gate: np.ndarray, e: Evidence, some: np.ndarray | slice) -> tuple[np.ndarray, float]:
    """Of the negative log-likelihood of the tokens ``some``, by logit; and its value."""
    g = gate_of(gate, e.rows[:, some], e.there[some].T)
    joint = g * e.shares[some].T
    total = np.maximum(joint.sum(0), 1e-300)
    joint /= total
    g -= joint
    return g.T, float(-np.log(total).sum())


def train_gate_block(gate: np.ndarray, e: Evidence, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gate after one AdaGrad pass over the block's learned tokens, and how often each feature was seen."""
    own, squares, seen = gate.copy(), np.zeros_like(gate), np.zeros(len(gate))
    some = np.flatnonzero(learn)
    some = some[np.argsort(words.mix(some.astype(np.uint64)))]
    for a in range(0, len(some), BATCH):
        part = e.of(some[a : a + BATCH])
        error, _ = gate_gradient(own, part, slice(None))
        for (begin, end), rows in zip(GATE_RANGES, part.rows - GATE_STARTS, strict=True):
            gradient = np.stack([np.bincount(rows, weights=error[:, k], minlength=end - begin) for k in range(EXPERTS)], axis=1)
            squares[begin:end] += gradient**2
            own[begin:end] -= RATE * gradient / np.sqrt(squares[begin:end] + 1.0)
            seen[begin:end] += np.bincount(rows, minlength=end - begin)
    return own, seen


@dataclass
class Model:
    tables: Tables
    texts: int
    weights: np.ndarray
    bias: np.ndarray
    gate: np.ndarray


@dataclass
class Block:
    """A counted block, read back."""

    ids: list
    held: list
    n: np.ndarray
    local: np.ndarray
    counts: np.ndarray
    e: Evidence


def counted_blocks(batches: Iterator[pa.RecordBatch], model: Model, own: int = 0) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_buffer() for c in ("tokens", "symbols", "tails", "totals", "hits")}
            tails, symbols = np.frombuffer(row["tails"], np.uint8), np.frombuffer(row["symbols"], "<u2").astype(np.int64)
            ids, held = batch.column("ids")[i].as_py(), batch.column("held")[i].as_py()
            n = np.array(batch.column("n")[i].as_py(), np.int64)
            local = _tokens(row["tokens"], n)
            counts, lasts = (x.astype(np.int64) for x in _unpack(row["totals"], len(tails), [6, 6]))
            grams = [x.astype(np.int64) for x in _unpack(row["hits"], len(local), [6] * (EXPERTS - 1))]
            by_class = class_scores(local, n, counts, symbols, tails, model.tables, model.weights, model.bias, own)
            yield Block(ids, held, n, local, counts, evidence(local, n, counts, lasts, grams, symbols, by_class, model.texts, own))


def train_gate(table: DataFrame, model: Model) -> np.ndarray:
    """The gate after one pass over every block, averaged over blocks. A learned token's own occurrence is left out of what it is judged by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in counted_blocks(batches, model, own=1):
            learn = np.repeat(np.array([h is False for h in b.held], bool), b.n)
            if learn.any():
                own, seen = train_gate_block(model.gate, b.e, learn)
                row, part = np.nonzero(np.repeat(seen[:, None] > 0, EXPERTS, 1))
                yield pa.record_batch([pa.array(x) for x in (row, part, own[row, part] * seen[row], seen[row])], ["row", "expert", "w", "n"])

    sums = table.mapInArrow(run, "row long, expert long, w double, n double")
    out = model.gate.copy()
    for r in sums.groupBy("row", "expert").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():
        out[r["row"], r["expert"]] = r["w"] / r["n"]
    return out


def score_block(b: Block, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_known, base score and score (both log10) of each text of a block."""
    text, size = np.repeat(np.arange(len(b.n)), b.n), len(b.n)
    base = np.log10((b.counts + 1.0) / (model.tables.tokens + model.tables.types + 1.0))
    logs = np.empty(len(b.local))
    for a in range(0, len(logs), BATCH):
        some = slice(a, a + BATCH)
        logs[some] = np.log10((gate_of(model.gate, b.e.rows[:, some], b.e.there[some].T) * b.e.shares[some].T).sum(0))
    known = np.bincount(text, weights=(b.counts > 0)[b.local], minlength=size).astype(np.int64)
    return known, np.bincount(text, weights=base[b.local], minlength=size), np.bincount(text, weights=logs, minlength=size)


def fit(table: DataFrame, tables: Tables) -> Model:
    """The model of the counted blocks: class weights by ``ROUNDS`` passes, then the gate by one."""
    texts = table.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    bias = np.log(tables.class_tokens + tables.class_types + 1.0)
    bias = (bias - bias.max()).astype(np.float32)
    weights = np.zeros((ROWS, CLASSES), np.float32)
    for _ in range(ROUNDS):
        weights = train_round(table, weights, bias)
    model = Model(tables, texts, weights, bias, np.zeros((GATE_ROWS, EXPERTS)))
    model.gate = train_gate(table, model)
    return model


def score(docs: DataFrame, held_out: int = 2, folds: int = 7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; texts of the held-out fold are not learned from."""
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    source = source.withColumn("held", fold_of(F.col("id"), folds) == held_out)
    table, tables = counted(staged(blocks(source), "lm-blocks"))
    model = fit(table, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in counted_blocks(batches, model):
            got = score_block(b, model)
            held = pa.array([h is True for h in b.held], pa.bool_())
            columns = [pa.array(b.ids, pa.int64()), held, pa.array(b.n), pa.array(got[0]), pa.array(np.full(len(b.n), model.tables.tokens))]
            yield pa.record_batch([*columns, pa.array(got[1]), pa.array(got[2])], OUT)

    OUT = [id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"{id_column} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.mapInArrow(run, schema)
