"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the text is shared by all grades; ordered thresholds cut its score:
P(grade >= k) = sigmoid(w x + b - t_k) with t_1 < t_2 < ... From these come the expected grade and the tail probability
P(grade >= ``SELECT``) by which documents are selected. Thresholds stay ordered because their gaps are exponentials.

Features are hashed into ``WIDTH`` weights: runs of three bytes as they stand (so case and signs count), runs of four to the
coarser classes of their bytes, lower-cased words, and a few properties of the whole text in steps (shares of distinct words and of words that repeat the one before, mean word length,
capitals, signs, digits, line lengths). Each kind is divided by its number of occurrences, so long texts don't outweigh short ones.

Ratings are learned outside the held-out fold, from at most ``FIT_ROWS`` rated rows chosen by a hash of their id; that is a
bound of the training only. Training is gradient descent by rounds: each task sums the gradient over its feature rows, and the
driver adds the twelve tasks' vectors, which are of fixed size. Every document is scored.

Grades here come from ``labels``: 0 for low quality, 1 for good quality that is toxic, 2 for good quality that is not; so the tail at 1 is
good quality, whatever else. A NULL in either label leaves a row out.

Defined cases: NULL and empty texts have no features but their shape; a NULL id is neither learned from nor held out; several ratings of a document count as
the lowest; without ratings every grade is equally likely; a grade nobody gave keeps its threshold. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import words
from askloom.llm.tables import fold_of, staged

WIDTH = 1 << 17
FIT_ROWS = 20_000
ROUNDS = 30
RATE = 0.5
SELECT = 1
GRADES = 3
SLICE = 1 << 20

# Byte classes for the coarser runs: blank, lower, upper, digit, other ASCII sign (each its own), beyond ASCII.
COARSE = np.arange(256, dtype=np.uint8)
COARSE[[9, 11, 12, 13, 32]] = 32
COARSE[97:123] = 97
COARSE[65:91] = 65
COARSE[48:58] = 48
COARSE[128:] = 128


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    return (words.mix(code ^ np.uint64(kind << 56)) >> np.uint64(64 - 17)).astype(np.int64)


def _steps(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


def shape_features(w: words.Words) -> np.ndarray:
    """Steps of whole-text properties, one column each."""
    n, sizes = np.maximum(np.diff(w.at), 1), np.maximum(np.diff(w.offsets), 1)
    distinct = np.array([len(np.unique(w.hashes[a:b])) for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)])
    again = np.zeros(len(w.hashes), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    share = lambda mask: _sums(mask, w.offsets) / sizes
    lower, upper = (w.data >= 97) & (w.data < 123), (w.data >= 65) & (w.data < 91)
    digit, wide = (w.data >= 48) & (w.data < 58), w.data >= 128
    sign = ~(lower | upper | digit | wide | words.BLANK[w.data])
    rates = [0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5]
    columns = [
        _steps(distinct / n, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
        _steps(_sums(w.ends - w.starts, w.at) / n, [2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15]),
        _steps(share(upper), rates), _steps(share(sign), rates), _steps(share(digit), rates), _steps(share(wide), rates),
        _steps(_sums(again, w.at) / n, rates), _steps(share(w.data == 10), rates), _steps(np.log2(n), [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]),
    ]
    return np.stack(columns, axis=1)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def features_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, value) of every occurrence of a feature, one kind of feature at a time."""
    w = words.batch_words(batch)
    data, coarse = w.data.astype(np.uint64), COARSE[w.data].astype(np.uint64)
    n_texts = len(w.offsets) - 1
    for kind, source, length in ((1, data, 3), (2, coarse, 4)):
        n = max(len(data) - length + 1, 0)
        code = np.zeros(n, np.uint64)
        for k in range(length):
            code = code << np.uint64(8) | source[k : k + n]
        text = np.searchsorted(w.offsets, np.arange(n), "right") - 1
        inside = np.arange(n) + length <= w.offsets[text + 1] if n else np.zeros(0, bool)
        counts = np.bincount(text[inside], minlength=n_texts)
        yield text[inside], _bucket(code[inside], kind), 1.0 / np.maximum(counts, 1)[text[inside]]
    text = np.repeat(np.arange(n_texts), np.diff(w.at))
    yield text, _bucket(w.hashes, 3), 1.0 / np.maximum(np.diff(w.at), 1)[text]
    shape = shape_features(w)
    text = np.repeat(np.arange(n_texts), shape.shape[1])
    code = (np.arange(shape.shape[1]) * 64 + shape).ravel().astype(np.uint64)
    yield text, _bucket(code, 4), np.ones(len(text))


def linear(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    """w x of every text; features are summed as they come, nothing is kept."""
    out = np.zeros(batch.num_rows)
    for text, bucket, value in features_of(batch):
        out += np.bincount(text, weights=weights[bucket] * value, minlength=batch.num_rows)
    return out


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ..., one column each."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -40, 40)))


def gradient(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the negative log-likelihood: by score, by threshold, and its value."""
    tail = np.concatenate([np.ones((len(score), 1)), tails(score, thresholds), np.zeros((len(score), 1))], axis=1)
    rows = np.arange(len(score))
    high, low = tail[rows, grade], tail[rows, grade + 1]
    p = np.maximum(high - low, 1e-12)
    d_high, d_low = high * (1 - high), low * (1 - low)
    by_score = -(d_high - d_low) / p
    by_threshold = np.zeros(len(thresholds))
    np.add.at(by_threshold, grade[grade > 0] - 1, (d_high / p)[grade > 0])
    np.add.at(by_threshold, grade[grade < len(thresholds)], -(d_low / p)[grade < len(thresholds)])
    return by_score, by_threshold, float(-np.log(p).sum())


def training_rows(docs: DataFrame) -> DataFrame:
    """grade, buckets and values of each rated text; features of one bucket are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in words.slices(b, most=SLICE)):
            found = list(features_of(part))
            text, bucket, value = (np.concatenate(x) for x in zip(*found, strict=True))
            keys, index = np.unique(text * WIDTH + bucket, return_inverse=True)
            sums = np.bincount(index, weights=value).astype(np.float32)
            at = np.searchsorted(keys, np.arange(part.num_rows + 1) * WIDTH)
            buckets = [(keys[a:b] % WIDTH).astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            values = [sums[a:b].astype("<f4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([part.column("grade"), pa.array(buckets, pa.binary()), pa.array(values, pa.binary())], ["grade", "buckets", "values"])

    return docs.select("grade", "text").mapInArrow(run, "grade int, buckets binary, values binary")


def fit(rows: DataFrame, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from the written training rows."""
    total = rows.count()
    seen = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    share = np.array([sum(n for g, n in seen.items() if g >= k) + 0.5 for k in range(1, grades)]) / (total + 1.0)
    start = np.log((1 - share) / share)
    first, gaps = float(start[0]), np.log(np.maximum(np.diff(start), 1e-3))
    weights, squares, small = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(grades - 1)
    for _ in range(ROUNDS if total else 0):
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])

        def run(batches: Iterator[pa.RecordBatch], w=weights.astype(np.float32), t=thresholds) -> Iterator[pa.RecordBatch]:
            by_bucket, by_threshold = np.zeros(WIDTH), np.zeros(len(t))
            for batch in batches:
                sizes = [b.as_buffer().size // 4 for b in batch.column("buckets")]
                bucket = np.concatenate([np.frombuffer(b.as_buffer(), "<u4") for b in batch.column("buckets")]).astype(np.int64)
                value = np.concatenate([np.frombuffer(b.as_buffer(), "<f4") for b in batch.column("values")])
                owner = np.repeat(np.arange(len(sizes)), sizes)
                score = np.bincount(owner, weights=w[bucket] * value, minlength=len(sizes))
                d, dt, _ = gradient(score, batch.column("grade").to_numpy().astype(np.int64), t)
                by_bucket += np.bincount(bucket, weights=d[owner] * value, minlength=WIDTH)
                by_threshold += dt
            yield pa.record_batch([pa.array([by_bucket.astype(np.float32).tobytes()]), pa.array([by_threshold.tolist()])], ["w", "t"])

        # Training rows are bounded, and so is the number of their partitions: one vector of fixed size from each.
        got = rows.mapInArrow(run, "w binary, t array<double>").collect()
        by_bucket = sum(np.frombuffer(r["w"], np.float32).astype(float) for r in got) / total + 1e-6 * weights
        by_threshold = sum(np.array(r["t"]) for r in got) / total
        squares += by_bucket**2
        weights -= RATE * by_bucket / (np.sqrt(squares) + 1e-6)
        g = np.concatenate([[by_threshold.sum()], [by_threshold[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, grades - 1)]])
        small += g**2
        step = 0.1 * g / (np.sqrt(small) + 1e-6)
        first, gaps = first - step[0], gaps - step[1:]
    return weights.astype(np.float32), first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def score(docs: DataFrame, ratings: DataFrame, grades: int = GRADES, select: int = SELECT, held_out: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, keep of every row of ``docs`` (doc_id, text).

    ``ratings`` has doc_id and grade (0 to grades - 1). keep: P(grade >= select) is at least a half.
    """
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    kind = texts.schema["id"].dataType.simpleString()
    fold = fold_of(F.col("id"), folds)
    known = ratings.select(F.col("doc_id").alias("id"), F.col("grade").cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    known = known.where((fold != held_out) & F.col("grade").between(0, grades - 1)).groupBy("id").agg(F.min("grade").alias("grade"))
    n = known.count()
    if n > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / n))
    known = staged(known, "ratings")
    # At most about FIT_ROWS rows of two numbers, so sending them is bounded. The scan of all texts keeps its own tasks.
    rows = staged(training_rows(texts.join(F.broadcast(known), "id")).repartition(12), "quality-rows")
    weights, thresholds = fit(rows, grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in words.slices(b, most=SLICE)):
            tail = tails(linear(part, weights), thresholds)
            columns = [part.column("id"), pa.array(tail.sum(1)), pa.array(np.ascontiguousarray(tail[:, select - 1]))]
            yield pa.record_batch(columns, ["id", "expected_grade", "tail_probability"])

    out = texts.mapInArrow(run, f"id {kind}, expected_grade double, tail_probability double")
    held = F.coalesce(fold == held_out, F.lit(False)).alias("held_out")
    return out.select(F.col("id").alias("doc_id"), held, "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("keep"))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from quality and toxic labels."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", grade.alias("grade"))
