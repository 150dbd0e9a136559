"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features (``FEATURES``) are rates of the whole text, computed in numpy on Arrow batches: densities of two lexicons, one given and
one learned, with their hits near second-person words, with capitals and in disguise (letters replaced by digits or signs, or
split by signs), besides capitals, punctuation, repeated signs and mixed words. The learned lexicon holds the words whose share
of toxic documents stands out in the training rows. Trees and calibration are Spark ML's, fitted on feature rows only.

Labels are learned from rows outside the held-out fold; these are split once more, so that the calibration sees rows that
the trees have not. At most ``FIT_ROWS`` labelled rows are used for fitting, chosen by a hash of their id: a bound of the
classifier's training only. Every document is scored.

Defined cases: NULL and empty texts have all features 0 and are scored as such; a NULL id is never held out and never
learned from; several labels of a document count as the highest; labels with NULL are left out; with no labels, or
labels of one kind only, every score is that kind's rate (0.5 without any). Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from askloom.llm import words
from askloom.llm.tables import fold_of, fresh, staged

# Tasks import this module for the features only; Spark ML would take 50 MB of every Python worker.
if TYPE_CHECKING:
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import IsotonicRegressionModel

SLICE = 1 << 20  # bytes of text whose features are made at once; work arrays hold about 50 times as much
FIT_ROWS = 60_000
LEARNED_WORDS = 500
LEAST_DOCS = 4
LEAST_GAIN = 12.0
NEAR = 4

# Words of abuse, and second-person words, by language.
ABUSE = """
idiot idiots moron morons stupid dumb dumbass imbecile cretin loser losers clown clowns scum trash garbage worthless pathetic disgusting
filth filthy vermin bastard bitch asshole jerk freak retard fool ugly
idiote idiotes imbécile crétin connard connasse salaud salope ordure débile minable raclure abruti
idiota idiotas imbécil estúpido estúpida tonto basura asqueroso patético inútil escoria cabrón puta payaso
dumm dummkopf trottel depp arschloch schwein abschaum müll wertlos erbärmlich widerlich ekelhaft
""".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros du dich dir dein deine deiner ihr euch sie".split()

FEATURES = [
    "abuse_rate", "learned_rate", "learned_weight", "learned_most", "abuse_any", "near_person", "person_rate", "disguised_rate", "capital_hits",
    "capital_bytes", "capital_words", "punctuation", "exclamations", "repeated_signs", "mixed_words", "digits", "length", "hits", "first_hit",
]

IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_LETTER = IS_UPPER.copy()
IS_LETTER[97:123] = True
IS_LETTER[128:] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_SIGN = ~(IS_LETTER | IS_DIGIT | words.BLANK)
# Signs and digits that stand for letters in disguised words.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
PLAIN = words.LOWER.copy()
for _sign, _letter in STAND_INS.items():
    PLAIN[ord(_sign)] = ord(_letter)


def bare_words(w: words.Words) -> words.Words:
    """The same texts with every sign as a blank: words are runs of letters and digits."""
    data = np.where(IS_SIGN[w.data], np.uint8(32), w.data)
    return words.words_of(data, w.offsets)


def plain_words(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of ``w`` with stand-ins as letters and other signs left out, and whether that changed the word's letters.

    A sign that ends a word is punctuation, so only signs and digits with a letter behind them in the same word count.
    """
    disguise = (IS_SIGN | IS_DIGIT)[w.data]
    last_letter = np.full(len(w.starts), -1, np.int64)
    letters = np.flatnonzero(IS_LETTER[w.data])
    if len(letters) and len(w.starts):
        at = np.searchsorted(letters, w.ends) - 1
        last_letter = np.where((at >= 0) & (letters[at] >= w.starts), letters[np.maximum(at, 0)], -1)
    marks = np.concatenate([[0], np.cumsum(disguise)])
    first_letter = np.searchsorted(letters, w.starts)
    begin = letters[np.minimum(first_letter, len(letters) - 1)] if len(letters) else w.starts
    inner = np.where(last_letter >= 0, marks[np.maximum(last_letter, 0)] - marks[np.minimum(begin, np.maximum(last_letter, 0))], 0)
    chosen = np.flatnonzero(inner > 0)
    hashes = np.zeros(len(chosen), np.uint64)
    if len(chosen):
        length = last_letter[chosen] + 1 - w.starts[chosen]
        source = np.repeat(w.starts[chosen] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        raw = PLAIN[w.data[source]]
        owner = np.repeat(np.arange(len(chosen)), length)
        keep = ~IS_SIGN[raw]
        sizes = np.bincount(owner[keep], minlength=len(chosen))
        got = words.words_of(raw[keep], np.concatenate([[0], np.cumsum(sizes)]))
        full = np.flatnonzero(sizes > 0)
        hashes[full] = got.hashes[got.at[full]]
    return hashes, chosen


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _member(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted ``known``, -1 where it is not there."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def features_of(batch: pa.RecordBatch, text_column: str, learned: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Feature rows (float32) of the texts of a batch; ``learned`` are sorted word hashes with their weights."""
    w = words.batch_words(batch, text_column)
    bare = bare_words(w)
    sizes = np.maximum(np.diff(w.offsets), 1).astype(float)
    n_words = np.maximum(np.diff(bare.at), 1).astype(float)
    abuse = _member(bare.hashes, ABUSE_HASHES) >= 0
    found = _member(bare.hashes, learned)
    hit = abuse | (found >= 0)
    weight = np.where(found >= 0, weights[np.maximum(found, 0)] if len(weights) else 0.0, 0.0)
    person = _member(bare.hashes, PERSON_HASHES) >= 0
    upper = np.concatenate([[0], np.cumsum(IS_UPPER[bare.data])])
    shouted = (bare.ends - bare.starts >= 2) & (upper[bare.ends] - upper[bare.starts] == bare.ends - bare.starts)
    disguised, chosen = plain_words(w)
    caught = (_member(disguised, ABUSE_HASHES) >= 0) | (_member(disguised, learned) >= 0)
    person_at, hit_at = np.flatnonzero(person), np.flatnonzero(hit)
    near = np.zeros(len(hit_at), bool)
    owner = np.searchsorted(bare.at, hit_at, "right") - 1
    if len(person_at) and len(hit_at):
        for side, step in (("left", -1), ("right", 0)):
            k = np.clip(np.searchsorted(person_at, hit_at, side) + step, 0, len(person_at) - 1)
            other = person_at[k]
            near |= (np.abs(other - hit_at) <= NEAR) & (np.searchsorted(bare.at, other, "right") - 1 == owner)
    n, most = batch.num_rows, np.zeros(batch.num_rows)
    np.maximum.at(most, owner, weight[hit_at])
    hits = np.bincount(owner, minlength=n)
    first = np.ones(n)
    np.minimum.at(first, owner, (hit_at - bare.at[owner]) / n_words[owner])
    word_of = np.searchsorted(w.at, chosen, "right") - 1
    signs = IS_SIGN[w.data]
    same = np.zeros(len(w.data), bool)
    same[1:] = signs[1:] & (w.data[1:] == w.data[:-1])
    caught_by_doc = np.bincount(word_of[caught], minlength=n)
    out = np.stack(
        [
            _sums(abuse, bare.at) / n_words, _sums(found >= 0, bare.at) / n_words, _sums(weight, bare.at) / n_words, most, _sums(abuse, bare.at) > 0,
            np.bincount(owner[near], minlength=n), _sums(person, bare.at) / n_words, caught_by_doc / n_words, _sums(hit & shouted, bare.at),
            _sums(IS_UPPER[w.data], w.offsets) / sizes, _sums(shouted, bare.at) / n_words, _sums(signs, w.offsets) / sizes,
            _sums(w.data == 33, w.offsets) / sizes, _sums(same, w.offsets) / sizes, np.bincount(word_of, minlength=n) / n_words,
            _sums(IS_DIGIT[w.data], w.offsets) / sizes, np.log1p(np.diff(w.offsets)), hits + caught_by_doc, first,
        ],
        axis=1,
    )
    return out.astype(np.float32)


ABUSE_HASHES = np.unique(np.array([words.hash_word(x) for x in ABUSE], np.uint64))
PERSON_HASHES = np.unique(np.array([words.hash_word(x) for x in SECOND_PERSON], np.uint64))


def learn_words(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most LEARNED_WORDS word hashes that toxic texts use more often than others, sorted, with their weights.

    ``texts`` has text and label. A word counts once per text; it is taken if at least LEAST_DOCS toxic texts hold it and
    its log-likelihood ratio is at least LEAST_GAIN. Counts are combined before the shuffle; only the chosen words leave it.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                w = bare_words(words.batch_words(part))
                label = part.column("label").to_numpy(zero_copy_only=False)
                each = [np.unique(w.hashes[w.at[i] : w.at[i + 1]]) for i in range(part.num_rows)]
                hashes = np.concatenate(each) if each else np.zeros(0, np.uint64)
                toxic = np.repeat(label, [len(x) for x in each])
                got, index = np.unique(hashes, return_inverse=True)
                n, t = np.bincount(index, minlength=len(got)), np.bincount(index, weights=toxic, minlength=len(got))
                yield pa.record_batch([pa.array(got.view(np.int64)), pa.array(n, pa.int64()), pa.array(t.astype(np.int64))], ["h", "n", "t"])

    counts = texts.mapInArrow(distinct, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    total = texts.agg(F.count("*").alias("n"), F.sum("label").alias("t")).first()
    if not total["t"] or total["t"] == total["n"]:
        return np.zeros(0, np.uint64), np.zeros(0)
    share = total["t"] / total["n"]
    n, t = F.col("n"), F.col("t")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = 2 * (part(t, n * share) + part(n - t, n * (1 - share)))
    odds = F.log((t + 0.5) / (n - t + 0.5)) - float(np.log(share / (1 - share)))
    chosen = counts.where((t >= LEAST_DOCS) & (t / n > share)).select("h", gain.alias("gain"), odds.alias("odds")).where(F.col("gain") >= LEAST_GAIN)
    rows = chosen.orderBy(F.desc("gain"), "h").limit(LEARNED_WORDS).collect()
    hashes, odds = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["odds"] for r in rows], float)
    order = np.argsort(hashes)
    return hashes[order], odds[order]


def featurize(docs: DataFrame, text_column: str, name: str, learned: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """All rows and columns of ``docs`` and a last column ``name`` with the features (ARRAY<FLOAT>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in words.slices(b, text_column, SLICE)):
            rows = features_of(part, text_column, *learned)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.record_batch([*part.columns, flat], [*part.schema.names, name])
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(FloatType()))]))


@dataclass
class Scorer:
    """Fitted trees and calibration, or the rate that stands in for them (see module text)."""

    learned: tuple[np.ndarray, np.ndarray]
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None
    rate: float = 0.5

    def apply(self, docs: DataFrame, text_column: str = "text") -> DataFrame:
        """row (all columns of ``docs`` as they are) and score of every row."""
        from pyspark.ml.functions import array_to_vector

        if self.trees is None or self.steps is None:
            return docs.select(F.struct("*").alias("row"), F.lit(self.rate).alias("score"))
        name = fresh(docs, "features")
        rows = featurize(docs, text_column, name, self.learned)
        rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), array_to_vector(F.col(f"`{name}`")).alias("features"))
        scored = self.steps.transform(margin(self.trees, rows).select("row", "margin"))
        # The step function has ties; a small share of the trees' own value keeps their order.
        score = F.lit(0.98) * F.col("prediction") + F.lit(0.02) * F.col("margin")
        return scored.select("row", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def margin(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """``rows`` (with features) and margin, the trees' probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    return trees.transform(rows).withColumn("margin", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 0, folds: int = 5, id_column: str = "doc_id", text_column: str = "text") -> Scorer:
    """Learns from rows whose fold (crc32 of the id, modulo ``folds``) is not ``held_out``; ``labels`` has doc_id and ``label``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL AND NOT isnan(label)")
    known = known.where(fold_of(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / n))
    known = staged(known.withColumn("label", (F.col("label") > 0).cast("double")), "toxic-labels")
    # At most about FIT_ROWS rows of two numbers: small enough to send, so texts need no shuffle.
    marked = texts.join(F.broadcast(known), "id")
    # Which of the learning rows calibrate is a hash of the id, independent of the fold. Neither words nor trees are learned from them.
    calibrate = F.pmod(F.xxhash64(F.col("id"), F.lit("calibrate")), F.lit(4)) == 0
    learned = learn_words(marked.where(~calibrate).select("text", "label"))
    # The rows are bounded, but the scan before them isn't: it keeps its own tasks, and the exchange makes few files.
    rows = staged(featurize(marked, "text", "values", learned).drop("text").repartition(12, "id"), "toxic-features")
    rows = rows.select("id", "label", array_to_vector("values").alias("features"))
    train, check = rows.where(~calibrate), rows.where(calibrate)
    if any(p.select("label").distinct().count() < 2 for p in (train, check)):
        rate = rows.agg(F.avg("label").alias("rate")).first()["rate"]
        return Scorer(learned, rate=0.5 if rate is None else float(rate))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxDepth=4, maxIter=24, stepSize=0.25, maxBins=48, minInstancesPerNode=2, seed=7)
    trees = gbt.fit(train)
    steps = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margin(trees, check).select("margin", "label"))
    return Scorer(learned, trees, steps)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    scored = fit(docs, labels, label, held_out, folds).apply(docs.select("doc_id", "text"))
    held = F.coalesce(fold_of(F.col("row.doc_id"), folds) == held_out, F.lit(False))
    return scored.select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    return fit(docs, labels).apply(docs).where(F.col("score") < threshold).select("row.*")
