"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers (``quantize``), so scores are exact. Distances of every vector to many pivots are computed once and
kept in a table. For a query q and a vector x, every pivot p gives |d(q,p) - d(x,p)| <= d(q,x), and the largest of these is a
lower bound of the distance, hence (|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of the inner product. Candidates are
evaluated in the order of that bound until no bound left reaches the k-th best score found: the stop is exact.

The set of queries is laid against all rows in blocks: vectors lie in blocks of at most ``BLOCK`` rows, queries in blocks of at most
``QUERIES``. A grid of block numbers is joined first with the queries' blocks, then with the candidates'; so each block of
candidates is shuffled once, and each pair of blocks is one row, handled alone in numpy, with at most k rows a query as its
result. What meets in one task is two blocks at a time, however large the tables grow.

Defined cases: vectors that are NULL, or hold NULL or non-finite components, take no part, neither as query nor as
candidate; a vector of another length than the pivots' takes no part; a NULL id takes no part; ties go to the smaller id;
fewer than k candidates give fewer rows. Repeated rows of one id are candidates each, but never for a query of the same id; as
a query, a repeated id counts once, with its least vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askloom.llm.tables import staged

PIVOTS = 24
PIVOT_SAMPLE = 512
BLOCK = 4096
QUERIES = 256


def quantize(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """True for a non-empty vector whose components are all finite."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(wrong, F.lit(True))


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Pivots far from each other, out of at most PIVOT_SAMPLE vectors with the least hash of their id.

    Any choice gives exact results; the sample bounds only what the choice looks at.
    """
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()
    sizes = [len(r["v"]) for r in rows]
    if not rows:
        return np.zeros((0, 0))
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    sample = np.array([r["v"] for r in rows if len(r["v"]) == size], float)
    chosen = [int(np.argmax((sample**2).sum(1)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _pack(ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, part: int) -> pa.RecordBatch:
    """One block: ids, integer vectors, and the pivot table (distances, one row a pivot)."""
    wide = vectors.astype(float)
    squares = ((wide[:, None, :] - pivots[None, :, :]) ** 2).sum(2) if len(pivots) else np.zeros((len(ids), 0))
    columns = [part], [len(ids)], [ids.tobytes()], [vectors.astype(np.int64).tobytes()], [np.sqrt(squares).T.tobytes()]
    kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "n", "ids", "vectors", "table"])


def blocks(vectors: DataFrame, pivots: np.ndarray, most: int) -> DataFrame:
    """Blocks of at most ``most`` vectors with their pivot table; written by the caller, so each keeps its number."""
    size = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        ids, held = np.zeros(0, np.int64), np.zeros((0, size), np.int64)
        for batch in batches:
            column = batch.column("v")
            right = np.flatnonzero(np.asarray(column.value_lengths()) == size)
            column = column.take(pa.array(right))
            ids = np.concatenate([ids, batch.column("id").to_numpy()[right]])
            held = np.concatenate([held, column.flatten().to_numpy().reshape(-1, size)])
            while len(ids) >= most:
                yield _pack(ids[:most], held[:most], pivots, part)
                ids, held, part = ids[most:], held[most:], part + 1
        if len(ids):
            yield _pack(ids, held, pivots, part)

    return vectors.mapInArrow(run, "block long, n long, ids binary, vectors binary, table binary")


def search_block(queries: tuple, candidates: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query ids, candidate ids and scores of the k best of one block of candidates for each query, and the number evaluated.

    Queries and candidates are (ids, integer vectors, pivot table).
    """
    q_ids, q, q_table = queries
    c_ids, c, c_table = candidates
    c_squares, out, evaluated = (c.astype(float) ** 2).sum(1), [], 0
    for i in range(len(q_ids)):
        bound = np.zeros(len(c_ids))
        for p in range(len(c_table)):
            np.maximum(bound, np.abs(c_table[p] - q_table[p, i]), out=bound)
        squares = (q[i].astype(float) ** 2).sum() + c_squares
        # The margin covers the rounding of roots and squares; scores themselves are integers.
        reach = (squares - bound**2) / 2 + 1e-9 * (1 + squares)
        order = np.argsort(-reach, kind="stable")
        order = order[c_ids[order] != q_ids[i]]
        best_ids, best, least = np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf
        begin, step = 0, 64
        while begin < len(order) and reach[order[begin]] >= least:
            these = order[begin : begin + step]
            evaluated += len(these)
            best_ids, best = np.concatenate([best_ids, c_ids[these]]), np.concatenate([best, c[these] @ q[i]])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
            if len(best) == k:
                least = best[-1]
            begin, step = begin + step, min(4 * step, 2048)
        out.append((np.full(len(best_ids), q_ids[i]), best_ids, best))
    found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return *found, evaluated


def _unpack(ids: bytes, vectors: bytes, table: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.int64).reshape(len(ids), size), np.frombuffer(table, float).reshape(-1, len(ids))


def _searched(pairs: DataFrame, k: int, size: int) -> DataFrame:
    """query_id, vec_id, score of every pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                queries = _unpack(row["q_ids"], row["q_vectors"], row["q_table"], size)
                candidates = _unpack(row["ids"], row["vectors"], row["table"], size)
                q, c, s, _ = search_block(queries, candidates, k)
                yield pa.record_batch([pa.array(q), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query against all other rows."""
    chosen = vectors.where(usable(F.col(f"`{vector_column}`")) & F.col(f"`{id_column}`").isNotNull())
    chosen = chosen.select(F.col(f"`{id_column}`").cast("long").alias("id"), quantize(F.col(f"`{vector_column}`"), scale).alias("v"), is_query.alias("is_query"))
    pivots = choose_pivots(chosen)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = pivots.shape[1]
    candidates = staged(blocks(chosen.select("id", "v"), pivots, BLOCK), "vector-blocks")
    asked = staged(chosen.where("is_query").groupBy("id").agg(F.min("v").alias("v")), "queries")
    parts = 1 + asked.count() // QUERIES
    queries = blocks(asked.repartition(parts, "id"), pivots, QUERIES)
    queries = staged(queries.select((F.shiftright("block", 32)).alias("part"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "table")]), "query-blocks")
    grid = candidates.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    found = _searched(grid.join(queries, "part").join(candidates, "block"), k, size)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
