"""A stored table with one row a key, changed by batches: only the pieces that hold a changed key are written again.

Rows lie in ``parts`` by a hash of their key. A batch writes a segment, a folder for each part it touches; what is in force is a list of pieces
(part, segment) in a manifest. A key is held by one piece at most. A batch finds the pieces that hold its keys in two steps: a Bloom filter of
each piece names candidates, and the key column of the candidates confirms them. Confirmed pieces are read, merged with the batch and replaced
by the batch's own segment; all other pieces keep their files, and a batch of new keys rewrites nothing.

The manifest is written last and every change has a new one: a change that fails before leaves folders that nothing refers to, and can be
repeated. A batch that is applied twice changes no row. One writer at a time; a second one's change fails.

The row with the greatest ``order`` of a key wins; between equal ones the stored row, within a batch the greatest row. Rows without a key are
left out; a NULL order is less than any other. Columns that the store does not have are left out, missing ones are NULL.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from askloom.session import is_small, staged

HASHES = 4
BITS_PER_KEY = 10
BLOCK_BITS = 15  # fixed value: bitmaps of Spark's functions hold 32,768 bits
FEW_ROWS = 100_000
PIECE = StructType().add("segment", "string").add("part", "integer")


def _spots(key: Column, power: Column) -> Column:
    """Bit numbers of ``key`` in a filter of ``2 ** power`` bits."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), power) - 1
    return F.array(*[F.xxhash64(key, F.lit(k)).bitwiseAND(mask) for k in range(HASHES)])


def _is_set(bits: Column, spot: Column) -> Column:
    place = spot.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substr(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1


class KeyedStore:
    """The store in the folder ``root``, which all executors must share."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, order: str, parts: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = StructType.fromDDL(schema)
        self.key, self.order, self.parts = key, order, parts
        self.rest = [c for c in self.schema.names if c not in (key, order)]

    # State ------------------------------------------------------------------------------------------------------

    def _version(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        names = [s.getPath() for s in fs.listStatus(path)]
        return max((int(p.getName()) for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=0)

    def _state(self) -> tuple[int, list[tuple[int, str]]]:
        version = self._version()
        if not version:
            return 0, []
        rows = self.spark.read.schema("part int, segment string").parquet(f"{self.root}/manifest/{version}").collect()
        return version, sorted((r["part"], r["segment"]) for r in rows)

    def pieces(self) -> list[tuple[int, str]]:
        """(part, segment) of every folder in force: at most ``parts`` for each batch."""
        return self._state()[1]

    def _read(self, pieces: Sequence[tuple[int, str]]) -> DataFrame:
        schema = StructType([*self.schema.fields, *PIECE.fields])
        if not pieces:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/data/segment={s}/part={p}" for p, s in pieces]
        return self.spark.read.option("basePath", f"{self.root}/data").schema(schema).parquet(*paths)

    def table(self) -> DataFrame:
        return self._read(self.pieces()).select(*self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``; reads only the parts of their hashes and, by the filters, only pieces that may hold them."""
        pieces = self.pieces()
        asked = staged(self._keyed(keys.select(self.key)).distinct(), "asked")
        held = self._read(self._candidates(asked, pieces)[0])
        return held.join(self._side(asked.select(self.key)), self.key, "left_semi").select(*self.schema.names)

    # Changes ----------------------------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame) -> list[tuple[int, str]]:
        """Applies a batch; returns the pieces that it replaced."""
        have = set(rows.columns)
        plain = rows.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        fresh = staged(self._keyed(self._newest(plain.withColumn("_stored", F.lit(0)))), "batch")
        version, pieces = self._state()
        hit = self._holding(fresh.select("part", self.key), pieces)
        both = fresh.select(*self.schema.names, F.lit(0).alias("_stored")).unionByName(self._read(hit).select(*self.schema.names, F.lit(1).alias("_stored")))
        self._replace(version, pieces, hit, self._newest(both))
        return hit

    def delete(self, keys: DataFrame) -> list[tuple[int, str]]:
        """Deletes ``keys`` wherever they are held; returns the pieces that it replaced."""
        gone = staged(self._keyed(keys.select(self.key)).distinct(), "gone")
        version, pieces = self._state()
        hit = self._holding(gone, pieces)
        if hit:
            self._replace(version, pieces, hit, self._read(hit).join(self._side(gone.select(self.key)), self.key, "left_anti"))
        return hit

    def merge(self, most: int = 1) -> list[tuple[int, str]]:
        """One piece in place of the pieces of every part that has more than ``most``."""
        version, pieces = self._state()
        each: dict[int, list[tuple[int, str]]] = {}
        for piece in pieces:
            each.setdefault(piece[0], []).append(piece)
        old = [piece for held in each.values() if len(held) > most for piece in held]
        if old:
            self._replace(version, pieces, old, self._read(old))
        return old

    def _keyed(self, rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        return rows.filter(F.col(self.key).isNotNull()).withColumn("part", part)

    def _side(self, df: DataFrame) -> DataFrame:
        """A staged table with the broadcast hint if its rows, counted, are few."""
        return F.broadcast(df) if is_small(df) and df.count() <= FEW_ROWS else df

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row a key. The maximum is combined before the shuffle, so a key with most of the rows is one row a task."""
        best = rows.groupBy(self.key).agg(F.max(F.struct(self.order, "_stored", *self.rest)).alias("_best"))
        return best.select(*[F.col(self.key) if c == self.key else F.col(f"_best.`{c}`") for c in self.schema.names])

    def _candidates(self, keys: DataFrame, pieces: Sequence[tuple[int, str]]) -> tuple[list[tuple[int, str]], DataFrame]:
        """Pieces whose filters name one of ``keys`` (part, key), and these keys with their segment."""
        segments = sorted({s for _, s in pieces})
        if not segments:
            return [], keys.withColumn("segment", F.lit("")).limit(0)
        schema = "part int, power int, block long, bits binary, segment string"
        paths = [f"{self.root}/filters/segment={s}" for s in segments]
        in_force = self.spark.createDataFrame(pieces, "part int, segment string")
        stored = self.spark.read.option("basePath", f"{self.root}/filters").schema(schema).parquet(*paths)
        filters = stored.join(F.broadcast(in_force), ["part", "segment"], "left_semi")
        sizes = filters.select("part", "segment", "power").distinct()
        asked = keys.join(sizes, "part").select("part", "segment", self.key, F.explode(_spots(F.col(self.key), F.col("power"))).alias("spot"))
        asked = asked.withColumn("block", F.shiftright("spot", BLOCK_BITS))
        # Two hashes of a key may fall on one bit, so bits are counted as they are asked.
        met = asked.join(filters, ["part", "segment", "block"]).filter(_is_set(F.col("bits"), F.col("spot")))
        full = met.groupBy("part", "segment", self.key).agg(F.count("*").alias("n")).filter(F.col("n") == HASHES)
        found = staged(full.select("part", "segment", self.key), "candidates")
        return sorted((r["part"], r["segment"]) for r in found.select("part", "segment").distinct().collect()), found

    def _holding(self, keys: DataFrame, pieces: Sequence[tuple[int, str]]) -> list[tuple[int, str]]:
        """Pieces that hold one of ``keys``: candidates of the filters, confirmed by their key column."""
        candidates, found = self._candidates(keys, pieces)
        if not candidates:
            return []
        held = self._read(candidates).select("part", "segment", self.key)
        sure = held.join(self._side(found), ["part", "segment", self.key], "left_semi")
        return sorted((r["part"], r["segment"]) for r in sure.select("part", "segment").distinct().collect())

    def _replace(self, version: int, pieces: Sequence[tuple[int, str]], old: Sequence[tuple[int, str]], rows: DataFrame) -> None:
        """A new segment of ``rows`` in place of ``old``."""
        name = uuid.uuid4().hex
        placed = self._keyed(rows.select(*self.schema.names)).repartitionByRange("part", self.key).sortWithinPartitions("part", self.key)
        placed.write.partitionBy("part").parquet(f"{self.root}/data/segment={name}")
        schema = StructType([self.schema[self.key], PIECE["part"]])
        keys = self.spark.read.schema(schema).parquet(f"{self.root}/data/segment={name}")
        bits = F.ceil(F.log2(F.col("n") * BITS_PER_KEY)).cast("int")
        sizes = keys.groupBy("part").agg(F.count("*").alias("n")).select("part", F.greatest(bits, F.lit(BLOCK_BITS)).alias("power"))
        sizes = staged(sizes, "sizes")
        spots = keys.join(F.broadcast(sizes), "part").select("part", "power", F.explode(_spots(F.col(self.key), F.col("power"))).alias("spot"))
        place = F.col("spot").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        filters = spots.groupBy("part", "power", F.shiftright("spot", BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(place).alias("bits"))
        filters.write.parquet(f"{self.root}/filters/segment={name}")
        gone = set(old)
        new = [(r["part"], name) for r in sizes.select("part").collect()]
        manifest = self.spark.createDataFrame([p for p in pieces if p not in gone] + new, "part int, segment string")
        manifest.coalesce(1).write.parquet(f"{self.root}/manifest/{version + 1}")
