"""Operator 10: nearest neighbours by randomly rotated one-bit codes.

Every vector is indexed.  Vectors lie in cells about centroids, which are fitted on a
sample, and a cell in blocks.  Within a block each vector is taken relative to the
block's centre, scaled to length one, rotated at random into MIN_BITS dimensions or
more, and kept as one packed sign bit for each, with two scalars: its distance to the
centre and the inner product of the unit vector with its code.  A query is rotated the
same way and cut into bit planes, so that AND and counting bits give its inner product
with a code; with the scalars that is an unbiased estimate of the distance, with a
bound on its error.

1. Each query searches one block of its own cell, which bounds its k-th distance.
2. Queries lie in lots by cell.  A lot meets a block only if the triangle inequality
   lets some vector of the block be near enough; there the codes are scanned, and
   only vectors whose lower bound reaches the k-th distance are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import bound_batches, map_batches, written

#: Bytes of the vectors in a block of the index, and in a lot of queries, about.
BLOCK_BYTES, LOT_BYTES = 2 << 20, 1 << 19
#: Bits of a code, at least; longer vectors have one for each dimension.
MIN_BITS = 256
#: Bit planes of a rotated query.
PLANES = 6
#: Standard deviations of the estimate that the bound allows for.
SLACK = 3.0
#: Vectors that the centroids are fitted on, about, and centroids, at most.
SAMPLE, CELLS = 8_192, 256
#: Rows that are broadcast, at most; more are joined by a shuffle.
SMALL = 100_000
SEED = 7

INDEX = "dim int, cell int, sub int, ids binary, vectors binary, codes binary, norms binary, agreements binary, centre binary, radius double"
LOT = "dim int, cell int, lot int, q_ids binary, queries binary, reaches binary"
FOUND = "query_id long, vec_id long, score double"
BLOCK = ["dim", "cell", "sub"]


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """``dim`` rows that are orthonormal in as many dimensions as a code has bits."""
    bits = -(-max(dim, MIN_BITS) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length, as rows."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T)


def centroids(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """k-means, a few rounds from random rows."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = squares(sample, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def encode_block(ids: np.ndarray, vectors: np.ndarray) -> dict:
    centre = vectors.mean(axis=0)
    rest = vectors - centre
    norms = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(norms > 0, norms, 1)[:, None]) @ rotation(vectors.shape[1])
    return {
        "ids": ids.astype("<i8").tobytes(),
        "vectors": vectors.astype("<f8").tobytes(),
        # word by word, so that a scan reads each word of all codes in a row
        "codes": np.packbits(turned > 0, axis=1, bitorder="little").view("<u8").T.tobytes(),
        "norms": norms.astype("<f8").tobytes(),
        "agreements": (np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])).astype("<f8").tobytes(),
        "centre": centre.astype("<f8").tobytes(),
        "radius": float(norms.max()),
    }


class Block:
    def __init__(self, row: dict):
        self.centre = np.frombuffer(row["centre"], "<f8")
        self.ids = np.frombuffer(row["ids"], "<i8")
        dim, n = len(self.centre), len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(n, dim)
        self.codes = np.frombuffer(row["codes"], "<u8").reshape(-1, n)
        self.bits = 64 * len(self.codes)
        self.ones = np.bitwise_count(self.codes).sum(axis=0, dtype=np.int32)
        self.norms, agree = np.frombuffer(row["norms"], "<f8"), np.frombuffer(row["agreements"], "<f8")
        self.agree = np.where(agree > 0, agree, 1)
        self.error = np.sqrt(np.maximum(0, 1 - self.agree**2)) / self.agree * (SLACK / np.sqrt(max(1, self.bits - 1)))
        self.radius = row["radius"]
        self.compared = 0

    def estimates(self, turned: np.ndarray) -> np.ndarray:
        """Inner products of the unit vectors with a rotated unit vector, from packed bits."""
        low, step = turned.min(), max(np.ptp(turned), 1e-12) / (2**PLANES - 1)
        levels = np.rint((turned - low) / step).astype(np.uint8)
        planes = [np.packbits((levels >> p) & 1, bitorder="little").view("<u8") for p in range(PLANES)]
        total = np.zeros(len(self.ids), np.int32)
        for i, words in enumerate(self.codes):
            for p, plane in enumerate(planes):
                total += np.bitwise_count(words & plane[i]).astype(np.int32) << p
        inside = low * self.ones + step * total
        return (2 * inside - (low * self.bits + step * levels.sum())) / np.sqrt(self.bits) / self.agree

    def top(self, query_id: int, query: np.ndarray, reach: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest within ``reach``."""
        away = query - self.centre
        length = float(np.linalg.norm(away))
        turned = (away / length if length > 0 else away) @ rotation(len(query))
        scale = 2 * self.norms * length
        square = self.norms**2 + length**2 - scale * self.estimates(turned)
        own = self.ids == query_id
        n = min(k, int(len(self.ids) - own.sum()))
        if n <= 0:
            return self.ids[:0], self.norms[:0]
        square[own] = np.inf
        first = np.argpartition(square, n - 1)[:n]
        if n == k:
            reach = min(reach, ((self.vectors[first] - query) ** 2).sum(axis=1).max())
        # a hair of slack, so that rounding can't drop a vector as near as the k-th
        near = np.flatnonzero((square - scale * self.error <= reach + 1e-9 * (1 + reach)) & ~own)
        self.compared += len(near)
        distance = np.sqrt(((self.vectors[near] - query) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[near], distance))[:k]
        return self.ids[near][best], distance[best]


def with_cells(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Add ``dim`` and ``cell``, the nearest centroid of that length (0 if none was fitted)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1).value_lengths())
            cells = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) in shared.value:
                    cells[at] = squares(stacked(pa.chunked_array([batch.column(1).take(pa.array(at))])), shared.value[int(dim)]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(cells)], names=["vec_id", "embedding", "dim", "cell"])

    return map_batches(vectors, run, "vec_id long, embedding array<double>, dim int, cell int")


def small(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if ``rows``, a checked size, allows it."""
    return F.broadcast(df) if rows <= SMALL else df


def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Deal the vectors of each cell by hash into parts of ``size`` bytes, about."""
    parts = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") * F.first("dim") * 8 / size).cast("int").alias("parts"))
    parts = written(parts, "nearest-parts")
    rows = rows.join(small(parts, parts.count()), ["dim", "cell"])
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "embedding", F.lit(len(name))), F.col("parts")).cast("int"))


def index(vectors: DataFrame) -> DataFrame:
    """One row for each block; ``vectors`` has vec_id, embedding, dim and cell."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        row = dict(zip(BLOCK, (k.as_py() for k in key), strict=True)) | encode_block(group.column("vec_id").to_numpy(), stacked(group.column("embedding")))
        kinds = {bytes: pa.binary(), int: pa.int32(), float: pa.float64()}
        return pa.table({k: pa.array([v], kinds[type(v)]) for k, v in row.items()})

    return written(dealt(vectors, BLOCK_BYTES, "sub").groupBy(*BLOCK).applyInArrow(run, INDEX), "nearest-index")


def lots_of(asked: DataFrame) -> DataFrame:
    """Queries (vec_id, embedding, reach, dim, cell) as one row for each lot."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        cells = [*(pa.array([k.as_py()], pa.int32()) for k in key), group.column("vec_id").to_numpy().astype("<i8").tobytes(), stacked(group.column("embedding")).astype("<f8").tobytes(), group.column("reach").to_numpy().astype("<f8").tobytes()]
        return pa.table([c if isinstance(c, pa.Array) else pa.array([c], pa.binary()) for c in cells], names=[c.split()[0] for c in LOT.split(", ")])

    return dealt(asked, LOT_BYTES, "lot").groupBy("dim", "cell", "lot").applyInArrow(run, LOT)


def search_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of the block, for each query of the lot, of each row of ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                block, q_ids = Block(row), np.frombuffer(row["q_ids"], "<i8")
                queries, reaches = np.frombuffer(row["queries"], "<f8").reshape(len(q_ids), -1), np.frombuffer(row["reaches"], "<f8")
                out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                gap = np.sqrt(((queries - block.centre) ** 2).sum(axis=1)) - block.radius
                for j in np.flatnonzero(gap <= reaches * (1 + 1e-9) + 1e-9):
                    ids, distances = block.top(q_ids[j], queries[j], reaches[j] ** 2, k)
                    out.append((np.full(len(ids), q_ids[j]), ids, distances))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    columns = [c.split()[0] for c in INDEX.split(", ")] + ["q_ids", "queries", "reaches"]
    return pairs.select(*columns).mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, query: Column, k: int = 10) -> DataFrame:
    """The k nearest other vectors of each row for which ``query`` holds.

    query_id, rank, vec_id, score: the Euclidean distance in double precision,
    nearest first, ties to the smaller vec_id.  Null, empty and zero vectors and
    those with null or non-finite components take no part; vectors of unlike
    length aren't compared; a row isn't its own neighbour, nor is another row with
    its vec_id.  Repeated rows are neighbours of their own, but each id asks once,
    with the least of its vectors.  A lot of queries and a block of the index are one
    row of work, so no task holds more than two blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    bound_batches(spark)
    n = rows.count()
    sample = rows.select("embedding").sample(min(1.0, SAMPLE / max(1, n)), seed=SEED).limit(2 * SAMPLE).toArrow().column(0)
    dims = np.asarray(sample.combine_chunks().value_lengths()) if len(sample) else np.zeros(0, int)
    centres = {}
    for dim in np.unique(dims).tolist():
        own = stacked(sample.take(pa.array(np.flatnonzero(dims == dim))))
        centres[dim] = centroids(own, int(np.clip(n * dim * 8 * len(own) / max(1, len(dims)) / BLOCK_BYTES, 1, min(CELLS, len(own)))))
    asked = with_cells(rows.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", "embedding"), centres)
    asked = written(asked, "nearest-queries")
    blocks = index(with_cells(rows.select("vec_id", "embedding"), centres))
    heads = written(blocks.select(*BLOCK, "centre", "radius"), "nearest-heads")
    n_heads = heads.count()

    # how far the k-th nearest can be: from one block of the query's own cell
    first = lots_of(asked.withColumn("reach", F.lit(float("inf")))).withColumnRenamed("lot", "some_lot")
    home = heads.groupBy("dim", "cell").agg(F.count("*").alias("subs"))
    first = first.join(small(home, n_heads), ["dim", "cell"]).withColumn("sub", F.pmod("some_lot", "subs").cast("int"))
    found = search_pairs(blocks.join(first, BLOCK), k)
    reach = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("reach"))
    asked = asked.join(reach, asked["vec_id"] == reach["query_id"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    lots = written(lots_of(asked.select("vec_id", "embedding", "dim", "cell", "reach")).withColumnRenamed("cell", "q_cell"), "nearest-lots")

    def may_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for queries, reaches, centre, radius in zip(*(batch.column(c).to_pylist() for c in ("queries", "reaches", "centre", "radius")), strict=True):
                centre = np.frombuffer(centre, "<f8")
                gap = np.sqrt(((np.frombuffer(queries, "<f8").reshape(-1, len(centre)) - centre) ** 2).sum(axis=1)) - radius
                fine.append(bool((gap <= np.frombuffer(reaches, "<f8") * (1 + 1e-9) + 1e-9).any()))
            yield batch.select(["dim", "q_cell", "lot", "cell", "sub", "q_ids", "queries", "reaches"]).filter(pa.array(fine, pa.bool_()))

    questions = lots.join(small(heads, n_heads), "dim").mapInArrow(may_meet, "dim int, q_cell int, lot int, cell int, sub int, q_ids binary, queries binary, reaches binary")
    found = search_pairs(blocks.join(questions, BLOCK), k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
