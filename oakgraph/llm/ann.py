"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index: every vector is centred, normalised and turned by a random orthogonal map into CODE_FACTOR times as many
dimensions (at least 64); its code is the packed signs, beside the distance to the centre and the inner product of
vector and code, which corrects estimates. The centre is fitted on a bounded sample and kept with the index; every row is indexed.

Search: a query is turned by the same map and rounded to QUERY_BITS bits a dimension, so that its inner product with a code is a sum of
counts of common bits: of the code's 64-bit words and the words of each of the query's bit planes. The correction makes
it an estimate of the inner product of the vectors, with an error bound of ERROR_SCALE standard widths for the code and for the
rounding of the query. Original vectors are gathered for those alone whose lower bound of the distance does not exceed what the
query has: first its k-th smallest distance to a bounded sample of the index, known before the search, then, block by block of a task,
the k-th smallest that it has found. So thresholds are tight from the first block on. Tasks hand on k rows a query at most, and a
window with a map-side limit merges them.

Queries come in tiles of TILE_BYTES at most, and each tile is handed to all tasks: a stated query set against all
rows, in blocks, without a shuffle of the index and without any pair leaving its task but the k best. Of several tiles, one is held at a
time: its results are written and it is released.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors meet only those of their own length; a query never finds rows with its own
id; ties go to the smaller id; with fewer than k candidates all are returned; equal rows (same id and vector) count
once; pairs without finite bounds (norms near the largest double) are reranked; an empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize

CODE_FACTOR = 4
QUERY_BITS = 4
ERROR_SCALE = 3.0
TILE_BYTES = 32 << 20  # of queries, with their planes
BLOCK = 4096  # index rows that one numpy step compares
QUERY_STEP = 32
CENTRE_SAMPLE = 20_000
#: Rows of the index that every query is compared with beforehand, and their bytes at most.
FIRST_ROWS, FIRST_BYTES = 2_048, 16 << 20
SEED = 7


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """(dim, bits) with orthonormal rows, the same in every process."""
    bits = max(64, -(-CODE_FACTOR * dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T.astype(np.float32)


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where("id is not null and size(vec) > 0")
    return rows.where(~bad & F.exists("vec", lambda x: x != 0))


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of a sample of each length: of the CENTRE_SAMPLE rows whose ids have the smallest hashes."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(CENTRE_SAMPLE)
    means = sample.select(F.size("vec").alias("dim"), F.posexplode("vec").alias("pos", "x")).groupBy("dim", "pos").agg(F.avg("x").alias("x")).orderBy("dim", "pos")
    found: dict[int, list[float]] = {}
    for r in means.collect():
        found.setdefault(r["dim"], []).append(r["x"])
    return {d: np.array(c) for d, c in found.items()}


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, vectors) of a batch of (id, vec)."""
    vec = batch.column(1)
    sizes = np.diff(vec.offsets.to_numpy())
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, flat[starts[at][:, None] + np.arange(dim)]


INDEX = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("code", T.BinaryType()),
    T.StructField("norm", T.DoubleType()), T.StructField("fit", T.FloatType()),
])


class Index(NamedTuple):
    rows: DataFrame  # INDEX, a written table
    centres: dict[int, np.ndarray]  # by length


def build_index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", path: str | None = None) -> Index:
    """The index of every row that takes part: packed signs, distance to the centre, inner product of unit vector and code. With path
    it is kept there, for load_index()."""
    rows = valid(df, id_col, vec_col).dropDuplicates(["id", "vec"])
    middle = centres(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in blocks(batch):
                turn = rotation(dim)
                off = x - middle.get(dim, 0.0)
                norm = np.linalg.norm(off, axis=1)
                turned = (off / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32) @ turn
                fit = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
                codes = np.packbits(turned > 0, axis=1)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float64()), pa.array(fit.astype(np.float32))], names=INDEX.names)

    found = rows.mapInArrow(run, INDEX)
    if path is None:
        return Index(materialize(found, "ann-index"), middle)
    found.write.parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.createDataFrame([(d, c.tolist()) for d, c in middle.items()], "dim int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> Index:
    kept = spark.read.schema("dim int, centre array<double>").parquet(f"{path}/centres").collect()
    return Index(spark.read.schema(INDEX).parquet(f"{path}/rows"), {r["dim"]: np.array(r["centre"]) for r in kept})


def words_of(bits: np.ndarray) -> np.ndarray:
    """(words, rows): 0/1 of each row, padded with 0 and packed into 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64).T)


class Tile:
    """Queries of one length, centred, turned and rounded: value = low + step * the number in the bit planes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: np.ndarray, centre: np.ndarray):
        self.ids, self.vectors, self.reach = ids, vectors, reach.copy()
        off = vectors - centre
        self.norm = np.linalg.norm(off, axis=1)
        turned = (off / np.where(self.norm > 0, self.norm, 1)[:, None]).astype(np.float32) @ rotation(vectors.shape[1])
        self.bits, self.low = turned.shape[1], turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**QUERY_BITS - 1), 1e-9)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [words_of(whole >> b & 1) for b in range(QUERY_BITS)]
        self.total = whole.sum(axis=1, dtype=np.int64)
        lost = turned - (self.low[:, None] + self.step[:, None] * whole)
        self.lost = np.linalg.norm(lost, axis=1) * ERROR_SCALE / np.sqrt(self.bits)

    def estimate(self, part: slice, codes: np.ndarray) -> np.ndarray:
        """Inner products of rounded queries and codes (words, rows) of unit length."""
        common = np.zeros((len(self.ids[part]), codes.shape[1]), np.int32)
        for b, plane in enumerate(self.planes):
            for w, word in enumerate(codes):
                common += np.bitwise_count(plane[w, part, None] & word).astype(np.int32) << b
        ones = np.bitwise_count(codes).sum(axis=0, dtype=np.int64)
        low, step = self.low[part, None], self.step[part, None]
        return (low * (2 * ones - self.bits) + step * (2 * common - self.total[part, None])) / np.sqrt(self.bits)


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    gap = left - right
    return np.sqrt(np.add.accumulate(gap * gap, axis=1)[:, -1])


class Best:
    """The k best of each query of a tile so far, as a table in the order of queries, distances and ids."""

    def __init__(self, tile: Tile, k: int):
        self.tile, self.k, self.reranked = tile, k, 0
        self.q, self.i, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, q: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
        """q: places in the tile. Tightens how far the tile's queries reach."""
        q, i, d = np.concatenate([self.q, q]), np.concatenate([self.i, i]), np.concatenate([self.d, d])
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        first = np.searchsorted(q, np.arange(len(self.tile.ids)))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.i, self.d = q[keep], i[keep], d[keep]
        last = np.flatnonzero(np.bincount(self.q, minlength=len(first)) == self.k)
        ends = np.searchsorted(self.q, last, "right") - 1
        self.tile.reach[last] = np.minimum(self.tile.reach[last], self.d[ends])

    def search_block(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> None:
        """Compare the tile with a block of the index: by the bounds, then, the likeliest first, exactly."""
        tile, found = self.tile, []
        words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64).T)
        fit = np.maximum(fit.astype(np.float64), 1e-6)
        width = ERROR_SCALE * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(tile.bits - 1)
        for s in range(0, len(tile.ids), QUERY_STEP):
            part = slice(s, s + QUERY_STEP)
            qn, own = tile.norm[part, None], tile.ids[part, None] == ids
            scale = 2 * qn * norm
            mid = qn**2 + norm**2 - scale * (tile.estimate(part, words) / fit)
            slack = scale * (width + tile.lost[part, None] / fit) + 1e-5 * (qn**2 + norm**2)
            lower = mid - slack
            lower[~np.isfinite(lower)] = -np.inf  # no bound: to rerank
            lower[own] = np.inf
            reach = tile.reach[part].copy()
            if lower.shape[1] > self.k:  # the k likeliest tell how far to look
                near = np.argpartition(np.where(own, np.inf, mid), self.k - 1, axis=1)[:, : self.k]
                rows = np.repeat(np.arange(len(near)), self.k)
                d = distances(vectors[near.ravel()], tile.vectors[s + rows]).reshape(near.shape)
                d[np.take_along_axis(own, near, 1)] = np.inf
                reach = np.fmin(reach, d.max(axis=1))
            rows, cols = np.nonzero(~(lower > (reach**2)[:, None]) & ~own)
            self.reranked += len(rows)
            for a in range(0, len(rows), 100_000):
                r, c = rows[a : a + 100_000], cols[a : a + 100_000]
                d = distances(vectors[c], tile.vectors[s + r])
                good = ~(d > reach[r])
                found.append((s + r[good], ids[c][good], d[good]))
        if found:
            self.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def tiles(table: pa.Table, centre: dict[int, np.ndarray]) -> dict[int, Tile]:
    """Of (id, vec, reach), by length."""
    held: dict[int, list] = {}
    for batch in table.to_batches():
        for dim, at, x in blocks(batch):
            held.setdefault(dim, []).append((batch.column(0).to_numpy()[at], x, batch.column(2).to_numpy()[at]))
    return {d: Tile(*(np.concatenate(x) for x in zip(*parts, strict=True)), centre.get(d, np.zeros(d))) for d, parts in held.items()}


def with_reach(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """queries (id, vec), with the column reach: the k-th smallest distance to FIRST_ROWS rows of the index, those with the smallest hashes
    of their ids, or infinity if these hold fewer; a written table."""
    longest = index.rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(1))).first()[0]
    number = min(FIRST_ROWS, max(1, FIRST_BYTES // (8 * longest)))
    sent = queries.sparkSession.sparkContext.broadcast(index.rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(number).toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {}
        for batch in sent.value.to_batches():
            for dim, at, x in blocks(batch):
                first.setdefault(dim, []).append((batch.column(0).to_numpy()[at], x))
        for batch in batches:
            ids, reach = batch.column(0).to_numpy(), np.full(len(batch), np.inf)
            for dim, at, x in blocks(batch):
                known, vectors = (np.concatenate(p) for p in zip(*first[dim], strict=True)) if dim in first else (np.zeros(0, np.int64), np.zeros((0, dim)))
                if len(known) > k:
                    for row, v in zip(at, x, strict=True):
                        d = distances(vectors, v)
                        d[known == ids[row]] = np.inf
                        reach[row] = np.partition(d, k - 1)[k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach)], names=["id", "vec", "reach"])

    kind = T.StructType([*INDEX.fields[:2], T.StructField("reach", T.DoubleType())])
    found = materialize(queries.select("id", "vec").mapInArrow(run, kind), "ann-queries")
    sent.unpersist()
    return found


HIT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query. queries: (id, vec) rows from valid()."""
    spark, middle = index.rows.sparkSession, index.centres
    queries = with_reach(index, queries, k)
    held = queries.agg(F.coalesce(F.sum(F.size("vec").cast("long") * (8 + CODE_FACTOR * QUERY_BITS // 8) + 64), F.lit(0))).first()[0]
    parts = -(-held // (TILE_BYTES * 4 // 5)) or 1  # even by hash; a tile stays below TILE_BYTES
    hits = None
    for p in range(parts):
        sent = spark.sparkContext.broadcast(queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).toArrow())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = {dim: Best(tile, k) for dim, tile in tiles(sent.value, middle).items()}
            for batch in batches:
                for start in range(0, len(batch), BLOCK):
                    part = batch.slice(start, BLOCK)
                    for dim, at, x in blocks(part):
                        if dim in best:
                            got = part.take(pa.array(at))
                            codes = np.frombuffer(b"".join(got.column(2).to_pylist()), np.uint8).reshape(len(at), -1)
                            best[dim].search_block(got.column(0).to_numpy(), x, codes, got.column(3).to_numpy(), got.column(4).to_numpy())
            for b in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(b.tile.ids[b.q]), pa.array(b.i), pa.array(b.d)], names=HIT.names)

        got = index.rows.mapInArrow(run, HIT)
        if parts > 1:
            got = materialize(got, "ann-hits")
            sent.unpersist()
        hits = got if hits is None else hits.unionAll(got)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
