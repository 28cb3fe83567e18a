"""Exact top-k by inner product with a pivot table.

Vectors become integers, floor(factor * x). Their distances to `PIVOTS` pivots are computed once and stored
beside them, in blocks of up to `BLOCK` rows whose nearest pivots are alike. For a query q and a candidate v
the triangle inequality gives, over all pivots p, the lower bound max |d(q, p) - d(v, p)| on d(q, v), and so
the upper bound (|q|^2 + |v|^2 - bound^2) / 2 on the score. A whole block is passed over where the ranges of
its distances rule it out; in the others candidates are evaluated from the highest bound down until the next
bound is under the k-th best score found. Bounds carry a margin for rounding, scores are exact integers, and
equal bounds are still evaluated, so ties are settled by vec_id alone.

Queries start with the k-th best score inside their own block, which is near the final one, so few rows leave
a task. They are dealt into slices of about `SLICE` queries; the slices follow one another, each broadcast
(`SLICE` * (dim + PIVOTS) * 4 bytes, about 10 MB at 64 components) to one scan of the blocks. Pivots are the
farthest-first rows of a sample of `SAMPLE` rows: they steer the cost, never the result.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as ended by zeros.
A scaled component of 2**28 or more ends the job with an error, since scores would overflow. A null vec_id
is never a query and comes after all others in ties. Repeated rows are candidates, and queries, each; a row is
no candidate for itself, but an equal row is. No rows give no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import vectors
from marlstone.session import ship, stored, table

PIVOTS = 32
SAMPLE = 4096
BLOCK = 4096
SLICE = 16_384
#: Candidates evaluated at first, doubled while the search goes on.
STEP = 64
#: Share of a distance by which a bound is loosened, for single precision.
LOOSE = 4e-7
OUT = "query_row long, query_id long, vec_id long, score long"
PACKED = "n long, ids binary, known binary, rows binary, codes binary, dists binary"


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Up to count distinct points, each the farthest from those before it."""
    points = points.astype(np.float64)
    chosen, far = [], np.full(len(points), np.inf)
    at = 0
    while len(points) and len(chosen) < count and far[at] > 0:
        chosen.append(at)
        far = np.minimum(far, ((points - points[at]) ** 2).sum(axis=1))
        at = int(far.argmax())
    return points[chosen]


def distances(codes: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of every row to every pivot, in single precision: whole squares first, so no rounding before the root."""
    c = codes.astype(np.float64)
    square = (c * c).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (c @ pivots.T)
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


class Block:
    """Candidates with their pivot distances."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, rows: np.ndarray, codes: np.ndarray, dists: np.ndarray) -> None:
        self.ids, self.known, self.rows, self.dists = ids, known, rows, dists
        self.square = (codes.astype(np.int64) ** 2).sum(axis=1)
        exact = len(codes) == 0 or self.square.max() < 2**52
        self.codes = codes.astype(np.float64 if exact else np.int64)
        self.low, self.high = dists.min(axis=0), dists.max(axis=0)
        self.longest = int(self.square.max()) if len(codes) else 0

    @classmethod
    def unpack(cls, row: dict, dim: int) -> Block:
        n = row["n"]
        return cls(
            np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["rows"], np.int64),
            np.frombuffer(row["codes"], np.int32).reshape(n, dim), np.frombuffer(row["dists"], np.float32).reshape(n, -1),
        )

    def ceiling(self, square: int, dist: np.ndarray) -> float:
        """Above every score of the block with a query of this squared norm and these distances."""
        gap = np.maximum(self.low - dist, dist - self.high).max(initial=0) - LOOSE * max(dist.max(initial=0), self.high.max(initial=0))
        return _upper(square, self.longest, max(gap, 0.0))

    def search(self, row: int, code: np.ndarray, square: int, dist: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates but the row itself, of those that score least or more."""
        gap = np.abs(self.dists - dist).max(axis=1, initial=0).astype(np.float64) - LOOSE * max(dist.max(initial=0), self.high.max(initial=0))
        bound = _upper(square, self.square, np.maximum(gap, 0.0))
        open_ = np.flatnonzero((self.rows != row) & (bound >= (least if least is not None else -np.inf)))
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        code = code.astype(self.codes.dtype if square < 2**52 else np.int64)
        best, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
        while at < len(open_) and (len(best) < k or bound[open_[at]] >= scores[-1]):
            part = open_[at : at + step]
            got = (self.codes[part] @ code).astype(np.int64)
            best, scores = np.concatenate([best, part]), np.concatenate([scores, got])
            order = np.lexsort((self.ids[best], ~self.known[best], -scores))[:k]
            best, scores = best[order], scores[order]
            at, step = at + step, step * 2
        if least is not None:
            best, scores = best[scores >= least], scores[scores >= least]
        return best, scores


def _upper(a, b, gap):
    """Above the inner product of two vectors with these squared norms and at least this distance."""
    total = np.asarray(a, np.float64) + b
    return (total - gap * gap) / 2 + 1e-9 * total


def index(rows: DataFrame, pivots: np.ndarray, dim: int, factor: int, block: int = BLOCK) -> DataFrame:
    """The pivot table: blocks of rows (row, vec_id, embedding), alike ones together, stored."""
    ship(rows.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(vectors.whole(batch.column("embedding"), dim, factor), pivots)
            home = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], names=[*batch.schema.names, "home", "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, block - size), batch.slice(block - size)
                waiting.append(part)
                size += part.num_rows
                if size == block:
                    yield packed(waiting)
                    waiting, size = [], 0
        if size:
            yield packed(waiting)

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        one = pa.Table.from_batches(parts).combine_chunks()
        codes = vectors.whole(one.column("embedding").combine_chunks(), dim, factor)
        known = ~np.asarray(one.column("vec_id").is_null())
        ids = one.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        fields = [ids.astype(np.int64), known, one.column("row").to_numpy(), codes.astype(np.int32), distances(codes, pivots)]
        return pa.RecordBatch.from_arrays([pa.array([len(codes)]), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in fields]], names=["n", "ids", "known", "rows", "codes", "dists"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(place, f"{kinds}, home int, near float")
    return stored(placed.repartitionByRange("home", "near", "row").sortWithinPartitions("home", "near", "row").mapInArrow(pack, PACKED))


def queries_of(blocks: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    """The queries (vec_id divisible by every) with the k-th best score of their own block, stored."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block.unpack(row, dim)
                chosen = np.flatnonzero(b.known & (b.ids % every == 0))
                least = []
                for i in chosen:
                    scores = b.search(b.rows[i], b.codes[i], int(b.square[i]), b.dists[i], k, None)[1]
                    least.append(int(scores[-1]) if len(scores) == k else None)
                arrays = [b.rows[chosen], b.ids[chosen], pa.array(least, pa.int64()), pa.array([x.astype(np.int32).tobytes() for x in b.codes[chosen]], pa.binary()), pa.array([x.tobytes() for x in b.dists[chosen]], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays], names=["query_row", "query_id", "least", "code", "dist"])

    return stored(blocks.mapInArrow(run, "query_row long, query_id long, least long, code binary, dist binary"))


def scan(blocks: DataFrame, queries: pa.Table, dim: int, k: int) -> DataFrame:
    """Of each query and each part of the blocks: the k best candidates that may still count."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        n = asked.num_rows
        rows, ids = asked.column("query_row").to_numpy(), asked.column("query_id").to_numpy()
        codes = np.frombuffer(b"".join(asked.column("code").to_pylist()), np.int32).reshape(n, dim)
        dists = np.frombuffer(b"".join(asked.column("dist").to_pylist()), np.float32).reshape(n, -1)
        square = (codes.astype(np.int64) ** 2).sum(axis=1)
        least = asked.column("least").to_pylist()
        for batch in batches:
            for row in batch.to_pylist():
                b = Block.unpack(row, dim)
                found = []
                for i in range(n):
                    if least[i] is not None and b.ceiling(int(square[i]), dists[i]) < least[i]:
                        continue
                    place, score = b.search(rows[i], codes[i], int(square[i]), dists[i], k, least[i])
                    if len(score) == k:  # the k-th best of any block bounds the others
                        least[i] = int(score[-1])
                    found.append((np.full(len(place), i), place, score))
                if found:
                    query, place, score = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[query]), pa.array(ids[query]), pa.array(b.ids[place], mask=~b.known[place]), pa.array(score)], names=["query_row", "query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, OUT)


def top(rows: DataFrame, k: int = 5, every: int = 50, factor: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose vec_id is divisible by every."""
    spark = rows.sparkSession
    ship(spark)
    rows = vectors.usable(rows).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    dim = vectors.longest(rows)
    some = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(sample).toArrow()
    chosen = farthest_first(vectors.whole(some.column("embedding").combine_chunks(), dim, factor), pivots)
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = index(rows, chosen, dim, factor, block)
    queries = queries_of(blocks, dim, k, every)
    parts = -(-queries.count() // slice_)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = []
    for part in range(parts):
        asked = queries.where(F.pmod(F.xxhash64("query_row"), F.lit(parts)) == part).toArrow()
        ranked = scan(blocks, asked, dim, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found.append(stored(ranked.select("query_id", "rank", "vec_id", "score")))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def op12_top_k(spark, sf_dir) -> DataFrame:
    """The five best of every query row of embeddings."""
    return top(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id NULLS LAST) AS rank
  FROM whole q JOIN whole c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
