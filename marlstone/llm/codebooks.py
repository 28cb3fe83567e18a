"""Product quantisation of vectors with kd-trees over the codebooks.

Vectors become integers, floor(factor * x), and are cut into equal consecutive parts with a codebook each.
In every round the driver builds one kd-tree for each codebook and broadcasts them (parts * entries small
boxes). Tasks search all parts of a batch by branch and bound: a node is left out only where the distance to
its box is greater than the best so far, so equal bounds are visited and the lowest index wins a tie. Each
task sums the parts of each entry as integers; Spark adds up the tasks' sums, whose number doesn't depend on
the rows, and the driver replaces each entry that has parts by floor(sum / count). Everything is integer
arithmetic, so results depend on neither order nor partitions nor retries.

Vectors that are null or hold null or non-finite components are dropped. Shorter vectors, and a length that
isn't a multiple of the number of parts, end in zeros. A scaled component of 2**28 or more ends the job with an
error, since distances would overflow. Codebooks start as the rows first by vec_id (null ids last, equal ids by
their components); with fewer rows there are fewer entries. Repeated rows count each. Labels
are of any type; null labels make one group. No rows give no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import vectors
from marlstone.session import bounded, ship, stored, table

PARTS, ENTRIES, ROUNDS, FACTOR = 8, 16, 6, 4096
#: Entries in a leaf.
LEAF = 2
_FAR = np.iinfo(np.int64).max


@dataclass
class Node:
    """A box around some entries: a leaf has their ascending indexes, another node two halves."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    halves: tuple[Node, Node] | None = None

    @classmethod
    def over(cls, codebook: np.ndarray, entries: np.ndarray | None = None) -> Node:
        entries = np.arange(len(codebook)) if entries is None else entries
        own = codebook[entries]
        low, high = own.min(axis=0), own.max(axis=0)
        widest = int((high - low).argmax()) if own.shape[1] else 0
        if len(entries) <= LEAF or not own.shape[1] or low[widest] == high[widest]:
            return cls(low, high, np.sort(entries))
        order = entries[np.argsort(own[:, widest], kind="stable")]
        half = len(order) // 2
        return cls(low, high, entries, (cls.over(codebook, order[:half]), cls.over(codebook, order[half:])))

    def gap(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to the box."""
        out = np.maximum(np.maximum(self.low - points, points - self.high), 0)
        return (out * out).sum(axis=1)


def nearest(tree: Node, codebook: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry; of equally near ones the lowest index."""
    index, best = np.full(len(points), len(codebook)), np.full(len(points), _FAR)

    def visit(node: Node, who: np.ndarray) -> None:
        who = who[node.gap(points[who]) <= best[who]]
        if not len(who):
            return
        if node.halves is None:
            for entry in node.entries:
                apart = points[who] - codebook[entry]
                d = (apart * apart).sum(axis=1)
                better = (d < best[who]) | ((d == best[who]) & (entry < index[who]))
                best[who[better]], index[who[better]] = d[better], entry
            return
        left, right = node.halves
        first = left.gap(points[who]) <= right.gap(points[who])
        for near, far, group in ((left, right, who[first]), (right, left, who[~first])):
            visit(near, group)
            visit(far, group)

    visit(tree, np.arange(len(points)))
    return index, best


def assign(trees: list[Node], books: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (row, part) and squared distances of the nearest entries; books is (part, entry, component)."""
    parts = codes.reshape(len(codes), len(books), -1)
    found = [nearest(tree, book, parts[:, k]) for k, (tree, book) in enumerate(zip(trees, books, strict=True))]
    return np.stack([x[0] for x in found], axis=1), np.stack([x[1] for x in found], axis=1)


def _decoded(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dim).astype(np.int64)


def sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, place, total, n: integer sums of the parts nearest to each entry, one row for each component."""
    dim = books.shape[0] * books.shape[2]
    shared = rows.sparkSession.sparkContext.broadcast(([Node.over(b) for b in books], books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held = shared.value
        total, n = np.zeros(held.shape, np.int64), np.zeros(held.shape[:2], np.int64)
        for batch in batches:
            codes = _decoded(batch.column("whole"), dim)
            index, _ = assign(trees, held, codes)
            part = np.broadcast_to(np.arange(len(held)), index.shape)
            np.add.at(total, (part, index), codes.reshape(len(codes), len(held), -1))
            np.add.at(n, (part, index), 1)
        used = np.argwhere(np.broadcast_to(n[:, :, None] > 0, total.shape))
        at = tuple(used.T)
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in at], pa.array(total[at]), pa.array(n[at[:2]])], names=["part", "entry", "place", "total", "n"])

    summed = rows.mapInArrow(run, "part int, entry int, place int, total long, n long")
    return summed.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def learn(rows: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after so many rounds of assignment and update over rows of (whole: int32 components)."""
    books = start.copy()
    for _ in range(rounds):
        for r in sums(rows, books).collect():  # one row for each component of an entry
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def prepared(vectors_: DataFrame, parts: int = PARTS, entries: int = ENTRIES, factor: int = FACTOR) -> tuple[DataFrame, np.ndarray]:
    """Usable rows (vec_id, label, whole), stored, and the first codebooks."""
    rows = vectors.usable(vectors_).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    ship(rows.sparkSession)
    dim = -(-vectors.longest(rows) // parts) * parts
    first = rows.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    start = vectors.whole(first.column("embedding").combine_chunks(), dim, factor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = vectors.whole(batch.column("embedding"), dim, factor).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "label", "whole"])

    kind = rows.schema["label"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"vec_id long, label {kind}, whole binary")), start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2).copy()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of every prepared row."""
    dim = books.shape[0] * books.shape[2]
    shared = rows.sparkSession.sparkContext.broadcast(([Node.over(b) for b in books] if books.shape[1] else [], books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, apart = assign(*shared.value, _decoded(batch.column("whole"), dim))
            code = [x.tobytes().hex() for x in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(apart.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors_: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable rows and the codebooks that decode them; at most 256 entries."""
    rows, start = prepared(vectors_, parts, entries, factor)
    books = learn(rows, start, rounds) if start.shape[1] else start
    return encode(rows, books), books


def op13_vector_codes(spark, sf_dir) -> DataFrame:
    """Code and errors of every usable vector."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = stored(coded)
    totals = bounded(stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"))))
    joined = coded.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds spelt out one after another: each is a table of nearest entries and the next codebooks."""
    steps = [f"""
usable AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding, len(embedding) // {parts} AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS MATERIALIZED (
  SELECT r, i // d AS part, i % d AS place, CAST(floor({FACTOR} * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, d, embedding, unnest(range(len(embedding))) AS i FROM usable)),
book0 AS MATERIALIZED (SELECT part, r AS entry, place, x AS e FROM cell WHERE r < {entries})"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, part, min(apart * {entries} + entry) AS least FROM (
    SELECT r, c.part, entry, CAST(sum((x - e) * (x - e)) AS BIGINT) AS apart FROM cell c JOIN book{k} b ON c.part = b.part AND c.place = b.place GROUP BY ALL)
  GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce((total - ((total % n) + n) % n) // n, e) AS e FROM book{k} b LEFT JOIN (
    SELECT part, least % {entries} AS entry, place, CAST(sum(x) AS BIGINT) AS total, count(*) AS n
    FROM near{k} JOIN cell USING (r, part) GROUP BY ALL) USING (part, entry, place))""")
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', least % {entries}), '' ORDER BY part) AS code, CAST(sum(least // {entries}) AS BIGINT) AS error
  FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(e AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
FROM usable JOIN coded USING (r)
"""


OP13_SQL = _sql()
