"""Near duplicates: a Jaccard join of five-word shingles with Bayesian pruning of candidates.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased; a text of fewer than
five words has one shingle, all of them. Documents with equal shingle sets form one class. Classes
that agree on one of `BANDS` bands of `ROWS` MinHash values are candidates (a pair of similarity
0.8 is missed with probability 1e-5). A pair is taken up in the first band it agrees on. Further
MinHash values (a byte each) are compared in lots of 16; a pair goes when the posterior probability,
under a uniform prior, that its similarity reaches the threshold falls below `TOLERANCE`. The rest
is verified exactly on the shingle sets (64-bit hashes).

No pair becomes a row. Buckets over `BLOCK` classes are split into blocks, and each pair of blocks
is one group, so a bucket of any size is spread over tasks of bounded size; a group yields the
members of its surviving pairs and, after verification, each member's link count and its root in
the group. Roots are joined to components by alternating large-star and small-star rounds.

Null and empty texts have no shingle: each document is alone, without links. A null doc_id gets a
null class. Repeated rows are copies and link to each other. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textbatch as tb
from marlstone.session import bounded, ship, stored, table

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
CHECKS, LOT, TOLERANCE = 64, 16, 1e-5
BLOCK = 256
_RNG = np.random.default_rng(7)
_FACTOR = _RNG.integers(1, 1 << 31, BANDS * ROWS + CHECKS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, BANDS * ROWS + CHECKS, dtype=np.uint32)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the number before each row."""
    w = tb.words(column, tb.ALNUM, lower=True)
    n = w.counts()
    _, row, h = tb.windows(w, SHINGLE)
    for size in range(1, SHINGLE):
        few = np.flatnonzero(n == size)
        if len(few):
            _, where, short = tb.windows(w, size, salt=1)
            mine = np.isin(where, few)
            row, h = np.concatenate([row, where[mine]]), np.concatenate([h, short[mine]])
    order = np.argsort(row, kind="stable")
    row, h = row[order], h[order]
    first = np.searchsorted(row, np.arange(len(n) + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def minhashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of MinHash values for each set, none of which is empty."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(_FACTOR), len(first) - 1), np.uint32)
    for k in range(len(_FACTOR)):
        out[k] = np.minimum.reduceat(x * _FACTOR[k] + _SHIFT[k], first[:-1])
    return out.T


def signatures(docs: DataFrame) -> DataFrame:
    """Per document its class (a hash of the shingle set; null without one), band hashes and check bytes."""
    names = ["doc_id", "key", "class", "second", "bands", "checks"]

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, most=1 << 20):
                values, first = shingles(part.column("text"))
                full = np.flatnonzero(np.diff(first))
                rows = len(first) - 1
                own, second = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                bands, checks = [None] * rows, [None] * rows
                if len(full):
                    starts = np.append(first[:-1][full], first[-1])
                    own[full] = tb.mix(np.add.reduceat(tb.mix(values), starts[:-1]))
                    second[full] = np.add.reduceat(tb.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts[:-1])
                    m = minhashes(values, starts)
                    key = np.zeros((len(full), BANDS), np.uint64)
                    for r in range(ROWS):
                        key = tb.mix(key ^ m[:, r * BANDS : (r + 1) * BANDS])
                    byte = ((m[:, BANDS * ROWS :] * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
                    for k, i in enumerate(full.tolist()):
                        bands[i], checks[i] = key[k].tobytes(), byte[k].tobytes()
                none = np.diff(first) == 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(own.view(np.int64), mask=none), pa.array(second.view(np.int64), mask=none), pa.array(bands, pa.binary()), pa.array(checks, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, class long, second long, bands binary, checks binary")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared bytes (LOT, 2 LOT, ...) the fewest matches that keep a pair alive."""
    grid = (np.arange(4000) + 0.5) / 4000
    match = grid + (1 - grid) / 256  # bytes of different values agree once in 256
    limits = []
    for n in range(LOT, CHECKS + 1, LOT):
        alive = n
        while alive:
            log = (alive - 1) * np.log(match) + (n - alive + 1) * np.log(np.maximum(1 - match, 1e-300))
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() < tolerance:
                break
            alive -= 1
        limits.append(alive)
    return limits


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches that end where a group ends; rows of a group follow one another in the input."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != c[0].item() for k, c in zip(keys, columns, strict=True)):
            yield _joined(held)
            held = []
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        if len(at):
            held.append(batch.slice(0, int(at[-1])))
            yield _joined(held)
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def by_group(df: DataFrame, keys: list[str], order: str, run: Callable, schema: str) -> DataFrame:
    """run over batches of whole groups. Groups are of bounded size; many share a partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Fixed-width binary values as the rows of a matrix."""
    data = np.frombuffer(b"".join(column.to_pylist()), kind)
    return data.reshape(-1, width)


def buckets(classes: DataFrame) -> DataFrame:
    """Members of every bucket of at least two classes: key, band, blocks p and q, own block, class."""
    keyed = classes.select("class", "bands").mapInArrow(_band_rows, "key long, band int, class long")
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    member = keyed.join(bounded(shared), "key").select("key", "band", "class", blocks.alias("blocks"), F.pmod(F.xxhash64("class", "key"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return member.select("key", "band", "class", "block", other.alias("other")).select("key", "band", "class", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))


def _band_rows(batches):
    number = np.arange(1, BANDS + 1, dtype=np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            bands = matrix(part.column("bands"), BANDS, "<u8")
            key = tb.mix(bands ^ number)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(bands))), pa.array(np.repeat(part.column("class").to_numpy(), BANDS))], names=["key", "band", "class"])


def _pairs(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of one group, i < j, where one row is of the left and the other of the right block."""
    last = np.append(np.flatnonzero(np.diff(group)), len(group) - 1)
    room = np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(len(group))
    at = np.arange(len(group))
    step = 1
    while len(at):
        at = at[room[at] >= step]
        i, j = at, at + step
        fits = (left[i] & right[j]) | (right[i] & left[j])
        if fits.any():
            yield i[fits], j[fits]
        step += 1


def prune(threshold: float, tolerance: float) -> Callable:
    """Compare the members of each group; yield members of surviving pairs, with the pairs beside the first of them."""
    limits = least_matches(threshold, tolerance)

    def run(batches):
        for batch in groups(batches, ["key", "p", "q"]):
            key, p, q = (batch.column(c).to_numpy() for c in ("key", "p", "q"))
            block, band = batch.column("block").to_numpy(), batch.column("band").to_numpy()
            group = np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0))])
            bands, checks = matrix(batch.column("bands"), BANDS, "<u8").astype(np.uint32), matrix(batch.column("checks"), CHECKS, np.uint8)
            earlier = np.arange(BANDS)
            kept_i, kept_j = [], []
            for i, j in _pairs(group, block == p, block == q):
                for a in range(0, len(i), 100_000):
                    x, y = i[a : a + 100_000], j[a : a + 100_000]
                    new = ~((bands[x] == bands[y]) & (earlier < band[x][:, None])).any(1)
                    x, y = x[new], y[new]
                    matches = np.zeros(len(x), int)
                    for lot, limit in enumerate(limits):
                        s = slice(lot * LOT, (lot + 1) * LOT)
                        matches += (checks[x, s] == checks[y, s]).sum(1)
                        alive = matches >= limit
                        x, y, matches = x[alive], y[alive], matches[alive]
                    kept_i.append(x)
                    kept_j.append(y)
            i, j = np.concatenate([*kept_i, np.zeros(0, int)]), np.concatenate([*kept_j, np.zeros(0, int)])
            if not len(i):
                continue
            used = np.unique(np.concatenate([i, j]))
            head = np.searchsorted(used, np.searchsorted(group, np.unique(group[used])))  # first used row of each group
            seat = np.arange(len(used)) - np.repeat(head, np.diff(np.append(head, len(used))))
            order = np.argsort(group[i], kind="stable")
            i, j = i[order], j[order]
            cut = np.searchsorted(group[i], group[used[head]])
            both = np.column_stack([seat[np.searchsorted(used, i)], seat[np.searchsorted(used, j)]]).astype("<u2")
            pairs: list[bytes | None] = [None] * len(used)
            for h, a, b in zip(head.tolist(), cut.tolist(), np.append(cut[1:], len(i)).tolist(), strict=True):
                pairs[h] = both[a:b].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(key[used]), pa.array(p[used]), pa.array(q[used]), pa.array(seat.astype(np.int32)), batch.column("class").take(pa.array(used)), pa.array(pairs, pa.binary())], names=["key", "p", "q", "seat", "class", "pairs"])

    return run


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j."""
    if len(i) <= 8:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], int)
    _, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = n[place] > 1
    place, row = np.unique(place[shared], return_inverse=True)[1], row[shared]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    width = max(1, 4_000_000 // len(sets))
    for low in range(0, int(place.max(initial=-1)) + 1, width):  # bounded columns at a time
        a, b = np.searchsorted(place, [low, low + width])
        part = np.zeros((len(sets), min(width, int(place[-1]) + 1 - low)), np.float32)
        part[row[a:b], place[a:b] - low] = 1
        total += part @ part.T
    return total[i, j].astype(int)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)])


def verify(threshold: float) -> Callable:
    """Exact similarities of each group's pairs: of each member its linked copies and its root in the group."""

    def run(batches):
        for batch in groups(batches, ["key", "p", "q"]):
            key, p, q = (batch.column(c).to_numpy() for c in ("key", "p", "q"))
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            classes, copies = batch.column("class").to_numpy(), batch.column("copies").to_numpy()
            links, root = np.zeros(len(key), np.int64), classes.copy()
            for a, b in zip(np.append(0, change).tolist(), np.append(change, len(key)).tolist(), strict=True):
                pairs = np.frombuffer(batch.column("pairs")[a].as_py(), "<u2").reshape(-1, 2).astype(int)
                sets = [np.frombuffer(batch.column("shingles")[k].as_py(), "<u8") for k in range(a, b)]
                sizes = np.array([len(s) for s in sets])
                i, j = pairs.T
                both = overlaps(sets, i, j)
                linked = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
                i, j = i[linked], j[linked]
                links[a:b] = np.bincount(i, copies[a + j], b - a) + np.bincount(j, copies[a + i], b - a)
                root[a:b] = classes[a + roots(b - a, i, j)]
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(classes[found]), pa.array(links[found]), pa.array(root[found])], names=["class", "links", "root"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v): stars around the smallest node of each component."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.where("u > v").groupBy("u").agg(F.min("v").alias("m"))
        step = large.where("u > v").join(low, "u")
        star = step.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(step.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(star)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def linked_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Signed documents (doc_id, key of the text, class) and classes (first document, copies, links, root)."""
    ship(docs.sparkSession)
    signed = stored(signatures(docs))
    known = signed.where("class IS NOT NULL")
    classes = stored(known.groupBy("class", "second").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.min("doc_id").alias("doc_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("named"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("checks").alias("checks")))
    member = buckets(classes).join(classes.select("class", "bands", "checks"), "class")
    alive = stored(by_group(member, ["key", "p", "q"], "class", prune(threshold, tolerance), "key long, p int, q int, seat int, class long, pairs binary"))

    source = F.coalesce("named", "first")  # a class may have no document with a doc_id
    wanted = stored(classes.join(alive.select("class").distinct(), "class", "left_semi").select("class", source["doc_id"].alias("_doc"), source["key"].alias("_key"), "copies"))
    seated = alive.join(shingle_sets(docs, wanted), "class")
    linked = stored(by_group(seated, ["key", "p", "q"], "seat", verify(threshold), "class long, links long, root long"))

    star = components(linked.select(F.col("class").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    placed = classes.select("class", "first", "doc_id", "copies").join(links, "class", "left").join(star.withColumnRenamed("node", "class"), "class", "left")
    return signed, placed.withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per document: class_id, the smallest doc_id among all that links connect it to, and n_links, its linked documents."""
    signed, placed = linked_classes(docs, threshold, tolerance)
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    found = placed.join(smallest, "root").select("class", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "class").join(found, "class", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle sets of the wanted classes, from one document of each."""

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, most=1 << 20):
                values, first = shingles(part.column("text"))
                own = np.array([tb.mix(np.array([tb.mix(values[a:b]).sum()]))[0] if b > a else 0 for a, b in zip(first[:-1], first[1:], strict=True)], np.uint64).view(np.int64)
                same = np.flatnonzero((own == part.column("class").to_numpy()) & (np.diff(first) > 0))  # a key may be another text's too
                packed = [values[first[k] : first[k + 1]].tobytes() for k in same]
                yield pa.RecordBatch.from_arrays([part.column("class").take(pa.array(same)), part.column("copies").take(pa.array(same)), pa.array(packed, pa.binary())], names=["class", "copies", "shingles"])

    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").join(bounded(wanted), same)
    return texts.mapInArrow(run, "class long, copies long, shingles binary").dropDuplicates(["class"])


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group of linked ones, that of the smallest doc_id; columns as they are.

    Of rows that repeat that doc_id the first by a hash of the text stays, and one of equal rows.
    Documents without doc_id or without words stay.
    """
    signed, placed = linked_classes(docs, threshold)
    known = signed.where("class IS NOT NULL AND doc_id IS NOT NULL")
    first = placed.groupBy("root").agg(F.min(F.when(F.col("first.doc_id").isNotNull(), F.col("first"))).alias("stays"))
    kept = placed.select("class", "root").join(first, "root").select("class", "stays")
    gone = stored(known.join(kept, "class").where("doc_id <> stays.doc_id OR key <> stays.key").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).distinct())
    again = stored(known.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).count().where("count > 1").drop("count"))
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")  # boxed, so no name can clash
    boxed = docs.select(whole, docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(docs["text"]).alias("_key"))
    rest = boxed.join(bounded(gone), ["_doc", "_key"], "left_anti")
    if again.isEmpty():
        return rest.select("row.*")
    repeated = rest.join(bounded(again), ["_doc", "_key"], "left_semi").dropDuplicates(["_doc", "_key"])
    return rest.join(bounded(again), ["_doc", "_key"], "left_anti").unionByName(repeated.select(*rest.columns)).select("row.*")


def op4_jaccard_join(spark, sf_dir) -> DataFrame:
    """Near-duplicate classes and link counts of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
