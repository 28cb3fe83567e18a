"""Infilling, exact top-k and vector codes against plain versions on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import codebooks, infill, pivots

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("row", T.StringType()), T.StructField("home", T.StringType()), T.StructField("code", T.StringType())])
NAN, INF = float("nan"), float("inf")


def made(spark, n, dim=16, seed=5):
    """Clustered vectors, repeated ones, null ids, repeated ids and vectors that take no part; columns of clashing names."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    rows = [(i, [float(x) for x in np.float32(centres[i % 4] + 0.4 * r.normal(size=dim))], i % 3 or None, "x", "y", "z") for i in range(n)]
    hot = rows[0][1] if n else [0.5] * dim
    other = rows[n // 2][1] if n else [0.25] * dim
    rows += [(n + i, hot, 1, "x", "y", "z") for i in range(n // 2)]
    rows += [(None, hot, None, "x", "y", "z"), (50, other, 2, "x", "y", "z"), (50, other, 2, "x", "y", "z"), (100, [0.0] * dim, 9, None, None, None)]
    rows += [(900, None, 1, "x", "y", "z"), (950, [NAN] + [0.0] * (dim - 1), 1, "x", "y", "z"), (1000, [INF] * dim, 1, "x", "y", "z"), (1050, [None] * dim, 1, "x", "y", "z")]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(5), [x for x in rows if x[1] is not None and all(c is not None and np.isfinite(c) for c in x[1])]


@pytest.mark.parametrize("n", [400, 3, 0])
def test_top_k_equals_brute_force(spark, n):
    table, rows = made(spark, n)
    ids = [x[0] for x in rows]
    codes = np.floor(256 * np.array([x[1] for x in rows], np.float64)).astype(np.int64)
    want = []
    for i, q in enumerate(ids):
        if q is not None and q % 50 == 0:
            score = codes @ codes[i]
            order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-score[j], ids[j] is None, ids[j] or 0))[:5]
            want += [(q, k, ids[j], int(score[j])) for k, j in enumerate(order, 1)]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    for block, slice_ in ((37, 16_384), (4096, 3)):
        found = pivots.top(table, block=block, slice_=slice_, sample=50, pivots=8)
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_top_k_of_nothing_and_of_uneven_vectors(spark):
    table, _ = made(spark, 0)
    assert pivots.top(table.where("false")).count() == 0
    uneven = spark.createDataFrame([(0, [1.0, 2.0], 1, "", "", ""), (1, [1.0], 1, "", "", ""), (2, [], 1, "", "", "")], ROWS)
    assert [tuple(r) for r in pivots.top(uneven).orderBy("rank").collect()] == [(0, 1, 1, 65536), (0, 2, 2, 0)]
    assert [tuple(r) for r in pivots.top(uneven.withColumn("embedding", F.array().cast("array<float>"))).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]
    with pytest.raises(Exception, match="overflow"):
        pivots.top(uneven.withColumn("embedding", F.array(F.lit(1e30)).cast("array<float>"))).collect()


def test_bounds_pass_over_candidates():
    r = np.random.default_rng(2)
    codes = np.floor(256 * (np.repeat(np.eye(8), 100, axis=0) + 0.02 * r.normal(size=(800, 8)))).astype(np.int64)
    dists = pivots.distances(codes, pivots.farthest_first(codes, 8))
    block = pivots.Block(np.arange(800), np.ones(800, bool), np.arange(800), codes, dists)
    seen = []
    block.codes = type("Counted", (np.ndarray,), {"__getitem__": lambda self, at: (seen.append(np.size(at)), np.asarray(self)[at])[1]})(block.codes.shape, block.codes.dtype, block.codes.copy())
    place, score = block.search(3, codes[3], int(block.square[3]), dists[3], 5, None)
    assert list(score) == sorted((int(s) for i, s in enumerate(codes @ codes[3]) if i != 3), reverse=True)[:5] and 3 not in place
    assert sum(seen) < 400
    other = pivots.Block(np.arange(100), np.ones(100, bool), np.arange(100), codes[700:], dists[700:])
    assert other.ceiling(int(block.square[3]), dists[3]) < score[-1]


def plain_codes(rows, parts=8, entries=16, rounds=6, factor=4096):
    far = 1 << 62
    rows = sorted(rows, key=lambda x: (x[0] if x[0] is not None else far, x[1]))
    codes = np.floor(factor * np.array([x[1] for x in rows], np.float64)).astype(np.int64).reshape(len(rows), parts, -1)
    books = codes[:entries].copy()
    for k in range(rounds + 1):
        apart = ((codes[:, None] - books[None]) ** 2).sum(axis=3)
        index = apart.argmin(axis=1)
        if k < rounds:
            for p in range(parts):
                for e in range(len(books)):
                    own = codes[index[:, p] == e, p]
                    if len(own):
                        books[e, p] = own.sum(axis=0) // len(own)
    error = apart.min(axis=1).sum(axis=1)
    by_label = {}
    for x, e in zip(rows, error, strict=True):
        by_label[x[2]] = by_label.get(x[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for v in books.transpose(1, 0, 2).reshape(-1)).encode()).hexdigest()
    return [(x[0], "".join(f"{i:02x}" for i in index[k]), int(error[k]), by_label[x[2]], sha) for k, x in enumerate(rows)]


@pytest.mark.parametrize("n", [600, 2])
def test_vector_codes_equal_a_plain_version(spark, n, tmp_path):
    table, rows = made(spark, n)
    table.coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = codebooks.op13_vector_codes(spark, f"file://{tmp_path}")
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_codes(rows), key=repr)


def test_vector_codes_of_nothing_and_of_uneven_vectors(spark, tmp_path):
    table, _ = made(spark, 0)
    table.where("false").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert codebooks.op13_vector_codes(spark, f"file://{tmp_path}").count() == 0
    uneven = spark.createDataFrame([(0, [1.0, 2.0], 1, "", "", ""), (1, [1.0], 1, "", "", ""), (2, [], 1, "", "", "")], ROWS)
    coded, books = codebooks.compress(uneven)
    assert books.shape == (8, 3, 1) and {r["error"] for r in coded.collect()} == {0}


def test_tree_equals_all_distances_with_ties():
    r = np.random.default_rng(3)
    for size, entries in ((1, 1), (2, 5), (3, 16), (8, 16)):
        book, points = r.integers(-3, 4, (entries, size)), r.integers(-4, 5, (500, size))
        index, best = codebooks.nearest(codebooks.Node.over(book), book, points)
        apart = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_infill_equals_a_plain_version(spark):
    r = random.Random(4)
    bits = ["word", "Zz", " ", "\n", "é", "日本", "😀", "1", "<", "P>", "<S", ">", "\x00", "ß", "-"]
    texts = [None, "", "a", "<P>", "x<M>y", "long " * 50_000, "same text", "same text"] + ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(300)]
    rows = [(i if i != 7 else None, t, "s", "o") for i, t in enumerate(texts)] + [(6, "same text", "s", "o")]
    table = spark.createDataFrame(rows, "doc_id long, text string, form string, output string")
    found = infill.transform(table).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    want = []
    for i, t, *_ in rows:
        t = t or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        key = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
        h = [int(key[k : k + 8], 16) for k in (0, 8, 16, 24)]
        low, high = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((i, len(units), "plain", None, None, t, t))
        elif h[3] % 100 < 20:
            want.append((i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert infill.transform(table.where("false")).count() == 0
