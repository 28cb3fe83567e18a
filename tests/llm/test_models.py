"""The trained operators against plain versions, and on rows they weren't trained on."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import docs, kinds

import corpus_pipeline
from marlstone.llm import interpolation, language, linear, quality, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def balanced(found, want):
    """Mean of the shares of right verdicts among rows of either kind."""
    found, want = np.array(found), np.array(want)
    return np.mean([(found == want)[want == v].mean() for v in (False, True)])


def test_toxicity_without_labels_rejects_nothing(spark, tmp_path):
    table = docs(spark, ["some words", "", None, "x" * 50_000, "some words"])
    for rows in ([], [(0, 1, 0), (1, 0, 0)], [(0, 1, 1)], [(None, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        models = toxicity.train(table, labels)
        assert toxicity.keep(table, models).count() == 5
        assert not any(r["rejected"] for r in toxicity.score(table, models).collect())
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, table, f"file://{tmp_path}").count() == 5


def test_toxicity_on_held_out_rows(tables):
    table, labels = tables
    models = toxicity.train(table, labels.where("doc_id % 2 = 0"))
    truth = labels.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = toxicity.score(table, models).join(truth, "doc_id").collect()
    assert balanced([r["rejected"] for r in got], [r["toxic"] == 1 for r in got]) > 0.9


def test_quality_on_held_out_rows(tables):
    table, labels = tables
    model = quality.train(table, labels.where("doc_id % 2 = 0"))
    truth = labels.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    got = quality.judge(table, model).join(truth, "doc_id").where("NOT base_failed").collect()
    assert balanced([r["kept"] for r in got], [r["quality"] == 1 for r in got]) > 0.85


def test_chain_probabilities_by_hand(spark, tables):
    """Sums over each text's distinct features, one text and one feature at a time."""
    table, labels = tables
    models = toxicity.train(table, labels)
    texts = [r["text"] for r in table.where("text IS NOT NULL").orderBy("doc_id").limit(40).collect()] + ["", None, "é" * 9]
    want = []
    for text in texts:
        have = set(linear.features(pa.array([text or ""]), lower=True)[1].tolist())
        p, extra = [], []
        for m in models:
            margin = m.bias + sum(v for k, v in zip(m.index.tolist(), m.values.tolist(), strict=True) if k in have) + sum(a * b for a, b in zip(m.extra, extra, strict=True))
            p.append(1 / (1 + math.exp(-(m.a * margin + m.b))))
            q = min(max(p[-1], 1e-4), 1 - 1e-4)
            extra.append(math.log(q / (1 - q)))
        want.append(p)
    assert np.abs(toxicity.probabilities(models, pa.array(texts)) - np.array(want)).max() < 1e-9


def test_character_runs_are_code_points():
    row, feature = linear.features(pa.array(["äöüßé", "abcd efghi"]), lower=True)
    runs = Counter(row[feature >= 1 << linear.BITS].tolist())
    assert runs == {0: 3 + 1, 1: 6 + 2}  # of 3: three; two, " ef" and three; of 5: the whole word; " efgh" and "efghi"


def test_weights_equal_a_plain_descent():
    r = np.random.default_rng(4)
    x = (r.random((60, 9)) < 0.4).astype(float)
    y, used, extra = (x[:, 0] + x[:, 3] + r.random(60) > 1.2).astype(float), r.random(60) < 0.8, r.normal(size=(60, 2))
    row, col = np.nonzero(x)
    old = linear.PRESENCES
    try:
        for linear.PRESENCES in (7, old):
            w, more, bias = linear.descend(row.astype(np.int32), col.astype(np.int32), 9, extra, y, used, 1e-3, 50)
            full, v, m, s = np.column_stack([x, extra, np.ones(60)]), np.zeros(12), np.zeros(12), np.zeros(12)
            for t in range(1, 51):
                e = np.where(used, 1 / (1 + np.exp(-full @ v)) - y, 0) / used.sum()
                g = full.T @ e + 1e-3 * np.append(v[:-1], 0)
                m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
                v = v - 0.1 * (1 - t / 51) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
            assert np.abs(np.concatenate([w, more, [bias]]) - v).max() < 1e-9
    finally:
        linear.PRESENCES = old


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(hit), failed


def test_quality_base_equals_a_plain_version(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.lit(1).alias("n_words"))
    odd = docs(spark, [None, "", "a b c d e f g h " * 5, "#\n#\n \n", "é " * 30], 10**6).select("doc_id", "text", F.lit(1).alias("n_words"))
    table = table.union(odd).union(odd)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.judge(table, quality.train(table, labels)).collect()
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    assert len(got) == table.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_quality(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["p_quality"] >= quality.THRESHOLD)


def test_five_languages_in_one_text(spark):
    alphabets = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    r = random.Random(2)
    made = lambda k, n: " ".join("".join(r.choice(alphabets[k]) for _ in range(5)) for _ in range(n))
    rows = [(i, made(i % 5, 60), f"l{i % 5}") for i in range(100)]
    mixed = " ".join(made(k, 40) for k in range(5))
    table = spark.createDataFrame([*rows, (1000, mixed, None), (1001, None, "l0"), (1002, "12 34", "l1"), (None, mixed, None), (1000, mixed, None)], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"], [x["lang"] for x in r["languages"]]) for r in language.predict(table, language.learn(table)).collect()]
    assert [g[2] for g in got if g[0] in (1000, None)] == [["l0", "l1", "l2", "l3", "l4"]] * 3
    assert {g[1] for g in got if g[0] in (1001, 1002)} == {"und"}
    assert all(g[1] == f"l{g[0] % 5}" for g in got if g[0] is not None and g[0] < 100)


def test_language_model_scores_by_hand(spark):
    """Counts in dictionaries, the mixture a token at a time; and the weights near those of an unbinned EM."""
    n = 300
    texts = [" ".join(f"w{min(int(random.Random(i * 1000 + k).expovariate(0.05)), 199)}" for k in range(40)) for i in range(n)]
    table = docs(spark, texts)
    parts = interpolation.chunks(table)
    model = interpolation.learn(parts, interpolation.totals(parts, 2))
    part = kinds(n)
    tokens = [[None, *t.split(), None] for t in texts]

    def counts(which):
        own, both, context = Counter(), Counter(), Counter()
        for i, t in enumerate(tokens):
            if part[i] in which:
                own.update(t[1:])
                both.update(zip(t[:-1], t[1:], strict=True))
        for (a, _), c in both.items():
            context[a] += c
        return own, both

    own, both = counts({interpolation.MAIN, interpolation.HELD})
    assert (model.tokens, model.distinct) == (sum(own.values()), len(own))
    bucket = lambda c: min(int(math.log2(c + 1)), interpolation.BUCKETS - 1)
    for r in interpolation.score(table).collect():
        total = 0.0
        for a, b in zip(tokens[r["doc_id"]][:-1], tokens[r["doc_id"]][1:], strict=True):
            x, y, z = model.lambdas[bucket(own[a])]
            rest = y * own[b] / model.tokens + z / (model.distinct + 1)
            total += math.log10(x * both[a, b] / own[a] + rest if own[a] else rest / (y + z))
        assert abs(total - r["score"]) < 1e-6 * abs(total)

    own, both = counts({interpolation.MAIN})
    main = sum(own.values())
    rows = [(bucket(own[a]), both[a, b] / own[a] if own[a] else 0.0, own[b] / main) for i, t in enumerate(tokens) if part[i] == interpolation.HELD for a, b in zip(t[:-1], t[1:], strict=True)]
    weights = np.tile(interpolation._START, (interpolation.BUCKETS, 1))
    for _ in range(interpolation.ROUNDS):
        added = np.tile(interpolation._START, (interpolation.BUCKETS, 1))
        for k, x, y in rows:
            share = weights[k] * np.array([x, y, 1 / (model.distinct + 1)])
            added[k] += share / share.sum()
        weights = added / added.sum(1, keepdims=True)
    assert np.abs(weights - model.lambdas).max() < 0.1


def test_packing_retrieves_within_groups_of_common_tokens():
    """Copies that hold a third of a shard still find one another."""
    from marlstone.llm import packing

    group, other = [1, 2, 3, 4, 5] * 20, lambda k: [100 + k, 200 + k] * 50
    shard = [group, other(1), group, other(2), other(3), group, other(4), other(5), other(6)]
    order = [p[0] for p in packing.pack(np.concatenate([np.array(x, np.uint32) for x in shard]), np.array([len(x) for x in shard]))]
    assert list(dict.fromkeys(order))[:3] == [0, 2, 5]


