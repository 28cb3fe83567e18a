"""Language mixtures and BM25 neighbours against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from marlstone.llm import language, packing


def plain_words(text):
    """Words of a-z and non-ASCII bytes, A-Z lower-cased."""
    out, word = [], b""
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b
        if 97 <= b <= 122 or b >= 128:
            word += bytes([b])
        elif word:
            out, word = [*out, word], b""
    return [*out, word] if word else out


def plain_cells(word):
    padded = b" " + word + b" "
    padded += b" " * max(0, 4 - len(padded))
    grams = [padded[i : i + 4] for i in range(max(len(word) - 1, 1))]
    return [(int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language.BITS) for g in grams]


def plain_mixture(model, text):
    """The shares of the best language set of one text."""
    k = len(model.names)
    words = plain_words(text)
    like = []
    for w in words:
        log = [sum(float(model.log_p[j][c]) for c in plain_cells(w)) for j in range(k)]
        like.append([math.exp(max(x - max(log), -60)) for x in log])

    def em(allowed):
        pi = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(language.ROUNDS):
            new = [0.0] * k
            for row in like:
                total = sum(a * b for a, b in zip(row, pi, strict=True))
                for j in range(k):
                    new[j] += row[j] * pi[j] / total / len(like)
            pi = new
        return pi, sum(math.log(sum(a * b for a, b in zip(row, pi, strict=True))) for row in like)

    share, _ = em(range(k))
    order = sorted(range(k), key=lambda j: -share[j])
    best, cost = [float(j == order[0]) for j in range(k)], -2 * sum(math.log(row[order[0]]) for row in like)
    for m in range(2, k + 1):
        if share[order[m - 1]] <= language.LEAST_SHARE:
            break
        pi, total = em(order[:m])
        if -2 * total + (m - 1) * math.log(len(like)) < cost:
            best, cost = pi, -2 * total + (m - 1) * math.log(len(like))
    return best


def test_mixtures_equal_a_plain_version():
    r = random.Random(6)
    alphabets = ["abcdef", "defghi", "ghijkl", "éöabc"]
    word = lambda k: "".join(r.choice(alphabets[k]) for _ in range(r.randrange(1, 8)))
    counts = np.full((4, 1 << language.BITS), 0.5)
    for k in range(4):
        for _ in range(400):
            for c in plain_cells(word(k).encode()):
                counts[k, c] += 1
    model = language.Languages(list("wxyz"), np.log(counts / counts.sum(1, keepdims=True)))
    texts = [" ".join(word(r.choice(kinds)) for _ in range(r.randrange(1, 40))) for kinds in ([0], [1], [0, 2], [0, 1, 2, 3], [3], [1, 1, 1, 2]) for _ in range(8)] + ["A", "Ab-cd 12 É"]
    found, n, letter = language.infer(model, pa.array([*texts, "", None, "12"]))
    assert letter.tolist() == [True] * len(texts) + [False] * 3 and n[-3:].tolist() == [0, 0, 0]
    several = 0
    for text, got in zip(texts, found, strict=False):
        want = plain_mixture(model, text)
        assert np.abs(got - want).max() < 1e-9, text
        several += np.count_nonzero(got) > 1
    assert several > 5


def plain_neighbours(docs, seed, unused):
    n, lengths = len(docs), [len(d) for d in docs]
    mean, tf = sum(lengths) / n, [Counter(d) for d in docs]
    df = Counter(t for c in tf for t in c)
    score = {}
    for d in range(n):
        total = 0.0
        for t in set(docs[seed]) & set(docs[d]):
            f = tf[d][t]
            total += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * lengths[d] / mean))
        if total and unused[d]:
            score[d] = total
    return score


def test_neighbours_equal_plain_bm25():
    r = random.Random(9)
    for size, vocabulary in ((12, 30), (60, 200), (40, 8)):
        docs = [[r.randrange(vocabulary) for _ in range(r.randrange(1, 60))] for _ in range(size)]
        docs[3] = docs[5]
        index = packing.Index(np.concatenate([np.array(d, np.uint32) for d in docs]), np.array([len(d) for d in docs]))
        for seed in range(size):
            unused = np.array([r.random() < 0.7 for _ in docs])
            found = index.neighbours(seed, unused).tolist()
            want = plain_neighbours(docs, seed, unused)
            assert set(found) == set(want)
            assert all(want[a] > want[b] - 1e-4 for a, b in zip(found, found[1:], strict=False))
