"""What the operators' steps take: calls, sorted rows and memory, on small inputs."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_operators import library

from marlstone.llm import linear, repair, tokens


def peak(work) -> float:
    """MB that NumPy and Python take on top at most."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class Counting:
    """The library, counting the texts that it cuts itself."""

    def __init__(self, inner) -> None:
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_go_to_the_library_as_pieces(name):
    r = random.Random(5)
    made = ["".join(r.choice("abcdeéßñTHÉ") for _ in range(r.randrange(3, 12))) for _ in range(3000)]
    texts = [" ".join(made[i : i + 50]) + "\n  Ü x\xa0y  ... 42 don't 日本 é" for i in range(0, len(made), 50)]
    encoder = tokens.Encoder(tokens.encoder(name).file)
    encoder.library = Counting(encoder.library)
    ids, sizes = encoder.encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    capitals = sum("É" in w for w in made)
    assert encoder.library.texts < 100 + (capitals if encoder.lower else 0)


def test_known_parts_take_little_memory_and_are_found_after_growth():
    keys = np.random.default_rng(1).integers(1, 2**63, 200_000, dtype=np.uint64)
    keys[:500] = np.arange(1, 501)  # all in the first slot
    known = tokens.Known()
    for at in range(0, len(keys), 7000):
        known.add(keys[at : at + 7000])
    assert (known.find(keys) == np.arange(len(keys))).all() and (known.find(keys[500:] | np.uint64(1 << 63)) == -1).all()
    assert known.keys.nbytes + known.at.nbytes < 40 * len(keys)


def test_a_text_of_more_parts_than_are_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PARTS", 100)
    texts = [" ".join(f"x{i}y{i * k}" for i in range(300)) for k in (1, 2, 1)]
    encoder = tokens.Encoder(tokens.encoder("byte_bpe_50k.json").file)
    for text in texts:
        assert encoder.encode(pa.array([text]))[0].tolist() == library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


def test_compression_sorts_few_pairs(monkeypatch):
    r = np.random.default_rng(4)
    ids = np.minimum((r.pareto(1.0, 60_000) * 3).astype(np.uint32), 5000)
    lengths = np.full(60, 1000)
    sizes, unique = [], np.unique
    monkeypatch.setattr(repair.np, "unique", lambda x, **options: sizes.append(len(x)) or unique(x, **options))
    g = repair.compress(ids, lengths)
    monkeypatch.undo()
    assert (repair.expand(g.symbols, g) == ids).all() and len(g.left) > 100
    pairs = [p for begin in range(0, 60_000, 1000) for p in zip(ids[begin : begin + 999].tolist(), ids[begin + 1 : begin + 1000].tolist(), strict=True)]
    most = max(Counter(pairs).values())
    first = {(a, b) for a, b in zip(g.left.tolist(), g.right.tolist(), strict=True) if max(a, b) < g.base}
    assert {p for p, n in Counter(pairs).items() if n >= max(repair.LEAST_COUNT, most // 4)} <= first
    assert sum(sizes) < len(ids)


def test_training_takes_memory_by_the_sample_s_features():
    r = np.random.default_rng(2)
    rows = [np.sort(r.choice(2000, 100, replace=False)) for _ in range(300)]
    spans = [(100 * i, 100 * i + 100) for i in range(300)]
    flat = np.concatenate(rows).astype(np.int32) * 1000
    y = np.array([int(7 in x or 8 in x or 9 in x) for x in rows], float)
    held = linear.Sample.gathered(flat, spans, linear.LEAST_TEXTS)
    found = []
    assert peak(lambda: found.append(linear.fit_calibrated(held, y, np.zeros((300, 0)), np.arange(300) % 3)[0])) < 10
    assert {7000, 8000, 9000} & set(found[0].index.tolist())
