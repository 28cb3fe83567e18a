"""Hashed text features and logistic regression in NumPy, for models trained on a bounded sample.

Features are presences: whether a word, or a run of 3 or 5 characters (code points) that has white
space at its start at most, occurs in the text. Every feature whose presence differs significantly
between the classes gets a weight, however many they are; the neutral ones get none, so a long text
doesn't gather noise from them. A model is its weighted features alone, so it is small to send.

A sample is held once, as the distinct features of its texts one after another, and read in slices: counts,
margins and gradients need little memory beside it. Sums are in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from marlstone.llm import textbatch as tb

BITS = 20
#: Characters in a run.
GRAMS = (3, 5)
DIMS = (1 + len(GRAMS)) << BITS
#: Text bytes whose features are made at a time; each takes some 200 bytes of memory meanwhile.
SLICE = 1 << 18
#: Presences that are summed up at a time.
PRESENCES = 1 << 20
#: Texts that must hold a feature for it to get a weight.
LEAST_TEXTS = 3
#: Least |z| of a feature's difference between the classes.
LEAST_Z = 4.0


def features(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and run of characters, with repeats; each kind has its own numbers."""
    w = tb.words(column, tb.NOT_SPACE, lower)
    rows, found = [w.doc], [(w.hash >> np.uint64(64 - BITS)).astype(np.int64)]
    begins = np.flatnonzero(tb.STARTS[w.data])
    chars = np.frombuffer(w.data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    inner = tb.NOT_SPACE[w.data[begins]]
    chars[~inner] = 32
    owner = np.searchsorted(w.bounds, begins, "right") - 1
    for kind, size in enumerate(GRAMS, 1):
        n = len(chars) - size + 1
        if n <= 0:
            continue
        h, whole = chars[:n] + np.uint64(kind), owner[:n] == owner[size - 1 :]
        for k in range(1, size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + chars[k : n + k]
            whole = whole & inner[k : n + k]
        at = np.flatnonzero(whole)
        rows.append(owner[at])
        found.append((tb.mix(h[at]) >> np.uint64(64 - BITS)).astype(np.int64) + (kind << BITS))
    return np.concatenate(rows), np.concatenate(found)


def present(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), ordered."""
    both = np.unique(row.astype(np.int64) * DIMS + feature)
    return both // DIMS, both % DIMS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Sample:
    """Distinct features of texts: those of text i are number[feature[first[i]:first[i + 1]]]; number ascends."""

    feature: np.ndarray
    first: np.ndarray
    number: np.ndarray

    @classmethod
    def gathered(cls, flat: np.ndarray, spans: list[tuple[int, int]], least: int) -> Sample:
        """From int32 features of texts in any order and where those of each text lie; only features that `least` texts have."""
        counts = np.zeros(DIMS, np.int32)
        for at in range(0, len(flat), PRESENCES):
            counts += np.bincount(flat[at : at + PRESENCES], minlength=DIMS)
        number = np.flatnonzero(counts >= least)
        feature, first = np.empty(int(counts[number].sum()), np.int32), np.zeros(len(spans) + 1, np.int64)
        place = counts  # no longer needed
        place[:] = -1
        place[number] = np.arange(len(number))
        for k, (begin, end) in enumerate(spans):
            one = place[flat[begin:end]]
            one = one[one >= 0]
            first[k + 1] = first[k] + len(one)
            feature[first[k] : first[k + 1]] = one
        return cls(feature, first, number)

    def __len__(self) -> int:
        return len(self.first) - 1

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, feature) of about `PRESENCES` presences at a time, by ascending row."""
        at = 0
        while at < len(self):
            to = max(at + 1, int(np.searchsorted(self.first, self.first[at] + PRESENCES, "right")) - 1)
            yield np.repeat(np.arange(at, to), np.diff(self.first[at : to + 1])), self.feature[self.first[at] : self.first[to]]
            at = to

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """The sum of the rows' weights for each of the sample's features."""
        out = np.zeros(len(self.number))
        for row, feature in self.slices():
            out += np.bincount(feature, weight[row], len(out))
        return out

    def only(self, kept: np.ndarray) -> Sample:
        """With the features alone that kept holds for, as they were counted."""
        sizes = np.zeros(len(self), np.int64)
        for row, feature in self.slices():
            sizes += np.bincount(row[kept[feature]], minlength=len(self))
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        left, at = np.empty(first[-1], np.int32), 0
        for _, feature in self.slices():
            stay = feature[kept[feature]]
            left[at : at + len(stay)] = stay
            at += len(stay)
        return Sample(left, first, self.number)

    def margins(self, model: Model) -> np.ndarray:
        """The sum of the model's weights for each text."""
        weights = np.zeros(len(self.number))
        weights[np.searchsorted(self.number, model.index)] = model.values
        out = np.zeros(len(self))
        for row, feature in self.slices():
            out += np.bincount(row, weights[feature], len(self))
        return out


def _groups(index: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of an ascending index that cut no group: begin, end, the groups' numbers and where each begins in the slice."""
    found, at = [], 0
    while at < len(index):
        to = min(at + PRESENCES, len(index))
        if to < len(index):
            cut = int(np.searchsorted(index, index[to], "left"))
            to = cut if cut > at else int(np.searchsorted(index, index[to], "right"))
        heads = np.flatnonzero(np.diff(index[at:to], prepend=-1))
        found.append((at, to, index[at:to][heads].astype(np.int64), heads))
        at = to
    return found


def descend(row: np.ndarray, col: np.ndarray, dims: int, extra: np.ndarray, y: np.ndarray, used: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of features, weights of further columns, and bias of an L2-penalised logistic regression.

    (row, col) are the presences, by ascending row; only the used rows count. Adam on the full sample; sums
    run over presences ordered by row and by column, a slice of whole groups at a time.
    """
    n, k = max(int(used.sum()), 1), extra.shape[1]
    order = np.argsort(col, kind="stable").astype(np.int32)
    row_by_col = row[order]
    by_row, by_col = _groups(row), _groups(col[order])
    w = np.zeros(dims + k + 1)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        margin = extra @ w[dims:-1] + w[-1]
        for at, to, number, heads in by_row:
            margin[number] += np.add.reduceat(w[col[at:to]], heads)
        e = np.where(used, sigmoid(margin) - y, 0.0) / n
        g = np.append(l2 * w[:-1], e.sum())
        g[dims:-1] += extra.T @ e
        for at, to, number, heads in by_col:
            g[number] += np.add.reduceat(e[row_by_col[at:to]], heads)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:dims], w[dims:-1], float(w[-1])


@dataclass
class Model:
    """index, values: the features with a weight, ascending; extra: weights of columns beside the text; a, b: the calibration."""

    index: np.ndarray
    values: np.ndarray
    bias: float
    extra: np.ndarray
    a: float = 1.0
    b: float = 0.0
    fitted: bool = False

    @property
    def weighted(self) -> np.ndarray:
        """Whether a feature has a weight, by number: made once in each process, a byte each."""
        if not hasattr(self, "_weighted"):
            self._weighted = np.zeros(DIMS, bool)
            self._weighted[self.index] = True
        return self._weighted

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_weighted"}

    def margin(self, row: np.ndarray, feature: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(self.weighted[feature])
        r, f = present(row[used], feature[used])
        return np.bincount(r, self.values[np.searchsorted(self.index, f)], n)[:n] + self.bias + extra @ self.extra

    def probability(self, row: np.ndarray, feature: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.margin(row, feature, n, extra) + self.b)


def fit(sample: Sample, y: np.ndarray, extra: np.ndarray, used: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 200) -> Model:
    """A model of y from the used texts' features and further columns; a class without rows gives its prior."""
    used = np.ones(len(y), bool) if used is None else used
    n, ones = int(used.sum()), float(y[used].sum())
    share = (ones + 1) / (n + 2)
    if not 0 < ones < n:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))), np.zeros(extra.shape[1]))
    c1, c = sample.counts(y * used), sample.counts(used.astype(float))
    p = c / n
    z = np.abs(c1 / ones - (c - c1) / (n - ones)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / ones + 1 / (n - ones)))
    z[(c < LEAST_TEXTS) | (c == n)] = 0
    chosen = np.flatnonzero(z >= LEAST_Z)
    place = np.full(len(c), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = sample.only(place >= 0)
    row = np.repeat(np.arange(len(kept), dtype=np.int32), np.diff(kept.first))
    w, more, bias = descend(row, place[kept.feature], len(chosen), extra, y, used, l2, rounds)
    return Model(sample.number[chosen], w, bias, more, fitted=True)


def fit_calibrated(sample: Sample, y: np.ndarray, extra: np.ndarray, fold: np.ndarray) -> tuple[Model, np.ndarray]:
    """A model of all rows, calibrated on margins of models that didn't see the row; and those rows' probabilities."""
    n = len(y)
    margin = np.zeros(n)
    for k in np.unique(fold):
        part = fit(sample, y, extra, fold != k)
        outside = sample.margins(part) + part.bias + extra @ part.extra
        margin[fold == k] = outside[fold == k]
    model = fit(sample, y, extra)
    if len(np.unique(y)) == 2:
        none = np.zeros(0, np.int32)
        _, a, b = descend(none, none, 0, margin[:, None], y, np.ones(n, bool), 1e-4, 300)
        model.a, model.b = float(max(a[0], 1e-3)), b
    return model, sigmoid(model.a * margin + model.b)
