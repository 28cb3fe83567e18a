"""Quality rules: word statistics with fixed limits, then a calibrated linear model.

The model is a logistic regression over hashed words and character n-grams (case kept), trained on at most
`training.ROWS_PER_CLASS` labelled rows of each class and calibrated on out-of-fold margins. All
documents are scored whole, in Arrow batches, against `THRESHOLD`.

Words are runs of other bytes than space and \\t..\\r. A null or empty text has no words and fails
the base rules. Without labels of both values the model keeps what the base rules keep. A
probability equal to the threshold keeps. Very long texts are scored whole. Repeated rows each get
their own row; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import linear, training
from marlstone.llm import textbatch as tb
from marlstone.session import ship, table

#: Least calibrated probability of good quality.
THRESHOLD = 0.5
LEAST_WORDS, MOST_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def repeat_words(w: tb.Words, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each row in windows that occur twice or more in the row."""
    at, doc, h = tb.windows(w, size)
    key = h ^ tb.mix(doc.astype(np.uint64) + np.uint64(1))
    cell = (key >> np.uint64(43)).astype(np.int64)
    maybe = np.flatnonzero((np.bincount(cell, minlength=1 << 21) > 1)[cell])
    _, inverse, n = np.unique(key[maybe], return_inverse=True, return_counts=True)
    start = at[maybe[n[inverse] > 1]]
    depth = np.zeros(len(w.start) + size + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + size, -1)
    return tb.sum_by(np.cumsum(depth)[: len(w.start)] > 0, w.first)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The base columns of every row."""
    w = tb.words(column, tb.NOT_SPACE)
    chars = np.concatenate([[0], np.cumsum(tb.STARTS[w.data], dtype=np.int64)])
    per_word = chars[w.end] - chars[w.start]
    lines = np.zeros(len(w.bounds) - 1, np.int64)
    for i in range(len(lines)):
        full = [x for x in w.data[w.bounds[i] : w.bounds[i + 1]].tobytes().split(b"\n") if x.strip(tb.SPACES)]
        lines[i] = len(full) - len(set(full))
    n, repeat = w.counts(), repeat_words(w)
    return {"n_words": n, "word_chars": tb.sum_by(per_word, w.first), "n_symbols": tb.sum_by(_SYMBOL[w.data], w.bounds), "n_dup_lines": lines, "n_repeat_words": repeat, "base_failed": (n < LEAST_WORDS) | (100 * repeat > MOST_REPEAT_PERCENT * n)}


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = training.ROWS_PER_CLASS) -> linear.Model:
    learn = lambda s, y, k: linear.fit_calibrated(s, y["quality"], np.zeros((len(k), 0)), k)[0]
    return training.train(docs, training.sample(labels, ["quality"], rows_per_class), ["quality"], False, learn)


def judge(docs: DataFrame, model: linear.Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base columns, the probability of good quality and the verdict."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, most=linear.SLICE):
                column = part.column("text")
                base = statistics(column)
                p = shared.value.probability(*linear.features(column, lower=False), len(column), np.zeros((len(column), 0)))
                kept = ~base["base_failed"] & ((p >= threshold) | (not shared.value.fitted))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x) for x in base.values()], pa.array(kept), pa.array(p)], names=["doc_id", *base, "kept", "p_quality"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double")


def op8_quality(spark, sf_dir) -> DataFrame:
    """Base statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
