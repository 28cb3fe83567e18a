"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a logistic regression over hashed words and
runs of characters; the log odds of all earlier categories are further inputs. Later models are trained on
earlier categories' out-of-fold probabilities (three folds by a hash of doc_id), so they see the
same kind of probability that scoring gives them. Every model is calibrated on out-of-fold margins.

The labels know two categories: low quality, then toxic. Training takes at most
`training.ROWS_PER_CLASS` rows of each value of each label; scoring takes all documents whole.

A null or empty text has no feature, is never rejected, and gets the models' priors. Where the last
category has no labelled rows of both values there is no model to reject by: nothing is rejected,
and without any label all probabilities are 1/2. A probability equal to the threshold rejects. Very
long texts are scored whole. Repeated rows each get their own row. Extra columns pass through `keep`
untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import linear, training
from marlstone.llm import textbatch as tb
from marlstone.llm import tokens as tk
from marlstone.session import ship, table

CHAIN = ("low_quality", "toxic")
#: A document of this probability of being toxic is rejected.
THRESHOLD = 0.5


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def learn_chain(sample: linear.Sample, labels: dict[str, np.ndarray], fold: np.ndarray, chain: Sequence[str] = CHAIN) -> list[linear.Model]:
    models, extra = [], np.zeros((len(fold), 0))
    for name in chain:
        model, outside = linear.fit_calibrated(sample, labels[name], extra, fold)
        models.append(model)
        extra = np.column_stack([extra, odds(outside)])
    return models


def train(docs: DataFrame, labels: DataFrame, chain: Sequence[str] = CHAIN, rows_per_class: int = training.ROWS_PER_CLASS) -> list[linear.Model]:
    if "low_quality" in chain:
        labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), *[c for c in labels.columns if c in chain])
    chain = list(chain)
    return training.train(docs, training.sample(labels, chain, rows_per_class), chain, True, lambda s, y, k: learn_chain(s, y, k, chain))


def probabilities(models: list[linear.Model], column: pa.Array) -> np.ndarray:
    """One column for each category of the chain."""
    row, feature = linear.features(column, lower=True)
    out = np.zeros((len(column), 0))
    for model in models:
        out = np.column_stack([out, model.probability(row, feature, len(column), odds(out))])
    return out


def score(docs: DataFrame, models: list[linear.Model], chain: Sequence[str] = CHAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability p_<category> for each category and rejected, by the last of them."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = ["doc_id", *[f"p_{c}" for c in chain], "rejected"]

    def run(batches):
        tk.drop()
        for batch in batches:
            for part in tb.slices(batch, most=linear.SLICE):
                p, bad = rejected(shared.value, part.column("text"), threshold)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x) for x in p.T], pa.array(bad)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names[1:-1]) + ", rejected boolean")


def rejected(models: list[linear.Model], column: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and which rows the last category's model rejects."""
    p = probabilities(models, column)
    return p, (p[:, -1] >= threshold) & textual(column) & models[-1].fitted


def textual(column: pa.Array) -> np.ndarray:
    _, bounds = tb.raw(column)
    return np.diff(bounds) > 0


def keep(docs: DataFrame, models: list[linear.Model], threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't rejected, as they are."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        tk.drop()
        for batch in batches:
            for part in tb.slices(batch, most=linear.SLICE):
                yield part.filter(pa.array(~rejected(shared.value, part.column("text"), threshold)[1]))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op6_toxicity(spark, sf_dir) -> DataFrame:
    """Chain probabilities of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
