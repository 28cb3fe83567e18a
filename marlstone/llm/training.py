"""Bounded labelled samples and models trained from them in one Spark task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import linear
from marlstone.llm import textbatch as tb
from marlstone.llm import tokens as tk
from marlstone.session import ship

#: Labelled rows of each value of each label that a model is trained on, at most.
ROWS_PER_CLASS = 2500


def sample(labels: DataFrame, names: Sequence[str], rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """doc_id and 0/1 labels: of each value of each label the rows that come first by a hash of doc_id.

    A document with several rows of labels has the highest of each. Null labels count as 0.
    """
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(n).cast("int"), F.lit(0))).alias(n) for n in names])
    parts = [one.where(F.col(n) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for n in names for v in (0, 1)]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    return chosen.distinct()


def train(docs: DataFrame, chosen: DataFrame, names: Sequence[str], lower: bool, learn: Callable[..., object]) -> object:
    """learn(sample of features, labels by name, fold) over the sample's texts, run in one task.

    The sample's bound also bounds what that task and the driver get: distinct features of each
    text, and the model. Repeated documents count once; documents without text train nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    names = list(names)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def extract(batches):
        tk.drop()
        for batch in batches:
            for part in tb.slices(batch, most=linear.SLICE):
                row, feature = linear.present(*linear.features(part.column("text"), lower))
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                kept = [feature[first[i] : first[i + 1]].astype(np.int32).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column(n) for n in names], pa.array(kept, pa.binary())], names=["doc_id", *names, "features"])

    def fit(batches):
        tk.drop()  # what an earlier stage left in this worker
        flat, spans, labels = bytearray(), {}, {}
        for batch in batches:
            for x in batch.to_pylist():
                if x["doc_id"] not in spans:
                    at = len(flat) // 4
                    flat += x["features"]
                    spans[x["doc_id"]], labels[x["doc_id"]] = (at, len(flat) // 4), [x[n] for n in names]
        keys = sorted(spans)
        fold = tb.mix(np.array(keys, np.int64).view(np.uint64)) % np.uint64(3)
        y = np.array([labels[k] for k in keys], float).reshape(len(keys), len(names))
        held = linear.Sample.gathered(np.frombuffer(flat, np.int32), [spans[k] for k in keys], linear.LEAST_TEXTS)  # rarer ones can't get a weight
        del flat
        tb.give_back()
        model = learn(held, {n: y[:, k] for k, n in enumerate(names)}, fold.astype(int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    kinds = ", ".join(f"{n} int" for n in names)
    return pickle.loads(picked.mapInArrow(extract, f"doc_id long, {kinds}, features binary").repartition(1).mapInArrow(fit, "model binary").first()["model"])
