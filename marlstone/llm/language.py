"""Language by a mixture over each document's words.

Per language, byte 4-grams of letter words (with the space at either end) give a multinomial with
add-half smoothing over 2**17 hashed cells. It is learned from text and non-null lang of documents
whose crc32(doc_id) mod 3 isn't 1, from about `ROWS_PER_LANGUAGE` of each language, picked by a
hash of doc_id. A document's words then have a likelihood under each language; expectation
maximisation gives the proportions. The language set is the one of least -2 log L + (m - 1) log n
(n words) among the m most likely languages, for every m up to all of them; the largest proportion in it is the prediction and its
score. Whole texts are scored; lang, source and doc_id aren't read for it.

`und` with score 0: null text, no letter, or nothing learned. Ties go to the first language by name.
Repeated rows are scored each; further columns aren't read. A null doc_id isn't held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textbatch as tb
from marlstone.session import ship, table

ROWS_PER_LANGUAGE = 3000
BITS = 17
ROUNDS = 12
#: A language of a smaller share in the mixture of all starts no larger set.
LEAST_SHARE = 1e-9
_LETTERS = ((tb._BYTE >= 97) & (tb._BYTE <= 122)) | (tb._BYTE >= 128)


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray  # a row for each language, a column for each cell


def grams(w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all 4-grams of the words and the number of them before each word.

    A word has a space at either end, whatever stands beside it in its row or in the next one.
    """
    row = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    data = np.full(len(w.data) + len(w.bounds) + 4, 32, np.uint64)
    data[np.arange(len(w.data)) + row + 1] = np.where(_LETTERS[w.data], w.data, 32)  # a space before each row
    sizes = np.maximum(w.end - w.start - 1, 1)
    at = tb.ranges(w.start + w.doc, sizes)  # the byte before the word
    gram = data[at]
    for k in (1, 2, 3):
        gram = gram << np.uint64(8) | data[at + k]
    before = np.concatenate([[0], np.cumsum(sizes)])
    single = before[:-1][w.end - w.start == 1]
    gram[single] = gram[single] & ~np.uint64(0xFF) | np.uint64(32)  # the fourth byte would be the next word's
    cell = (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    return cell.astype(np.int64), before


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Languages:
    """Counts of cells by language over the sample; languages times 2**17 rows at most reach the driver."""
    ship(docs.sparkSession)
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").count().select("lang", (F.lit(rows_per_language) / F.col("count")).alias("share"))
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    picked = known.join(F.broadcast(sizes), "lang").where(chance < F.col("share")).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in tb.slices(batch):
                cell, before = grams(w := tb.words(part.column("text"), _LETTERS, lower=True, hashed=False))
                names, place = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                row = np.repeat(place[w.doc], np.diff(before))
                both, n = np.unique(row << np.int64(BITS) | cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[both >> np.int64(BITS)].tolist(), pa.string()), pa.array(both & np.int64((1 << BITS) - 1)), pa.array(n.astype(np.int64))], names=["lang", "cell", "n"])

    found = picked.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    counts = np.full((len(names), 1 << BITS), 0.5)
    counts[np.searchsorted(names, found["lang"].to_numpy(str)) if names else [], found["cell"].to_numpy(int)] += found["n"].to_numpy(float)
    return Languages(names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def _mean(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1], axis=0) / np.diff(first)[:, None]


def proportions(likelihood: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixture of the allowed languages of each document (each with words) and its log likelihood."""
    n = np.diff(first)
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        joint = likelihood * np.repeat(pi, n, axis=0)
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        pi = _mean(joint, first)
    total = np.log(np.maximum((likelihood * np.repeat(pi, n, axis=0)).sum(1), 1e-300))
    return pi, np.add.reduceat(total, first[:-1])


def infer(model: Languages, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of each row (zero outside its language set), its words, and whether it has a letter."""
    w = tb.words(column, _LETTERS, lower=True, hashed=False)
    k, rows = len(model.names), len(column)
    n, out = w.counts(), np.zeros((rows, k))
    ascii_letter = tb.sum_by(_LETTERS[w.data] & (w.data < 128), w.bounds) > 0
    letter = ascii_letter.copy()
    for i in np.flatnonzero(~ascii_letter & (n > 0)):
        letter[i] = any(c.isalpha() for c in column[int(i)].as_py())
    full = np.flatnonzero(n > 0)
    if not len(full) or not k:
        return out, n, letter
    cell, before = grams(w)
    log = np.column_stack([np.add.reduceat(model.log_p[j][cell], before[:-1]) for j in range(k)]).astype(np.float64)
    likelihood = np.exp(np.maximum(log - log.max(1, keepdims=True), -60))
    first = np.append(w.first[:-1][full], len(w.start))
    pi, _ = proportions(likelihood, first, np.ones((len(full), k)))
    order = np.argsort(-pi, axis=1, kind="stable")
    best = np.zeros_like(pi)
    best[np.arange(len(full)), order[:, 0]] = 1
    each = np.log(np.maximum(likelihood, 1e-300))
    cost = -2 * np.add.reduceat(each, first[:-1], axis=0)[np.arange(len(full)), order[:, 0]]
    share = np.take_along_axis(pi, order, axis=1)
    for m in range(2, k + 1):  # every size: a larger set may be better though the next one isn't
        open_ = np.flatnonzero(share[:, m - 1] > LEAST_SHARE)
        if not len(open_):
            break
        sizes = np.diff(first)[open_]
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :m], 1.0, axis=1)
        mix, total = proportions(likelihood[tb.ranges(first[:-1][open_], sizes)], np.concatenate([[0], np.cumsum(sizes)]), allowed)
        new = -2 * total + (m - 1) * np.log(sizes)
        better = new < cost[open_]
        best[open_[better]], cost[open_[better]] = mix[better], new[better]
    out[full] = best
    return out, n, letter


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the proportions of the chosen languages."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in tb.slices(batch, most=max(1 << 18, (1 << 22) // max(4, len(model.names)))):
                pi, _, letter = infer(model, part.column("text"))
                known = letter & (pi.sum(1) > 0)
                top = pi.argmax(1) if len(model.names) else np.zeros(len(pi), int)
                names = [model.names[j] if ok else "und" for j, ok in zip(top, known, strict=True)]
                score = np.where(known, pi.max(1, initial=0), 0.0).clip(0, 1)
                sets = [[{"lang": model.names[j], "share": float(p[j])} for j in np.flatnonzero(p)] if ok else [] for p, ok in zip(pi, known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(score), pa.array(sets, kinds.field("languages").type)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def op3_language(spark, sf_dir) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
