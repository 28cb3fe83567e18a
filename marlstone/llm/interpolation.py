"""Language-model scores by deleted interpolation.

Tokens are words (A-Z lower-cased) and one end token for each document, which is also the first
word's context. A token's probability is a mixture of the bigram, unigram and uniform estimates;
the mixture's weights depend on a bucket of the context's count and are learned by expectation
maximisation on training documents whose own counts are deleted from the estimates.

Counts are exact over all training documents and are never gathered in one place. Documents are
put into chunks of about `CHUNK_TOKENS` tokens, written once. Each chunk sends its distinct keys,
with counts, to the key's range; the range adds up and answers each chunk with the totals of its
keys; then each chunk is scored alone. A key that half of all documents hold is one entry of each
chunk, so no range gets more than its share. Words are known by 64-bit hashes, bigrams by 56 bits
of a hash. A token after a context that training doesn't hold has no bigram estimate: the unigram
and uniform weights of its bucket then share the whole.

Only the (bucket, bigram, unigram) histogram of held-out tokens goes to the driver. Its steps of
half an octave reach down to one in all training tokens: at most some 100,000 rows at 2**32 tokens. Null and empty texts hold one token, the end. A null doc_id belongs to training.
Repeated rows count, and are scored, each. Other columns aren't read. Without training documents
every estimate is the uniform one; without held-out tokens the weights stay at their start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textbatch as tb
from marlstone.session import ship, stored, table

CHUNK_TOKENS = 1_000_000
#: Tokens for each range of keys, about.
RANGE_TOKENS = 1_000_000
#: One in so many training documents is held out for the weights.
HELD_OUT = 10
BUCKETS = 24
BIGRAM_BITS = 56
ROUNDS = 40
END = np.uint64(0x5EED0FE9D0C5A11E)
MAIN, HELD, TEST = 0, 1, 2
_START = np.array([0.3, 0.6, 0.1])


@dataclass
class Weights:
    """lambdas[bucket] are the weights of the bigram, unigram and uniform estimates."""

    lambdas: np.ndarray
    tokens: int
    distinct: int


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers by byte position: high bytes are mostly zero and compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)


def bigrams(words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A key of `BIGRAM_BITS` bits of each token with the one before it; the first follows an end."""
    h = words[tokens]
    before = np.concatenate([[END], h[:-1]])
    return tb.mix((before * np.uint64(0x9E3779B97F4A7C15)) ^ h) >> np.uint64(64 - BIGRAM_BITS)


def chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents of one kind: ids and lengths of documents, tokens as places in the chunk's sorted words."""
    spark = docs.sparkSession
    ship(spark)
    key = F.col("doc_id").cast("string")
    kind = F.when(F.crc32(key) % 5 == 1, TEST).when(F.crc32(F.concat(F.lit("held out "), key)) % HELD_OUT == 0, HELD).otherwise(MAIN)
    schema = "chunk long, kind int, n_tokens long, docs binary, missing binary, lengths binary, tokens binary, words binary"

    def flush(number: int, kind: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, missing, lengths, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, tokens = np.unique(hashes, return_inverse=True)
        values = [number, kind, len(tokens), ids.tobytes(), missing.tobytes(), lengths.tobytes(), tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), words.tobytes()]
        types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["chunk", "kind", "n_tokens", "docs", "missing", "lengths", "tokens", "words"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = {MAIN: [], HELD: [], TEST: []}
        size = dict.fromkeys(held, 0)
        for batch in batches:
            for part in tb.slices(batch, most=1 << 20):
                w = tb.words(part.column("text"), tb.NOT_SPACE, lower=True)
                kinds = part.column("kind").to_numpy(zero_copy_only=False)
                ids, missing = part.column("doc_id").fill_null(0).to_numpy(), part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                n = w.counts()
                for k in held:
                    rows = np.flatnonzero(kinds == k)
                    if not len(rows):
                        continue
                    tokens = np.full(int(n[rows].sum()) + len(rows), END)
                    ends = np.cumsum(n[rows] + 1) - 1
                    body = np.ones(len(tokens), bool)
                    body[ends] = False
                    tokens[body] = w.hash[tb.ranges(w.first[rows], n[rows])]
                    held[k].append((ids[rows], missing[rows], n[rows] + 1, tokens))
                    size[k] += len(tokens)
                    if size[k] >= CHUNK_TOKENS:
                        yield flush(number, k, held[k])
                        held[k], size[k], number = [], 0, number + 1
        for k in held:
            if held[k]:
                yield flush(number, k, held[k])
                number += 1

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", kind.alias("kind")).mapInArrow(run, schema))


def _tokens(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def totals(parts: DataFrame, bits: int) -> DataFrame:
    """Of each chunk and range the counts over all training documents of the chunk's keys, and without the held-out ones."""
    sent = "range int, chunk long, kind int, u_keys binary, u_counts binary, b_keys binary, b_counts binary"
    names = [x.split(" ")[0] for x in sent.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, kind = batch.column("chunk")[i].as_py(), batch.column("kind")[i].as_py()
                words, tokens = np.frombuffer(batch.column("words")[i].as_py(), "<u8"), _tokens(batch.column("tokens")[i].as_py())
                u_counts = np.bincount(tokens, minlength=len(words))
                b_keys, b_counts = np.unique(bigrams(words, tokens), return_counts=True)
                edge = np.arange(1, 1 << bits, dtype=np.uint64)
                u_cut = np.concatenate([[0], np.searchsorted(words, edge << np.uint64(64 - bits)) if bits else [], [len(words)]]).astype(int)
                b_cut = np.concatenate([[0], np.searchsorted(b_keys, edge << np.uint64(BIGRAM_BITS - bits)) if bits else [], [len(b_keys)]]).astype(int)
                rows = [
                    (r, chunk, kind, words[u0:u1].tobytes(), b"" if kind == TEST else planes(u_counts[u0:u1]), pack(b_keys[b0:b1]), b"" if kind == TEST else planes(b_counts[b0:b1]))
                    for r, (u0, u1, b0, b1) in enumerate(zip(u_cut[:-1], u_cut[1:], b_cut[:-1], b_cut[1:], strict=True))
                    if u1 > u0 or b1 > b0
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def add(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        out = {"chunk": group.column("chunk").to_pylist(), "range": group.column("range").to_pylist()}
        found = {}
        for family, read in (("u", lambda x: np.frombuffer(x, "<u8")), ("b", unpack)):
            keys = [read(x) for x in group.column(f"{family}_keys").to_pylist()]
            counts = [unplanes(x) if x else np.zeros(len(k), np.uint64) for x, k in zip(group.column(f"{family}_counts").to_pylist(), keys, strict=True)]
            sizes = [len(k) for k in keys]
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.concatenate(counts).astype(float)
            held = np.repeat(kind == HELD, sizes)
            main = np.bincount(place, counts * ~held, len(every)).astype(np.uint64)
            total = main + np.bincount(place, counts * held, len(every)).astype(np.uint64)
            cut = np.concatenate([[0], np.cumsum(sizes)])
            out[f"{family}_all"] = [planes(total[place[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            out[f"{family}_main"] = [planes(main[place[a:b]]) if k == HELD else b"" for a, b, k in zip(cut[:-1], cut[1:], kind, strict=True)]
            found[family] = int((total > 0).sum())
        out["distinct"] = [found["u"]] + [0] * (len(kind) - 1)
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("u_all", pa.binary()), ("u_main", pa.binary()), ("b_all", pa.binary()), ("b_main", pa.binary()), ("distinct", pa.int64())]).empty_table().select(list(out)).schema)

    answer = "chunk long, range int, u_all binary, u_main binary, b_all binary, b_main binary, distinct long"
    return stored(parts.select("chunk", "kind", "tokens", "words").mapInArrow(send, sent).groupBy("range").applyInArrow(add, answer))


def _located(chunk: pa.Table, answers: pa.Table, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of a chunk the counts of itself, of its context and of both."""
    answers = answers.sort_by("range")
    words, tokens = np.frombuffer(chunk.column("words")[0].as_py(), "<u8"), _tokens(chunk.column("tokens")[0].as_py())
    u = np.concatenate([unplanes(x) for x in answers.column(f"u_{which}").to_pylist()])
    b = np.concatenate([unplanes(x) for x in answers.column(f"b_{which}").to_pylist()])
    _, place = np.unique(bigrams(words, tokens), return_inverse=True)
    own = u[tokens].astype(float)
    ends = float(u[np.searchsorted(words, END)])
    return own, np.concatenate([[ends], own[:-1]]), b[place].astype(float)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(int), BUCKETS - 1)


def mixed(model: Weights, own: np.ndarray, context: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The mixture's probability of each token."""
    share = model.lambdas[_bucket(context)]
    rest = share[:, 1] * own / max(model.tokens, 1) + share[:, 2] / (model.distinct + 1)
    return np.where(context > 0, share[:, 0] * both / np.maximum(context, 1) + rest, rest / (share[:, 1] + share[:, 2]))


def learn(parts: DataFrame, back: DataFrame) -> Weights:
    """Weights by expectation maximisation over a histogram of the held-out tokens."""
    n = {r["kind"]: r["n"] for r in parts.groupBy("kind").agg(F.sum("n_tokens").alias("n")).collect()}
    distinct = back.select(F.sum("distinct")).first()[0] or 0
    main = n.get(MAIN, 0)
    steps = 2 * int(np.ceil(np.log2(max(main, 1)))) + 2  # 0 is no estimate, 1 at most one in main, the last is 1

    def count(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        own, context, both = _located(chunk, answers, "main")
        step = lambda p: np.where(p > 0, np.minimum(np.round(2 * np.log2(np.maximum(p, 1e-300))), 0) + steps - 1, 0).astype(int)
        cell = (_bucket(context) * steps + step(both / np.maximum(context, 1))) * steps + step(own / max(main, 1))
        cells, times = np.unique(cell, return_counts=True)
        return pa.table({"cell": cells.astype(np.int64), "n": times.astype(np.int64)})

    answers = back.where((F.length("u_main") > 0) | (F.length("b_main") > 0))  # a range may have bigrams and no word, or the reverse
    held = parts.where(F.col("kind") == HELD).groupBy("chunk").cogroup(answers.groupBy("chunk"))
    rows = held.applyInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cell, times = np.array([r["cell"] for r in rows], int), np.array([r["n"] for r in rows], float)
    value = lambda s: np.where(s > 0, 2.0 ** ((s - steps + 1) / 2), 0)
    p = np.column_stack([value(cell // steps % steps), value(cell % steps), np.full(len(cell), 1 / (distinct + 1))])
    bucket = cell // steps // steps
    lambdas = np.tile(_START, (BUCKETS, 1))
    for _ in range(ROUNDS):
        share = lambdas[bucket] * p
        share *= (times / np.maximum(share.sum(1), 1e-300))[:, None]
        added = np.column_stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)]) + _START
        lambdas = added / added.sum(1, keepdims=True)
    return Weights(lambdas, n.get(MAIN, 0) + n.get(HELD, 0), distinct)


def score(docs: DataFrame) -> DataFrame:
    """Per document its tokens, the unigram base score and the model's log10 probability."""
    parts = chunks(docs)
    tokens = parts.select(F.sum("n_tokens")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(tokens / RANGE_TOKENS, 1)))))
    back = totals(parts, bits)
    shared = docs.sparkSession.sparkContext.broadcast(learn(parts, back))
    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def rate(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        own, context, both = _located(chunk, answers, "all")
        p = mixed(model, own, context, both)
        lengths = np.frombuffer(chunk.column("lengths")[0].as_py(), np.int64)
        heads = np.cumsum(lengths) - lengths
        base = np.log10((own + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
        ids = pa.array(np.frombuffer(chunk.column("docs")[0].as_py(), np.int64), mask=np.frombuffer(chunk.column("missing")[0].as_py(), bool))
        rows = len(lengths)
        return pa.table([ids, pa.array(np.full(rows, chunk.column("kind")[0].as_py() == TEST)), pa.array(lengths), pa.array(np.add.reduceat((own > 0).astype(np.int64), heads)), pa.array(np.full(rows, model.tokens)), pa.array(np.add.reduceat(base, heads)), pa.array(np.add.reduceat(np.log10(p), heads))], schema=kinds)

    answers = back.select("chunk", "range", "u_all", "b_all")
    return parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scores(spark, sf_dir) -> DataFrame:
    """Scores of every document, learned from those whose crc32(doc_id) mod 5 isn't 1."""
    return score(table(spark, sf_dir, "documents"))
