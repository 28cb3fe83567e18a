"""Token-id output as shards of Re-Pair grammars.

Documents are ordered by doc_id (range partitions, sorted inside), encoded whole, and put into
shards of about `SHARD_TOKENS` tokens. In a shard the frequent pairs of neighbouring symbols are
replaced by nonterminals, round after round: each round takes all pairs with at least a quarter of
the most frequent pair's count, until none occurs `LEAST_COUNT` times. Pairs never cross documents.

File format: a Parquet table, one row for each shard, (part, shard) in doc_id order: the documents'
ids, token and symbol counts; the rules (rule k is nonterminal base + k and stands for two earlier
symbols); the expansion length of each rule; and the symbols. Integers are little-endian, stored by
byte position. `decode` expands a shard, `decode_span` only the symbols that a span of a document needs.

A null text is empty and holds its end id alone. Null doc_ids come first; rows with one doc_id are
ordered by text. An empty table makes an empty file. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import textbatch as tb
from marlstone.llm import tokens as tk
from marlstone.session import bounded, shared_folder, ship, stored, table

VOCABULARY, END = "word_bpe_49k.json", 2
SHARD_TOKENS = 1_000_000
LEAST_COUNT = 16
SHARD = "part int, shard int, n_tokens long, base long, docs binary, missing binary, lengths binary, symbols_of_doc binary, left binary, right binary, expansion binary, symbols binary"
_CELLS = 20


@dataclass
class Grammar:
    """symbols: what is left of the text; rule k makes symbol base + k of left[k] and right[k]."""

    base: int
    left: np.ndarray
    right: np.ndarray
    expansion: np.ndarray
    symbols: np.ndarray
    symbols_of_doc: np.ndarray


def frequent(key: np.ndarray, cell: np.ndarray, times: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all pairs that occur at least a quarter as often as the most frequent, their pairs, which each is, and counts.

    A pair's cell counts it at least as often. So only cells of enough occurrences are sorted: as the fullest
    cell may hold many pairs, those of a quarter of it show a frequency, and it shows whether more are needed.
    """
    inside = ~last[:-1]
    least = max(LEAST_COUNT, int(times[1:].max(initial=0)) // 4)
    while True:
        often = np.flatnonzero((times >= least)[cell] & inside)
        pairs, which, n = np.unique(key[often], return_inverse=True, return_counts=True)
        enough = max(LEAST_COUNT, int(n.max(initial=0)) // 4)
        if enough >= least:
            return often, pairs, which, n
        least = enough


def compress(ids: np.ndarray, lengths: np.ndarray) -> Grammar:
    """The grammar of one shard; lengths are the documents' token counts."""
    symbols = ids.astype(np.int64)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    base = int(symbols.max(initial=0)) + 1
    left, right, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.ones(base, np.int64)]
    known = base
    while len(symbols) > 1:
        key = (symbols[:-1] << np.int64(32)) | symbols[1:]
        cell = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CELLS)).astype(np.int64)
        cell[last[:-1]] = 0  # counted together and never replaced
        times = np.bincount(cell, minlength=1 << _CELLS)
        often, pairs, which, n = frequent(key, cell, times, last)
        if not len(pairs) or n.max() < LEAST_COUNT:
            break
        chosen = n >= max(LEAST_COUNT, n.max() // 4)
        number = np.full(len(pairs), -1)
        number[chosen] = known + np.arange(int(chosen.sum()))
        use = chosen[which]
        at, to = often[use], number[which[use]]
        # Of places that overlap, those at even distance from the first of their run are replaced.
        run = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, to = at[even], to[even]
        symbols[at] = to
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last = symbols[stay], last[stay]
        a, b = pairs[chosen] >> np.int64(32), pairs[chosen] & np.int64(0xFFFFFFFF)
        sizes = np.concatenate(size)
        left.append(a)
        right.append(b)
        size.append(sizes[a] + sizes[b])
        known += len(a)
    ends = np.flatnonzero(last)
    per_doc = np.zeros(len(lengths), np.int64)
    per_doc[lengths > 0] = np.diff(ends, prepend=-1)
    return Grammar(base, np.concatenate(left), np.concatenate(right), np.concatenate(size[1:] or [np.zeros(0, np.int64)]), symbols, per_doc)


def expand(symbols: np.ndarray, g: Grammar) -> np.ndarray:
    """The tokens that symbols stand for; each pass undoes one level of rules."""
    while len(big := np.flatnonzero(symbols >= g.base)):
        twice = np.ones(len(symbols), np.int64)
        twice[big] = 2
        rule = symbols[big] - g.base
        place = (np.cumsum(twice) - twice)[big]
        symbols = np.repeat(symbols, twice)
        symbols[place], symbols[place + 1] = g.left[rule], g.right[rule]
    return symbols.astype(np.uint32)


def decode_span(g: Grammar, doc: int, start: int, stop: int) -> np.ndarray:
    """Tokens start to stop of a document, from the expansion lengths, without expanding the rest."""
    first = int(g.symbols_of_doc[:doc].sum())
    symbols = g.symbols[first : first + int(g.symbols_of_doc[doc])]
    sizes = np.where(symbols < g.base, 1, g.expansion[np.maximum(symbols - g.base, 0)] if len(g.expansion) else 1)
    ends = np.cumsum(sizes)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], g)[start - skipped : stop - skipped]


def planes(values: np.ndarray, width: int = 4) -> bytes:
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unplanes(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode the documents and write the shards."""
    ship(docs.sparkSession)
    names = [x.split(" ")[0] for x in SHARD.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 8]

    def shard(parts: list[tuple], part: int, number: int) -> pa.RecordBatch:
        ids, lengths = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        keys = pa.concat_arrays([x[2] for x in parts])
        g = compress(ids, lengths)
        values = [part, number, len(ids), g.base, planes(keys.fill_null(0).to_numpy().view(np.uint64), 8), keys.is_null().to_numpy(zero_copy_only=False).tobytes(), planes(lengths), planes(g.symbols_of_doc), planes(g.left), planes(g.right), planes(g.expansion, 8), planes(g.symbols)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        parts, size = [], 0
        for batch in batches:
            for piece in tb.slices(batch, most=1 << 20):
                ids, lengths = tk.with_end(*tk.encoder(vocabulary).encode(piece.column("text")), end)
                parts.append((ids, lengths, piece.column("doc_id")))
                size += len(ids)
                if size >= shard_tokens:
                    yield shard(parts, part, number)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield shard(parts, part, number)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARD).write.parquet(folder)


def grammar(batch: pa.RecordBatch, i: int) -> Grammar:
    get = lambda name, width=4: unplanes(batch.column(name)[i].as_py(), width)
    return Grammar(batch.column("base")[i].as_py(), get("left"), get("right"), get("expansion", 8), get("symbols"), get("symbols_of_doc"))


def read(spark, folder: str) -> DataFrame:
    """Per document: doc_id, start among all tokens, n_tokens and ids_crc32, from the decoded shards."""
    ship(spark)
    shards = spark.read.schema(SHARD).parquet(folder)
    # Tokens before each part: a row for each range partition; then before each shard, inside its part.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    starts = shards.select("part", "shard", inside.alias("shard_start"), "n_tokens").join(before, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("first"))
    columns = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                g = grammar(batch, i)
                data = memoryview(expand(g.symbols, g).astype("<u4").tobytes())
                n = unplanes(batch.column("lengths")[i].as_py())
                ends = np.cumsum(n)
                ids = unplanes(batch.column("docs")[i].as_py(), 8)
                crc = [zlib.crc32(data[4 * (b - k) : 4 * b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                keys = pa.array(ids, mask=np.frombuffer(batch.column("missing")[i].as_py(), bool))
                yield pa.RecordBatch.from_arrays([keys, pa.array(ends - n + batch.column("first")[i].as_py()), pa.array(n), pa.array(np.array(crc, np.int64))], schema=columns)

    placed = shards.join(bounded(stored(starts)), ["part", "shard"])
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_ids(spark, sf_dir) -> DataFrame:
    """All documents' ids written as grammars and read back."""
    folder = f"{shared_folder(spark)}/ids"
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
