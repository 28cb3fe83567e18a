"""Packing documents into windows by lexical retrieval.

Documents are taken from each input partition in shards of about `SHARD_TOKENS` tokens; a shard has
its own BM25 inverted index over token ids. A seed document fills windows; where its last window
has room, the index returns the unused neighbours, best first, and they fill it. A neighbour that
doesn't fit is cut: its rest is the next seed. So only the last window of a shard has padding.
Every token takes part in retrieval: those that more than a quarter of the shard's documents hold
are kept as a dense matrix, the others as postings. Without any neighbour the next unused document
follows; equal scores go by place.

There is no shuffle: partitions are packed where they are read, so the same input splits give the
same windows when a lost task runs again. sequence_id is unique over the result.

A null text is empty and holds its end id alone. Repeated rows are packed each. An empty table
gives no piece. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textbatch as tb
from marlstone.llm import tokens as tk
from marlstone.session import ship, table

WINDOW = 1024
SHARD_TOKENS = 600_000
#: Text bytes that are encoded at a time.
SLICE = 1 << 19
VOCABULARY, END = "byte_bpe_50k.json", 0
K1, B = 1.2, 0.75
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 over the documents of one shard: postings by token, and weights as of a query of single tokens."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(lengths)
        doc = np.repeat(np.arange(n, dtype=np.int64), lengths)
        pair, tf = np.unique(doc << np.int64(32) | ids.astype(np.int64), return_counts=True)
        doc, term = pair >> np.int64(32), (pair & np.int64(0xFFFFFFFF)).astype(np.int64)
        df = np.bincount(term)
        weight = np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(lengths.mean(), 1)))
        common = df[term] > max(1, n // 4)
        which, column = np.unique(term[common], return_inverse=True)
        self.dense = np.zeros((n, len(which)), np.float32)
        self.dense[doc[common], column] = weight[common]
        doc, term, weight = doc[~common], term[~common], weight[~common]
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.terms = term
        by = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by], weight[by]
        self.at = np.searchsorted(term[by], np.arange(len(df) + 1))
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a token with the seed, by falling score, then place."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        post = tb.ranges(self.at[terms], self.at[terms + 1] - self.at[terms])
        score = np.bincount(self.doc[post], self.weight[post], self.n)
        score = (score + self.dense @ (self.dense[seed] > 0).astype(np.float32)) * unused
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(ids: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    index = Index(ids, lengths)
    unused = np.ones(len(lengths), bool)
    sequence = offset = following = 0
    queue: list[int] = []
    for _ in range(len(lengths)):
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            doc = queue.pop()
        else:
            while not unused[following]:
                following += 1
            doc = following
        unused[doc] = False
        start, left = 0, int(lengths[doc])
        new_window = not offset
        while left:
            size = min(left, window - offset)
            yield doc, start, size, sequence, offset
            start, left, offset = start + size, left - size, offset + size
            if offset == window:
                sequence, offset, new_window = sequence + 1, 0, True
        if new_window and offset:  # this document's rest is the seed of the open window
            queue = index.neighbours(doc, unused)[::-1].tolist()


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every document's pieces and where they lie."""
    ship(docs.sparkSession)
    names = [x.split(" ")[0] for x in PIECE.split(", ")]

    def shard(parts: list[tuple], number: int) -> tuple[pa.RecordBatch, int]:
        ids, lengths = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        keys = pa.concat_arrays([x[2] for x in parts])
        head = np.cumsum(lengths) - lengths
        found = np.array(list(pack(ids, lengths, window)), np.int64).reshape(-1, 5)
        doc, start, size, sequence, offset = found.T
        data = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((head[doc] + start).tolist(), (head[doc] + start + size).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *map(pa.array, (start, size, np.array(crc, np.int64), lengths[doc], sequence + number, offset))], names=names), number + int(sequence.max(initial=-1)) + 1

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        tb.give_back()  # what an earlier stage left in this worker
        parts, size = [], 0
        for batch in batches:
            for part in tb.slices(batch, most=SLICE):
                ids, lengths = tk.with_end(*tk.encoder(vocabulary).encode(part.column("text")), end)
                parts.append((ids, lengths, part.column("doc_id")))
                size += len(ids)
                if size >= shard_tokens:
                    out, number = shard(parts, number)
                    yield out
                    parts, size = [], 0
        if parts:
            yield shard(parts, number)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def op1_packing(spark, sf_dir) -> DataFrame:
    """All documents in windows of 1024 tokens."""
    return pieces(table(spark, sf_dir, "documents"))
