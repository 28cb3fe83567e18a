"""Benchmark decontamination with a generalised suffix automaton.

Items are normalised to words (A-Z lower-cased, runs of ASCII letters, digits and any non-ASCII
byte) and put into one automaton. Training words stream through it; the longest match that ends at
each word is tracked. Every occurrence of `window` consecutive item words, or of a whole shorter
item, is a hit. Spans of hits are cut from a document; a document whose hit share is over
`max_coverage` goes whole.

The automaton is broadcast, so its size is bounded: items are dealt by hash into blocks of about
`BLOCK_WORDS` words, and up to `BLOCKS_AT_ONCE` blocks are sent together: their hits are united where the
documents are read, in one scan without a shuffle. Beyond that, every such group of blocks scans the documents
and the hits are united per document.

Null and empty texts have no words and no hits. Items without words match nothing. An empty
benchmark leaves all documents clean. Repeated rows each get their own result. Extra columns pass
through `clean` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import textbatch as tb
from marlstone.session import bounded, ship, stored

WINDOW = 10
#: Words of items in one automaton: at most some 100 MB in a Python worker.
BLOCK_WORDS = 100_000
#: Text bytes that are searched at a time.
SLICE = 1 << 18
#: Blocks whose automata a task holds at a time, so a benchmark of ten blocks needs one scan of the documents.
BLOCKS_AT_ONCE = 10
#: A document with a larger share of hit words goes whole.
MAX_COVERAGE = 0.5
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class SuffixAutomaton:
    """All runs of words of all items; each state knows which items contain its runs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ids: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        owners: list[set[int]] = [set()]
        ends: dict[int, list[tuple[int, int]]] = {}
        for number, (_, item) in enumerate(items):
            state = 0
            for word in item:
                state = self._extend(state, self.ids.setdefault(word, len(self.ids)), owners)
                owners[state].add(number)
            if item and len(item) < window:
                ends.setdefault(state, []).append((len(item), number))
        # Owners move up the links, longest states first; short items down, shortest first.
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(by_length):
            if self.link[state] > 0:
                owners[self.link[state]] |= owners[state]
        self.owners = [tuple(sorted(x)) for x in owners]
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        for state in by_length:
            if found := (*self.short.get(self.link[state], ()), *ends.get(state, ())):
                self.short[state] = found
        self.least = min((min(len(item), window) for _, item in items if item), default=window)
        self._filter(items)

    def _extend(self, last: int, word: int, owners: list[set[int]]) -> int:
        length, link, goto = self.length, self.link, self.next
        if word in goto[last]:
            known = goto[last][word]
            return known if length[known] == length[last] + 1 else self._clone(last, word, known, owners)
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        goto.append({})
        owners.append(set())
        at = last
        while at >= 0 and word not in goto[at]:
            goto[at][word] = state
            at = link[at]
        if at >= 0:
            known = goto[at][word]
            link[state] = known if length[known] == length[at] + 1 else self._clone(at, word, known, owners)
        return state

    def _clone(self, at: int, word: int, known: int, owners: list[set[int]]) -> int:
        copy = len(self.length)
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[known])
        self.next.append(dict(self.next[known]))
        owners.append(set(owners[known]))
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _filter(self, items: list[tuple[str, list[bytes]]]) -> None:
        """Hashes of the items' short runs: only words inside such runs need to be streamed."""
        self.gram = min(4, self.least)
        joined = tb.words(pa.array([b" ".join(item).decode() for _, item in items], pa.string()), tb.ALNUM)
        self.grams = np.unique(tb.windows(joined, self.gram)[2])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.grams >> np.uint64(44)] = True

    def regions(self, w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges in which a match may lie: all their short runs occur in items."""
        at, doc, h = tb.windows(w, self.gram)
        hit = np.flatnonzero(self.sieve[h >> np.uint64(44)])
        if len(hit) and len(self.grams):
            place = np.minimum(np.searchsorted(self.grams, h[hit]), len(self.grams) - 1)
            hit = hit[self.grams[place] == h[hit]]
        else:
            hit = hit[:0]
        if not len(hit):
            return hit, hit
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at[hit]) != 1) | (np.diff(doc[hit]) != 0)]))
        start, end = at[hit[new]], at[hit[np.concatenate([new[1:], [len(hit)]]) - 1]] + self.gram
        long = end - start >= self.least
        return start[long], end[long]

    def stream(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words (start, end) and the items they come from."""
        state = matched = 0
        spans, items = [], set()
        length, link, goto, ids, window = self.length, self.link, self.next, self.ids, self.window
        for i, word in enumerate(text):
            number = ids.get(word, -1)
            while state and number not in goto[state]:
                state = link[state]
                matched = length[state]
            if number in goto[state]:
                state, matched = goto[state][number], matched + 1
            else:
                state = matched = 0
                continue
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                items.update(self.owners[at])
                spans.append((i + 1 - window, i + 1))
            for size, item in self.short.get(state, ()):
                if size <= matched:
                    items.add(item)
                    spans.append((i + 1 - size, i + 1))
        return spans, items


def hits(automaton: SuffixAutomaton, w: tb.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Of each word whether it is hit; of each row with hits the items' names."""
    hit, items = np.zeros(len(w.start), bool), {}
    for start, end in zip(*automaton.regions(w), strict=True):
        spans, found = automaton.stream([w.text(i) for i in range(start, end)])
        for a, b in spans:
            hit[start + a : start + b] = True
        if found:
            items.setdefault(int(w.doc[start]), set()).update(automaton.names[i] for i in found)
    return hit, items


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """One automaton for each block of items; a block is read alone, so its size bounds memory."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.select(F.sum(F.size(F.split("text", _SPLIT)))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        w = tb.words(pa.array([r["text"] for r in rows], pa.string()), tb.ALNUM, lower=True, hashed=False)
        yield SuffixAutomaton([(r["item_id"] or "", [w.text(i) for i in range(w.first[k], w.first[k + 1])]) for k, r in enumerate(rows)], window)


def digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def all_hits(blocks: list, w: tb.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words any block's items hit, and the names of the items of all blocks by row."""
    hit, items = np.zeros(len(w.start), bool), {}
    for block in blocks:
        own, names = hits(block, w)
        hit |= own
        for row, found in names.items():
            items.setdefault(row, set()).update(found)
    return hit, items


def shared_groups(spark: SparkSession, benchmark: DataFrame, window: int, block_words: int, blocks_at_once: int) -> list[Broadcast]:
    """Broadcasts of so many blocks' automata at a time: the documents are scanned once for each."""
    return [spark.sparkContext.broadcast(list(group)) for group in batched(automata(benchmark, window, block_words), blocks_at_once)]


def scans(docs: DataFrame, shared: list[Broadcast]) -> list[DataFrame]:
    """Of each group of blocks per document: doc_id, n_words, hit spans of words, the sorted names of the items that occur and a hash of the text."""
    schema = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, text_key long"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("text_key", pa.int64())])

    def scan(shared):
        def run(batches):
            for batch in batches:
                for part in tb.slices(batch, most=SLICE):
                    w = tb.words(part.column("text"), tb.ALNUM, lower=True)
                    hit, items = all_hits(shared.value, w)
                    spans = [[] for _ in range(part.num_rows)]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    for a, b in zip(edge[::2], edge[1::2], strict=True):
                        while a < b:  # a run of hits may cross rows
                            row = int(w.doc[a])
                            c = min(b, w.first[row + 1])
                            spans[row].append({"start": int(a - w.first[row]), "end": int(c - w.first[row])})
                            a = c
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), w.counts(), pa.array(spans, arrow.field("spans").type), pa.array([sorted(items.get(i, ())) for i in range(part.num_rows)], arrow.field("items").type), part.column("text_key")], schema=arrow)

        return run

    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return [source.mapInArrow(scan(one), schema) for one in shared]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, blocks_at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """Per document: doc_id, n_words, hit spans of words and the sorted names of the items that occur."""
    spark = docs.sparkSession
    ship(spark)
    found = scans(docs, shared_groups(spark, benchmark, window, block_words, blocks_at_once))
    if len(found) == 1:
        return found[0].drop("text_key")
    united = found[0]
    for more in found[1:]:
        united = united.unionByName(more)
    return (
        united.groupBy("doc_id", "text_key", "n_words")
        .agg((F.count("*") / len(found)).cast("int").alias("rows"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select("doc_id", "n_words", merged("spans").alias("spans"), "items", F.explode(F.sequence(F.lit(1), "rows")))
        .drop("col")
    )


def merged(spans: str):
    """Overlapping or touching spans made one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(
        F.array_sort(F.array_distinct(spans)),
        none,
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.named_struct(F.lit("start"), F.element_at(done, -1)["start"], F.lit("end"), F.greatest(F.element_at(done, -1)["end"], s["end"]))))).otherwise(F.concat(done, F.array(s))),
    )


def cut(text: bytes, start: np.ndarray, end: np.ndarray) -> str:
    """The text without the byte ranges, which are ascending and apart."""
    kept, a = [], 0
    for x, y in zip(start.tolist(), end.tolist(), strict=True):
        kept.append(text[a:x])
        a = y
    return b"".join([*kept, text[a:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS, blocks_at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """The documents without hit spans; those over max_coverage are dropped. Same columns as docs.

    A span is cut from its first word to its last. Up to `blocks_at_once` blocks of items need one scan and no shuffle.
    With more, each group of blocks scans the uncut texts; a document's spans of all groups are united, then
    cut and measured once, so the result doesn't depend on how items are dealt into blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = shared_groups(spark, benchmark, window, block_words, blocks_at_once)
    if len(shared) > 1:
        return _clean_blocks(docs, shared, max_coverage)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, most=SLICE):
                w = tb.words(part.column("text"), tb.ALNUM, lower=True)
                hit, items = all_hits(shared[0].value, w)
                if not items:
                    yield part
                    continue
                plain, bounds = tb.raw(part.column("text"))
                share = tb.sum_by(hit, w.first) / np.maximum(w.counts(), 1)
                texts = part.column("text").to_pylist()
                for row in items:
                    marks = hit[w.first[row] : w.first[row + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))) + w.first[row]
                    texts[row] = cut(plain[bounds[row] : bounds[row + 1]].tobytes(), w.start[edge[::2]] - bounds[row], w.end[edge[1::2] - 1] - bounds[row])
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part.filter(pa.array(share <= max_coverage))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def _clean_blocks(docs: DataFrame, shared: list[Broadcast], max_coverage: float) -> DataFrame:
    """Spans of all blocks go to the documents by doc_id and a hash of the text."""
    found = [f.where(F.size("spans") > 0).select("doc_id", "text_key", "spans") for f in scans(docs, shared)]
    united = found[0]
    for more in found[1:]:
        united = united.unionByName(more)
    spans = stored(united.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.flatten(F.collect_set("spans")).alias("spans")).select("_doc", "_key", merged("spans").alias("_spans")))
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")  # boxed, so no name can clash
    boxed = docs.select(whole, docs["text"].alias("text"), docs["doc_id"].cast("long").alias("doc"), F.xxhash64(docs["text"]).alias("key"))
    hit = boxed.join(bounded(spans), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left").select("row", "text", "_spans")

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, most=SLICE):
                w = tb.words(part.column("text"), tb.ALNUM, lower=True, hashed=False)
                plain, bounds = tb.raw(part.column("text"))
                texts, spans = part.column("text").to_pylist(), part.column("_spans").to_pylist()
                stays = np.ones(part.num_rows, bool)
                for row in [k for k, x in enumerate(spans) if x]:
                    first = w.first[row]
                    a, b = (np.array([x[side] for x in spans[row]]) for side in ("start", "end"))
                    stays[row] = (b - a).sum() / (w.first[row + 1] - first) <= max_coverage
                    texts[row] = cut(plain[bounds[row] : bounds[row + 1]].tobytes(), w.start[first + a] - bounds[row], w.end[first + b - 1] - bounds[row])
                cleaned = pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, part.column("text").type)], names=["row", "text"])
                yield cleaned.filter(pa.array(stays))

    return hit.mapInArrow(run, T.StructType([hit.schema["row"], hit.schema["text"]])).select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


def op7_decontamination(spark, sf_dir) -> DataFrame:
    """Hits of every benchmark item in every document."""
    from marlstone.session import table

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
