"""Fill-in-the-middle rearrangement by a two-pass streaming matcher.

A text is a run of units: ASCII words, and every other code point by itself. The first pass counts the
units; the second advances a fresh lazy iterator over the matches to the two cut ranks and looks at nothing
behind them. Neither pass stores a unit, so beside the text itself memory doesn't grow with its length.
Draws come from a hash of the salt and doc_id, so a row's result doesn't depend on its neighbours,
on partitions or on retries.

A null text is an empty one; an empty text, and a text that holds a marker, stays plain, as does the plain
share of the draws. A null doc_id draws as the string `null`. Very long texts are cut whole. Repeated rows
get equal results each; no rows give no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import textbatch as tb
from marlstone.session import ship, table

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PLAIN_FROM, SPM_BELOW = 90, 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(salt: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit draws of a row."""
    key = hashlib.sha256(f"{salt}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(key[i : i + 4], "big") for i in (0, 4, 8, 12))


def count(text: str) -> int:
    """First pass: how many units there are."""
    return sum(1 for _ in UNIT.finditer(text))


def positions(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first low and the first high units end."""
    matches, at, done = UNIT.finditer(text), [0, 0], 0
    for k, rank in enumerate((low, high)):
        at[k] = at[k - 1] if rank == done else next(islice(matches, rank - done - 1, None)).end()
        done = rank
    return at[0], at[1]


def rearranged(text: str, doc_id: int | None, salt: str, plain_from: int, spm_below: int) -> tuple:
    """(units, form, code points of prefix and middle or null, output) of one text."""
    first, second, third, fourth = draws(salt, doc_id)
    n = count(text)
    if not text or third % 100 >= plain_from or any(m in text for m in MARKERS):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = positions(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if fourth % 100 < spm_below:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, salt: str = "1", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                ids = part.column("doc_id").to_pylist()
                texts = (x.as_py() or "" for x in part.column("text"))
                made = zip(*(rearranged(t, i, salt, plain_from, spm_below) for t, i in zip(texts, ids, strict=True)), strict=True)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                arrays = [pa.array(column, kind) for column, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that output was made from, of output and form alone.

    Only markers hold '<P>', '<S>' or '<M>' there: no marker begins or ends inside another one, and a text that
    holds one is plain.
    """
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op11_infill(spark, sf_dir) -> DataFrame:
    """Digests of every document's output and of the text restored from it."""
    made = transform(table(spark, sf_dir, "documents"))
    return made.withColumns({"output_sha256": F.sha2(F.col("output"), 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}).drop("output")


OP11_SQL = """
WITH keyed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit FROM documents),
drawn AS (
  SELECT doc_id, t, unit, len(unit) AS n, ('0x' || key[1:8])::BIGINT AS h1, ('0x' || key[9:16])::BIGINT AS h2,
    ('0x' || key[17:24])::BIGINT AS h3, ('0x' || key[25:32])::BIGINT AS h4 FROM keyed),
cut AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(unit[1:least(h1 % (n + 1), h2 % (n + 1))], ''), '') AS p,
    coalesce(array_to_string(unit[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], ''), '') AS m,
    coalesce(array_to_string(unit[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], ''), '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM cut
"""
