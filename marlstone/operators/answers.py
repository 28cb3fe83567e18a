"""Model answers: strict checks, what an item becomes by them, and summaries made in steps.

The model itself is a table of answers that some other system fills; these operators make its
requests and judge what came back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.chunks import split_text
from marlstone.functions.markdown import without_fence
from marlstone.functions.text import CHARS_PER_TOKEN
from marlstone.functions.timing import half_up
from marlstone.session import ship, stored

CHUNK_TOKENS, OVERLAP_TOKENS, MOST_CHUNKS, COMBINE_TOKENS = 3000, 200, 20, 3000
#: What stands between the parts of a request.
SEPARATOR = "\n\n"


def _document(answer: Column) -> Column:
    return F.try_parse_json(F.trim(without_fence(answer)))


def _kind(document: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(document, path, "variant"))


def _keys(document: Column, *names: str) -> Column:
    """Whether the document is an object of exactly these names."""
    keys = F.json_object_keys(F.to_json(document))
    return F.array_sort(keys) == F.array(*[F.lit(n) for n in sorted(names)])


def _blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == ""


def relevance_answer(answer: Column) -> Column:
    """score, reason and key_points of a valid answer, else null.

    The score is a JSON number from 0 to 1 (no text, no boolean), the reason isn't blank, and
    key_points are strings; there is nothing else.
    """
    d = _document(answer)
    score, reason = F.try_variant_get(d, "$.score", "double"), F.try_variant_get(d, "$.reason", "string")
    number = _kind(d, "$.score").rlike(r"^(BIGINT|DOUBLE|DECIMAL)") & score.between(0, 1)
    points = _kind(d, "$.key_points").isin("ARRAY<STRING>", "ARRAY<VOID>")
    fits = _keys(d, "score", "reason", "key_points") & number & (_kind(d, "$.reason") == "STRING") & ~_blank(reason) & points
    return F.when(fits, F.struct(score.alias("score"), F.trim(reason).alias("reason"), F.try_variant_get(d, "$.key_points", "array<string>").alias("key_points")))


def summary_answer(answer: Column) -> Column:
    """headline, bullets and why_relevant of a valid answer, else null.

    Three to six bullets; nothing is blank; the headline is one line; there is nothing else.
    """
    d = _document(answer)
    headline, why = (F.trim(F.try_variant_get(d, f"$.{n}", "string")) for n in ("headline", "why_relevant"))
    bullets = F.try_variant_get(d, "$.bullets", "array<string>")
    texts = (_kind(d, "$.headline") == "STRING") & (_kind(d, "$.why_relevant") == "STRING") & (_kind(d, "$.bullets") == "ARRAY<STRING>")
    full = F.size(bullets).between(3, 6) & F.forall(bullets, lambda b: ~_blank(b)) & ~_blank(headline) & ~_blank(why)
    fits = _keys(d, "headline", "bullets", "why_relevant") & texts & full & ~headline.rlike(r"[\r\n]")
    return F.when(fits, F.struct(headline.alias("headline"), F.transform(bullets, F.trim).alias("bullets"), why.alias("why_relevant")))


def rated(items: DataFrame, answer: str, least: str) -> DataFrame:
    """Items with relevance, status (relevant, skipped_irrelevant or failed) and error, by their answers."""
    valid = relevance_answer(F.col(answer))
    stored = half_up(valid["score"])
    status = F.when(valid.isNull(), "failed").when(stored >= F.lit(least).cast("decimal(10,2)"), "relevant").otherwise("skipped_irrelevant")
    error = F.when(valid.isNull(), "invalid answer")
    return items.withColumns({"relevance": stored, "status": status, "error": error})


def usable_entries(items: DataFrame, summary: str, url_fits: Column) -> DataFrame:
    """Summarised items whose stored summary is valid and whose address fits, with its fields."""
    valid = summary_answer(F.col(summary))
    return items.where((F.col("status") == "summarized") & url_fits).withColumn("entry", valid).where("entry IS NOT NULL")


def cuts(sizes: Sequence[int], most: int, between: int = len(SEPARATOR)) -> list[int]:
    """Where groups of consecutive parts begin, and the end: each is as long as fits, but of two parts at least.

    A last part that would stand alone stays with those before it.
    """
    ends = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64) + between)])
    at = [0]
    while at[-1] < len(sizes):
        fits = int(np.searchsorted(ends, ends[at[-1]] + between + most, "right")) - 1
        at.append(min(max(fits, at[-1] + 2), len(sizes)))
    if len(at) > 2 and at[-1] - at[-2] == 1:
        del at[-2]
    return at


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def part_groups(lengths: pd.Series) -> pd.Series:
    """The group of each part, from the lengths of the parts' rendered blocks."""

    def one(sizes) -> list[int]:
        begins = cuts(sizes, CHARS_PER_TOKEN * COMBINE_TOKENS)
        return np.repeat(np.arange(len(begins) - 1), np.diff(begins)).tolist()

    return lengths.map(one, na_action="ignore")


def grouped_parts(parts: DataFrame, key: str, number: str, summary: str) -> DataFrame:
    """Partial summaries (key, number from 1, summary) in groups to combine: key, group, first, parts, content.

    A group's content is its parts' blocks as a request shows them, `Part n:` and the summary; blocks
    with their numbers are what is measured. An item's array is no larger than its text.
    """
    ship(parts.sparkSession)
    block = F.concat(F.lit("Part "), F.col(number).cast("string"), F.lit(":\n"), F.coalesce(F.col(summary), F.lit("")))
    whole = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), block.alias("t")))).alias("p"))
    dealt = whole.withColumn("g", part_groups(F.transform("p", lambda x: F.length(x["t"]))))
    rows = dealt.select(key, F.explode(F.arrays_zip("p", "g")).alias("x")).groupBy(key, F.col("x.g").alias("group"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.col("x.p"))), lambda x: x["t"]), SEPARATOR)
    return rows.agg(F.min("x.p.n").alias("first"), F.count("*").alias("parts"), joined.alias("content"))


def combined(parts: DataFrame, key: str, number: str, summary: str, combine: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One summary of each item, made of its partial ones in rounds, and all requests that took.

    combine answers a round's requests (key, group, first, parts, content, round) with their `summary`; the
    answers, numbered by group, are the next round's parts. Each round has at most half as many parts, so there are as
    many rounds as the logarithm of the most parts of an item; each is stored. An item of one part keeps it without a request.
    """
    waiting = parts.select(F.col(key), F.col(number).cast("int").alias("_n"), F.col(summary).alias("summary"))
    done, asked = None, None
    for turn in count(1):
        sizes = waiting.groupBy(key).agg(F.count("*").alias("_parts"))
        single = waiting.join(sizes.where("_parts = 1"), key, "left_semi").select(key, "summary")
        done = single if done is None else done.union(single)
        requests = grouped_parts(waiting.join(sizes.where("_parts > 1"), key, "left_semi"), key, "_n", "summary").withColumn("round", F.lit(turn))
        answered = stored(combine(requests).select(key, "group", "first", "parts", "content", "round", "summary"))
        asked = answered if asked is None else asked.union(answered)
        if answered.isEmpty():
            return done, asked
        waiting = answered.select(key, (F.col("group") + 1).cast("int").alias("_n"), "summary")


def summary_requests(items: DataFrame, key: str, text: str, most: int | None = MOST_CHUNKS) -> DataFrame:
    """The requests that summarise each item: key, purpose, part, parts, dropped, content.

    A text of up to `CHUNK_TOKENS` estimated tokens is one request; a longer one is cut into parts
    that overlap, of which the first `most` are asked for and the others counted as dropped; None asks for all.
    """
    ship(items.sparkSession)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, CHUNK_TOKENS, OVERLAP_TOKENS), na_action="ignore")

    made = items.select(key, cut(text).alias("all")).where("size(all) > 0")
    asked = F.col("all") if most is None else F.slice("all", 1, most)
    rows = made.select(key, F.size("all").alias("total"), F.posexplode(asked).alias("part", "content"))
    kept = F.least("total", F.lit(most))  # a null doesn't count
    purpose = F.when(F.col("total") == 1, "summarize").otherwise("summarize_chunk")
    return rows.select(key, purpose.alias("purpose"), (F.col("part") + 1).alias("part"), kept.alias("parts"), (F.col("total") - kept).alias("dropped"), "content")
