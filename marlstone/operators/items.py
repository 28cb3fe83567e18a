"""Candidates and items: deduplication against history, keyword rules, gates and digest order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import casefold, collapse_ends, fold, fold_text, whole_word
from marlstone.functions.timing import half_up
from marlstone.operators.ordering import previous
from marlstone.operators.runs import pending_kind


def first_occurrence(candidates: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The first row of each key in a stated order; a struct minimum needs no sort within keys."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in candidates.columns if c not in keys]
    row = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return candidates.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*candidates.columns)


def changed_version(new: Column, old: Column) -> Column:
    """Both hashes are known and differ."""
    return new.isNotNull() & old.isNotNull() & (new != old)


def classify(candidates: DataFrame, known: DataFrame, this_run: int | None = None) -> DataFrame:
    """Candidates with kind: new, changed, retryable, waiting or dropped.

    known has url_hash, content_hash, status, attempts and run_id, one row for each url_hash.
    """
    names = ["url_hash", "content_hash", "status", "attempts", "run_id"]
    old = known.select(*[F.col(c).alias(f"_{c}") for c in names])
    changed = changed_version(F.col("content_hash"), F.col("_content_hash"))
    pending = pending_kind(F.col("_run_id"), F.col("_status"), F.col("_attempts"), F.lit(this_run).cast("long"))
    kind = F.when(F.col("_url_hash").isNull(), "new").when(changed, "changed").otherwise(F.coalesce(pending, F.lit("dropped")))
    return candidates.join(old, F.col("url_hash") == F.col("_url_hash"), "left").withColumn("kind", kind).drop(*old.columns)


def known_items(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored items of the wanted (job_id, url_hash)."""
    return items.join(wanted.select("job_id", "url_hash").distinct(), ["job_id", "url_hash"], "left_semi")


def of_job(items: DataFrame, job_id: int, status: str | None = None) -> DataFrame:
    mine = items.where(F.col("job_id") == job_id)
    return (mine if status is None else mine.where(F.col("status") == status)).orderBy("id")


def newest_new_per_source(classified: DataFrame, source: str, n: int, *order: Column) -> DataFrame:
    """All rows that aren't new, and the first n new ones of each source."""
    fresh = newest_per_source(classified.where("kind = 'new'"), source, n, *order)
    return classified.where("kind <> 'new'").unionByName(fresh)


def newest_per_source(items: DataFrame, source: str, n: int, *order: Column) -> DataFrame:
    """The first n items of each source; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return items.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def clean_keywords(any_: Column, all_: Column, exclude: Column) -> Column:
    """Keyword lists cleaned: split at commas, stripped, the first of each folded form; no exclude that is also included.

    A struct of the arrays any, all and exclude. Null lists count as empty.
    """
    none = F.array().cast("array<string>")
    parts = lambda c: F.filter(F.transform(F.flatten(F.transform(F.coalesce(c, none), lambda k: F.split(k, ","))), collapse_ends), lambda k: k != "")
    first = lambda k, seen: F.exists(seen, lambda s: casefold(s) == casefold(k))
    once = lambda c: F.aggregate(parts(c), none, lambda seen, k: F.when(first(k, seen), seen).otherwise(F.array_append(seen, k)))
    some, every = once(any_), once(all_)
    kept = F.filter(once(exclude), lambda k: ~first(k, F.concat(some, every)))
    return F.struct(some.alias("any"), every.alias("all"), kept.alias("exclude"))


def keyword_match(text: Column, any_: Sequence[str] = (), all_: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """No excluded term occurs, all of all_ do, and one of any_ unless that is empty. Blank terms don't count.

    Text and terms are compared in folded form (ß is ss, composed letters are decomposed ones);
    ASCII text needs no more than lower case, so only other text goes through Python.
    """
    ascii_ = text.rlike(r"\A[\x00-\x7f]*\z")
    folded = F.when(ascii_, F.lower(text)).otherwise(fold(F.when(~ascii_, text)))
    hit = lambda term: folded.rlike(whole_word(fold_text(term)))
    found = F.lit(True)
    for term in filter(str.strip, all_):
        found &= hit(term)
    for term in filter(str.strip, exclude):
        found &= ~hit(term)
    some = [hit(t) for t in any_ if t.strip()]
    if some:
        either = some[0]
        for one in some[1:]:
            either |= one
        found &= either
    return found


def keyword_hits(text: Column, any_: Sequence[str] = (), all_: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """The terms that occur, as they are written in the rules: any, all, then excluded ones, the first of each folded form."""
    first: dict[str, str] = {}
    for term in (*any_, *all_, *exclude):
        if term.strip():
            first.setdefault(fold_text(term.strip()), term.strip())
    hits = [F.when(keyword_match(text, any_=[term]), F.lit(term)) for term in first.values()]
    return F.filter(F.array(*hits), lambda t: t.isNotNull()) if hits else F.array().cast("array<string>")


def ordered_distinct(values: Column) -> Column:
    """Each value of an array once, where it first stands."""
    return F.array_distinct(values)


def relevance_gate(items: DataFrame, score: str, least: str) -> DataFrame:
    """Items whose stored (rounded) relevance reaches the limit."""
    return items.withColumn("relevance", half_up(F.col(score))).where(F.col("relevance") >= F.lit(least).cast("decimal(10,2)"))


def digest_order(items: DataFrame) -> DataFrame:
    """Most relevant first, then newest, then by id; what is unknown comes last."""
    return items.orderBy(F.col("relevance").desc_nulls_last(), F.col("published_at").desc_nulls_last(), "id")


def drop_adjacent_repeats(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Lines that differ from the line before them in their group, which may be of any size."""
    placed = previous(lines, "_before", text, [group], order)
    return placed.where(F.coalesce(F.col(text) != F.col("_before"), F.lit(True))).select(*lines.columns)
