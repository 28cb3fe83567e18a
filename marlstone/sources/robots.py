"""Robots rules as a table, and which URLs an agent may fetch under them."""

from __future__ import annotations

from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.urls import origin
from marlstone.session import ship

# Fixed value: characters that stay as they are in a compared path.
PATH_SAFE = "/?&=:;@!,+*$'()~"
_RULES = ("allow", "disallow")


@F.pandas_udf(T.StringType())
def one_encoding(paths: pd.Series) -> pd.Series:
    """Paths with one percent-encoded form."""
    return paths.map(lambda p: quote(unquote(p), safe=PATH_SAFE), na_action="ignore")


def _lines(robots: DataFrame) -> DataFrame:
    """Lines with a key: origin, line, key, value."""
    body = F.regexp_replace("body", "^﻿", "")
    lines = robots.select("origin", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("line", "raw"))
    bare = F.substring_index("raw", "#", 1)
    return lines.where(bare.contains(":")).select("origin", "line", F.lower(F.trim(F.substring_index(bare, ":", 1))).alias("key"), F.trim(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1)).alias("value"))


def rules(robots: DataFrame, agent: str) -> DataFrame:
    """The rules for an agent, from (origin, body): origin, allow, length, pattern, crawl_delay.

    Groups that name the agent count; without one those for '*'. An origin has a row without a
    pattern for its crawl delay. Empty rules allow everything and are left out.
    """
    ship(robots.sparkSession)
    known = _lines(robots).where(F.col("key").isin("user-agent", "crawl-delay", *_RULES))
    file = Window.partitionBy("origin").orderBy("line")
    begins = (F.col("key") == "user-agent") & ((F.lag("key").over(file) != "user-agent") | F.lag("key").over(file).isNull())
    grouped = known.withColumn("begins", begins.cast("int")).withColumn("section", F.sum("begins").over(file)).where("section > 0")
    name = F.when(F.col("key") == "user-agent", F.lower(F.trim(F.substring_index("value", "/", 1))))
    names = grouped.withColumn("names", F.collect_set(name).over(Window.partitionBy("origin", "section")))
    ours, anyone = F.array_contains("names", agent.lower()), F.array_contains("names", "*")
    named = names.withColumn("named", F.max(ours).over(Window.partitionBy("origin")))
    chosen = named.where(F.when(F.col("named"), ours).otherwise(anyone) & (F.col("key") != "user-agent"))
    ends = F.col("value").endswith("$")
    path = one_encoding(F.when(ends, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))
    quoted = F.array_join(F.transform(F.split(path, r"\*"), lambda part: F.when(part == "", "").otherwise(F.concat(F.lit(r"\Q"), part, F.lit(r"\E")))), ".*")
    pattern = F.concat(F.lit("(?s)^"), quoted, F.when(ends, r"\z").otherwise(""))
    paths = chosen.where(F.col("key").isin(*_RULES) & (F.col("value") != "")).select("origin", (F.col("key") == "allow").alias("allow"), F.length("value").alias("length"), pattern.alias("pattern"), F.lit(None).cast("double").alias("crawl_delay"))
    delay = F.expr("try_cast(value AS double)")
    usable = chosen.where((F.col("key") == "crawl-delay") & delay.isNotNull() & (delay >= 0))
    delays = usable.groupBy("origin").agg(F.min_by(delay, F.col("line")).alias("crawl_delay")).select("origin", F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("pattern"), "crawl_delay")
    return paths.unionByName(delays)


def sitemaps(robots: DataFrame) -> DataFrame:
    """The sitemap lines of every file: origin, line, link."""
    return _lines(robots).where("key = 'sitemap' AND value <> ''").select("origin", "line", F.col("value").alias("link"))


def _target(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def allowed(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """urls with `allowed`: the longest matching rule decides, allow wins a tie, no rule allows.

    One join by origin: an origin's rules travel as one array (a robots file is of bounded size),
    so a URL stays one row however many rules match.
    """
    ship(urls.sparkSession)
    per = rules.where("pattern IS NOT NULL").groupBy("origin").agg(F.collect_list(F.struct("length", "allow", "pattern")).alias("_rules"))
    placed = urls.withColumn("_origin", origin(F.col(url))).withColumn("_target", one_encoding(_target(F.col(url))))
    joined = placed.join(per.withColumnRenamed("origin", "_origin"), "_origin", "left")
    best = F.array_max(F.transform(F.filter("_rules", lambda r: F.regexp_like(F.col("_target"), r["pattern"])), lambda r: F.struct(r["length"], r["allow"])))
    free = F.regexp_extract("_target", r"^([^?]*)", 1) == "/robots.txt"
    return joined.withColumn("allowed", free | F.coalesce(best["allow"], F.lit(True))).drop("_origin", "_target", "_rules")
