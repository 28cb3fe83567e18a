"""Feed, sitemap and job files read by Spark, with a row for each file that can't be used.

Files come through Spark's own `binaryFile` reader, so any store, pushed-down filters on path, time and size, and one
task for many files. Bodies may be gzip of any number of members. A file that is damaged, larger than
`most` bytes or not of the wanted kind has a row in `problems` and no others. Spark doesn't list empty files: they have
no row at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import ship
from marlstone.sources import configs, listings

MOST_BYTES = 50 << 20


@dataclass
class Read:
    """rows: what the files hold; problems: (path, kind, message) of those that hold nothing usable."""

    rows: DataFrame
    problems: DataFrame


def bodies(spark: SparkSession, paths: str | list[str], newer_than: Column | None = None, most: int = MOST_BYTES) -> DataFrame:
    """path, body (null where it can't be had) and problem of files; older ones than newer_than aren't opened."""
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    if newer_than is not None:
        found = found.where(F.col("modificationTime") >= newer_than)
    large = F.col("length") > most
    body = found.select("path", large.alias("_large"), listings.inflated(F.when(~large, F.col("content")), most).alias("body"))
    return body.select("path", "body", F.when(F.col("_large"), "too large").when(F.col("body").isNull(), "damaged").alias("problem"))


def _split(files: DataFrame, kind: str, fits: Column) -> tuple[DataFrame, DataFrame]:
    problem = F.coalesce("problem", F.when(~F.coalesce(fits, F.lit(False)), f"no {kind}"))
    judged = files.withColumn("problem", problem)
    return judged.where("problem IS NULL").select("path", "body"), judged.where("problem IS NOT NULL").select("path", F.lit(kind).alias("kind"), F.col("problem").alias("message"))


def feeds(files: DataFrame, base: Column | None = None) -> Read:
    """Entries of feed files (path, body, problem); links are taken against base, else the path."""
    good, bad = _split(files, "feed", listings.feed_format(F.col("body")).isNotNull())
    own = F.col("path") if base is None else base
    return Read(listings.feed_entries(good.select(F.col("path").alias("feed_id"), own.alias("base"), "body")).withColumnRenamed("feed_id", "path"), bad)


def sitemaps(files: DataFrame, base: Column | None = None) -> Read:
    """Entries of sitemap files; indexes are left to `listings.followed`."""
    good, bad = _split(files, "sitemap", F.col("body").rlike(r"<(\w+:)?(urlset|sitemapindex)\b") & F.col("body").rlike(r"</(\w+:)?(urlset|sitemapindex)\s*>\s*$"))
    own = F.col("path") if base is None else base
    return Read(listings.sitemap_entries(good.select(F.col("path").alias("map_id"), own.alias("base"), "body")).withColumnRenamed("map_id", "path"), bad)


def jobs(files: DataFrame) -> Read:
    """Job files as documents; a file with problems has a row for each of them."""
    read = configs.jobs(files.where("problem IS NULL").select("path", F.col("body").alias("text")))
    wrong = F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(F.col("problems"))
    told = read.select("path", F.explode(wrong).alias("message")).select("path", F.lit("job").alias("kind"), "message")
    unread = files.where("problem IS NOT NULL").select("path", F.lit("job").alias("kind"), F.col("problem").alias("message"))
    return Read(read.where("problem IS NULL AND size(problems) = 0").select("path", "document"), told.unionByName(unread))
