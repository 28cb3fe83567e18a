"""The archive of digests: page names without overwriting, and indexes newest first."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.markdown import markdown_html
from marlstone.functions.text import casefold, slug
from marlstone.operators.ordering import running_total
from marlstone.session import stored


def job_directories(jobs: DataFrame) -> DataFrame:
    """jobs (name, first_at) with their directory: the slug, for the first job that has it, else slug and a part of the name's hash."""
    named = jobs.withColumn("_slug", slug(F.col("name")))
    first = named.groupBy("_slug").agg(F.min_by("name", F.struct("first_at", "name")).alias("_owner"))
    own = F.concat_ws("-", "_slug", F.left(F.sha2("name", 256), F.lit(8)))
    return named.join(first, "_slug").withColumn("directory", F.when(F.col("name") == F.col("_owner"), F.col("_slug")).otherwise(own)).drop("_slug", "_owner")


def page_names(digests: DataFrame, stored_pages: DataFrame | None = None) -> DataFrame:
    """digests (directory, created_at, id) with page: its minute, and -2, -3, ... where that is taken.

    stored_pages (directory, page) are those already in the archive; their names stay theirs.
    """
    stamp = F.date_format("created_at", "yyyy-MM-dd-HHmm")
    number = F.row_number().over(Window.partitionBy("directory", "_stamp").orderBy("created_at", "id"))
    made = digests.withColumn("_stamp", stamp).withColumn("_n", number)
    if stored_pages is not None:
        last = _known(stored_pages).groupBy("directory", "_s").agg(F.max("_n").alias("_last")).withColumnRenamed("_s", "_stamp")
        made = made.join(last, ["directory", "_stamp"], "left").withColumn("_n", F.col("_n") + F.coalesce("_last", F.lit(0))).drop("_last")
    name = F.concat(F.col("_stamp"), F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""), F.lit(".html"))
    return made.withColumn("page", name).select(*digests.columns, "page")


def _known(pages: DataFrame) -> DataFrame:
    """Pages whose name is one of the archive's, with its minute and number."""
    suffix = F.coalesce(F.nullif(F.regexp_extract("page", r"^.{15}-(\d+)\.html$", 1), F.lit("")).cast("int"), F.lit(1))
    return pages.where(F.col("page").rlike(r"^\d{4}-\d\d-\d\d-\d{4}(-\d+)?\.html$")).withColumns({"_s": F.left("page", F.lit(15)), "_n": suffix})


def index_entries(pages: DataFrame) -> DataFrame:
    """Pages (directory, page) of each directory newest first, with label and rank; a directory may be of any size."""
    stamp, suffix = F.col("_s"), F.col("_n")
    label = F.concat(F.left(stamp, F.lit(10)), F.lit(" "), F.substring(stamp, 12, 2), F.lit(":"), F.substring(stamp, 14, 2), F.lit(" UTC"), F.when(suffix > 1, F.concat(F.lit(" #"), suffix.cast("string"))).otherwise(""))
    back = _known(pages).withColumns({"label": label, "_back": -F.regexp_replace(stamp, "-", "").cast("long"), "_less": -suffix, "_one": F.lit(1)})
    return running_total(back, "_ahead", "_one", ["directory"], "_back", "_less").withColumn("rank", (F.col("_ahead") + 1).cast("int")).select(*pages.columns, "label", "rank")


def global_index(entries: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row for each job with pages (directory, name, detail), by folded, then exact name."""
    per = entries.groupBy("directory").agg(F.count("*").alias("n"), F.min_by("label", "rank").alias("newest"))
    detail = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " page").otherwise(" pages"), F.lit(" · latest "), F.regexp_replace("newest", " #.*", ""))
    return per.join(jobs.select("directory", "name"), "directory").select("directory", "name", detail.alias("detail")).orderBy(casefold(F.col("name")), "name")


def html_page(title: Column, body: Column) -> Column:
    """A page of Markdown, with its title escaped."""
    safe = F.replace(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<!doctype html>\n<meta charset=\"utf-8\">\n<title>"), safe, F.lit("</title>\n"), markdown_html(body))


def write_archive(pages: DataFrame, folder: str) -> None:
    """Add pages (directory, page, html) to a table by directory; of a name that is there, or comes twice, the first page stays."""
    new = pages.groupBy("directory", "page").agg(F.min("html").alias("html"))
    if (known := archived(pages.sparkSession, folder)) is not None:
        new = new.join(known.select("directory", "page"), ["directory", "page"], "left_anti")
    stored(new).write.mode("append").partitionBy("directory").parquet(folder)


def archived(spark: SparkSession, folder: str) -> DataFrame | None:
    """The pages of an archive; None before the first."""
    try:
        return spark.read.schema("page string, html string, directory string").parquet(folder)
    except AnalysisException:
        return None
