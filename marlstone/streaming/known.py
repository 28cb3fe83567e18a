"""Candidates as a stream: each batch is told apart against everything seen before it.

The state is what each batch changed, written as its own part (`state/batch=<n>`); the newest part
that holds a url_hash counts. A batch reads of earlier parts only the rows of its own hashes and
writes only its new and changed ones. A batch that is tried again reads the parts before its own
and writes the same rows again, so a lost driver or executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = "url_hash string, content_hash string, batch long"


def decide(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Decisions (new, changed or known) for the first row of each url_hash by seq, and whether its version is stored.

    known: url_hash, content_hash, batch; the newest batch of a hash counts.
    """
    first = rows.groupBy("url_hash").agg(F.min_by(F.struct("seq", "content_hash"), F.col("seq")).alias("_row")).select("url_hash", "_row.*")
    newest = F.max_by(F.struct("content_hash"), F.col("batch")).alias("_old")
    old = known.join(first.select("url_hash"), "url_hash", "left_semi").groupBy("url_hash").agg(newest)
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("content_hash") != F.col("_old.content_hash"), "changed").otherwise("known")
    joined = first.join(old, "url_hash", "left")
    # A version without a fingerprint keeps the one that is known.
    first_print = F.col("_old.content_hash").isNull() & F.col("content_hash").isNotNull()
    stores = (kind != "known") | first_print
    return joined.select("url_hash", "seq", F.coalesce("content_hash", "_old.content_hash").alias("content_hash"), kind.alias("kind"), stores.alias("stores"))


def follow(candidates: DataFrame, folder: str) -> StreamingQuery:
    """Process what a stream of (seq, url_hash, content_hash) holds now and stop; decisions go to folder/decisions."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        known = spark.read.schema(STATE).parquet(f"{folder}/state").where(F.col("batch") < number) if number else spark.createDataFrame([], STATE)
        target = f"{folder}/decisions/batch={number}"
        decide(rows, known).write.mode("overwrite").parquet(target)
        made = spark.read.parquet(target)
        made.where("stores").select("url_hash", "content_hash").write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    return candidates.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/decisions")
