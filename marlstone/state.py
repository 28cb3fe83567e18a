"""Tables in a shared folder, changed by atomic commits.

A commit is one small file that names the folders of every table as of its number. Writers put new data into
folders of their own and then publish the file under the next number, which succeeds for one of them only: the
others learn that their snapshot is old, read the new one and try again. Data that no commit names doesn't
count, so a writer that dies leaves the tables as they were, and no snapshot is ever overwritten.

A table is a list of folders. `save` replaces it. `insert_absent` adds to a keyed table, which is stored in
buckets of a hash of its key: it reads only the buckets of the new rows and writes only rows that aren't there, so
what it writes grows with the batch and not with the table; a bucket of many pieces is written anew as one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators import lifecycle
from marlstone.operators.ordering import numbered
from marlstone.session import bounded, forget, stored

BUCKETS, MOST_PIECES, TRIES = 64, 8, 20
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed first."""


class Files:
    """Small files of the shared folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.folder = spark.sparkContext._jvm, folder
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = "") -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.path())] if self.fs.exists(self.path()) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Put a whole file in place if there is none of this name; of several writers one succeeds."""
        draft = f".{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getScheme() != "file":
                return bool(self.fs.rename(self.path(draft), self.path(name)))  # refused where the name is taken
            here = lambda x: self.jvm.java.nio.file.Paths.get(self.fs.makeQualified(self.path(x)).toUri())
            self.jvm.java.nio.file.Files.createLink(here(name), here(draft))  # local renames would overwrite
            return True
        except Exception as e:  # noqa: BLE001  (py4j wraps the file system's own errors)
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(self.path(draft), False)


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = Files(spark, f"{self.folder}/commits")

    def newest(self) -> int:
        """The number of the newest snapshot, 0 before the first."""
        return max((int(n.partition(".")[0]) for n in self.commits.names() if n[:1].isdigit()), default=0)

    def manifest(self, number: int) -> dict[str, dict]:
        """Of each table its schema, its keys if it has any, and its folders (of a keyed table by bucket)."""
        return json.loads(self.commits.read(f"{number}.json")) if number else {}

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table as of a snapshot, else of the newest."""
        held = self.manifest(self.newest() if number is None else number).get(table)
        if held is None:
            raise KeyError(f"there is no table {table!r}")
        return self._frame(held, None)

    def _frame(self, held: dict, buckets: Sequence[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        folders = held["folders"]
        if isinstance(folders, dict):
            folders = [f for b, own in folders.items() if buckets is None or int(b) in buckets for f in own]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, base: int, changes: dict[str, dict]) -> int:
        """Publish the snapshot after base; Conflict if there is one already."""
        whole = self.manifest(base) | changes
        self.commits.fs.mkdirs(self.commits.path())
        if not self.commits.publish(f"{base + 1}.json", json.dumps(whole, sort_keys=True)):
            raise Conflict(f"snapshot {base + 1} exists")
        return base + 1

    def _written(self, name: str, table: DataFrame) -> dict:
        folder = f"{self.folder}/tables/{name}/{uuid.uuid4().hex}"
        table.write.parquet(folder)
        return {"schema": table.schema.jsonValue(), "folders": [folder]}

    def save(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Replace tables in one snapshot: all of them count, or none. Conflict if base isn't the newest."""
        base = self.newest() if base is None else base
        return self.commit(base, {name: self._written(name, table) for name, table in tables.items()})

    def change(self, step: Callable[[int], dict[str, DataFrame]], tries: int = TRIES) -> int:
        """Save what step makes of a snapshot (its number); where another writer was faster, of the next one."""
        for _ in range(tries):
            base = self.newest()
            made = step(base)
            if not made:
                return base
            try:
                return self.save(made, base)
            except Conflict:
                continue
        raise Conflict(f"no snapshot in {tries} tries")

    def save_run(self, tables: dict[str, DataFrame], dry_run: bool = False) -> int:
        """A run's tables, or of a dry run its row in `runs` alone."""
        return self.save({"runs": tables["runs"]} if dry_run else tables)

    def recover_run(self, runs: DataFrame, ledger: DataFrame) -> int:
        """After a failed save: the failed run's row, and usage rows that aren't stored yet, by (run_id, seq)."""

        def step(base: int) -> dict[str, DataFrame]:
            known = self.read("llm_usage", base)
            new = ledger.join(known.select("run_id", "seq"), ["run_id", "seq"], "left_anti").select(*known.columns)
            return {"runs": runs, "llm_usage": known.unionByName(new)}

        return self.change(step)

    def claim(self, job_id: int, now: Column, until: Column, still_due: bool = False) -> bool:
        """Lock a job until its token's time if it is free; of several callers one gets True."""
        mine = F.col("id") == job_id

        def step(base: int) -> dict[str, DataFrame]:
            jobs = self.read("jobs", base)
            free = not jobs.where(mine & lifecycle.free_lock(now, still_due)).isEmpty()
            return {"jobs": lifecycle.claim(jobs, mine, now, until, still_due)} if free else {}

        return self._changed(step)

    def release(self, job_id: int, token: Column, next_run_at: Column | None = None) -> bool:
        """Unlock a job whose lock is still this token; False, and no change, if it is another's."""
        mine = F.col("id") == job_id

        def step(base: int) -> dict[str, DataFrame]:
            jobs = self.read("jobs", base)
            own = not jobs.where(mine & (F.col("locked_until") == token)).isEmpty()
            return {"jobs": lifecycle.release_lock(jobs, mine, token, next_run_at)} if own else {}

        return self._changed(step)

    def _changed(self, step: Callable[[int], dict[str, DataFrame]]) -> bool:
        made = False

        def noted(base: int) -> dict[str, DataFrame]:
            nonlocal made
            tables = step(base)
            made = bool(tables)
            return tables

        self.change(noted)
        return made

    def create_keyed(self, name: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS) -> int:
        """An empty table of rows that keys tell apart, with an id of their own."""
        held = {"schema": T.StructType([T.StructField("id", T.LongType()), *schema.fields]).jsonValue(), "keys": list(keys), "buckets": buckets, "last": 0, "folders": {}}
        return self.commit(self.newest(), {name: held})

    def insert_absent(self, name: str, rows: DataFrame, *order: str, tries: int = TRIES) -> int:
        """Add the rows whose key isn't there, with ids in the given order after the largest; how many they were.

        Of rows with the same key the first in that order counts. Where another writer commits first, rows that it
        added are found to be there in the next try.
        """
        for _ in range(tries):
            base = self.newest()
            held = self.manifest(base)[name]
            keys, most = held["keys"], held["buckets"]
            first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
            dealt = stored(first.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(most)).cast("int")))
            touched = [r[0] for r in dealt.select(_BUCKET).distinct().collect()]  # at most the number of buckets
            known = self._frame(held, touched).select(*keys)
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
            absent = stored(dealt.alias("n").join(known.alias("o"), same, "left_anti"))
            fresh = absent.count()
            if not fresh:
                return 0
            columns = T.StructType.fromJson(held["schema"]).names
            made = numbered(absent, "id", *order).withColumn("id", F.col("id") + held["last"]).select(*columns, _BUCKET)
            folder = f"{self.folder}/tables/{name}/{uuid.uuid4().hex}"
            made.repartition(_BUCKET, F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy(_BUCKET).parquet(folder)
            folders = {b: list(f) for b, f in held["folders"].items()}
            for bucket in (r[0] for r in absent.select(_BUCKET).distinct().collect()):
                folders.setdefault(str(bucket), []).append(f"{folder}/{_BUCKET}={bucket}")
            full = [b for b, f in folders.items() if len(f) > MOST_PIECES]
            for bucket in full:
                whole = f"{self.folder}/tables/{name}/{uuid.uuid4().hex}"
                self._frame(held | {"folders": folders}, [int(bucket)]).write.parquet(whole)
                folders[bucket] = [whole]
            try:
                self.commit(base, {name: held | {"folders": folders, "last": held["last"] + fresh}})
                return fresh
            except Conflict:
                continue
        raise Conflict(f"no snapshot in {tries} tries")

    def rewrite(self, name: str, changes: DataFrame, tries: int = TRIES) -> int:
        """New values for rows of a keyed table, by key (all columns but id; null is a value); only their buckets are written."""
        for _ in range(tries):
            base = self.newest()
            held = self.manifest(base)[name]
            keys = held["keys"]
            dealt = stored(changes.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(held["buckets"])).cast("int")))
            touched = [r[0] for r in dealt.select(_BUCKET).distinct().collect() if str(r[0]) in held["folders"]]
            if not touched:
                return base
            columns = T.StructType.fromJson(held["schema"]).names
            new = dealt.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*[c for c in columns if c != "id"]).alias("_new"))
            old = self._frame(held, touched).withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(held["buckets"])).cast("int"))
            joined = old.join(bounded(stored(new)), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
            values = [F.col("id"), *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns if c != "id"]]
            folder = f"{self.folder}/tables/{name}/{uuid.uuid4().hex}"
            joined.select(*values, _BUCKET).repartition(_BUCKET, F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy(_BUCKET).parquet(folder)
            folders = held["folders"] | {str(b): [f"{folder}/{_BUCKET}={b}"] for b in touched}
            try:
                return self.commit(base, {name: held | {"folders": folders}})
            except Conflict:
                continue
        raise Conflict(f"no snapshot in {tries} tries")

    def compact(self, keep: int = 1) -> None:
        """Delete the folders that none of the newest `keep` snapshots names. No writer may be at work."""
        last = self.newest()
        text = " ".join(self.commits.read(f"{n}.json") for n in range(max(last - keep, 0) + 1, last + 1))
        for name in Files(self.spark, f"{self.folder}/tables").names():
            for piece in Files(self.spark, f"{self.folder}/tables/{name}").names():
                if piece not in text:
                    forget(self.spark, f"{self.folder}/tables/{name}/{piece}")
