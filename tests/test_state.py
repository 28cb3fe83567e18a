"""The store: atomic commits, locks, keyed tables in buckets."""

import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import CLEANUP, shared_folder, stored
from marlstone.state import Conflict, Files, Store

JOBS = "id long, enabled boolean, next_run_at timestamp, locked_until timestamp"
at = lambda text: F.lit(text).cast("timestamp")


def together(*steps):
    """Run steps at once; their results in order."""
    gate, out = threading.Barrier(len(steps)), [None] * len(steps)

    def run(k, step):
        gate.wait()
        out[k] = step()

    threads = [threading.Thread(target=run, args=x) for x in enumerate(steps)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_stored_leaves_no_shuffle_files(spark):
    """They go when the write ends, not when the driver collects its garbage; the session's setting is as before."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, setting = held(), spark.conf.get(CLEANUP, None)
    made = stored(spark.range(20_000).withColumn("k", F.xxhash64("id")).repartition(5, "k"))
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert made.count() == 20_000 and spark.conf.get(CLEANUP, None) == setting


def test_one_of_many_publishes(spark):
    files = [Files(spark, shared_folder(spark))] * 6
    assert sorted(together(*[lambda f=f, k=k: f.publish("1.json", f"writer {k}") for k, f in enumerate(files)])) == [False] * 5 + [True]
    assert files[0].names() in (["1.json"], [".1.json.crc", "1.json"]) and files[0].read("1.json").startswith("writer")


def test_an_old_snapshot_is_no_base(spark):
    store = Store(spark, shared_folder(spark))
    store.save({"a": spark.range(2)})
    store.save({"b": spark.range(3)})
    with pytest.raises(Conflict):
        store.save({"a": spark.range(9)}, base=1)
    assert (store.read("a").count(), store.read("b").count(), store.newest()) == (2, 3, 2)
    with pytest.raises(KeyError):
        store.read("b", 1)
    before = len(list(Path(store.folder.removeprefix("file:").replace("///", "/")).glob("tables/*/*")))
    store.save({"a": spark.range(1)})
    store.compact()
    after = len(list(Path(store.folder.removeprefix("file:").replace("///", "/")).glob("tables/*/*")))
    assert before == 3 and after == 2 and store.read("a").count() == 1


def test_of_two_claims_one_wins_and_its_token_releases(spark):
    store = Store(spark, shared_folder(spark))
    day = spark.sql("SELECT CAST(id AS long) AS id, true AS enabled, timestamp'2024-01-01 08:00:00' AS next_run_at, CAST(NULL AS timestamp) AS locked_until FROM range(3)")
    store.save({"jobs": day})
    now = at("2024-01-02 00:00:00")
    tokens = [at(f"2024-01-02 0{k}:00:00") for k in (1, 2, 3)]
    won = together(*[lambda t=t: Store(spark, store.folder).claim(1, now, t, still_due=True) for t in tokens])
    assert sorted(won) == [False, False, True] and store.newest() == 2
    mine, other = tokens[won.index(True)], tokens[won.index(False)]
    assert not store.release(1, other) and store.newest() == 2
    assert store.release(1, mine, at("2024-01-03 08:00:00"))
    row = store.read("jobs").where("id = 1").first()
    assert row["locked_until"] is None and str(row["next_run_at"]) == "2024-01-03 08:00:00"
    assert not store.claim(1, now, mine, still_due=True) and store.claim(1, now, mine) and store.claim(2, now, other)
    assert store.claim(1, at("2024-01-05 00:00:00"), other)  # run out


def test_two_changes_at_once_both_count(spark):
    store = Store(spark, shared_folder(spark))
    store.save({"n": spark.range(1)})
    more = lambda k: lambda base: {"n": store.read("n", base).union(spark.range(k, k + 1))}
    together(*[lambda k=k: Store(spark, store.folder).change(more(k)) for k in (5, 6, 7)])
    assert sorted(r[0] for r in store.read("n").collect()) == [0, 5, 6, 7] and store.newest() == 4


SCHEMA = T.StructType().add("job_id", "long").add("url_hash", "string").add("title", "string")


def rows(spark, keys, title="t"):
    return spark.createDataFrame([(*k, title, n) for n, k in enumerate(keys)], "job_id long, url_hash string, title string, seq long")


def size(folder):
    return sum(p.stat().st_size for p in Path(folder.removeprefix("file:").replace("///", "/")).rglob("*.parquet"))


def test_inserts_write_only_what_is_absent(spark):
    store = Store(spark, shared_folder(spark))
    store.create_keyed("items", SCHEMA, ["job_id", "url_hash"], buckets=8)
    first = [(k % 3, f"u{k}") for k in range(2000)]
    assert store.insert_absent("items", rows(spark, first), "seq") == 2000
    found = {(r["job_id"], r["url_hash"]): r["id"] for r in store.read("items").collect()}
    assert found == {k: n for n, k in enumerate(first, 1)}
    written = size(store.folder)
    some = [*first[:50], (None, "u1"), (1, None), (1, None), (9, "new")]
    assert store.insert_absent("items", rows(spark, some, "other"), "seq") == 3
    assert size(store.folder) - written < 0.2 * written
    assert store.insert_absent("items", rows(spark, some), "seq") == 0 and store.newest() == 3
    got = {(r["job_id"], r["url_hash"]): (r["id"], r["title"]) for r in store.read("items").collect()}
    assert len(got) == 2003 and got[(0, "u0")] == (1, "t") and sorted(got[k][0] for k in ((None, "u1"), (1, None), (9, "new"))) == [2001, 2002, 2003]


def test_inserts_at_once_and_many_pieces(spark):
    store = Store(spark, shared_folder(spark))
    store.create_keyed("items", SCHEMA, ["job_id", "url_hash"], buckets=2)
    made = together(*[lambda k=k: Store(spark, store.folder).insert_absent("items", rows(spark, [(1, "same"), (1, f"own{k}")]), "seq") for k in range(3)])
    assert sorted(made) == [1, 1, 2]
    ids = [r["id"] for r in store.read("items").collect()]
    assert sorted(ids) == [1, 2, 3, 4]
    for k in range(10):
        store.insert_absent("items", rows(spark, [(2, f"x{k}"), (3, f"x{k}"), (4, f"x{k}")]), "seq")
    assert store.read("items").count() == 34
    assert all(len(f) <= 8 for f in store.manifest(store.newest())["items"]["folders"].values())
    store.rewrite("items", spark.createDataFrame([(1, "same", None), (2, "x0", "changed"), (8, "none", "x")], "job_id long, url_hash string, title string"))
    got = {(r["job_id"], r["url_hash"]): r["title"] for r in store.read("items").collect()}
    assert len(got) == 34 and got[(1, "same")] is None and got[(2, "x0")] == "changed" and got[(2, "x1")] == "t"
