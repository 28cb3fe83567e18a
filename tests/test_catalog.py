"""Every query of the catalog against DuckDB on the smallest tables, and the operators' edge cases."""

import datetime as dt
import numbers
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone.functions import text, timing, urls
from marlstone.operators import items, runs, usage
from marlstone.plans import catalog
from marlstone.sources import pages

DATA = Path("/root/testdata/sf0.001")


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else float(f"{v:.9g}") if isinstance(v, numbers.Number) and not isinstance(v, bool) else v
    return sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, str(DATA)).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["model", "calls", "input_tokens", "output_tokens", "cost_usd", "cost_complete", "unpriced_models"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://u:p@Blog.Example.com:80?utm_source=x&a=1&&b=%20#top", "http://blog.example.com/?a=1&b=%20"),
        ("https://e.org:443/p?FBCLID=1", "https://e.org/p"),
        ("https://e.org:8443/p?%75tm_x=1&k", "https://e.org:8443/p?k"),
        ("mailto:a@b", "mailto:a@b"),
        (None, None),
    ],
)
def test_canonical_url(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(urls.canonical_url(F.col("u"))).first()[0] == want


def test_schedule_shifts_over_a_gap_and_takes_the_first_of_a_repeat(spark):
    def at(after: str) -> dt.datetime:
        frame = spark.createDataFrame([(after,)], "t string").select(F.date_format(timing.next_daily(F.col("t").cast("timestamp"), 2, 30, "Europe/Berlin"), "yyyy-MM-dd HH:mm"))
        return frame.first()[0]

    assert at("2026-03-28 23:00:00") == "2026-03-29 01:30"
    assert at("2026-10-24 22:00:00") == "2026-10-25 00:30"
    assert at("2026-06-01 00:30:00") == "2026-06-02 00:30"


def test_keywords_are_whole_words(spark):
    frame = spark.createDataFrame([("Äpfel und C++ code",), ("pfel",), ("under",), (None,)], "t string")
    match = lambda *any_: [r[0] for r in frame.select(items.keyword_match(F.col("t"), any_=any_)).collect()]
    assert match("pfel") == [False, True, False, None]
    assert match("c++", "  ") == [True, False, False, None]
    assert match("und") == [True, False, False, None]


def test_report_over_nothing(spark):
    none = spark.createDataFrame([], "provider string, model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([], "provider string, model string, price_in decimal(10,2), price_out decimal(10,2)")
    assert usage.report(none, prices, "model").count() == 0
    assert usage.totals(none).first().asDict() == {"calls": 0, "input_tokens": 0, "output_tokens": 0}


def test_streak_skips_dry_runs_after_the_scan_limit(spark):
    made = [(1, i, "failed", i % 2 == 0) for i in range(60)] + [(2, 1, "failed", False), (2, 2, "succeeded", False), (2, 3, "failed", None)]
    frame = spark.createDataFrame(made, "job_id long, id long, status string, dry_run boolean").withColumn("started_at", F.col("id"))
    assert {r["job_id"]: r["streak"] for r in runs.failure_streak(frame, cap=99).collect()} == {1: 25, 2: 1}


def test_html_text_and_links(spark):
    page = '<p>a</p><script>x</script>wo<b>rd</b><a href="/q?utm_a=1">l</a><a href="http://other.org/">o</a><a href="/q">again</a>'
    frame = spark.createDataFrame([(1, "http://h.org/", page), (2, None, None)], "page_id long, url string, html string")
    assert frame.select(text.html_text("html")).first()[0] == "a wordloagain"
    assert [tuple(r) for r in pages.page_links(frame).collect()] == [(1, "http://h.org/q", 0, "l")]


def test_folding_equates_sharp_s(spark):
    got = spark.createDataFrame([("Straße",), ("STRASSE",), (None,)], "t string").select(text.fold("t")).collect()
    assert got[0] == got[1] and got[2][0] is None


def test_streamed_candidates_and_chunks_cover_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert catalog.streamed_candidates(spark, str(DATA)).where("kind = 'new'").count() == docs.where("text IS NOT NULL").select("text").distinct().count()
    assert catalog.text_chunks(spark, str(DATA)).select("doc_id").distinct().count() == docs.where("trim(text) <> ''").select("doc_id").distinct().count()


def test_stream_keeps_versions_over_batches(spark, tmp_path):
    """Two runs of the stream: the second tells new, changed and known apart by what the first stored."""
    from marlstone.streaming import known

    schema = "seq long, url_hash string, content_hash string"
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in ([(1, "a", "x"), (2, "a", "y"), (3, "b", None)], [(4, "a", "x"), (5, "b", "z"), (6, "c", "q")], [(7, "a", "w"), (8, "b", None), (9, "c", "q")], [(10, "a", "w")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        known.follow(spark.readStream.schema(schema).parquet(source), folder).awaitTermination()
    got = {r["seq"]: r["kind"] for r in known.decisions(spark, folder).collect()}
    assert got == {1: "new", 3: "new", 4: "known", 5: "known", 6: "new", 7: "changed", 8: "known", 9: "known", 10: "known"}
    assert known.decisions(spark, folder).where("stores").count() == 5
