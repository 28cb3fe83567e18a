"""Scorers, source files and feeds on odd input."""

import gzip
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.operators import answers, items, scoring
from marlstone.plans import catalog, stages
from marlstone.session import ARROW_BYTES, ARROW_SETTING, ship
from marlstone.sources import files, listings

GOOD = '{"score": 0.5, "reason": "r", "key_points": ["p"]}'


def scripted(*steps):
    """A scorer that follows a script: texts are answers, errors are raised."""
    left = list(steps)

    def scorer(purpose, content):
        step = left.pop(0)
        if isinstance(step, Exception):
            raise step
        return scoring.Reply(step, len(content), 1)

    return scorer


def outcome(*lines, tries=3):
    made = [scoring.Line(f"p{k}", "m", scripted(*steps)) for k, steps in enumerate(lines)]
    answer, error, calls = scoring.ask(made, scoring.relevance_problem, "relevance", "c", tries)
    return answer, error and error.partition(":")[0], [(c[1], c[5]) for c in calls]


busy, dead = scoring.Passing("busy"), ValueError("dead")


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([[GOOD]], (GOOD, None, [("p0", "answered")])),
        ([["no", GOOD]], (GOOD, None, [("p0", "invalid"), ("p0", "answered")])),
        ([["no", "no", GOOD], [GOOD]], (None, "invalid answer", [("p0", "invalid"), ("p0", "invalid")])),
        ([[busy, busy, GOOD]], (GOOD, None, [("p0", "passing"), ("p0", "passing"), ("p0", "answered")])),
        ([[busy, busy, busy], [GOOD]], (GOOD, None, [("p0", "passing")] * 3 + [("p1", "answered")])),
        ([[dead], [busy, "no", GOOD]], (GOOD, None, [("p0", "failed"), ("p1", "passing"), ("p1", "invalid"), ("p1", "answered")])),
        ([[dead], [dead]], (None, "ValueError", [("p0", "failed"), ("p1", "failed")])),
        ([], (None, "no scorer", [])),
    ],
)
def test_repair_retry_and_fallback(lines, want):
    assert outcome(*lines) == want


def test_problems_are_those_of_the_native_check(spark):
    texts = [GOOD, f"```json\n{GOOD}\n```", "[]", "x", "", GOOD.replace("0.5", "1.5"), GOOD.replace("0.5", "true"), GOOD.replace("0.5", '"0.5"'), GOOD.replace('"r"', '" "'), GOOD.replace("[", "[1, "), GOOD.replace('"p"', ""), GOOD[:-1] + ', "more": 1}', GOOD.replace("0.5", "1")]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, a string")
    native = {r[0]: r[1] for r in frame.select("k", answers.relevance_answer(F.col("a")).isNotNull()).collect()}
    assert native == {k: scoring.relevance_problem(t) is None for k, t in enumerate(texts)}


def test_answers_and_usage_in_one_pass(spark):
    def scorer(purpose, content):
        return scoring.Reply(GOOD if content.endswith("alone.") else "no", len(content), 1)

    asked = spark.createDataFrame([(1, "relevance", "abc", "x"), (2, "relevance", None, "x")], "id long, purpose string, content string, calls string")
    made = scoring.answered(asked, [scoring.Line("p", "m", scorer)])
    assert {r["id"]: r["answer"] for r in made.collect()} == {1: GOOD, 2: GOOD}
    assert sorted((r["id"], r["call"], r["outcome"]) for r in scoring.usage(made).collect()) == [(1, 1, "invalid"), (1, 2, "answered"), (2, 1, "invalid"), (2, 2, "answered")]
    assert scoring.answered(asked.where("false"), []).count() == 0


def test_files_of_all_kinds(spark, tmp_path):
    sitemap = b"<urlset><url><loc>http://h.org/a</loc></url><url><loc>http://h.org/b</loc></url></urlset>"
    (tmp_path / "plain.xml").write_bytes(sitemap)
    (tmp_path / "members.xml.gz").write_bytes(gzip.compress(sitemap[:40]) + gzip.compress(sitemap[40:]) + b"\0\0")
    (tmp_path / "cut.xml.gz").write_bytes(gzip.compress(sitemap)[:-10])
    (tmp_path / "bad.xml.gz").write_bytes(b"\x1f\x8bnot gzip")
    (tmp_path / "page.html").write_bytes(b"<html></html>")
    (tmp_path / "empty").write_bytes(b"")
    found = files.bodies(spark, f"file://{tmp_path}")
    read = files.sitemaps(found)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    assert sorted(map(tuple, read.rows.select(name, "link").collect())) == [(n, f"http://h.org/{x}") for n in ("members.xml.gz", "plain.xml") for x in "ab"]
    assert dict(map(tuple, read.problems.select(name, "message").collect())) == {"cut.xml.gz": "damaged", "bad.xml.gz": "damaged", "page.html": "no sitemap"}  # Spark lists no empty file
    assert files.bodies(spark, f"file://{tmp_path}", most=50).where("problem = 'too large'").count() >= 2
    assert files.bodies(spark, f"file://{tmp_path}", newer_than=F.lit("2999-01-01").cast("timestamp")).count() == 0
    assert files.feeds(found).problems.count() == 5


def test_feed_formats_and_broken_ones(spark):
    bodies = {
        1: "<rss><channel><title>no items</title></channel></rss>", 2: "<rss><channel><item><link>http://h.org/", 3: "<!-- c --><feed><title>x</title></feed>", 4: "{}", 5: "", 6: None,
        7: '{"version": "https://jsonfeed.org/version/1", "items": [{"url": "/x", "title": "T", "summary": "S"}, {"id": "mailto:x"}]}',
    }
    frame = spark.createDataFrame(list(bodies.items()), "feed_id int, body string").withColumn("base", F.lit("http://h.org/"))
    told = {r["feed_id"]: (r["format"], r["broken"], r["entries"]) for r in listings.feed_description(frame).collect()}
    assert {k: v for k, v in told.items() if k != 2} == {1: ("rss", False, 0), 3: ("atom", True, 0), 4: (None, True, 0), 5: (None, True, 0), 6: (None, True, 0), 7: ("json", False, 1)}
    assert [(r["link"], r["title"], r["teaser"]) for r in listings.feed_entries(frame).where("feed_id = 7").collect()] == [("http://h.org/x", "T", "S")]


def test_keyword_hits_fold_and_keep_their_order(spark):
    frame = spark.createDataFrame([("die STRASSE und ein Café",), ("",), (None,)], "t string")
    got = [r[0] for r in frame.select(items.keyword_hits(F.col("t"), any_=["straße", "Strasse", "x"], all_=[" und "], exclude=["cafe\u0301"])).collect()]
    assert got == [["straße", "und", "cafe\u0301"], [], []]
    assert frame.select(items.keyword_hits(F.col("t"))).first()[0] == []


def test_batches_are_bounded_by_bytes(spark):
    """A session that sets nothing gets the bound too: 40 MB of texts don't come as one batch."""
    before = spark.conf.get(ARROW_SETTING, None)
    spark.conf.unset(ARROW_SETTING)
    try:
        ship(spark)
        rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert sum(r["n"] for r in sizes) >= 40_000_000
        assert max(r["n"] for r in sizes) < 2 * ARROW_BYTES
        spark.conf.set(ARROW_SETTING, "1000000")
        ship(spark)
        assert spark.conf.get(ARROW_SETTING) == "1000000"  # a bound of the session's own stays
    finally:
        spark.conf.unset(ARROW_SETTING) if before is None else spark.conf.set(ARROW_SETTING, before)


def test_stand_in_scorer_keeps_one_request():
    """Its memory doesn't grow with the requests of a task."""
    scorer = stages._length_score("spare").scorer
    tracemalloc.start()
    for key in range(1, 200):
        scorer("relevance", f"{key}\n{'x' * 100_000}{key}")
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 2_000_000


def test_stand_in_scorer_counts_tries():
    scorer = stages._length_score("main").scorer
    for content in ("7\na", "14\nb", "7\na"):
        for _ in range(2):
            with pytest.raises(scoring.Passing):
                scorer("relevance", content)
        assert scorer("relevance", content).output_tokens == 2


def test_sitemap_files_are_opened_once(spark):
    """Entries and problems come from the stored bodies, not each from the files again; the rows are those of the SQL."""
    folder = "/root/testdata/sf0.001"
    found = stages.sitemap_files(spark, folder)
    assert "binaryfile" not in found._jdf.queryExecution().toString().lower()
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
        want = base.execute(catalog.oracle_sql()["sitemap_files"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_page_files_are_written_by_tasks_into_few_folders(spark, tmp_path):
    """One file for a row, repeated ids too, none in a folder of its own; the reader sees each body."""
    made = [(i % 290, "é<x>" * (i % 5)) for i in range(300)] + [(None, None)]
    stages._page_files(spark.createDataFrame(made, "page_id long, value string"), f"file://{tmp_path}/f")
    found = files.bodies(spark, f"file://{tmp_path}/f").select(F.regexp_extract("path", r"page_id=(\d+)", 1), "body", "problem").collect()
    assert sorted(tuple(x) for x in found) == sorted(("" if k is None else str(k), f"{v or ''}\n", None) for k, v in made)
    assert len({p.parent for p in tmp_path.rglob("*.gz")}) <= stages.LEAST_FOLDERS
