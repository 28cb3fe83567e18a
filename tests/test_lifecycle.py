"""Item state, run statistics, schedules and sources: cases that the whole-table queries don't single out."""

import html.parser
import json
import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from marlstone.functions import markdown, text, timing, urls
from marlstone.operators import answers, dedupe, items, ordering, runs, statistics
from marlstone.plans import catalog, texts
from marlstone.session import shared_folder
from marlstone.sources import discovery, listings, pages, transcripts
from marlstone.state import Store

DATA = "/root/testdata/sf0.001"
CANDIDATE = "job_id long, source_index int, position long, url_hash string, published_at string, content_hash string, url string, type string, title string, teaser string"
ITEM = "id long, job_id long, url_hash string, status string, attempts long, run_id long, published_at string, content_hash string, relevance double, last_error string, url string, type string, title string, teaser string"


def candidate(source, position, key, date=None, content=None):
    return (1, source, position, key, date, content, None, None, None, None)


def item(id_, key, status, attempts, run=None, content=None, date=None):
    return (id_, 1, key, status, attempts, run, date, content, None, None, None, None, None, None)


def test_pending_kinds(spark):
    rows = [("failed", 0, None, "retryable"), ("failed", 2, None, "retryable"), ("failed", 3, None, None), ("new", 0, None, "waiting"), ("new", 1, None, "retryable"), ("new", 0, 3, None), ("failed", 1, 2, "retryable"), ("summarized", 1, None, None)]
    frame = spark.createDataFrame(rows, "status string, attempts int, run_id int, want string")
    got = frame.select(runs.pending_kind(F.col("run_id"), F.col("status"), F.col("attempts"), F.lit(3)).alias("kind"), "want").collect()
    assert [r["kind"] for r in got] == [r["want"] for r in got]


def test_deduplicate_keeps_its_sums_and_repeats(spark):
    found = spark.createDataFrame([candidate(0, k, f"n{k}", f"2024-01-{k + 1:02}") for k in range(6)] + [candidate(1, 0, "n0"), candidate(1, 1, "done"), candidate(1, 2, "old", None, "b"), candidate(1, 3, "bare", None, "x")], CANDIDATE)
    stored = spark.createDataFrame([item(1, "done", "summarized", 1), item(2, "old", "summarized", 3, 1, "a"), item(3, "left", "failed", 0), item(4, "wait", "new", 0, None, None, "2025-01-01"), item(5, "bare", "summarized", 1)], ITEM)
    batch = spark.createDataFrame([(1, 9, True)], "job_id long, this_run long, baseline boolean")
    once = dedupe.deduplicate(found, stored, batch, 2, 4)
    s = once.statistics.first()
    assert s["new"] + s["changed"] + s["retried"] + s["waiting"] + s["dropped"] == s["found"] + s["stored_only"]
    assert s["selected"] + s["limit_cut"] + s["baseline_skipped"] == s["new"] + s["changed"] + s["retried"] + s["waiting"]
    assert (s["found"], s["new"], s["changed"], s["retried"], s["waiting"], s["dropped"], s["baseline_skipped"], s["selected"]) == (9, 6, 1, 1, 1, 2, 4, 4)
    chosen = [(r["url_hash"], r["reason"]) for r in once.selected.orderBy("rank").collect()]
    assert chosen == [("wait", "waiting"), ("n5", "new"), ("n4", "new"), ("old", "changed")]
    after = {r["url_hash"]: r for r in once.items.collect()}
    assert after["n0"]["status"] == "skipped_baseline" and after["old"]["attempts"] == 1 and after["bare"]["content_hash"] == "x"
    assert sorted(r["id"] for r in after.values()) == list(range(1, 12))
    folder = shared_folder(spark)
    once.items.write.parquet(folder)
    again = dedupe.deduplicate(found, spark.read.parquet(folder), batch, 2, 4)
    assert again.selected.where("reason <> 'retryable'").count() == 0
    assert {r["url_hash"]: r["attempts"] for r in again.items.collect() if r["url_hash"] != "left"} == {k: v["attempts"] for k, v in after.items() if k != "left"}


def test_running_total_over_ranges(spark):
    rows = [(k % 3, k, k % 5) for k in range(200)]
    got = ordering.running_total(spark.createDataFrame(rows, "g int, o int, v int"), "before", "v", ["g"], "o").collect()
    for r in got:
        assert r["before"] == sum(v for g, o, v in rows if g == r["g"] and o < r["o"])


def test_keywords_fold_letters(spark):
    frame = spark.createDataFrame([("STRASSE",), ("straße",), ("strasse",), ("cafe\u0301",), ("street",)], "t string")
    got = lambda term: [r[0] for r in frame.select(items.keyword_match(F.col("t"), any_=[term])).collect()]
    assert got("Straße") == [True, True, True, False, False]
    assert got("CAFÉ") == [False, False, False, True, False]


def test_store_counts_only_committed_snapshots(spark):
    store = Store(spark, shared_folder(spark))
    assert store.newest() == 0
    store.save({"runs": spark.range(2), "llm_usage": spark.createDataFrame([(1, 1)], "run_id long, seq long")})
    spark.range(5).write.parquet(f"{store.folder}/tables/runs/2")  # a writer died before its commit
    assert store.read("runs").count() == 2
    store.save_run({"runs": spark.range(3), "items": spark.range(1)}, dry_run=True)
    store.recover_run(spark.range(4), spark.createDataFrame([(1, 1), (1, 2)], "run_id long, seq long"))
    assert (store.read("runs").count(), store.read("llm_usage").count()) == (4, 2)


@pytest.mark.parametrize(
    ("after", "want"),
    [("2024-01-30 08:00:00", "2024-01-31 06:30:00"), ("2024-01-31 06:30:00", "2024-02-29 06:30:00"), ("2023-02-28 07:00:00", "2023-03-31 05:30:00")],
)
def test_monthly_schedule_takes_the_last_day(spark, after, want):
    made = timing.next_monthly(F.lit(after).cast("timestamp"), 31, 7, 30, "Europe/Berlin")
    assert spark.range(1).select(F.date_format(made, "yyyy-MM-dd HH:mm:ss")).first()[0] == want


def test_answers_are_strict(spark):
    good = {"headline": "h", "bullets": ["a", "b", "c"], "why_relevant": "w"}
    bad = [good | {"bullets": ["a"] * 7}, good | {"bullets": ["a", " ", "c"]}, good | {"headline": "a\nb"}, good | {"more": 1}, good | {"why_relevant": 3}, {"headline": "h"}]
    frame = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]] + [("[]",), (None,), (f"```json\n{json.dumps(good)}\n```",)], "a string")
    assert [r[0] is not None for r in frame.select(answers.summary_answer(F.col("a"))).collect()] == [True, *[False] * 8, True]


def test_part_groups_hold_two_or_more(spark):
    frame = spark.createDataFrame([([7000, 7000, 100],), ([5000, 5000, 5000, 5000, 10],), ([1],), ([13000] * 5,)], "n array<int>")
    assert [r[0] for r in frame.select(answers.part_groups("n")).collect()] == [[0, 0, 0], [0, 0, 1, 1, 1], [0], [0, 0, 1, 1, 1]]


def test_rounds_end_in_one_summary(spark):
    """Against a plain loop, with texts from none to many parts and sizes near the limit."""
    r = random.Random(5)
    made = {k: ["w" * r.choice([1, 3000, 5990, 6100, 13000]) for _ in range(r.choice([1, 2, 3, 7, 20]))] for k in range(12)}
    rows = [(k, n, t) for k, ts in made.items() for n, t in enumerate(ts, 1)]
    answer = lambda content: content[:4000] + str(len(content))
    combine = lambda asked: asked.withColumn("summary", F.concat(F.left("content", F.lit(4000)), F.length("content").cast("string")))
    found, asked = answers.combined(spark.createDataFrame(rows, "k int, n int, s string"), "k", "n", "s", combine)
    want, calls = {}, 0
    for k, parts in made.items():
        while len(parts) > 1:
            groups, current = [], []
            for n, part in enumerate(parts, 1):
                block = f"Part {n}:\n{part}"
                if len(current) >= 2 and len("\n\n".join([*current, block])) > 12_000:
                    groups.append(current)
                    current = []
                current.append(block)
            if len(current) == 1 and groups:
                groups[-1] += current
            else:
                groups.append(current)
            calls += len(groups)
            parts = [answer("\n\n".join(g)) for g in groups]
        want[k] = parts[0]
    assert {x["k"]: x["summary"] for x in found.collect()} == want and asked.count() == calls


def test_links_equal_a_plain_parser(spark):
    """Every link of the pages table, against Python's own HTML parser."""

    class Anchors(html.parser.HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a" and dict(attrs).get("href"):
                self.found.append(dict(attrs)["href"])

    table = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {}
    for row in table.collect():
        reader = Anchors()
        reader.found = []
        reader.feed(row["html"] or "")
        links = [urljoin(row["url"], h.strip()) for h in reader.found]
        want[row["page_id"]] = [x for x in links if urlsplit(x).scheme in ("http", "https") and urlsplit(x).hostname == urlsplit(row["url"]).hostname]
    flat = spark.createDataFrame([(p, x) for p, xs in want.items() for x in xs], "page_id long, link string")
    own = table.select("page_id", urls.canonical_url(F.col("url")).alias("own"))
    expected = flat.select("page_id", urls.canonical_url(F.col("link")).alias("link")).join(own, "page_id").where("link <> own").select("page_id", "link").distinct()
    assert sorted(catalog.page_links(spark, DATA).select("page_id", "link").collect()) == sorted(expected.collect())


def test_regions_titles_and_patterns(spark):
    page = '<base href="/b/"><div class="main x"><p>one<br>two</p><a href="i"> a <b>b</b></a></div><div id="side"><a href="http://o.org/#/r/1">o</a></div>'
    frame = spark.createDataFrame([(1, "http://h.org/p", page)], "page_id long, url string, html string")
    assert [tuple(r) for r in pages.page_links(frame, selector="div.main").collect()] == [(1, "http://h.org/b/i", 0, "a b")]
    assert [tuple(r) for r in pages.page_links(frame, url_pattern="o\\.org").collect()] == [(1, "http://o.org/#/r/1", 1, "o")]
    assert pages.page_fingerprints(frame, "p").first()["text"] == "one two"
    assert pages.page_fingerprints(frame, ".none").first()["text"] is None
    assert pages.decoded("<meta charset=gbk>é".encode("gbk", "replace"), None).startswith("<meta")
    assert pages.decoded("ü".encode("latin-1"), "text/html; charset=iso-8859-1") == "ü"


def test_text_and_addresses(spark):
    row = lambda *columns: spark.range(1).select(*columns).first()
    assert row(urls.redact_url(F.lit("user:secret@host/feed")))[0] == "host/feed"
    assert row(urls.canonical_url(F.lit("http://h.org/a\nb?x=1\t")))[0] == "http://h.org/ab?x=1"
    assert row(listings.http_link(F.lit("http://h.org:0/"), F.lit("")), listings.http_link(F.lit("http://h.org:99999/"), F.lit("")), listings.http_link(F.lit("/x"), F.lit("http://h.org:8080/"))) == (None, None, "http://h.org:8080/x")
    assert row(text.cost_text(F.lit(3), F.lit("0.12345").cast("decimal(18,6)"), F.lit(False), F.lit(1)))[0] == "≥ $0.1234 (1 call without price)"
    assert [discovery.is_public(a) for a in ("8.8.8.8", "10.0.0.1", "::ffff:127.0.0.1", "2002:7f00:1::1", "2001:4860:4860::8888", "x")] == [True, False, False, False, True, False]
    assert [discovery.is_public(a) for a in ("192.88.99.1", "fec0::1", "5f00::1", "64:ff9b::10.0.0.1", "64:ff9b::8.8.8.8", "fe80::1%eth0", "192.0.0.9", "::1", "2001:20::1")] == [False] * 4 + [True, False, True, False, True]
    assert transcripts.spoken("WEBVTT\n\nNOTE x\ny\n\nNOTEBOOK-1\n00:00 --> 00:01\n<i>a</i> &amp; b\na & b\n") == "a & b"
    assert row(statistics.stat_count(F.lit('{"a": true, "b": 3}'), "a"), statistics.stat_count(F.lit('{"a": true, "b": 3}'), "b")) == (None, 3)


def test_summaries_are_of_whole_texts(spark, tmp_path):
    """Every word of a text is in its summary, however many parts it has; words only at the end of a part, too."""
    made = {1: " ".join(f"w{i}" for i in range(60_000)), 2: "one two one", 3: "x " * 5990 + "late " + "y " * 9000 + "end", 4: None, 5: " "}
    spark.createDataFrame(list(made.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["summary"].split() for r in texts.combined_summaries(spark, str(tmp_path)).collect()}
    assert sorted(found) == [1, 2, 3] and found[2] == ["one", "two"]
    for key, words in found.items():
        assert set(made[key].split()) <= set(words)
    groups = texts.summary_groups(spark, str(tmp_path)).where("doc_id = 1").collect()
    assert set(made[1].split()) <= {w for g in groups for w in g["content"].split()} and sum(g["parts"] for g in groups) > answers.MOST_CHUNKS
