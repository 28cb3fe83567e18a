"""The numbered operators against brute force, exact round trips and held-out accuracy on small fixtures."""

import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import decontamination, interpolation, jaccard, language, lines, packing, quality, queries, repair, tokens, toxicity, warc
from marlstone.session import stored

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, class string, _doc string"


def docs(spark, texts, first=0):
    """Rows with extra columns of clashing names."""
    return spark.createDataFrame([(first + i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    want = duck.execute(queries.oracle_sql()[name]).fetchall()
    names = [d[0] for d in duck.description]
    got = [tuple(r) for r in queries.queries()[name](spark, DATA).select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def library(name):
    """The tokenizers library by itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    r = random.Random(3)
    bits = ["hello", " ", "don't", "'", "I'm", " they'll ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "123", "é", "é", "日本語", "ß", "\n", "\t", "...", "#", "😀", "Ⅷ", "_", "\u2028"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(2000)]
    ids, sizes = tokens.encoder(name).encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]


ODD = [None, "", " \n", "one", "a b c d e f g", "a b c d e f g", "é" * 50, "long " * 30_000]


@pytest.mark.parametrize("texts", [ODD, []])
def test_packing_covers_every_id_once(spark, texts):
    found = packing.pieces(docs(spark, texts)).orderBy("doc_id", "start").collect()
    encoder = library("byte_bpe_50k.json")
    for i, text in enumerate(texts):
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [r for r in found if r["doc_id"] == i]
        assert [r["start"] for r in mine] == list(np.cumsum([0, *[r["length"] for r in mine]])[:-1])
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    windows = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert windows.get(r["sequence_id"], 0) == r["offset"]
        windows[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 1024 for n in windows.values())


def test_packing_prefers_lexical_neighbours():
    seed, other, near = [1, 2, 3, 4] * 50, [9, 8, 7, 6] * 50, [1, 2, 3, 5] * 50
    fill = [[100 + k] * 10 for k in range(9)]
    shard = [seed, other, *fill, near]
    order = [p[0] for p in packing.pack(np.concatenate([np.array(x, np.uint32) for x in shard]), np.array([len(x) for x in shard]))]
    assert order[:2] == [0, len(shard) - 1]


@pytest.mark.parametrize("texts", [ODD, []])
def test_token_ids_come_back(spark, texts, tmp_path):
    folder = f"file://{tmp_path}/ids"
    repair.write(docs(spark, texts), folder, shard_tokens=500)
    found = {r["doc_id"]: r for r in repair.read(spark, folder).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = np.array([*library("word_bpe_49k.json").encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(texts)


def test_grammar_is_exact_and_random_access():
    r = np.random.default_rng(1)
    ids = np.tile(r.integers(0, 40, 300), 20).astype(np.uint32)
    lengths = np.array([0, 1000, 1, 4999, 0])
    g = repair.compress(ids, lengths)
    assert len(g.left) and len(g.symbols) < len(ids) / 3
    assert (repair.expand(g.symbols, g) == ids).all()
    assert (repair.decode_span(g, 3, 100, 900) == ids[1101:1901]).all()


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.predict(table, language.learn(table)).join(table.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert found and np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.8
    empty = language.predict(docs(spark, ODD).withColumn("lang", F.lit(None).cast("string")), language.learn(table)).collect()
    assert [r["lang_pred"] for r in sorted(empty, key=lambda r: r["doc_id"])][:3] == ["und"] * 3


def brute_classes(texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root, links


def test_near_duplicates_equal_brute_force(spark):
    texts = list(ODD)
    for k in range(8):
        w = words(120, k)
        texts.append(" ".join(w))
        for e in range(1, 6):
            v = list(w)
            for x in range(e):
                v[10 + 17 * x] = "changed"
            texts.append(" ".join(v))
    root, links = brute_classes(texts)
    found = sorted(jaccard.near_duplicates(docs(spark, texts)).collect())
    assert [(r["doc_id"], r["class_id"], r["n_links"]) for r in found] == list(zip(range(len(texts)), root, links, strict=True))
    kept = {r["doc_id"] for r in jaccard.keep_one(docs(spark, texts)).collect()}
    assert kept == set(root)
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_one_of_equal_rows_stays(spark):
    twice = docs(spark, ["a b c d e f"]).union(docs(spark, ["a b c d e f"]))
    assert jaccard.keep_one(twice).count() == 1


def test_large_bucket_is_split_without_loss(spark):
    w = words(100, 3)
    made = [" ".join([*w[:50], f"x{i}", *w[51:]]) for i in range(600)]
    found = jaccard.near_duplicates(docs(spark, made)).collect()
    assert {r["class_id"] for r in found} == {0} and {r["n_links"] for r in found} == {599}


def test_lines_odd_inputs(spark):
    near = "the quick brown fox jumps over the lazy dog near a calm river bank in the early warm morning light of may"
    made = [near, near + " now", "short line", "short  LINE!", None, "", f"x\n{near}\ny", "--\n", "--\n"]
    out = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs(spark, made)).collect()}
    assert out == {0: near, 1: "", 2: "short line", 3: "", 4: None, 5: "", 6: "x\ny", 7: "--\n", 8: "--\n"}
    twice = docs(spark, ["one\ntwo three"]).union(docs(spark, ["one\ntwo three"]))
    assert [r["text"] for r in lines.without_repeats(twice).collect()] == ["one\ntwo three"] * 2
    assert lines.without_repeats(docs(spark, [])).count() == 0
    assert lines.without_repeats(docs(spark, made)).columns == ["doc_id", "text", "class", "_doc"]


def test_toxicity_learns_and_keeps_clean(spark):
    table, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    models = toxicity.train(table, labels)
    assert toxicity.keep(docs(spark, [None, ""]), models).count() == 2
    assert toxicity.score(docs(spark, []), models).count() == 0
    assert toxicity.keep(table, models).columns == table.columns


def test_toxicity_separates_a_planted_vocabulary(spark):
    r = random.Random(5)
    clean = [" ".join(words(40, k)) for k in range(300)]
    made = [t + (" vileword nastyword" if k % 3 == 0 else "") for k, t in enumerate(clean)]
    r.shuffle(made)
    labels = spark.createDataFrame([(i, 1, int("vileword" in t)) for i, t in enumerate(made)], "doc_id long, quality int, toxic int")
    table = docs(spark, made)
    found = {r["doc_id"]: r["rejected"] for r in toxicity.score(table, toxicity.train(table, labels)).collect()}
    assert np.mean([found[i] == ("vileword" in t) for i, t in enumerate(made)]) > 0.97


def test_quality_base_columns(spark):
    repeat = "a b c d e f g h " * 4
    models = quality.train(docs(spark, [repeat]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, [None, repeat, "#a\n#a\n\n\né"]), models).collect()}
    assert (got[0]["n_words"], got[0]["base_failed"], got[0]["kept"]) == (0, True, False)
    assert (got[1]["n_words"], got[1]["n_repeat_words"]) == (32, 32)
    assert (got[2]["n_words"], got[2]["word_chars"], got[2]["n_symbols"], got[2]["n_dup_lines"]) == (3, 5, 2, 1)


def test_decontamination_cuts_passages(spark):
    item = " ".join(words(30, 9))
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    rest = " ".join(words(200, 10))
    made = [rest, f"{rest} {item.upper()}", item, None, ""]
    out = {r["doc_id"]: r["text"] for r in decontamination.clean(docs(spark, made), benchmark).collect()}
    assert out[0] == rest and out[1].strip() == rest and 2 not in out and out[3] is None and out[4] == ""
    several = decontamination.contamination(docs(spark, made), benchmark.union(benchmark.selectExpr("item_id + 10", "text")), block_words=20).collect()
    assert {r["doc_id"]: r["items"] for r in several}[1] == ["1", "11"]


def test_language_model_base_score(spark):
    texts = ["A b a", None, "", "b c", "zz a", "a a a"] * 4
    got = interpolation.score(docs(spark, texts)).collect()
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    split = lambda t: [*(t or "").lower().split(), None]
    counts = {}
    for i in train:
        for w in split(texts[i]):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = split(texts[r["doc_id"]])
        base = sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        assert abs(r["base_score"] - base) < 1e-9 and r["score"] < 0
    assert interpolation.score(docs(spark, [])).count() == 0


def test_salvage_skips_damage():
    import gzip
    import hashlib

    def record(k: int, body: bytes) -> bytes:
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    one, two, three = record(1, b"a" * 50), record(2, b"b" * 50), record(3, b"c" * 50)
    broken = two.replace(b"bbb", b"bxb", 1)
    found = list(warc.salvage(one + broken + gzip.compress(three) + b"junk" + one))
    assert [x["kind"] for x in found] == ["record", "gap", "record", "gap", "record"]
    assert (found[1]["offset"], found[1]["length"], found[3]["length"]) == (len(one), len(broken), 4)
    assert list(warc.salvage(b"")) == []


def warc_record(k: int, body: bytes) -> bytes:
    import hashlib

    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_salvage_inside_members():
    import gzip

    one, two, three = (warc_record(k, bytes([96 + k]) * 3000) for k in (1, 2, 3))
    big = warc_record(4, " ".join(words(400_000, 4)).encode())
    ids = lambda found: [x["record_id"][10:-1] if x["kind"] == "record" else "gap" for x in found]
    assert ids(warc.salvage(gzip.compress(one + two.replace(b"bbb", b"bxb", 1) + three))) == ["1", "gap", "3"]
    packed = gzip.compress(one + big + two)
    assert ids(warc.salvage(packed + gzip.compress(three))) == ["1", "4", "2", "3"]
    assert ids(warc.salvage(packed[: len(packed) // 2] + gzip.compress(three) + two)) == ["1", "gap", "3", "2"]
    broken = bytearray(packed)
    broken[-5] ^= 255  # the member's check sum
    assert ids(warc.salvage(bytes(broken) + gzip.compress(three)))[:3] == ["1", "4", "2"]
    assert ids(warc.salvage(gzip.compress(b"no archive") + one)) == ["gap", "1"]
    assert ids(warc.salvage(gzip.compress(b"") + one)) == ["1"]


def test_warc_of_odd_pages(spark, tmp_path):
    body = "x" * 200
    rows = [(1, "u", None), (2, None, body), (2, "v", body), (3, "w", body), (None, "n", body), (4, "t", "short"), (5, "t", "short")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    warc.write(pages, f"file://{tmp_path}/odd")
    found = warc.read(spark, f"file://{tmp_path}/odd").collect()
    assert sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in found) == sorted(
        [
            ("<urn:page:1>", "response", None),
            ("<urn:page:2>", "response", None),
            ("<urn:page:2>", "response", None),
            ("<urn:page:3>", "revisit", "<urn:page:2>"),
            ("<urn:page:null>", "revisit", "<urn:page:2>"),
            ("<urn:page:4>", "response", None),
            ("<urn:page:5>", "response", None),
        ],
        key=str,
    )
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").where("kind = 'record'").count() == 0


def test_pipeline_keeps_columns_and_the_last_stage_packs(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    out = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out.count(), stored(stage(spark, out, DATA))
        assert out.columns == table.columns and 0 < out.count() <= before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, DATA)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in out.select("doc_id").collect()}


def test_line_tokens_of_equal_32_bit_hashes_differ(spark):
    found = spark.range(300_000).select(F.concat(F.lit("w"), "id").alias("w")).groupBy(F.hash("w")).agg(F.sort_array(F.collect_list("w")).alias("w")).where("size(w) > 1").first()
    made = [f"one two {w} four five" for w in found["w"][:2]]
    assert lines.removed(docs(spark, made)).count() == 0


def test_line_dedup_of_the_pipeline_normalises_words(spark):
    line = "The quick brown fox jumps over the lazy dog"
    made = [line, line.upper(), line.replace(" ", "\t"), line + "\r", line.replace(" ", "  "), line + "!"]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs(spark, made), DATA).collect()}
    assert out == {0: line} | dict.fromkeys(range(1, 6), "")


def brute_lines(texts):
    """Texts without repeated lines, every line compared with every earlier one."""
    seen, out = [], []
    for text in texts:
        rest = []
        for line in text.split("\n"):
            w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in line.lower()).split()
            own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({("short", *w)} if w else set())
            if not (own and any(5 * len(own & x) >= 4 * len(own | x) for x in seen)):
                rest.append(line)
            seen.append(own)
        out.append("\n".join(rest))
    return out


def test_lines_of_a_large_family_equal_brute_force(spark):
    """Families over the block size: near copies of one line, and lines that share only a passage."""
    r = random.Random(8)
    base, made = words(60, 50), []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(60), r.choice([1, 2, 3])):
            w[k] = f"x{i}y{k}"
        made.append(" ".join(w))
    made += [" ".join(base[:12] + words(10, 100 + i)) for i in range(150)]
    r.shuffle(made)
    texts = ["\n".join(made[i : i + 3]) for i in range(0, len(made), 3)]
    out = {x["doc_id"]: x["text"] for x in lines.without_repeats(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_lines(texts)


def test_line_tokens_ascend_and_frequent_ones_are_last_in_a_prefix(spark):
    made = [" ".join(words(12, 50) + words(30, 100 + i)) for i in range(200)]
    sets = stored(lines.tokens(lines.split_lines(docs(spark, ["\n".join(made)]))))
    rows = [r["tokens"] for r in sets.collect()]
    assert all(t == sorted(set(t)) for t in rows)
    shared = set.intersection(*map(set, rows))
    flags = lines.frequent(sets)
    assert len(shared) == 8 and sum(flags) == 8
    found = [r["prefix"] for r in lines.ordered(sets, flags).collect()]
    assert [len(p) for p in found] == [8] * 200 and not any(shared & {t % 2**lines.TOKEN_BITS for t in p} for p in found)
    assert [r["prefix"] for r in lines.ordered(sets, bytes(len(flags))).collect()] == [t[:8] for t in rows]


def test_lines_are_made_again_from_their_place_in_a_text(spark):
    """Texts with their own lines only, repeated rows too; no other line of a text comes with them."""
    texts = ["a b c d e f\n\nx y", "p q r s t u v", None]
    table = docs(spark, texts)
    table = table.union(table.where("doc_id = 0"))
    wanted = lines.split_lines(docs(spark, texts)).where("_line <> 1").selectExpr("_doc * 10 + _line AS id", "_doc", "_text", "_line")
    want = {r["_doc"] * 10 + r["_line"]: r["tokens"] for r in lines.tokens(lines.split_lines(docs(spark, texts))).where("_line <> 1").collect()}
    got = [(r["id"], r["tokens"]) for r in lines.made_again(wanted, table).collect()]
    assert sorted(got) == sorted([*want.items(), (0, want[0]), (2, want[2])])


def kinds(n):
    """Ids below n by their part in the language model."""
    crc = lambda x: zlib.crc32(x.encode())
    return {i: interpolation.TEST if crc(str(i)) % 5 == 1 else interpolation.HELD if crc(f"held out {i}") % 10 == 0 else interpolation.MAIN for i in range(n)}


def test_language_model_with_many_ranges_and_a_small_held_out_chunk(spark):
    part = kinds(200)
    held = next(i for i, k in part.items() if k == interpolation.HELD)
    texts = [(i, " ".join(words(30, i))) for i, k in part.items() if k != interpolation.HELD or i == held]
    parts = interpolation.chunks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    one, many = (interpolation.learn(parts, interpolation.totals(parts, bits)) for bits in (0, 7))
    assert (one.lambdas == many.lambdas).all() and (one.tokens, one.distinct) == (many.tokens, many.distinct)


def test_language_model_weights_have_no_floor(spark):
    """A word seen once in 2**21 tokens is rarer than one of 2**20 words by chance."""
    part = kinds(200)
    main, held = ([i for i, k in part.items() if k == x] for x in (interpolation.MAIN, interpolation.HELD))
    rare = [f"{k:x}" for k in range(1 << 20)]
    order = random.Random(1).sample(rare, 3000)
    texts = [(main[0], " ".join(rare)), (main[1], "same " * (1 << 20)), (held[0], " ".join(order))]
    parts = interpolation.chunks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    weights = interpolation.learn(parts, interpolation.totals(parts, 1))
    assert weights.lambdas[1][2] > weights.lambdas[1][1]


def test_decontamination_does_not_depend_on_blocks(spark):
    w = words(60, 21)
    items = [" ".join(x) for x in (w[:12], w[5:20], w[30:45], words(12, 22), words(12, 23))]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    fill = lambda n, k: " ".join(words(n, k))
    made = [
        f"{fill(50, 31)} {' '.join(w[:20])} {fill(50, 32)}",
        f"{items[3]} {fill(16, 33)} {items[4]}!",
        f"{fill(50, 34)} {' '.join(w[30:36])} {items[3]} {' '.join(w[36:45])} {fill(20, 35)}",
        fill(80, 36), None, "", items[2],
    ]
    table = docs(spark, made)
    table = table.union(table.where("doc_id = 0")).union(table.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    want = decontamination.clean(table, benchmark)
    rows = sorted(map(repr, want.collect()))
    assert len(rows) == 7  # of nine, the second and the last are over the limit
    for block_words, at_once in ((15, 1), (20, 2), (20, 10), (40, 10)):
        found = decontamination.clean(table, benchmark, block_words=block_words, blocks_at_once=at_once)
        assert found.columns == table.columns and sorted(map(repr, found.collect())) == rows


def test_near_copies_without_doc_id(spark):
    texts = [" ".join(words(120, k)) for k in (41, 42, 43)]
    near = [t + " changed" for t in texts]
    made = [(1, texts[0]), (None, near[0]), (2, texts[1]), (3, near[1]), (None, texts[2]), (None, near[2])]
    table = spark.createDataFrame(made, "doc_id long, text string")
    found = sorted(jaccard.near_duplicates(table).collect(), key=repr)
    assert [tuple(r) for r in found] == [(1, 1, 1), (2, 2, 1), (3, 2, 1), *[(None, None, 1)] * 3]
    assert sorted((r["doc_id"] or 0) for r in jaccard.keep_one(table).collect()) == [0, 0, 0, 1, 2]


def test_warc_headers_of_any_length(spark, tmp_path):
    url = "data:text/plain," + "x" * 150_000
    html = "<p>" + "y" * 200
    pages = spark.createDataFrame([(1, url, html), (2, url, html), (3, "http://h.org/", "z")], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/warc")
    found = sorted(warc.read(spark, f"file://{tmp_path}/warc").collect(), key=lambda r: r["record_id"])
    assert [(r["kind"], r["record_type"], r["target_uri"]) for r in found] == [("record", "response", url), ("record", "revisit", url), ("record", "response", "http://h.org/")]


def test_salvage_time_grows_in_proportion():
    import time

    def took(n):
        data = b"\x1f\x8b\x08junk" * n + b"WARC/1.0\r\nx" * n
        began = time.perf_counter()
        found = list(warc.salvage(data))
        assert [(x["kind"], x["length"]) for x in found] == [("gap", len(data))]
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 8 * took(5_000) + 0.5


def test_large_pages_have_files_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(k, "http://h.org/", "x" * size) for k, size in enumerate([10, 10, 200, 300, 5000, 6000])], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/warc", size_classes=((100, 500), (1000, 1), (None, 1)))
    files = [p for p in Path(tmp_path, "warc").glob("part-*") if p.stat().st_size]
    assert len(files) == 5 and sorted(r["payload_bytes"] for r in warc.read(spark, f"file://{tmp_path}/warc").collect()) == [10, 10, 200, 300, 5000, 6000]
