"""YAML values and the checks of registry files."""

import json

import pytest
from pyspark.sql import functions as F

yaml = pytest.importorskip("yaml")
from marlstone.sources import configs  # noqa: E402


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: 0123", "0123"), ("a: 089", "089"), ("a: 0", 0), ("a: -7", -7), ("a: +7", 7), ("a: 1.5", 1.5), ("a: .5", 0.5), ("a: -.5", "-.5"), ("a: 1e3", 1000.0), ("a: 1.", 1.0),
        ("a: 1.e", "1.e"), ("a: e5", "e5"), ("a: .", "."), ("a: yes", "yes"), ("a: True", True), ("a: tRue", "tRue"), ("a: ~", None), ("a:", None), ("a: '1'", "1"), ("a: 2024-01-01", "2024-01-01"),
        ("a: 0x1F", "0x1F"), ("a: 1_000", "1_000"), ("a: ١", "١"), ("a: [1, [x]]", [1, ["x"]]), ("b: &x {k: 1, l: 2}\na: {<<: *x, k: 3}", {"k": 3, "l": 2}), ("a: {<<: [{k: 1}, {k: 2, l: 2}]}", {"k": 1, "l": 2}),
    ],
)
def test_values(text, want):
    document, problem = configs.parsed(text)
    assert problem is None and json.loads(document)["a"] == want


@pytest.mark.parametrize("text", ["a: 1\na: 2", "{a: 1, a: 2}", "a: {<<: 3}", "a: {<<: *b}", "a: &x [*x]", "a: !!python/object:os.system x", "a: !own x", "[a", "? [1]\n: 2", "a: 1\n---\nb: 2"])
def test_refused(text):
    assert configs.parsed(text)[0] is None and configs.parsed(text)[1]


def test_registry_files(spark):
    head = "schema_version: 1\nprovider: {p}\nmodels:\n  {m}: "
    good = "{input_price_per_mtok: 0.1, output_price_per_mtok: 3, context_window: 10%s}"
    made = {
        "good": head.format(p="a", m="m1") + good % ", max_output_tokens: 5",
        "think": head.format(p="google", m="m2") + good % ", thinking_level: low, thinking_allowance_tokens: 4, keep_default_temperature: true",
        "elsewhere": head.format(p="b", m="m3") + good % ", thinking_level: low",
        "alone": head.format(p="google", m="m4") + good % ", thinking_allowance_tokens: 4",
        "text": head.format(p="c", m="m5") + "{input_price_per_mtok: x, output_price_per_mtok: 3, context_window: 10}",
        "window": head.format(p="d", m="m6") + "{input_price_per_mtok: 1, output_price_per_mtok: 3, context_window: '10'}",
        "more": head.format(p="e", m="m7") + good % ", other: 1",
        "version": "schema_version: 2\nprovider: f\nmodels: {}", "listed": "schema_version: 1\nprovider: g\nmodels: [a]", "empty": "schema_version: 1\nprovider: h\nmodels: {}", "none": "",
    }
    path = {"good": "a", "think": "google", "elsewhere": "b", "alone": "x/google", "text": "c", "window": "d", "more": "e", "version": "f", "listed": "g", "empty": "h", "none": "i"}
    files = spark.createDataFrame([(f"/models.d/{path[k]}.yaml", v) for k, v in made.items()], "path string, text string")
    found = {(r["path"], r["model"]): r for r in configs.models(files).collect()}
    assert {r["model"]: r["problem"] for r in found.values() if r["model"] in ("m1", "m2")} == {"m1": None, "m2": None}
    assert str(found["/models.d/a.yaml", "m1"]["input_price_per_mtok"]) == "0.100000000000" and found["/models.d/a.yaml", "m1"]["max_output_tokens"] == 5
    wrong = {m: r["problem"].partition(":")[0] for (_, m), r in found.items() if r["problem"] and m}
    assert wrong == {"m3": "thinking_level", "m4": "thinking_allowance_tokens", "m5": "input_price_per_mtok", "m6": "context_window", "m7": "unknown field"}
    assert sorted(p for (p, m), r in found.items() if m is None) == ["/models.d/f.yaml", "/models.d/g.yaml", "/models.d/i.yaml"]
    twice = files.where("path LIKE '%/a.yaml'").union(files.where("path LIKE '%/a.yaml'").withColumn("path", F.lit("/models.d/z/a.yaml")))
    assert all("also defined" in r["problem"] for r in configs.models(twice).collect())


def test_texts_are_parsed_once_by_many_tasks_and_verdicts_are_pyyamls(spark, monkeypatch):
    import yaml

    texts = ["a: 1", "a: &x 1\nb: &x 2\nc: *x", "a: b: c", "{a: [1, 2", "a: *gone", "a: \t1", "- \x07", "[" * 1500, ""]
    fast = [configs.parsed(t) for t in texts]
    monkeypatch.delattr(yaml, "CBaseLoader", raising=False)
    assert fast == [configs.parsed(t) for t in texts]
    files = spark.range(0, 400, 1, 1).selectExpr("concat('/m/n', id, '.yaml') AS path", "concat('schema_version: 1\nprovider: n', id, '\nmodels: {m', id, ': {input_price_per_mtok: 1, output_price_per_mtok: 2, context_window: 3}}') AS text")
    made = configs.models(files)
    assert made.where("problem IS NULL").count() == 400
    assert "Python" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert configs.spread(files).select(F.spark_partition_id()).distinct().count() > 4
