"""Job and model files: YAML texts as JSON, checked, and models as a dimension of prices."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import ship, stored

# Plain scalars of YAML 1.2's core, its tags, and the fields of a model's entry.
NULLS, TRUE, FALSE = ("", "~", "null", "Null", "NULL"), ("true", "True", "TRUE"), ("false", "False", "FALSE")
CORE_TAGS = ("tag:yaml.org,2002:str", "tag:yaml.org,2002:seq", "tag:yaml.org,2002:map")
PRICES = ("input_price_per_mtok", "output_price_per_mtok")
THINKING, THINKING_LEVELS, THINKING_PROVIDERS = ("thinking_level", "thinking_allowance_tokens", "keep_default_temperature"), ("minimal", "low", "medium", "high"), ("google",)
OWN_READING = re.compile("[\t?\ufeff]")
PARSED = T.StructType([T.StructField("document", T.StringType()), T.StructField("problem", T.StringType())])


class Unreadable(ValueError):
    """A document that isn't what these files may hold."""


def scalar(text: str) -> object:
    """A plain scalar: null, a truth value, a decimal number, else the text. `yes`, `0123` and dates are texts."""
    if text in NULLS:
        return None
    if text in TRUE or text in FALSE:
        return text in TRUE
    digits = text[1:] if text[:1] in ("+", "-") else text
    if digits.isascii() and digits.isdigit():
        return text if digits[0] == "0" and len(digits) > 1 else int(text)
    whole, point, rest = digits.lower().partition(".") if "." in digits else digits.lower().partition("e")
    part, _, power = rest.partition("e") if point == "." else ("", "", rest)
    counts = lambda d: not d or (d.isascii() and d.isdigit())
    signed = whole or digits is text  # a sign before a bare point makes no number
    if point and signed and counts(whole) and counts(part) and (whole or part) and (point == "." or power) and ("e" not in digits.lower() or counts(power.lstrip("+-")) and power.lstrip("+-")):
        return float(text)
    return text


def value_of(node: object, around: tuple[int, ...] = ()) -> object:
    """The value of a composed node: repeated keys, merges of what is no mapping, own tags and cycles are errors."""
    if id(node) in around:
        raise Unreadable("an alias holds itself")
    inner = (*around, id(node))
    kind = node.tag.rpartition(":")[2]
    if node.tag not in CORE_TAGS:
        raise Unreadable(f"unknown tag {node.tag!r}")
    if kind == "str":
        return node.value if node.style else scalar(node.value)
    if kind == "seq":
        return [value_of(x, inner) for x in node.value]
    own, merged = {}, {}
    for key, held in node.value:
        name = value_of(key, inner)
        if name == "<<" and not key.style:
            for base in held.value if held.tag.endswith(":seq") else [held]:
                if not (made := value_of(base, inner)) or not isinstance(made, dict):
                    raise Unreadable("a merge needs a mapping")
                merged = made | merged
            continue
        if isinstance(name, (dict, list)) or name in own:
            raise Unreadable(f"key {name!r} is repeated or no scalar")
        own[name] = value_of(held, inner)
    return merged | own


def parsed(text: str) -> tuple[str | None, str | None]:
    """A YAML text as JSON, or what is wrong with it.

    libyaml's parser, where PyYAML has it, takes a tenth of the time; what it refuses, and texts with
    what it reads otherwise (tabs, byte order marks, question marks), are judged by PyYAML's own.
    """
    import yaml

    try:
        try:
            node = yaml.compose(text, Loader=yaml.BaseLoader if OWN_READING.search(text) else getattr(yaml, "CBaseLoader", yaml.BaseLoader))
        except yaml.YAMLError:
            node = yaml.compose(text, Loader=yaml.BaseLoader)
        return json.dumps(None if node is None else value_of(node), ensure_ascii=False, sort_keys=True), None
    except (yaml.YAMLError, Unreadable, TypeError, ValueError, RecursionError) as e:
        return None, str(e).split("\n")[0][:200]


def spread(files: DataFrame) -> DataFrame:
    """Dealt to all tasks by path: small files make few partitions, and YAML takes far more time than its bytes tell."""
    session = files.sparkSession
    # A number of our own, since Spark would join parts that are small by bytes.
    return files.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism), "path")


@F.pandas_udf(PARSED)
def yaml_json(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else parsed(t) for t in texts], columns=["document", "problem"])


def job_problems(document: Column) -> Column:
    """Dotted paths of what a job's file lacks or has wrong: name, schedule, sources."""
    get = lambda path: F.get_json_object(document, f"$.{path}")
    frequency = get("schedule.frequency")
    checks = (
        ("name", F.coalesce(F.trim(get("name")), F.lit("")) == ""),
        ("schedule.frequency", ~F.coalesce(frequency.isin("daily", "weekly", "monthly"), F.lit(False))),
        ("schedule.time", ~F.coalesce(get("schedule.time").rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False))),
        ("schedule.weekday", (frequency == "weekly") & get("schedule.weekday").isNull()),
        ("schedule.day_of_month", (frequency == "monthly") & ~F.coalesce(get("schedule.day_of_month").try_cast("int").between(1, 31), F.lit(False))),
        ("sources", F.coalesce(F.json_array_length(get("sources")), F.lit(0)) == 0),
    )
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), path) for path, test in checks]), lambda p: p.isNotNull())


def jobs(files: DataFrame) -> DataFrame:
    """Files (path, text) with document (JSON), problem (not YAML) and problems (paths that are wrong)."""
    ship(files.sparkSession)
    read = spread(files.select("path", "text")).select("path", yaml_json("text").alias("y")).select("path", "y.document", "y.problem")
    return read.withColumn("problems", F.when(F.col("document").isNotNull(), job_problems(F.col("document"))))


def _model_problem(entry: Column, provider: Column) -> Column:
    """The first thing that is wrong with a model's entry (JSON); null if nothing is."""
    document = F.try_parse_json(entry)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(document, f"$.{name}", "variant"))
    price = lambda name: F.coalesce(F.get_json_object(entry, f"$.{name}").try_cast("decimal(38,12)") >= 0, F.lit(False))
    given = lambda name: F.array_contains(F.json_object_keys(entry), name)
    positive = lambda name: (kind(name) == "BIGINT") & (F.try_variant_get(document, f"$.{name}", "bigint") > 0)
    wrong = [(f"{n}: a price of 0 or more is needed", ~price(n)) for n in PRICES]
    wrong += [("context_window: a positive whole number is needed", ~positive("context_window"))]
    wrong += [(f"{n}: a positive whole number is needed", given(n) & (kind(n) != "VOID") & ~positive(n)) for n in ("max_output_tokens", "thinking_allowance_tokens")]
    wrong += [("thinking_level: unknown", given("thinking_level") & (kind("thinking_level") != "VOID") & ~F.get_json_object(entry, "$.thinking_level").isin(*THINKING_LEVELS))]
    wrong += [("keep_default_temperature: true or false is needed", given("keep_default_temperature") & (kind("keep_default_temperature") != "BOOLEAN"))]
    wrong += [(f"{n}: not for this provider", given(n) & ~provider.isin(*THINKING_PROVIDERS)) for n in THINKING]
    wrong += [("thinking_allowance_tokens: needs thinking_level", F.get_json_object(entry, "$.thinking_allowance_tokens").isNotNull() & F.get_json_object(entry, "$.thinking_level").isNull())]
    known = F.array(*map(F.lit, (*PRICES, "context_window", "max_output_tokens", *THINKING)))
    made = F.when(F.json_object_keys(entry).isNull(), "a mapping is needed").when(F.size(F.array_except(F.json_object_keys(entry), known)) > 0, "unknown field")
    for problem, test in wrong:
        made = made.when(F.coalesce(test, F.lit(True)), problem)
    return made


def models(files: DataFrame) -> DataFrame:
    """Models of registry files (path, text): path, provider, model, prices, context_window, max_output_tokens and problem.

    A file is a mapping of schema_version 1, its own name as provider, and models by id. A file that isn't has
    one row without a model; a model whose entry is wrong, or whose id another file has too, keeps its row with
    the problem and no prices. Rows without a problem are the price dimension.
    """
    ship(files.sparkSession)
    stem = F.regexp_extract("path", r"([^/]+)\.ya?ml$", 1)
    read = spread(files.select("path", "text")).select("path", stem.alias("provider"), yaml_json("text").alias("y")).select("path", "provider", F.col("y.document").alias("d"), F.col("y.problem").alias("unread"))
    read = stored(read)  # read twice below: texts are parsed once
    get = lambda name: F.get_json_object("d", f"$.{name}")
    keys = F.array_sort(F.json_object_keys("d"))
    problem = (
        F.when(F.col("unread").isNotNull(), F.col("unread"))
        .when(F.coalesce(keys != F.array(F.lit("models"), F.lit("provider"), F.lit("schema_version")), F.lit(True)), "schema_version, provider and models are needed")
        .when(F.coalesce(get("schema_version") != "1", F.lit(True)), "schema_version must be 1")
        .when(F.coalesce(get("provider") != F.col("provider"), F.lit(True)), "provider isn't the file's name")
        .when(F.json_object_keys(get("models")).isNull(), "models must be a mapping")
    )
    entries = F.when(problem.isNull(), F.map_entries(F.from_json(get("models"), "map<string,string>")))
    rows = read.select("path", "provider", problem.alias("of_file"), entries.alias("entries")).select("path", "provider", "of_file", F.explode_outer("entries").alias("m")).where("of_file IS NOT NULL OR m IS NOT NULL")
    entry = F.col("m.value")
    made = rows.select("path", "provider", F.col("m.key").alias("model"), entry.alias("entry"), F.when(F.col("of_file").isNotNull(), F.col("of_file")).otherwise(_model_problem(entry, F.col("provider"))).alias("problem"))
    files_of = made.where("model IS NOT NULL").groupBy("model").agg(F.min("path").alias("_first"), F.count("*").alias("_n"))
    joined = made.join(files_of, "model", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("_n") > 1, F.concat(F.lit("also defined in another file, first in "), F.col("_first")))))
    good = lambda name, kind: F.when(F.col("problem").isNull(), F.get_json_object("entry", f"$.{name}").cast(kind)).alias(name)
    return joined.select("path", "provider", "model", *[good(n, "decimal(38,12)") for n in PRICES], good("context_window", "long"), good("max_output_tokens", "long"), "problem")
