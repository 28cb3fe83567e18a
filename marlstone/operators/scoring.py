"""Requests answered by scorers: repair, retries and fallback, with a usage row for every call.

A scorer is any picklable callable: a model behind a client, or a function. `answered` runs scorers where the
requests are, one pass over them in Arrow batches: an invalid answer is asked for once more with what was wrong; trouble
that may pass is tried again, and then the next scorer in line is asked. Every call is recorded, those with an
invalid answer too, so answers and usage come from the same stored rows and are never paid for twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import ship, stored

MOST_TRIES = 3
CALL = "array<struct<call:int,provider:string,model:string,input_tokens:long,output_tokens:long,outcome:string>>"
REPAIR = "\n\nYour last answer could not be used: {problem}. Answer again, with the JSON object alone."


class Passing(RuntimeError):
    """Trouble that may have passed at the next try."""


@dataclass
class Reply:
    text: str
    input_tokens: int
    output_tokens: int


class Scorer(Protocol):
    def __call__(self, purpose: str, content: str) -> Reply:
        """The reply to a request; Passing for trouble that may pass, any other error for trouble that won't."""


@dataclass
class Line:
    """A scorer with the names that its usage is booked on."""

    provider: str
    model: str
    scorer: Scorer


def relevance_problem(text: str) -> str | None:
    """What is wrong with a relevance answer; None if nothing is."""
    bare = text.strip()
    if bare.startswith("```") and bare.endswith("```") and "\n" in bare:
        bare = bare[bare.index("\n") : -3]
    try:
        found = json.loads(bare)
    except ValueError:
        return "not JSON"
    if not isinstance(found, dict) or set(found) != {"score", "reason", "key_points"}:
        return "not an object of score, reason and key_points"
    score, reason, points = found["score"], found["reason"], found["key_points"]
    if isinstance(score, bool) or not isinstance(score, (int, float)) or not 0 <= score <= 1:
        return "score isn't a number from 0 to 1"
    if not isinstance(reason, str) or not reason.strip():
        return "reason is blank"
    return None if isinstance(points, list) and all(isinstance(p, str) for p in points) else "key_points aren't strings"


def ask(lines: Sequence[Line], problem: Callable[[str], str | None], purpose: str, content: str, tries: int = MOST_TRIES) -> tuple[str | None, str | None, list[tuple]]:
    """The answer or the error, and the calls it took."""
    calls: list[tuple] = []
    error = "no scorer"
    for line in lines:
        request, repaired, trouble = content, False, 0
        while trouble < tries:
            try:
                reply = line.scorer(purpose, request)
            except Passing as e:
                trouble, error = trouble + 1, f"{type(e).__name__}: {e}"
                calls.append((len(calls) + 1, line.provider, line.model, 0, 0, "passing"))
                continue
            except Exception as e:  # noqa: BLE001  (a client's own errors)
                error = f"{type(e).__name__}: {e}"
                calls.append((len(calls) + 1, line.provider, line.model, 0, 0, "failed"))
                break
            wrong = problem(reply.text)
            calls.append((len(calls) + 1, line.provider, line.model, reply.input_tokens, reply.output_tokens, "invalid" if wrong else "answered"))
            if wrong is None:
                return reply.text, None, calls
            if repaired:  # an answer is repaired once, and another scorer isn't asked for it
                return None, f"invalid answer: {wrong}", calls
            request, repaired = content + REPAIR.format(problem=wrong), True
    return None, error, calls


def answered(requests: DataFrame, lines: Sequence[Line], problem: Callable[[str], str | None] = relevance_problem, tries: int = MOST_TRIES) -> DataFrame:
    """requests (id, purpose, content) with answer, error and calls, stored; null content is asked for as empty."""
    ship(requests.sparkSession)
    kind = requests.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ask(lines, problem, p or "", c or "", tries) for p, c in zip(batch.column("purpose").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            fields = [("call", pa.int32()), ("provider", pa.string()), ("model", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("outcome", pa.string())]
            calls = pa.array([x[2] for x in made], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("purpose"), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.string()), calls], names=["id", "purpose", "answer", "error", "calls"])

    return stored(requests.select("id", "purpose", "content").mapInArrow(run, f"id {kind}, purpose string, answer string, error string, calls {CALL}"))


def usage(answers: DataFrame) -> DataFrame:
    """A row for each call that used tokens: id, purpose, call, provider, model, input_tokens, output_tokens, outcome."""
    rows = answers.select("id", "purpose", F.explode("calls").alias("c")).select("id", "purpose", "c.*")
    return rows.where(F.col("outcome").isin("answered", "invalid"))
