"""Chat formatting: tool calls linked with their results.

Calls and results are hash-joined on conversation and identifier. Calls are put in topological order by peeling: a call's
level is one more than the highest level of the calls it depends on. Arguments are validated against the tools'
schemas, and each linked call is serialised as canonical JSON (sorted keys, no blanks).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import stored

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def argument_errors(arguments, schema: dict | None) -> list[str]:
    """What is wrong with ``arguments``, in the order of their names; an unknown tool has no schema."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    known = schema.get("properties", {})
    errors = [f"missing {n}" for n in sorted(schema.get("required", ())) if n not in arguments]
    for name in sorted(arguments):
        if name not in known:
            if not schema.get("additionalProperties", True):
                errors.append(f"unknown {name}")
            continue
        wanted = known[name].get("type")
        value = arguments[name]
        wrong = wanted is not None and not isinstance(value, _TYPES[wanted])
        if wrong or (isinstance(value, bool) and wanted in ("integer", "number")):
            errors.append(f"{name} is no {wanted}")
        elif "enum" in known[name] and value not in known[name]["enum"]:
            errors.append(f"{name} is not permitted")
    return errors


def call_levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` from ``conv_id, call_id, depends_on`` (an array of call ids of the conversation).

    Level 0 depends on nothing. References to calls that do not exist are ignored. Calls in or behind a cycle have a null level. One
    round of joins for each level; a call leaves the open set as soon as all it depends on have levels.
    """
    nodes = calls.select("conv_id", "call_id").distinct()
    refs = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needs")).distinct()
    refs = refs.join(nodes.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
    open_refs = stored(refs, "call-references")
    done = nodes.join(open_refs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    done, level = stored(done, "call-levels"), 0
    while not open_refs.isEmpty():
        settled = done.select("conv_id", F.col("call_id").alias("needs"))
        waiting = open_refs.join(settled, ["conv_id", "needs"], "left_anti").select("conv_id", "call_id").distinct()
        level += 1
        ready = open_refs.select("conv_id", "call_id").distinct().join(waiting, ["conv_id", "call_id"], "left_anti")
        ready = stored(ready.withColumn("level", F.lit(level)), "ready-calls")
        if ready.isEmpty():
            break  # what is left stands in or behind a cycle
        open_refs = stored(open_refs.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "call-references")
        done = done.unionByName(ready)
    return nodes.join(done, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "level")


def _format_batches(schemas: dict[str, dict]):
    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, text = [], [], []
            for row in batch.to_pylist():
                try:
                    arguments, problems = json.loads(row["arguments"] or "null"), []
                except ValueError:
                    arguments, problems = row["arguments"], ["arguments are no JSON"]
                problems = problems or argument_errors(arguments, schemas.get(row["name"]))
                if not row["linked"]:
                    problems = [*problems, "no result"]
                valid.append(not problems)
                errors.append(problems)
                text.append(
                    canonical_json(
                        {"id": row["call_id"], "name": row["name"], "arguments": arguments, "depends_on": row["depends_on"] or [], "result": row["result"]}
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(text, pa.string())],
                [*batch.schema.names, "valid", "errors", "json"],
            )

    return form


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call: ``conv_id, turn, call_id, name, level, valid, errors, json``.

    ``calls``: ``conv_id, turn, call_id, name, arguments`` (JSON text), ``depends_on``; ``results``: ``conv_id, call_id, result``; other
    columns are ignored. Ordering by ``level, turn, call_id`` within a conversation is a topological order. Calls without
    a conversation or an id cannot be linked and are left out; a repeated id keeps the first call (smallest turn, then name and arguments)
    and the smallest result. A call without a result is kept with a null result and marked invalid. ``schemas`` is configuration: a small mapping of
    tool names to argument schemas. No conversation is gathered in one task.
    """
    named = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    first = (
        named.groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"))
        .select("conv_id", "call_id", "c.*")
    )
    first = stored(first, "calls")
    answers = results.groupBy("conv_id", "call_id").agg(F.min("result").alias("result")).withColumn("linked", F.lit(True))
    linked = (
        first.join(answers, ["conv_id", "call_id"], "left")
        .join(call_levels(first), ["conv_id", "call_id"], "left")
        .select("conv_id", "turn", "call_id", "name", "level", "arguments", "depends_on", "result", F.coalesce("linked", F.lit(False)).alias("linked"))
    )
    types = linked.dtypes
    out = ", ".join([*(f"{n} {t}" for n, t in types), "valid boolean, errors array<string>, json string"])
    return linked.mapInArrow(_format_batches(schemas), out).select("conv_id", "turn", "call_id", "name", "level", "valid", "errors", "json")
