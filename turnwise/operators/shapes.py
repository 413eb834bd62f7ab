"""Shapes of model replies: a reply in JSON is walked against a shape that is held as data, and every breach is a row.

A shape is one of record(required, optional), listed(item, least, most), text(pattern), one_of(values), flag() and anything(). The walk is
built into one column expression over VARIANT, so replies stay in the JVM and shapes nest as deep as they say.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from turnwise.functions.text import json_object
from turnwise.operators.checking import CHANNELS, CONFIDENCE, LAYERS, LIKELIHOODS


class Shape(NamedTuple):
    kind: str
    fields: tuple = ()
    required: tuple = ()
    item: object = None
    least: int | None = None
    most: int | None = None
    pattern: str | None = None
    values: tuple = ()


def record(required: dict | None = None, **optional) -> Shape:
    return Shape("object", (*(required or {}).items(), *optional.items()), tuple(required or {}))


def listed(item: Shape | None = None, least: int | None = None, most: int | None = None) -> Shape:
    return Shape("array", item=item, least=least, most=most)


def text(pattern: str | None = None) -> Shape:
    return Shape("string", pattern=pattern)


def one_of(*values: str) -> Shape:
    return Shape("enum", values=values)


def flag() -> Shape:
    return Shape("boolean")


# fixed values: the shapes of the five replies
TURN, TURNS, MOMENTS, WORDS = text(r"^T\d{3,}$"), listed(text(r"^T\d{3,}$")), listed(text(r"^M\d{3,}$")), listed(text())
TOPIC = record({"id": text(), "label": text(), "spans": listed(listed(TURN, 2, 2))}, raised_by=text())
FACTS = listed(record({"text": text(), "turn_ids": TURNS}))
ACTIONS = listed(record({"task": text(), "turn_ids": TURNS}, owner=text(), due=text()))
KEPT = {"decisions": FACTS, "action_items": ACTIONS, "open_questions": FACTS, "key_numbers": FACTS}
EVIDENCE = record({"turn_id": TURN, "channel": one_of(*CHANNELS)}, quote=text(), moment_ids=MOMENTS, description=text())
RATED = {"likelihood": one_of(*LIKELIHOODS), "evidence_confidence": one_of(*CONFIDENCE)}
READING = record({"layer": one_of(*LAYERS), "speaker": text(), "claim": text(), **RATED, "evidence": listed(EVIDENCE, 1), "alternatives": WORDS, "follow_up": text()}, id=text(), topic_id=text())
SHAPES = {
    "pass_a": record({
        "topics": listed(TOPIC), "facts": record(KEPT), "per_speaker": listed(record()),
        "observations": listed(record({"id": text(), "turn_id": TURN, "speaker": text(), "channel": one_of(*CHANNELS), "description": text()}, quote=text(), moment_ids=MOMENTS, topic_id=text())),
    }),
    "pass_b": record({
        "clusters": listed(record({
            "id": text(), "speaker": text(), "layer": one_of(*LAYERS), "favoured": text(), **RATED,
            "readings": listed(record({"id": text(), "text": text(), "ordinary": flag(), "supports": WORDS}, against=WORDS), 2),
        }, topic_id=text(), why=text())),
        "nothing_notable": WORDS,
    }),
    "pass_c": record({"reviews": listed(record({"cluster_id": text(), "verdict": one_of("keep", "downgrade", "drop")}, claim=text(), reason=text(), **RATED))}),
    "insights_draft": record({
        "topics": listed(TOPIC), "notes": record({"summary": text(), **KEPT}), "insights": listed(READING),
        "speakers": listed(record({"label": text()}, nothing_notable=flag(), cares_about=listed(record({"why": text(), "turn_ids": TURNS}, topic_id=text())))),
    }, working=record(observations=listed(), rejected=listed(record(claim=text(), reason=text()))), so_what=listed(record({"text": text()}, refs=WORDS))),
    "coaching": record({"observations": listed(record({"feature": text(), "text": text()}, turn_id=TURN, **{"try": text()}), most=3), "nothing_to_report": flag()}),
}

_BREACH = "array<struct<depth:int,path:string,rule:string,message:string>>"


def _breach(wrong: Column, depth: Column, path: Column, rule: str, message: str | Column) -> Column:
    """An array of one breach, or none."""
    found = F.array(F.struct(depth.cast("int").alias("depth"), path.alias("path"), F.lit(rule).alias("rule"), (F.lit(message) if isinstance(message, str) else message).alias("message")))
    return F.when(F.coalesce(wrong, F.lit(False)), found).otherwise(F.array().cast(_BREACH))


def _walked(value: Column, shape: Shape, depth: Column, path: Column) -> Column:
    """The breaches of a value that is there."""
    kind = F.schema_of_variant(value)
    prefix = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN"}
    if shape.kind == "enum":
        said = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        return _breach(~F.coalesce(said.isin(*shape.values), F.lit(False)), depth, path, "enum", f"is not one of {', '.join(shape.values)}")
    right = kind.startswith(prefix[shape.kind])
    out = [_breach(~right, depth, path, "type", f"is not of type {shape.kind}")]
    if shape.pattern:
        out.append(_breach(right & ~F.try_variant_get(value, "$", "string").rlike(shape.pattern), depth, path, "pattern", f"does not match {shape.pattern}"))
    if shape.kind == "array":
        items = F.when(right, F.try_variant_get(value, "$", "array<variant>"))
        if shape.least is not None:
            out.append(_breach(F.size(items) < shape.least, depth, path, "minItems", f"has fewer than {shape.least} items"))
        if shape.most is not None:
            out.append(_breach(F.size(items) > shape.most, depth, path, "maxItems", f"has more than {shape.most} items"))
        if shape.item is not None:
            inner = F.transform(items, lambda x, i: _walked(F.coalesce(x, F.parse_json(F.lit("null"))), shape.item, depth + 1, F.concat(path, F.when(path != "", " → ").otherwise(""), i.cast("string"))))
            out.append(F.coalesce(F.flatten(inner), F.array().cast(_BREACH)))
    for name, inside in shape.fields:
        own = F.try_variant_get(value, f"$.{name}", "variant")
        if name in shape.required:
            out.append(_breach(right & own.isNull(), depth, path, "required", f"'{name}' is a required property"))
        below = _walked(own, inside, depth + 1, F.concat(path, F.when(path != "", " → ").otherwise(""), F.lit(name)))
        out.append(F.when(right & own.isNotNull(), below).otherwise(F.array().cast(_BREACH)))
    return F.concat(*out) if len(out) > 1 else out[0]


def breaches(reply: Column, shape: Shape) -> Column:
    """Array of (depth, path, rule, message) of a parsed reply (VARIANT), by depth, then path, then rule; null for a null reply.

    Rules: required, type, enum, pattern, minItems, maxItems. The path of what is required is that of the record that lacks it; '' is the
    top. What isn't named in a shape may be there.
    """
    return F.when(reply.isNotNull(), F.array_sort(_walked(reply, shape, F.lit(0), F.lit(""))))


def parsed_replies(replies: DataFrame, shape: str = "insights_draft", reply: str = "reply") -> DataFrame:
    """replies with body (VARIANT, null if it isn't JSON) and problems: texts 'path: message', empty if the reply has its shape.

    Code fences and what stands around the outermost braces go first.
    """
    body = F.try_parse_json(json_object(F.col(reply)))
    said = lambda b: F.concat(F.when(b["path"] == "", "top level").otherwise(b["path"]), F.lit(": "), b["message"])
    parsed = replies.withColumn("body", body)
    return parsed.withColumn("problems", F.when(F.col("body").isNull(), F.array(F.lit("The response is not valid JSON"))).otherwise(F.transform(breaches(F.col("body"), SHAPES[shape]), said)))
