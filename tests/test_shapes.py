"""Every rule of every shape broken once, against breaches written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from turnwise.operators import shapes as S

EVIDENCE = {"turn_id": "T001", "channel": "lexical", "quote": "q", "moment_ids": ["M001"], "description": "d"}
READING = {"layer": "unsaid", "speaker": "A", "claim": "c", "likelihood": "likely", "evidence_confidence": "low", "evidence": [EVIDENCE], "alternatives": ["a"], "follow_up": "f"}
TOPIC = {"id": "t1", "label": "l", "spans": [["T001", "T002"]]}
NOTES = {"summary": "s", "decisions": [{"text": "t", "turn_ids": ["T001"]}], "action_items": [{"task": "t", "turn_ids": []}], "open_questions": [], "key_numbers": []}
GOOD = {
    "insights_draft": {"topics": [TOPIC], "notes": NOTES, "speakers": [{"label": "A", "cares_about": [{"why": "w", "turn_ids": ["T001"]}]}], "insights": [READING], "so_what": [{"text": "t", "refs": ["r"]}], "working": {"observations": [1, {}], "rejected": [{"claim": "c"}]}, "more": 1},
    "pass_a": {"topics": [], "facts": {k: NOTES[k] for k in ("decisions", "action_items", "open_questions", "key_numbers")}, "observations": [{"id": "o", "turn_id": "T100", "speaker": "A", "channel": "timing", "description": "d"}], "per_speaker": [{}]},
    "pass_b": {"clusters": [{"id": "c", "speaker": "A", "layer": "relational", "readings": [{"id": "r", "text": "t", "ordinary": True, "supports": ["o"]}] * 2, "favoured": "r", "likelihood": "unlikely", "evidence_confidence": "high"}], "nothing_notable": []},
    "pass_c": {"reviews": [{"cluster_id": "c", "verdict": "keep"}]},
    "coaching": {"observations": [{"feature": "f", "text": "t"}] * 3, "nothing_to_report": False},
}


def changed(shape, *path_and_value):
    out = json.loads(json.dumps(GOOD[shape]))
    *path, last, value = path_and_value
    at = out
    for p in path:
        at = at[p]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


CASES = [
    ("insights_draft", GOOD["insights_draft"], []), ("pass_a", GOOD["pass_a"], []), ("pass_b", GOOD["pass_b"], []), ("pass_c", GOOD["pass_c"], []), ("coaching", GOOD["coaching"], []),
    ("insights_draft", {}, [("", "required")] * 4), ("insights_draft", [], None), ("insights_draft", changed("insights_draft", "notes", ...), [("", "required")]),
    ("insights_draft", changed("insights_draft", "topics", {}), [("topics", "type")]), ("insights_draft", changed("insights_draft", "topics", 0, "spans", 0, ["T001"]), [("topics → 0 → spans → 0", "minItems")]),
    ("insights_draft", changed("insights_draft", "topics", 0, "spans", 0, ["T001", "T002", "x"]), [("topics → 0 → spans → 0", "maxItems"), ("topics → 0 → spans → 0 → 2", "pattern")]),
    ("insights_draft", changed("insights_draft", "insights", 0, "evidence", []), [("insights → 0 → evidence", "minItems")]), ("insights_draft", changed("insights_draft", "insights", 0, "evidence", 0, "channel", "smell"), [("insights → 0 → evidence → 0 → channel", "enum")]),
    ("insights_draft", changed("insights_draft", "insights", 0, "evidence", 0, "turn_id", 7), [("insights → 0 → evidence → 0 → turn_id", "type")]), ("insights_draft", changed("insights_draft", "insights", 0, "evidence", 0, "moment_ids", 0, "M1"), [("insights → 0 → evidence → 0 → moment_ids → 0", "pattern")]),
    ("insights_draft", changed("insights_draft", "insights", 0, "likelihood", None), [("insights → 0 → likelihood", "enum")]), ("insights_draft", changed("insights_draft", "insights", 0, "follow_up", ...), [("insights → 0", "required")]),
    ("insights_draft", changed("insights_draft", "insights", 0, "alternatives", 0, None), [("insights → 0 → alternatives → 0", "type")]), ("insights_draft", changed("insights_draft", "speakers", 0, "nothing_notable", "yes"), [("speakers → 0 → nothing_notable", "type")]),
    ("insights_draft", changed("insights_draft", "working", []), [("working", "type")]), ("insights_draft", changed("insights_draft", "so_what", 0, "text", ...), [("so_what → 0", "required")]),
    ("pass_a", changed("pass_a", "observations", 0, "turn_id", "T01"), [("observations → 0 → turn_id", "pattern")]), ("pass_a", changed("pass_a", "facts", "decisions", ...), [("facts", "required")]), ("pass_a", changed("pass_a", "per_speaker", 0, "x"), [("per_speaker → 0", "type")]),
    ("pass_b", changed("pass_b", "clusters", 0, "readings", [GOOD["pass_b"]["clusters"][0]["readings"][0]]), [("clusters → 0 → readings", "minItems")]), ("pass_b", changed("pass_b", "clusters", 0, "readings", 1, "ordinary", "no"), [("clusters → 0 → readings → 1 → ordinary", "type")]),
    ("pass_c", changed("pass_c", "reviews", 0, "verdict", "maybe"), [("reviews → 0 → verdict", "enum")]), ("pass_c", changed("pass_c", "reviews", 0, "likelihood", 3), [("reviews → 0 → likelihood", "enum")]),
    ("coaching", changed("coaching", "observations", GOOD["coaching"]["observations"] + [{"feature": "f"}]), [("observations", "maxItems"), ("observations → 3", "required")]), ("coaching", changed("coaching", "nothing_to_report", 1), [("nothing_to_report", "type")]),
]


@pytest.mark.parametrize("shape", list(S.SHAPES))
def test_breaches_are_those_written_out(spark, shape):
    cases = [(k, json.dumps(body), want) for k, (name, body, want) in enumerate(CASES) if name == shape]
    got = {r.k: r.b for r in spark.createDataFrame([c[:2] for c in cases], "k int, body string").select("k", S.breaches(F.parse_json("body"), S.SHAPES[shape]).alias("b")).collect()}
    for k, body, want in cases:
        assert [(b.path, b.rule) for b in got[k]] == ([("", "type")] if want is None else want), body


def test_replies_are_parsed_and_problems_told(spark):
    rows = [(1, "Sure:\n```json\n" + json.dumps(GOOD["insights_draft"]) + "\n```"), (2, "not json at all"), (3, '{"topics": []}'), (4, None), (5, '{"topics": [}')]
    got = {r.k: r.problems for r in S.parsed_replies(spark.createDataFrame(rows, "k int, reply string")).select("k", "problems").collect()}
    assert got[1] == [] and got[2] == got[4] == got[5] == ["The response is not valid JSON"]
    assert got[3] == [f"top level: '{n}' is a required property" for n in ("insights", "notes", "speakers")]


def test_the_verifier_gives_every_reason(spark):
    """Two speakers a call; the tables of the query hold every reason and every problem of evidence."""
    from turnwise.operators.verifying import REASONS
    from turnwise.plans.verification import _verified

    claims, evidence = _verified(spark, "/root/testdata/sf0.01")
    assert {r.reason for r in claims.select("reason").distinct().collect()} == {None, *REASONS}
    problems = {"turn_missing", "wrong_speaker", "quote_too_long", "quote_mismatch", "prosody_unsupported", "disfluency_unsupported", "timing_unsupported", "lexical_needs_quote", "interaction_unsupported", "unknown_channel"}
    assert {r.problem for r in evidence.select("problem").distinct().collect()} == {None, *problems}
