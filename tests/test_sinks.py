"""Files of calls: round trips, names that are taken, pause marks."""

import csv
import io
import json
import random
import re
from pathlib import Path

import pytest

from turnwise.operators import report as P
from turnwise.sources import files, sinks

SEGS = [("one", 0, "A", 0.0, 5.0, 'We "need", it'), ("one", 1, "B", 6.5, 8.0, "Ünder\nway"), ("two / x", 0, None, 1.0, 3661.5, None)]


@pytest.fixture()
def segments(spark):
    return spark.createDataFrame(SEGS, "call_id string, seg_idx long, speaker string, start_s double, end_s double, text string")


def names(folder):
    return sorted(p.name for p in Path(folder).iterdir() if not p.name.startswith("."))


def test_segments_round_trip_and_taken_names(spark, segments, tmp_path):
    first = sinks.write_files(sinks.segment_json(segments), str(tmp_path), "json")
    second = sinks.write_files(sinks.segment_json(segments.where("call_id = 'one'")), str(tmp_path), "json")
    third = sinks.write_files(sinks.segment_json(segments.where("call_id = 'one'")), str(tmp_path), "json")
    assert names(tmp_path) == ["one (2).json", "one (3).json", "one.json", "two _ x.json"]
    assert [p.rsplit("/", 1)[1] for p in first + second + third] == ["one.json", "two _ x.json", "one (2).json", "one (3).json"]
    got = sorted((r.call_id, r.seg_idx, r.speaker or "", r.start_s, r.end_s, r.text) for r in files.segment_files(spark, str(tmp_path)).where("call_id not like '%)%'").collect())
    assert got == sorted((c.replace("/", "_"), k, w or "", a, b, t) for c, k, w, a, b, t in SEGS)
    assert json.loads((tmp_path / "one.json").read_text()) == json.loads((tmp_path / "one (2).json").read_text())


def test_formats(spark, segments, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_all(segments, str(tmp_path), ["doc"])
    with pytest.raises(ValueError):
        sinks.write_all(segments, str(tmp_path), ["md"])
    sinks.write_all(segments.where("call_id = 'one'"), str(tmp_path), ["csv", "srt", "txt"])
    assert names(tmp_path) == ["one.csv", "one.srt", "one.txt"]
    assert list(csv.reader(io.StringIO((tmp_path / "one.csv").read_text()))) == [["start", "end", "speaker", "text"], ["0.0", "5.0", "A", 'We "need", it'], ["6.5", "8.0", "B", "Ünder\nway"]]
    assert (tmp_path / "one.srt").read_text().startswith('1\n00:00:00,000 --> 00:00:05,000\nA: We "need", it\n\n2\n00:00:06,500 --> ')
    assert (tmp_path / "one.txt").read_text().splitlines()[0] == '[00:00:00.000] A: We "need", it'


def test_numbers_go_beside_md_and_json(spark, segments, tmp_path):
    scored = segments.where("call_id = 'one'").selectExpr("*", "0.5D arousal", "cast(null as double) valence", "true measured", "cast(null as double) certainty")
    words = spark.createDataFrame([("one", 0, 0, "We", 0.0, 0.5, None), ("one", 0, 1, '"need",', 3.0, 3.5, None)], "call_id string, seg_idx long, word_idx int, word string, start_s double, end_s double, kind string")
    report = P.analysed(scored, words, spark.createDataFrame([("one", 8.0)], "call_id string, media_seconds double"))
    written = sinks.write_all(segments.where("call_id = 'one'"), str(tmp_path), ["md", "json"], report)
    assert [p.rsplit("/", 1)[1] for p in written] == ["one.json", "one.md", "one.analysis.json"]
    text = (tmp_path / "one.md").read_text()
    assert "- [00:00:00] A: pauses for 2.5s" in text and 'We (...2.5s) "need", it' in text
    numbers = json.loads((tmp_path / "one.analysis.json").read_text())
    assert [t["turn_idx"] for t in numbers["turns"]] == [0, 1] and numbers["moments"][0]["observations"] == ["pauses for 2.5s"]


def marked(text, pauses):
    done = ""
    for _, seconds, word in sorted(pauses):
        word = word.strip()
        m = re.search((r"\b" if word[:1].isalnum() else "") + re.escape(word) + r"(?!\w)", text) if word else None
        if m:
            done, text = done + text[: m.end()] + f" (...{seconds:.1f}s)", text[m.end() :]
    return done + text


def test_pause_marks_equal_a_fold(spark):
    r = random.Random(3)
    vocabulary = ["the", "together", "we", "we'll", "né", "\"so", "end.", "a.b", "(x)", "\\E", "t"]
    turns, pauses = [("c", -1, None), ("c", -2, "no pauses")], []
    for k in range(200):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 12))]
        turns.append(("c", k, r.choice([" ", "  ", "-"]).join(words)))
        pauses += [("c", k, float(r.randrange(9)), r.choice([1.0, 2.25, 3.14, 10.0]), r.choice([*vocabulary, "absent", " ", " the "])) for _ in range(r.randrange(0, 5))]
    frame = spark.createDataFrame(pauses, "call_id string, turn_idx long, at double, seconds double, after_word string")
    got = {g.turn_idx: g.body for g in sinks.turn_bodies(spark.createDataFrame(turns, "call_id string, turn_idx long, text string"), frame).collect()}
    by = {k: [p[2:] for p in pauses if p[1] == k] for k in range(-2, 200)}
    for _, k, text in turns:
        mine = sorted((a, s, w.strip()) for a, s, w in by[k])
        assert got[k] == marked(text or "", mine), (text, mine)
