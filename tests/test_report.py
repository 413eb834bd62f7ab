"""The report from segments to moments against plain Python, one turn after another."""

import random
import statistics
from collections import defaultdict


from turnwise.operators import report as P

NOTES = {"articulation": ("faster than usual", "slower than usual"), "arousal": ("more energy than usual", "less energy than usual"), "certainty": (None, "sounds less certain than usual"), "medial_fillers": ("more mid-sentence hesitation than usual", None)}


def reference(values):
    values = [v for v in values if v is not None]
    if len(values) < 2:
        return None
    m = statistics.median(values)
    scale = 1.4826 * statistics.median(abs(v - m) for v in values)
    if scale <= 0:
        q = statistics.quantiles(values, n=4)
        scale = max((q[2] - q[0]) / 1.349, 0.0)
    return round(m, 3), round(scale, 4), len(values)


def z(value, ref):
    return None if value is None or not ref or ref[2] < 12 or not ref[1] else round((value - ref[0]) / ref[1], 2)


def made_turns(seed=3, n=260):
    r = random.Random(seed)
    rows = []
    for call, media in (("long", 900.0), ("short", 899.9), ("none", None)):
        for k in range(n if call == "long" else 80):
            speaker = r.choice("AAB")
            value = lambda p: None if r.random() < p else float("nan") if r.random() < 0.02 else r.choice([0.0, 0.0, 1.0, round(r.gauss(0, 1), 2)])  # noqa: B023, E731
            rows.append((call, k, speaker, k * 10.0, r.choice([2.0, 4.0, 9.0]), media, f"text of {k} " * 9, r.randrange(4), *(value(0.1 + 0.05 * f) for f in range(len(P.FEATURES)))))
    return rows


COLUMNS = "call_id string, turn_idx long, speaker string, start_s double, speech_seconds double, media_seconds double, text string, medial long, " + ", ".join(f"{f} double" for f in P.FEATURES)


def test_trailing_references_and_moments_equal_a_walk(spark):
    rows = made_turns()
    frame = spark.createDataFrame(rows, COLUMNS).repartition(5)
    clean = [{**dict(zip(("call", "k", "speaker", "start", "speech", "media", "text", "medial"), r)), **{f: None if v is None or v != v else v for f, v in zip(P.FEATURES, r[8:])}} for r in rows]
    scored = [t for t in clean if t["speech"] >= 4]
    past, local = defaultdict(list), {}
    for t in scored:
        before = past[t["call"], t["speaker"]]
        if (t["media"] or 0) >= 900 and len(before) >= 12:
            local[t["call"], t["k"]] = {f: reference([b[f] for b in before[-30:]]) for f in P.FEATURES}
        before.append(t)
    got = defaultdict(dict)
    for g in P.trailing_features(frame).collect():
        got[g.call_id, g.turn_idx][g.feature] = (g.median, g.scale, g.n) if g.median is not None else None
    assert got == local and local and {c for c, _ in local} == {"long"}

    held = [("long", k, s) for k in range(0, 260, 7) for s in ([2.0, 3.0] if k % 2 else [1.0, 2.25])]
    want = {}
    for t in scored:
        mine = past[t["call"], t["speaker"]]
        refs = local.get((t["call"], t["k"])) or ({f: reference([b[f] for b in mine]) for f in P.FEATURES} if len(mine) >= 12 else {})
        evidence = []
        for f in ("articulation", "arousal", "f0_range", "loudness_sd", "terminal_rise", "certainty", "medial_fillers"):
            score = z(t[f], refs.get(f))
            if score is None or abs(score) < 1.5 or (f == "medial_fillers" and t["medial"] < 2) or (f == "certainty" and t[f] > -0.25):
                continue
            if f in NOTES and NOTES[f][score < 0] is None:
                continue
            evidence.append((f, score, None, refs[f][2]))
        words, voice = z(t["lexical"], refs.get("lexical")), z(t["arousal"], refs.get("arousal"))
        if words is not None and voice is not None and abs(words) >= 2 and abs(voice) >= 2 and (words > 0) != (voice > 0):
            evidence.append(("mismatch", words, voice, refs["lexical"][2]))
        long_ = [s for c, k, s in held if (c, k) == (t["call"], t["k"]) and s >= 2]
        pause = [f"{len(long_)} long pauses"] if len(long_) > 1 else [f"pauses for {long_[0]:.1f}s"] if long_ else []
        if evidence or pause:
            want[t["call"], t["k"]] = (evidence, pause, "trailing" if (t["call"], t["k"]) in local else "call", t["text"][:80])
    moments = P.turn_moments(frame, spark.createDataFrame(held, "call_id string, turn_idx long, seconds double")).collect()
    assert {(m.call_id, m.turn_idx): ([(e.feature, e.z, e.arousal_z, e.n) for e in m.evidence], m.observations[len(m.evidence) :], m.baseline, m.preview) for m in moments} == want
    assert all([e.note for e in m.evidence] == m.voice_observations == m.observations[: len(m.evidence)] and m.mismatch == any(e.feature == "mismatch" for e in m.evidence) for m in moments)
    kinds = {e.feature for m in moments for e in m.evidence}
    assert {"mismatch", "certainty", "medial_fillers"} <= kinds and {m.baseline for m in moments} == {"trailing", "call"}


def test_the_gate_is_at_900_seconds(spark):
    rows = [(c, k, "A", 0.0, 5.0, m, "t", 0, *([float(k)] * len(P.FEATURES))) for c, m in (("at", 900.0), ("below", 899.99)) for k in range(14)]
    got = P.trailing_features(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(g.call_id, g.turn_idx, g.n) for g in got} == {("at", 12, 12), ("at", 13, 13)}


def test_segments_to_report(spark):
    """Two speakers; a pause within a segment, one between segments, a filler amid words, scores of segments and of turns."""
    segs = [
        ("c", 0, "A", 0.0, 5.0, "We um need [laughter] it", 0.5, 0.1, False, None), ("c", 1, "A", 6.5, 8.0, "now.", 0.9, 0.3, False, -0.4), ("c", 2, "B", 9.0, 14.0, "It is great", 0.2, None, True, 0.1),
        ("c", 3, "A", 14.25, 15.0, "No", None, None, False, None), ("d", 0, "A", 0.0, 6.0, "plain words", None, None, False, None),
    ]
    words = [
        ("c", 0, 0, "We", 0.0, 0.5, None), ("c", 0, 1, "um", 0.6, 0.8, "filler"), ("c", 0, 2, "need", 2.8, 3.2, None), ("c", 0, 3, "[laughter]", 3.2, 3.4, "event"), ("c", 0, 4, "it", 4.5, 5.0, None), ("c", 1, 0, "now.", 6.5, 8.0, None),
        ("c", 2, 0, "It", 9.0, 9.5, None), ("c", 2, 1, "is", 9.5, 10.0, None), ("c", 2, 2, "great", 10.0, 12.5, None), ("c", 3, 0, "No", 14.25, 15.0, None), ("d", 0, 0, "plain", 0.0, 1.0, None), ("d", 0, 1, "words", None, None, None),
    ]
    out = P.analysed(
        spark.createDataFrame(segs, "call_id string, seg_idx long, speaker string, start_s double, end_s double, text string, arousal double, valence double, measured boolean, certainty double"),
        spark.createDataFrame(words, "call_id string, seg_idx long, word_idx int, word string, start_s double, end_s double, kind string"),
        spark.createDataFrame([("c", 1000.0)], "call_id string, media_seconds double"),
        spark.createDataFrame([("c", 0, 7.5), ("c", 2, 3.0)], "call_id string, turn_idx long, f0_range double"),
    )
    turns = {(t.call_id, t.turn_idx): t for t in out["turns"].collect()}
    a, b, short, other = turns["c", 0], turns["c", 1], turns["c", 2], turns["d", 0]
    assert (a.speech_seconds, a.start_s, a.end_s, a.reply_latency, a.text) == (6.5, 0.0, 8.0, None, "We um need [laughter] it now.")
    assert (b.reply_latency, short.reply_latency) == (1.0, 0.25)
    assert [(p.seconds, p.within_segment, p.after_word) for p in out["pauses"].orderBy("at").collect()] == [(2.0, True, "um"), (1.1, True, "[laughter]"), (1.5, False, "it")]
    assert (a.word_count, a.wpm, a.articulation_wpm) == (5, round(5 / (8 / 60), 1), round(5 / (3.4 / 60), 1))
    assert (a.arousal, a.valence, a.certainty) == (round((5 * 0.5 + 1.5 * 0.9) / 6.5, 3), round((0.5 + 0.45) / 6.5, 3), -0.4)
    assert (b.arousal, b.certainty, short.arousal, short.certainty) == (0.2, 0.1, None, None)
    assert (a.medial, a.medial_fillers, b.medial, other.medial, other.medial_fillers) == (1, 20.0, 0, None, None)
    assert (a.f0_range, short.f0_range, b.f0_range) == (7.5, None, None) and b.lexical > 0
    speakers = {(s.call_id, s.speaker): s for s in out["speakers"].collect()}
    s = speakers["c", "A"]
    assert (s.turns, s.scored_turns, s.speech_seconds, s.talk_share, s.median_reply_latency, s.baseline_turns) == (2, 1, 7.3, round(7.25 / 12.25, 3), 0.25, 0) or s.speech_seconds == 7.2
    moment = out["moments"].collect()
    assert [(m.call_id, m.turn_idx, m.observations, m.evidence, m.baseline) for m in moment] == [("c", 0, ["pauses for 2.0s"], [], "call")]


def test_empty_report(spark):
    none = spark.createDataFrame([], "call_id string, seg_idx long, speaker string, start_s double, end_s double, text string, arousal double, valence double, measured boolean, certainty double")
    words = spark.createDataFrame([], "call_id string, seg_idx long, word_idx int, word string, start_s double, end_s double, kind string")
    out = P.analysed(none, words, spark.createDataFrame([], "call_id string, media_seconds double"))
    assert all(df.count() == 0 for df in out.values())


def test_no_shuffle_by_turn_and_feature(spark):
    """A turn's features are judged in its row: they aren't dealt one by one."""
    frame = spark.createDataFrame(made_turns(n=20), COLUMNS)
    plan = P.turn_moments(frame, spark.createDataFrame([("long", 0, 2.5)], "call_id string, turn_idx long, seconds double"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and not any("turn_idx" in x and "feature" in x for x in plan.split("hashpartitioning(")[1:] for x in [x.split(")")[0]])
