"""Hand rows whose results follow from the definitions."""

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.functions.numbers import exclusive_quartile, quartile_range, rounded
from turnwise.operators import baselines as B, checking as K, evaluating as E, logs as L, segments as S, verifying as V, words as W


def segs(spark, rows):
    return spark.createDataFrame([("c", i, who, float(a), float(b)) for i, (who, a, b) in enumerate(rows)], "call_id string, seg_idx long, speaker string, start_s double, end_s double")


def test_turns_end_by_gap_and_speaker(spark):
    found = S.build_turns(segs(spark, [("A", 0, 1), ("A", 3, 4), ("A", 6.01, 7), ("B", 7, 8), ("A", 8, 9)])).orderBy("turn_idx").collect()
    assert [(r.speaker, r.start_s, r.end_s) for r in found] == [("A", 0, 4), ("A", 6.01, 7), ("B", 7, 8), ("A", 8, 9)]


def test_turns_take_the_last_end_and_utterances_the_furthest(spark):
    rows = segs(spark, [("A", 0, 10), ("A", 2, 3), ("A", 5.5, 6)])
    assert S.build_turns(rows).count() == 2
    assert [(r.start_s, r.end_s) for r in S.utterances(rows).collect()] == [(0, 10)]


def test_overlaps_by_hand(spark):
    found = S.overlap_events(segs(spark, [("A", 0, 10), ("B", 2, 3), ("B", 9, 12), ("C", 10, 11)])).collect()
    assert sorted((r.by, r.over, r.kind) for r in found) == [("B", "A", "backchannel"), ("B", "A", "floor_taking"), ("C", "B", "backchannel")]


def test_overlap_across_time_bins(spark):
    rows = segs(spark, [("A", 0, 2000), ("B", 1300, 1301)])
    assert [r.seconds for r in S.overlap_events(rows).collect()] == [1.0]


@pytest.mark.parametrize("values, quartiles", [([1, 2, 4, 9], (1.25, 3.0, 7.75)), ([3, 5], (2.5, 4.0, 5.5))])
def test_exclusive_quartiles(spark, values, quartiles):
    a = F.array(*map(F.lit, map(float, values)))
    assert tuple(spark.range(1).select(*(exclusive_quartile(a, i).alias(f"q{i}") for i in (1, 2, 3))).first()) == quartiles


def test_spread_falls_back_on_quartiles(spark):
    a = F.array(*map(F.lit, (0.0, 0.0, 0.0, 0.0, 1.0, 5.0)))
    assert spark.range(1).select(quartile_range(a).alias("s")).first().s == pytest.approx(2.0 / 1.349)
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate((0.0, 0.0, 0.0, 0.0, 1.0, 5.0, 9.0))], "series int, k int, value double")
    s = B.references(rows.where("k < 6"), ["series"]).first()
    assert (s.median, s.mad, s.n) == (0.0, 0.0, 6) and s.scale == pytest.approx(2.0 / 1.349, abs=1e-4)
    late = B.trailing(rows, ["series"], ["k"], least=6).orderBy("k").collect()
    assert [r.t_scale for r in late] == [None] * 6 + [s.scale] and late[6].t_n == 6


def test_doubles_are_rounded_by_their_exact_value(spark):
    values = [1.025, 0.125, 2.675, 1.115, -0.001, 1e16, 12345.675, float("inf")]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(rounded("v", 2).alias("x")).collect()]
    assert got == [round(v, 2) for v in values[:-1]] + [float("inf")]


def test_replies_are_checked_by_channel(spark):
    """A timing claim needs a long gap, an overlap claim an overlap, a disfluency claim two stumbles in its quote."""
    words = "array<struct<norm:string,kind:string>>"
    turns = spark.createDataFrame(
        [("c", 0, [("um", "filler"), ("uh", "filler"), ("yes", "content")], 2.5, 0.8, [0.5], True), ("c", 1, [("yes", "content"), ("um", "filler")], 2.5, 0.9, [], False)],
        f"call_id string, turn_idx int, words {words}, reply_latency double, median_latency double, pauses array<double>, overlapped boolean",
    )
    said = [("timing", 0, "", ""), ("timing", 1, "", ""), ("interaction", 0, "", "they talked over it"), ("interaction", 1, "", "an interruption"), ("interaction", 1, "", "a question"), ("disfluency", 0, "um uh", ""), ("disfluency", 1, "yes um", ""), ("lexical", 1, "", ""), ("prosody", 0, "", ""), ("prosody", 1, "", ""), (None, 0, "", "")]
    evidence = spark.createDataFrame([("c", 1, i, t, ch, q, q != "", d, ["M1"]) for i, (ch, t, q, d) in enumerate(said)], "call_id string, claim int, item int, turn_idx int, channel string, quote string, matched boolean, description string, moments array<string>")
    moments = spark.createDataFrame([("c", "M1", 0, ["arousal", None])], "call_id string, moment_id string, turn_idx int, features array<string>")
    got = [r.problem for r in K.channel_problems(evidence, turns, moments).orderBy("item").collect()]
    assert got == [None, "timing_unsupported", None, "interaction_unsupported", None, None, "disfluency_unsupported", "lexical_needs_quote", None, "prosody_unsupported", "unknown_channel"]


def test_ids_and_times(spark):
    row = spark.range(1).select(*(T.turn_id(F.lit(i)).alias(f"t{i}") for i in (0, 56, 1205)), T.minutes(F.lit(3725.9)).alias("m"), T.minutes(F.lit(-3.0)).alias("n"), T.timestamp(F.lit(59.9999)).alias("s")).first()
    assert tuple(row) == ("T001", "T057", "T1206", "62:05", "00:00", "00:00:59,999")


def test_sentiment_turns_after_a_negator(spark):
    s, none = T.sentiment(F.lit("Not good")), T.sentiment(F.lit(""))
    assert tuple(spark.range(1).select(s.alias("s"), none.alias("n")).first()) == (-0.25, 0.0)  # -0.4 - 0.6 = -1, over the root of 16


@pytest.mark.parametrize("text, wanted", [("a, b,,a\n c ", ["a", "b", "c"]), ("", []), (None, None)])
def test_terms(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(T.terms(F.col("t")).alias("x")).first().x == wanted


def test_loops_keep_four(spark):
    rows = spark.createDataFrame([("c", 0, i, "um", "filler") for i in range(6)] + [("c", 0, 6, "yes", None)], "call_id string, turn_idx long, word_idx long, word string, kind string")
    assert W.without_loops(rows).count() == 5


def test_caps_keep_three_of_a_speaker_and_eight_of_a_call(spark):
    rows = spark.createDataFrame([("c", s, 10 * k + j, 1) for k, s in enumerate("abcd") for j in range(5)], "call_id string, speaker string, claim long, rank int")
    kept = V.ranked_caps(rows, [F.desc("rank"), F.col("claim")]).where(~F.col("capped")).orderBy("claim").collect()
    assert [r.claim for r in kept] == [0, 1, 2, 10, 11, 12, 20, 21]


def test_latest_row_wins_and_tombstones_delete(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "x", False), ("b", 2, None, True)], "k string, seq int, v string, gone boolean")
    assert [(r.k, r.v) for r in L.latest(log, ["k"], "seq", F.col("gone")).collect()] == [("a", "y")]


def test_greedy_matching_uses_each_reading_once():
    r = {"speaker": "a", "layer": "x", "turns": ["T1", "T2"]}
    assert E.matched_readings([r, r], [r]) == 1
    assert E.matched_readings([r], [{**r, "turns": ["T9"]}]) == 0


def test_auc_of_ties_is_a_half(spark):
    assert E.auc(spark.createDataFrame([(1, 1.0), (0, 1.0)], "y int, x double"), "y", "x").first().auc == 0.5


def test_split_cuts_only_between_sustained_speakers(spark):
    rows = [("c", 0, i, "w", float(i), i + 0.5, who, "A") for i, who in enumerate("AAAABBBBAB")]
    df = spark.createDataFrame(rows, "call_id string, seg_idx long, word_idx long, word string, start_s double, end_s double, word_speaker string, speaker string")
    pieces = {(r.piece, r.piece_speaker): r.n for r in W.split_by_speaker(df).groupBy("piece", "piece_speaker").agg(F.count("*").alias("n")).collect()}
    assert pieces == {(0, "A"): 4, (1, "B"): 6}


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "call_id string, seg_idx long, speaker string, start_s double, end_s double")
    assert S.build_turns(rows).count() == 0 and S.overlap_events(S.utterances(rows)).count() == 0 and S.call_summary(S.build_turns(rows)).count() == 0


def test_related_pairs_are_made_once_without_a_shuffle_of_pairs(spark):
    rows = [(k % 23, "pq"[k % 2], k * k % 11) for k in range(300)] + [(1, None, 3), (2, "p", None), (None, "p", 3)]
    frame = spark.createDataFrame(rows, "item long, p string, b long")
    of = {}
    for item, p, b in rows:
        if None not in (item, p, b):
            of.setdefault(item, set()).add((p, b))
    want = sorted((x, y) for x in of for y in of if x < y and of[x] & of[y])
    many = [len([r for r in rows if r[0] == k]) for k in range(23)]
    for held in (64, max(many) - 1, 1):
        assert sorted(tuple(r) for r in L.related(frame, "item", ["p", "b"], held=held).collect()) == want, held
    plan = L.related(frame, "item", ["p", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")]


def test_related_pairs_compare_bits_first(spark, monkeypatch):
    """Bits tell most items apart without their rows; where bits are common by chance (one long for many rows), rows decide."""
    rows = [(k % 90, "pqr"[k % 3], k * (k // 90 + 3) % 97) for k in range(1800)]
    frame = spark.createDataFrame(rows, "item long, p string, b long")
    of = {}
    for item, p, b in rows:
        of.setdefault(item, set()).add((p, b))
    want = sorted((x, y) for x in of for y in of if x < y and of[x] & of[y])
    for longs in (1, 4):
        monkeypatch.setattr(L, "BITS", longs)
        found = L.related(frame, "item", ["p", "b"])
        assert sorted(map(tuple, found.collect())) == want and len(want) > 1000
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.index(" & ") < plan.index("arrays_overlap") and plan.count(" & ") >= longs


def test_words_of_more_messages_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    from turnwise.sources import tables

    text = "some words. and more"
    spark.createDataFrame([(c, t, "user", text) for c in range(40) for t in range(5)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(tables, "MESSAGES", 10, raising=False)
    rows = tables.words(spark, str(tmp_path))
    assert rows.count() == 800 and rows.rdd.getNumPartitions() == 21
    assert rows.select("call_id", F.spark_partition_id().alias("p")).distinct().count() == 40
