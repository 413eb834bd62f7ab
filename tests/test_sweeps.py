"""Lookups in time against all pairs."""

import random
from collections import defaultdict

from pyspark.sql import Window, functions as F

from turnwise.operators import baselines as B, scores as X, segments as S


def test_lookups_equal_all_pairs(spark):
    r = random.Random(7)
    spans, points, clips, asked, events = [], [], [], [], []
    for c in ("a", "b", "no spans"):
        for k in range(60):
            t = r.randrange(200) / 2
            if c != "no spans":
                spans.append((c, k, r.choice("ABC"), t, t + r.choice([0.0, 0.5, 3.0, 20.0])))
                clips.append((c, r.randrange(500), t, t + r.choice([5.0, 30.0])))
                events.append((c, t, t + r.choice([0.5, 1.0])))
            points.append((c, k, r.randrange(-20, 260) / 2))
            asked.append((c, k, t, t + r.choice([0.0, 1.0, 8.0])))
    frame = spark.createDataFrame(spans, "call_id string, seg_idx long, speaker string, start_s double, end_s double").repartition(3)
    got = {(g.call_id, g.point): (g.speaker, g.distance) for g in S.nearest_label(spark.createDataFrame(points, "call_id string, point long, at_s double"), frame).collect()}
    want = {}
    for c, k, t in points:
        near = sorted((max(a - t, t - b, 0.0), a, b, who) for d, _, who, a, b in spans if d == c)
        if near:
            want[c, k] = (near[0][0], {x[3] for x in near if x[0] == near[0][0]}, near[0][3])
    assert set(got) == set(want)
    for key, (distance, _, who) in want.items():
        assert got[key][1] == distance and (got[key][0] == who or distance > 0 and got[key][0] in want[key][1]), key

    covered = {(g.call_id, g.span): g.clip for g in S.first_covering(spark.createDataFrame(asked, "call_id string, span long, start_s double, end_s double"), spark.createDataFrame(clips, "call_id string, clip long, clip_start double, clip_end double")).collect()}
    inside = defaultdict(list)
    for c, k, a, b in asked:
        for d, n, x, y in clips:
            if c == d and x <= a and b <= y:
                inside[c, k].append(n)
    assert covered == {k: min(v) for k, v in inside.items()}

    left = {(g.call_id, g.span) for g in S.untouched(spark.createDataFrame(asked, "call_id string, span long, start_s double, end_s double"), spark.createDataFrame(events, "call_id string, start_s double, end_s double")).collect()}
    assert left == {(c, k) for c, k, a, b in asked if not any(c == d and x < b and y > a for d, x, y in events)}


def test_word_intensity_across_bins(spark):
    frames = spark.createDataFrame([("t", k, float(k % 7)) for k in range(200)], "track string, frame long, db double")
    words = spark.createDataFrame([("t", w, 25 * w + 3, 25 * w + 20) for w in range(7)], "track string, word long, first long, last long")
    assert X.word_intensity(frames, words, bin_frames=8).collect() == X.word_intensity(frames, words, bin_frames=10**6).collect() != []


def test_first_covering_over_union_of_shuffled_tables(spark):
    rows = spark.range(40_000).selectExpr("cast(id % 30 as string) as call_id", "id div 30 as n", "cast(id div 30 as double) as start_s")
    numbered = rows.withColumn("span", F.row_number().over(Window.partitionBy("call_id").orderBy("start_s")) - 1)
    spans = numbered.withColumn("end_s", F.col("start_s") + 1)
    turns = numbered.where("n % 10 = 0").withColumn("end_s", F.col("start_s") + 2)
    clips = S.clip_windows(turns, 1.0, F.lit(1e6))
    # partitions of both sides are merged, each by its own sizes
    sizes = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        found = S.first_covering(spans, clips).count()
        want = spans.join(clips, "call_id").where("clip_start <= start_s and end_s <= clip_end").select("call_id", "span").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == want > 0


def test_word_intensity_adds_frames_in_one_order(spark):
    values = [0.1, 1e16, -1e16, 0.2, 0.3, 3.0, 0.7, 1.1, 2.3, 0.9]
    rows = [("t", 10 * w + k, v) for w in range(5) for k, v in enumerate(values)]
    words = spark.createDataFrame([("t", w, 10 * w, 10 * w + 9) for w in range(5)], "track string, word long, first long, last long")
    total = 0.0
    for v in reversed(values):
        total += v
    mean, onset = total / 10, (((0.2 - 1e16) + 1e16) + 0.1) / 4
    got = {tuple(X.word_intensity(spark.createDataFrame(r, "track string, frame long, db double").repartition(n), words).collect()[0]) for r in (rows, rows[::-1]) for n in (1, 3)}
    assert len(got) == 1 and got.pop()[2] == float(f"{onset - mean:.2f}")


def test_percentile_of_history_adds_shares_in_any_order(spark):
    # shares whose sum in floats is another in other orders: the mean lies at a half
    wins = [("a", 0, 11), ("b", 1, 8), ("c", 5, 12), ("d", 1, 12), ("e", 0, 13)]
    for order in (wins, wins[::-1], wins[2:] + wins[:2]):
        current = spark.createDataFrame([(1, f, 1.0) for f, _, _ in order], "entity long, feature string, value double").coalesce(1)
        history = spark.createDataFrame([(1, f, 0.0 if k < w else 2.0) for f, w, n in order for k in range(n)], "entity long, feature string, value double").coalesce(1)
        assert [tuple(r) for r in B.percentile_of_history(current, history, []).collect()] == [(1, 12, 5)]
