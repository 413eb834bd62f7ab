"""Queries on speakers and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import calls as C, segments as S
from turnwise.plans.segments import OVERLAPS_SQL, TURNS_SQL, _overlaps, _turns
from turnwise.registry import dround, query
from turnwise.sources import files
from turnwise.sources.tables import SEGMENTS_SQL, conversations, read, segments

SPEECH = "CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2))"
LATE_SQL = f"""{TURNS_SQL}, lt AS (SELECT *, CASE WHEN speaker <> lag(speaker) OVER o THEN {dround("(start_s - lag(end_s) OVER o)", 2)} END AS reply_latency,
    CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) OVER (PARTITION BY call_id) AS DOUBLE) AS total FROM turns WINDOW o AS (PARTITION BY call_id ORDER BY turn_idx))"""


@query(f"""WITH {LATE_SQL} SELECT call_id, speaker, count(*) AS turns, count(*) FILTER (speech_seconds >= 4.0) AS scored_turns, CAST((CAST(printf('%.1f', CAST({SPEECH} AS DOUBLE)) AS DOUBLE) + 0.0) AS DOUBLE) AS speech_seconds,
    (CAST(printf('%.3f', CAST(CAST({SPEECH} AS DOUBLE) / any_value(total) AS DOUBLE)) AS DOUBLE) + 0.0) AS talk_share, median(speech_seconds) AS median_turn_seconds, median(reply_latency) AS median_reply_latency,
    CASE WHEN count(*) FILTER (speech_seconds >= 4.0) >= 12 THEN count(*) FILTER (speech_seconds >= 4.0) ELSE 0 END AS baseline_turns FROM lt GROUP BY ALL""")
def speaker_baselines(spark, sf_dir):
    return C.speaker_baselines(_turns(spark, sf_dir))


@query(f"""WITH {TURNS_SQL}, {OVERLAPS_SQL.split(SEGMENTS_SQL + ",")[1]}, s AS (SELECT call_id, speaker, count(*) AS turns, (CAST(printf('%.1f', CAST(CAST({SPEECH} AS DOUBLE) / count(*) AS DOUBLE)) AS DOUBLE) + 0.0) AS average_turn FROM turns GROUP BY ALL),
    b AS (SELECT call_id, "by" AS speaker, count(*) FILTER (kind = 'floor_taking') AS floor_takes, count(*) FILTER (kind = 'backchannel') AS backchannels FROM ov GROUP BY ALL)
    SELECT call_id, speaker, turns, average_turn, coalesce(floor_takes, 0) AS floor_takes, coalesce(backchannels, 0) AS backchannels FROM s LEFT JOIN b USING (call_id, speaker)""")
def speaker_facts(spark, sf_dir):
    return C.speaker_facts(_turns(spark, sf_dir), _overlaps(spark, sf_dir))


@query(f"""WITH {TURNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY speech_seconds DESC, turn_idx) AS k, sum(speech_seconds) OVER (PARTITION BY call_id, speaker) AS total FROM turns),
    f AS (SELECT *, CASE WHEN end_s - start_s >= 4.0 THEN start_s + 1.0 ELSE start_s END AS a FROM k WHERE k = 1 AND total >= 5.0) SELECT call_id, speaker, turn_idx, a AS sample_start, least(a + 3.0, end_s) AS sample_end FROM f""")
def sample_ranges(spark, sf_dir):
    return C.sample_ranges(_turns(spark, sf_dir))


@query(f"""WITH {SEGMENTS_SQL} SELECT call_id, event_id FROM segs a WHERE speaker = 'click' AND NOT EXISTS (SELECT 1 FROM segs b WHERE b.speaker = 'view' AND b.call_id = a.call_id AND abs(a.start_s - b.start_s) <= 60.0)""")
def near_dedup(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumnRenamed("start_s", "at_s")
    return C.near_duplicates_dropped(rows.where("speaker = 'click'"), rows.where("speaker = 'view'"), 60.0).select("call_id", "event_id")


@query(f"""WITH {TURNS_SQL} SELECT call_id, turn_idx, CAST(floor(start_s * 1000) AS BIGINT) AS start_ms, CAST(floor(end_s * 1000) AS BIGINT) AS end_ms,
    coalesce({dround("(start_s - lag(end_s) OVER (PARTITION BY call_id ORDER BY turn_idx))", 2)}, 0.0) AS gap_before_s FROM turns""")
def view_index(spark, sf_dir):
    return C.view_index(_turns(spark, sf_dir)).select("call_id", "turn_idx", "start_ms", "end_ms", "gap_before_s")


@query(f"""WITH {TURNS_SQL}, b AS (SELECT call_id, turn_idx, CASE WHEN turn_idx % 50 = 7 THEN 'x' ELSE speaker END AS speaker, start_s + CASE WHEN turn_idx % 30 = 3 THEN 0.01 ELSE 0 END AS start_s FROM turns WHERE turn_idx % 40 <> 5),
    j AS (SELECT call_id, turn_idx, CASE WHEN b.speaker IS NULL OR a.speaker IS NULL THEN 'missing' WHEN a.speaker <> b.speaker THEN 'speaker' WHEN abs(a.start_s - b.start_s) > 0.001 THEN 'time' END AS problem FROM turns a FULL JOIN b USING (call_id, turn_idx))
    SELECT * FROM j WHERE problem IS NOT NULL""")
def view_consistency(spark, sf_dir):
    found = _turns(spark, sf_dir)
    other = found.where("turn_idx % 40 <> 5").select("call_id", "turn_idx", F.when(F.col("turn_idx") % 50 == 7, "x").otherwise(F.col("speaker")).alias("speaker"), (F.col("start_s") + F.when(F.col("turn_idx") % 30 == 3, 0.01).otherwise(0.0)).alias("start_s"))
    return C.inconsistent(found, other)


@query("SELECT event_id, CASE WHEN value >= 100 THEN 'large' WHEN value >= 30 THEN 'medium' WHEN value >= 5 THEN 'small' END AS tier FROM events")
def tier_lookup(spark, sf_dir):
    return C.tier_of(read(spark, sf_dir, "events"), "value", [("large", 100.0), ("medium", 30.0), ("small", 5.0)]).select("event_id", "tier")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (CAST(printf('%.4f', CAST((sum(l_quantity) OVER o - l_quantity) / sum(l_quantity) OVER g AS DOUBLE)) AS DOUBLE) + 0.0) AS begins, (CAST(printf('%.4f', CAST(sum(l_quantity) OVER o / sum(l_quantity) OVER g AS DOUBLE)) AS DOUBLE) + 0.0) AS ends FROM lineitem
    WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY l_orderkey)""")
def progress_fraction(spark, sf_dir):
    return C.progress(read(spark, sf_dir, "lineitem"), "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "begins", "ends")


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'meeting_type is not one of the known types' END, CASE WHEN o_orderkey % 5 = 0 THEN 'goal is empty' END,
    CASE WHEN o_custkey % 3 = 0 THEN 'consent is not yes, no or unknown' END], lambda x: x IS NOT NULL), '; ') AS problems FROM orders""")
def context_problems(spark, sf_dir):
    goal = F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("g")
    consent = F.when(F.col("o_custkey") % 3 == 0, F.lit(None)).otherwise("yes")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.context_problems(F.col("o_orderstatus"), goal, consent, ["F", "O"]), "; ").alias("problems"))


@query("""SELECT conv_id AS call_id, turn AS turn_idx, CASE WHEN conv_id % 2 = 0 AND role = 'user' THEN 'Ann' WHEN conv_id % 3 = 0 THEN 'Bo?' ELSE role END AS shown FROM conversations""")
def apply_names(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    labels = turns.select("call_id", "speaker").distinct()
    typed = labels.where("call_id % 2 = 0 and speaker = 'user'").withColumn("name", F.lit("Ann"))
    guessed = labels.where("call_id % 3 = 0").withColumn("name", F.lit("Bo"))
    return C.with_names(turns, typed, guessed).select("call_id", "turn_idx", "shown")


@query("""WITH l AS (SELECT DISTINCT conv_id AS call_id, role AS speaker FROM conversations) SELECT call_id, speaker, CASE WHEN call_id % 2 = 0 AND speaker = 'user' THEN 'Ann' ELSE 'Bo' END AS name FROM l WHERE (call_id % 2 = 0 AND speaker = 'user') OR call_id % 3 = 0""")
def merge_names(spark, sf_dir):
    labels = conversations(spark, sf_dir).select("call_id", "speaker").distinct()
    return C.merged_names(labels.where("call_id % 2 = 0 and speaker = 'user'").withColumn("name", F.lit("Ann")), labels.where("call_id % 3 = 0").withColumn("name", F.lit("Bo")))


@query(f"""WITH {TURNS_SQL}, sp AS (SELECT DISTINCT call_id, turn_idx // 40 AS topic, turn_idx // 40 * 40 AS a FROM turns), cv AS (SELECT DISTINCT call_id, topic, unnest(range(a, a + 61)) AS turn_idx FROM sp),
    r AS (SELECT call_id, topic, count(*) AS turns, (CAST(printf('%.2f', CAST(sum(segments) / count(*) AS DOUBLE)) AS DOUBLE) + 0.0) AS rate FROM cv JOIN turns USING (call_id, turn_idx) WHERE speech_seconds >= 4.0 GROUP BY ALL)
    SELECT *, count(*) OVER c >= 2 AND row_number() OVER (PARTITION BY call_id ORDER BY rate DESC, topic) = 1 AS most, count(*) OVER c >= 2 AND row_number() OVER (PARTITION BY call_id ORDER BY rate, topic) = 1 AS least FROM r WINDOW c AS (PARTITION BY call_id)""")
def topic_contrast(spark, sf_dir):
    found = _turns(spark, sf_dir)
    start = (F.floor(F.col("turn_idx") / 40) * 40).cast("long")
    spans = found.select("call_id", F.floor(F.col("turn_idx") / 40).alias("topic"), start.alias("first"), (start + 60).alias("last")).distinct()
    return C.topic_contrast(spans, found.where("speech_seconds >= 4.0").select("call_id", "turn_idx", F.col("segments").alias("observations")))


@query(f"WITH {SEGMENTS_SQL} SELECT call_id, max(end_s) AS media_seconds, count(DISTINCT speaker) AS speakers, count(*) AS segments FROM segs GROUP BY 1")
def call_meta(spark, sf_dir):
    return files.call_meta(segments(spark, sf_dir))


@query(f"WITH {TURNS_SQL} SELECT st.call_id, st.seg_idx, st.turn_idx, CASE WHEN t.speech_seconds >= 4.0 THEN t.speech_seconds END AS stamped FROM st JOIN turns t USING (call_id, turn_idx)")
def stamp_back(spark, sf_dir):
    rows = S.with_turns(segments(spark, sf_dir), 120.0)
    scores = _turns(spark, sf_dir).where("speech_seconds >= 4.0").select("call_id", "turn_idx", F.col("speech_seconds").alias("stamped"))
    return C.stamped_back(rows, scores).select("call_id", "seg_idx", "turn_idx", "stamped")
