"""Queries on scores, views and alignment."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from turnwise.functions.numbers import rounded
from turnwise.operators import baselines as B, calls as C, rendering as R, scores as X, segments as S, words as W
from turnwise.plans.people import KIND_SQL
from turnwise.plans.segments import TURNS_SQL, _turns
from turnwise.plans.signals import FRAMES_SQL, _frames
from turnwise.plans.statistics import KEYS, REFERENCE_SQL
from turnwise.registry import dround, query
from turnwise.sources.tables import WORDS_SQL, conversations, read, segments, series, words

SCORE_SQL = f"""{TURNS_SQL}, sc AS (SELECT call_id, turn_idx, seg_idx, end_s - start_s AS seconds, CASE WHEN event_id % 3 > 0 THEN (event_id % 100) / 100.0::DOUBLE END AS score, event_id % 7 = 0 AND event_id % 3 > 0 AS measured FROM st)"""


@query(f"""WITH {SCORE_SQL}, g AS (SELECT call_id, turn_idx, sum(seconds) AS s, bool_or(measured) AS m, arg_min(score, seg_idx) FILTER (measured) AS f,
    sum(seconds * score) FILTER (seconds >= 1.0 AND score IS NOT NULL) / sum(seconds) FILTER (seconds >= 1.0 AND score IS NOT NULL) AS mean FROM sc GROUP BY ALL)
    SELECT call_id, turn_idx, CASE WHEN s >= 4.0 THEN {dround("(CAST(printf('%.9f', CAST(CASE WHEN m THEN f ELSE mean END AS DOUBLE)) AS DOUBLE) + 0.0)", 3)} END AS score FROM g""")
def turn_emotion(spark, sf_dir):
    rows = S.with_turns(segments(spark, sf_dir), 120.0)
    score = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 100) / 100.0)
    scored = rows.select("call_id", "turn_idx", "seg_idx", (F.col("end_s") - F.col("start_s")).alias("seconds"), score.alias("score"), ((F.col("event_id") % 7 == 0) & (F.col("event_id") % 3 > 0)).alias("measured"))
    return X.turn_scores(scored)


@query(f"""WITH {KIND_SQL} SELECT speaker, count(*) AS words, (CAST(printf('%.2f', CAST(100 * count(*) FILTER (kind = 'filler') / count(*) AS DOUBLE)) AS DOUBLE) + 0.0) AS fillers, (CAST(printf('%.2f', CAST(100 * count(*) FILTER (kind = 'cutoff') / count(*) AS DOUBLE)) AS DOUBLE) + 0.0) AS cutoffs,
    (CAST(printf('%.1f', CAST(count(*) / (CAST(sum(CAST(end_s - start_s AS DECIMAL(18, 3))) AS DOUBLE) / 60) AS DOUBLE)) AS DOUBLE) + 0.0) AS articulation_wpm FROM kw GROUP BY 1""")
def delivery_features(spark, sf_dir):
    return X.delivery(words(spark, sf_dir).withColumn("kind", W.word_class(F.col("word"))), ["speaker"])


@query(f"""WITH {TURNS_SQL} SELECT call_id, count(*) FILTER (start_s >= 3599 AND end_s <= 7201) AS covered, count(*) AS turns, count(*) FILTER (start_s >= 3599 AND end_s <= 7201) = count(*) AS complete FROM turns GROUP BY 1""")
def coverage(spark, sf_dir):
    found = _turns(spark, sf_dir)
    tracks = found.select("call_id").distinct().withColumn("begins", F.lit(3600.0)).withColumn("ends", F.lit(7200.0))
    return X.coverage(found, tracks)


@query(f"""WITH {FRAMES_SQL}, wd AS (SELECT DISTINCT track, frame // 10 AS word, frame // 10 * 10 AS f, frame // 10 * 10 + 9 AS l FROM fr),
    g AS (SELECT fr.track, word, count(*) AS n, avg(db) AS m, avg(db) FILTER (3 * (frame - f) // 10 = 0) AS a, avg(db) FILTER (3 * (frame - f) // 10 = 1) AS b FROM fr JOIN wd ON fr.track = wd.track AND frame BETWEEN f AND l GROUP BY ALL)
    SELECT track, count(*) AS words, (CAST(printf('%.2f', CAST(median(a - m) AS DOUBLE)) AS DOUBLE) + 0.0) AS onset_db, (CAST(printf('%.2f', CAST(median(b - m) AS DOUBLE)) AS DOUBLE) + 0.0) AS mid_db FROM g WHERE n >= 9 GROUP BY 1 HAVING count(*) >= 5""")
def word_intensity(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    word = F.floor(F.col("frame") / 10)
    spans = frames.select("track", word.alias("word"), (word * 10).alias("first"), (word * 10 + 9).alias("last")).distinct()
    return X.word_intensity(frames, spans)


@query("""WITH v AS (SELECT user_id AS entity, event_type AS feature, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
    u AS (SELECT entity, feature, median(value) AS usual FROM v WHERE k > 1 GROUP BY ALL)
    SELECT entity, feature, CASE WHEN value <> usual THEN CASE WHEN feature = 'error' THEN value < usual ELSE value > usual END END AS steadier FROM v JOIN u USING (entity, feature) WHERE k = 1""")
def steadier(spark, sf_dir):
    rows = series(spark, sf_dir).select(F.col("series").alias("entity"), F.col("event_type").alias("feature"), "value", F.row_number().over(Window.partitionBy("series", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))).alias("k"))
    usual = rows.where("k > 1").groupBy("entity", "feature").agg(F.median("value").alias("usual"))
    return X.steadier(rows.where("k = 1"), usual, ["error"]).select("entity", "feature", "steadier")


@query("SELECT n_name AS model FROM nation WHERE coalesce(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 2 = 0 END, true)")
def models_enabled(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_name").alias("model"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") % 2 == 0).alias("enabled"))
    return X.enabled_models(rows).select("model")


@query(f"""WITH {WORDS_SQL}, b AS (SELECT *, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS o, regexp_replace(lower(lag(word) OVER w), '[^a-z0-9'']', '', 'g') AS p, lag(word) OVER w AS pw FROM words WINDOW w AS (PARTITION BY call_id, turn_idx ORDER BY word_idx))
    SELECT call_id, turn_idx, count(*) FILTER (coalesce((o <> '' AND o = p) OR (ends_with(pw, '-') AND p <> '' AND starts_with(o, p)), false)) AS repeats FROM b GROUP BY ALL""")
def is_repetition(spark, sf_dir):
    return X.repetitions(words(spark, sf_dir)).groupBy("call_id", "turn_idx").agg(F.count_if("repeats").alias("repeats"))


@query(f"""WITH {REFERENCE_SQL}, z AS (SELECT ev.user_id AS series, ev.event_id, ev.event_type, r.n, CASE WHEN r.n >= 12 THEN {dround("((ev.value - r.median) / nullif(r.scale, 0))", 2)} END AS z FROM events ev JOIN ref r ON ev.user_id = r.series)
    SELECT series, string_agg(event_type || ' (z ' || CASE WHEN z >= 0 THEN '+' ELSE '-' END || printf('%.1f', abs(z)) || ', n ' || n || ')', '; ' ORDER BY event_id) AS line FROM z WHERE abs(z) >= 2.5 GROUP BY 1""")
def moment_lines(spark, sf_dir):
    rows = series(spark, sf_dir)
    departed = B.departures(rows, B.references(rows, KEYS), KEYS).where(F.abs("z") >= 2.5)
    return R.moment_lines(departed, KEYS, note="event_type", order="event_id")


@query(f"""WITH {TURNS_SQL}, g AS (SELECT *, start_s - lag(end_s) OVER (PARTITION BY call_id ORDER BY turn_idx) AS gap FROM turns)
    SELECT call_id, turn_idx, CASE WHEN gap >= 2.0 THEN '[silence ' || CAST(floor(gap) AS BIGINT) || 's]' || chr(10) ELSE '' END || '**' || printf('T%03d', turn_idx + 1) || ' ' || printf('%02d:%02d', CAST(floor(floor(start_s) / 60) AS BIGINT), CAST(floor(start_s) AS BIGINT) % 60) || ' ' || speaker || '**' AS line FROM g""")
def render_md_lines(spark, sf_dir):
    return R.view_lines(_turns(spark, sf_dir))


@query(f"""WITH {TURNS_SQL}, t AS (SELECT *, CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) OVER (PARTITION BY call_id) AS DOUBLE) AS total FROM turns),
    f AS (SELECT call_id, speaker, count(*) AS n, (CAST(printf('%.3f', CAST(CAST(CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE) / any_value(total) AS DOUBLE)) AS DOUBLE) + 0.0) AS share FROM t GROUP BY ALL)
    SELECT call_id, speaker, '| ' || speaker || ' | ' || CAST(floor(share * 100 + 0.5) AS BIGINT) || '% | ' || n || ' |' AS line FROM f""")
def participants(spark, sf_dir):
    return R.participants(C.speaker_baselines(_turns(spark, sf_dir)))


@query("""WITH n AS (SELECT DISTINCT conv_id AS call_id, role AS speaker, CASE WHEN conv_id % 2 = 0 THEN upper(role) END AS name FROM conversations)
    SELECT call_id, coalesce(nullif(string_agg(speaker || ': ' || name, ', ' ORDER BY speaker) FILTER (name IS NOT NULL), ''), 'none') AS block FROM n GROUP BY 1""")
def context_block(spark, sf_dir):
    names = conversations(spark, sf_dir).select("call_id", "speaker", F.when(F.col("call_id") % 2 == 0, F.upper("speaker")).alias("name")).distinct()
    return R.name_block(names)


@query("SELECT event_id, (CAST(printf('%.1f', CAST(least(greatest(value / 120.0, 0), 1) * 1000 AS DOUBLE)) AS DOUBLE) + 0.0) AS x, CASE WHEN value < 5 THEN 'pin' WHEN value < 60 THEN 'tick' ELSE 'silence' END AS hit FROM events")
def time_to_x(spark, sf_dir):
    x = rounded(F.least(F.greatest(F.col("value") / 120.0, F.lit(0.0)), F.lit(1.0)) * 1000, 1)
    hit = F.when(F.col("value") < 5, "pin").when(F.col("value") < 60, "tick").otherwise("silence")
    return read(spark, sf_dir, "events").select("event_id", x.alias("x"), hit.alias("hit"))
