"""Queries that take event values, and components of vectors, as frames."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from turnwise.functions.numbers import rounded
from turnwise.functions.text import semitones as to_semitones
from turnwise.operators import acoustics as A
from turnwise.operators.pitch import tracked
from turnwise.registry import query
from turnwise.sources.tables import read


def _frames(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "event_id", (F.col("value") + 80).alias("f0"), (F.col("value") > 5).alias("voiced"), (F.col("value") / 2).alias("db"))


FRAMES_SQL = "fr AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id, value + 80 AS f0, value > 5 AS voiced, value / 2 AS db FROM events)"


@query(f"WITH {FRAMES_SQL} SELECT event_id, coalesce(quantile_cont(CASE WHEN voiced THEN f0 END, 0.5) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), f0) AS smooth FROM fr")
def despike(spark, sf_dir):
    return A.despiked(_frames(spark, sf_dir)).select("event_id", "smooth")


@query(f"WITH {FRAMES_SQL} SELECT event_id, CASE WHEN count(*) OVER w = 4 THEN (CAST(printf('%.4f', CAST(sqrt(sum(db * db) OVER w / 4) AS DOUBLE)) AS DOUBLE) + 0.0) END AS rms FROM fr WINDOW w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)")
def frame_rms(spark, sf_dir):
    return A.frame_energy(_frames(spark, sf_dir), 4, "db").select("event_id", rounded("rms", 4).alias("rms"))


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT *, db > max(db) OVER (PARTITION BY track) - 45.0 AS a FROM fr), v AS (SELECT *, voiced AND a AS v FROM p),
    g AS (SELECT track, count(*) FILTER (v) AS n, count(*) AS k, median(f0) FILTER (v) AS m, quantile_cont(f0, 0.1) FILTER (v) AS lo, quantile_cont(f0, 0.9) FILTER (v) AS hi, stddev_pop(db) FILTER (a) AS sd FROM v GROUP BY 1)
    SELECT track, (CAST(printf('%.1f', CAST(m AS DOUBLE)) AS DOUBLE) + 0.0) AS f0_median, (CAST(printf('%.2f', CAST(12 * log2(hi / lo) AS DOUBLE)) AS DOUBLE) + 0.0) AS range_semitones, (CAST(printf('%.2f', CAST(sd AS DOUBLE)) AS DOUBLE) + 0.0) AS loudness_sd, (CAST(printf('%.3f', CAST(n / k AS DOUBLE)) AS DOUBLE) + 0.0) AS voiced_share FROM g WHERE n >= 12""")
def turn_prosody(spark, sf_dir):
    return A.pitch_summary(_frames(spark, sf_dir))


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT *, frame >= max(frame) FILTER (voiced) OVER (PARTITION BY track) - 20 AS late FROM fr),
    g AS (SELECT track, count(*) FILTER (late) AS t, count(*) FILTER (NOT late) AS b, median(f0) FILTER (late) AS mt, median(f0) FILTER (NOT late) AS mb FROM l WHERE voiced GROUP BY 1)
    SELECT track, CASE WHEN t >= 12 AND b >= 12 THEN (CAST(printf('%.2f', CAST(12 * log2(mt / mb) AS DOUBLE)) AS DOUBLE) + 0.0) END AS terminal_rise FROM g""")
def terminal_rise(spark, sf_dir):
    return A.terminal_rise(_frames(spark, sf_dir), tail=20)


@query("SELECT event_id, CASE WHEN value > 0 THEN (CAST(printf('%.3f', CAST(12 * log2(value / 100.0) AS DOUBLE)) AS DOUBLE) + 0.0) END AS semitones FROM events")
def semitones(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", rounded(to_semitones(F.col("value"), F.lit(100.0)), 3).alias("semitones"))


@query("""WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS component FROM embeddings)
    SELECT label, component, (CAST(printf('%.4f', CAST(avg(CAST(v AS DOUBLE)) AS DOUBLE)) AS DOUBLE) + 0.0) AS mean, (CAST(printf('%.4f', CAST(stddev_pop(CAST(v AS DOUBLE)) AS DOUBLE)) AS DOUBLE) + 0.0) AS deviation FROM x GROUP BY ALL""")
def pooled_stats(spark, sf_dir):
    return A.pooled(read(spark, sf_dir, "embeddings"), "label", "embedding")


WEIGHTS = [[math.sin((k + 1) * (i + 1)) for i in range(64)] for k in range(3)]
_dot = lambda k: " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * {WEIGHTS[k][i]!r}::DOUBLE" for i in range(64))


@query(f"""WITH z AS (SELECT vec_id, {_dot(0)} AS a, {_dot(1)} AS b, {_dot(2)} AS c FROM embeddings), e AS (SELECT vec_id, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b, exp(c - greatest(a, b, c)) AS c FROM z)
    SELECT vec_id, (CAST(printf('%.4f', CAST(a / (a + b + c) AS DOUBLE)) AS DOUBLE) + 0.0) AS p0, (CAST(printf('%.4f', CAST(b / (a + b + c) AS DOUBLE)) AS DOUBLE) + 0.0) AS p1, (CAST(printf('%.4f', CAST(a / (a + b + c) - c / (a + b + c) AS DOUBLE)) AS DOUBLE) + 0.0) AS certainty FROM e""")
def softmax_score(spark, sf_dir):
    scored = read(spark, sf_dir, "embeddings").withColumn("p", A.linear_scores(F.col("embedding"), WEIGHTS, [0.0, 0.0, 0.0]))
    return scored.select("vec_id", rounded(F.col("p")[0], 4).alias("p0"), rounded(F.col("p")[1], 4).alias("p1"), rounded(F.col("p")[0] - F.col("p")[2], 4).alias("certainty"))


@query()
def pitch_track(spark, sf_dir):
    samples = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track"), F.posexplode("embedding").alias("i", "x"))
    return tracked(samples.withColumn("i", F.col("i").cast("long")), 600)
