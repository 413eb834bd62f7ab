"""Queries over the value series of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions.numbers import rounded
from turnwise.operators import baselines as B
from turnwise.registry import dround, query
from turnwise.sources.tables import read, series

KEYS, ORDER = ["series"], ["ts", "event_id"]


def quartile_sql(i: int, a: str = "a") -> str:
    j = f"greatest(1, least(len({a}) - 1, CAST(floor({i} * (len({a}) + 1) / 4) AS INT)))"
    return f"(({a}[{j}] * (4 - ({i} * (len({a}) + 1) - 4 * {j})) + {a}[{j} + 1] * ({i} * (len({a}) + 1) - 4 * {j})) / 4.0)"


def median_sql(a: str = "a") -> str:
    return f"(({a}[(len({a}) + 1) // 2] + {a}[(len({a}) + 2) // 2]) / 2)"


REFERENCE_SQL = f"""g AS (SELECT user_id AS series, list_sort(list(value)) AS a FROM events WHERE value IS NOT NULL GROUP BY 1),
    c AS (SELECT *, {median_sql()} AS m FROM g), d AS (SELECT *, list_sort(list_transform(a, lambda v: abs(v - m))) AS b FROM c),
    e AS (SELECT *, {median_sql("b")} AS dev, greatest(({quartile_sql(3)} - {quartile_sql(1)}) / 1.349, 0) AS iqr FROM d WHERE len(a) >= 2),
    ref AS (SELECT series, {dround("m", 3)} AS median, {dround("(CASE WHEN dev * 1.4826 > 0 THEN dev * 1.4826 ELSE iqr END)", 4)} AS scale, {dround("dev", 4)} AS mad, len(a) AS n FROM e)"""
TRAILING_SQL = f"""f AS (SELECT user_id AS series, ts, event_id, value, list_sort(list(value) OVER w) AS a, count(*) OVER w AS k FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
    fc AS (SELECT *, CASE WHEN k >= 12 THEN {median_sql()} END AS m FROM f), fd AS (SELECT *, list_sort(list_transform(a, lambda v: abs(v - m))) AS b FROM fc),
    tr AS (SELECT series, event_id, value, {dround("m", 3)} AS t_median, CASE WHEN k >= 12 THEN {dround(f"(CASE WHEN {median_sql('b')} * 1.4826 > 0 THEN {median_sql('b')} * 1.4826 ELSE greatest(({quartile_sql(3)} - {quartile_sql(1)}) / 1.349, 0) END)", 4)} END AS t_scale,
        CASE WHEN k >= 12 THEN len(a) END AS t_n FROM fd)"""


@query(f"WITH {REFERENCE_SQL} SELECT * FROM ref")
def spread_mad(spark, sf_dir):
    return B.references(series(spark, sf_dir), KEYS)


@query(f"WITH {REFERENCE_SQL} SELECT series, (CAST(printf('%.4f', CAST({quartile_sql(1)} AS DOUBLE)) AS DOUBLE) + 0.0) AS q1, (CAST(printf('%.4f', CAST({quartile_sql(3)} AS DOUBLE)) AS DOUBLE) + 0.0) AS q3, (CAST(printf('%.4f', CAST(iqr AS DOUBLE)) AS DOUBLE) + 0.0) AS iqr_scale FROM e")
def iqr_scale(spark, sf_dir):
    return B.quartile_scales(series(spark, sf_dir), KEYS)


@query(f"WITH {REFERENCE_SQL} SELECT ev.event_id, {dround("((ev.value - r.median) / nullif(r.scale, 0))", 2)} AS z FROM events ev LEFT JOIN ref r ON ev.user_id = r.series")
def zscore(spark, sf_dir):
    rows = series(spark, sf_dir)
    return B.departures(rows, B.references(rows, KEYS), KEYS, least=0).select("event_id", "z")


@query(f"WITH {REFERENCE_SQL} SELECT ev.event_id, CASE WHEN r.n >= 12 THEN {dround("((ev.value - r.median) / nullif(r.scale, 0))", 2)} END AS z FROM events ev LEFT JOIN ref r ON ev.user_id = r.series")
def departure(spark, sf_dir):
    rows = series(spark, sf_dir)
    return B.departures(rows, B.references(rows, KEYS), KEYS).select("event_id", "z")


@query(f"WITH {TRAILING_SQL} SELECT series, event_id, t_median, t_scale, t_n FROM tr")
def trailing_baseline(spark, sf_dir):
    return B.trailing(series(spark, sf_dir), KEYS, ORDER).select("series", "event_id", "t_median", "t_scale", "t_n")


@query(f"""WITH {REFERENCE_SQL}, {TRAILING_SQL}, j AS (SELECT tr.series, tr.event_id, tr.value, CASE WHEN t_n IS NOT NULL THEN 'trailing' ELSE 'whole' END AS scope, coalesce(t_n, n) AS reference_n,
    CASE WHEN t_n IS NOT NULL THEN {dround("((tr.value - t_median) / nullif(t_scale, 0))", 2)} ELSE {dround("((tr.value - ref.median) / nullif(ref.scale, 0))", 2)} END AS z0 FROM tr LEFT JOIN ref USING (series)),
    k AS (SELECT *, CASE WHEN reference_n >= 12 THEN z0 END AS z FROM j)
    SELECT series, event_id, value, scope, reference_n, z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM k WHERE abs(z) >= 1.5""")
def moments(spark, sf_dir):
    return B.moments(series(spark, sf_dir).select("series", "ts", "event_id", "value"), KEYS, ORDER).drop("ts")


@query("""SELECT o_orderkey AS series, 'price' AS feature, CAST(o_totalprice AS DOUBLE) AS value FROM orders WHERE o_totalprice IS NOT NULL
    UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS DOUBLE) FROM orders WHERE o_custkey IS NOT NULL""")
def feature_long(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("series"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    return B.long_features(rows, KEYS, ["price", "customer"])


@query(f"""WITH {REFERENCE_SQL}, lref AS (SELECT median(length(props)) AS lm FROM events), z AS (SELECT ev.event_id, {dround("((ev.value - r.median) / nullif(r.scale, 0))", 2)} AS voice_z, (CAST(printf('%.2f', CAST(lm - length(props) * 1.0 AS DOUBLE)) AS DOUBLE) + 0.0) AS words_z FROM events ev JOIN ref r ON ev.user_id = r.series CROSS JOIN lref)
    SELECT event_id, voice_z, words_z FROM z WHERE abs(words_z) >= 1.0 AND abs(voice_z) >= 1.0 AND (words_z > 0) <> (voice_z > 0)""")
def mismatch(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("series"), "event_id", "value", "props")
    middle = events.agg(F.median(F.length("props")).alias("lm"))
    rows = B.departures(events, B.references(events, KEYS), KEYS, least=0).crossJoin(F.broadcast(middle)).select("event_id", F.col("z").alias("voice_z"), rounded(F.col("lm") - F.length("props") * 1.0, 2).alias("words_z"))
    return B.mismatches(rows, least=1.0)


@query("""WITH v AS (SELECT user_id AS entity, event_type AS feature, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
    s AS (SELECT c.entity, c.feature, count(*) AS n, avg(CASE WHEN (CASE WHEN c.feature IN ('error', 'view') THEN c.value < h.value ELSE c.value > h.value END) THEN 1.0 ELSE 0.0 END) AS share
          FROM v c JOIN v h ON c.entity = h.entity AND c.feature = h.feature AND h.k > 1 WHERE c.k = 1 GROUP BY ALL HAVING count(*) >= 8)
    SELECT entity, CAST((CAST(printf('%.0f', CAST(100 * avg(share) AS DOUBLE)) AS DOUBLE) + 0.0) AS BIGINT) AS composite, count(*) AS features FROM s GROUP BY 1""")
def composite(spark, sf_dir):
    from pyspark.sql import Window

    rows = series(spark, sf_dir).select(F.col("series").alias("entity"), F.col("event_type").alias("feature"), "value", F.row_number().over(Window.partitionBy("series", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))).alias("k"))
    return B.percentile_of_history(rows.where("k = 1"), rows.where("k > 1"), ["error", "view"])


@query(f"SELECT user_id AS entity, event_type AS feature, {dround('median(value)', 2)} AS usual, count(*) AS n FROM events GROUP BY ALL")
def usual_features(spark, sf_dir):
    return series(spark, sf_dir).groupBy(F.col("series").alias("entity"), F.col("event_type").alias("feature")).agg(rounded(F.median("value"), 2).alias("usual"), F.count("*").alias("n"))


@query("""SELECT user_id AS series, CASE WHEN count(*) FILTER (value >= 60) >= 2 THEN count(*) FILTER (value >= 60) || ' long pauses' WHEN count(*) FILTER (value >= 60) = 1 THEN 'pauses for ' || printf('%.1f', max(value)) || 's' END AS note FROM events GROUP BY 1""")
def pause_notes(spark, sf_dir):
    long_ = F.count_if(F.col("value") >= 60)
    note = F.when(long_ >= 2, F.concat(long_.cast("string"), F.lit(" long pauses"))).when(long_ == 1, F.concat(F.lit("pauses for "), F.format_string("%.1f", F.max("value")), F.lit("s")))
    return series(spark, sf_dir).groupBy("series").agg(note.alias("note"))


@query("SELECT event_type, (CAST(printf('%.4f', CAST(sum(user_id * value) / sum(user_id) AS DOUBLE)) AS DOUBLE) + 0.0) AS mean FROM events GROUP BY 1")
def weighted_mean(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(rounded(F.expr("try_divide(sum(user_id * value), sum(user_id))"), 4).alias("mean"))


@query(f"SELECT event_id, {dround('least(greatest(value / 100 - 0.1, 0), 1)', 3)} AS clipped, {dround('(value / 100 - 0.1)', 6)} AS raw, value / 100 - 0.1 < 0 OR value / 100 - 0.1 > 1 AS out_of_range FROM events")
def clip_scores(spark, sf_dir):
    x = F.col("value") / 100 - 0.1
    return read(spark, sf_dir, "events").select("event_id", rounded(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 3).alias("clipped"), rounded(x, 6).alias("raw"), ((x < 0) | (x > 1)).alias("out_of_range"))


@query(f"""WITH {REFERENCE_SQL}, z AS (SELECT ev.event_id, ev.event_type, CASE WHEN r.n >= 12 THEN {dround("((ev.value - r.median) / nullif(r.scale, 0))", 2)} END AS z FROM events ev LEFT JOIN ref r ON ev.user_id = r.series),
    n(event_type, high, low, place) AS (VALUES ('click', 'faster', 'slower', 0), ('error', NULL, 'fewer errors', 1), ('view', 'longer', NULL, 2))
    SELECT event_id, event_type AS feature, z, CASE WHEN z > 0 THEN high ELSE low END AS note, place FROM z JOIN n USING (event_type) WHERE abs(z) >= 1.0 AND CASE WHEN z > 0 THEN high ELSE low END IS NOT NULL AND (event_type <> 'view' OR event_id % 2 = 0)""")
def observations(spark, sf_dir):
    rows = series(spark, sf_dir)
    departed = B.departures(rows, B.references(rows, KEYS), KEYS).select("event_id", F.col("event_type").alias("feature"), "z")
    notes = (("click", "faster", "slower"), ("error", None, "fewer errors"), ("view", "longer", None))
    return B.observations(departed, ["event_id"], 1.0, notes, {"view": F.col("event_id") % 2 == 0})
