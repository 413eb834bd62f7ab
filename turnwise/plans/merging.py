"""Queries of the merge of two word streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from turnwise.operators import aligning, merging
from turnwise.operators.clock import one_clock as clock
from turnwise.registry import query
from turnwise.sources.tables import WORDS_SQL, conversations, tasks_of, words


def _numbered(spark, sf_dir):
    order = Window.partitionBy("call_id").orderBy("turn_idx", "word_idx")
    return words(spark, sf_dir).withColumn("n", F.row_number().over(order) - 1)


def _tasks(spark, sf_dir):
    """The tasks that words are dealt to where they are made, so that the merge finds them dealt."""
    return tasks_of(conversations(spark, sf_dir))


def _streams(spark, sf_dir):
    """The conversations' words as they were recognised and, with other gaps and with fillers, as they were said."""
    rows = _numbered(spark, sf_dir)
    rec = rows.where("length(word) % 11 <> 0").select("call_id", F.col("n").alias("place"), "word", "start_s", "end_s", F.col("turn_idx").cast("long").alias("segment"))
    said = rows.where("length(word) % 13 <> 0")
    more = F.when(F.col("n") % 9 == 4, F.array(F.lit("um"))).when(F.col("n") % 23 == 6, F.array("word", "word")).otherwise(F.array().cast("array<string>"))
    ver = said.select("call_id", "n", "start_s", "end_s", F.posexplode(F.concat(F.array("word"), more)).alias("k", "word"))
    return rec, ver.select("call_id", (F.col("n") * 4 + F.col("k")).alias("place"), "word", (F.col("start_s") + 0.12).alias("start_s"), (F.col("end_s") + 0.12).alias("end_s"))


@query()
def verbatim_merge(spark, sf_dir):
    return merging.merged_words(*_streams(spark, sf_dir), tasks=_tasks(spark, sf_dir))[0]


@query()
def verbatim_align(spark, sf_dir):
    rec, ver = _streams(spark, sf_dir)
    side = lambda df: df.select("call_id", F.col("place").alias("at"), merging.word_key(F.col("word")).alias("key"), F.col("start_s").alias("t"))
    return aligning.word_pairs(side(rec), side(ver.where(merging.token_kind(F.col("word")) == "content")), tasks=_tasks(spark, sf_dir))


def _numbered_words(spark, sf_dir):
    """Words that occur once in a call, so that what is said in both streams is known; n % 35 says in what they differ."""
    rows = _numbered(spark, sf_dir).withColumn("p", F.col("n") % 35).withColumn("w", F.concat(F.lit("w"), "n"))
    own = F.when(F.col("p") == 25, F.array(F.concat(F.lit("x"), "n"))).when(F.col("p") == 27, F.array(F.concat(F.lit("x"), "n"), F.concat(F.lit("y"), "n"))).when(F.col("p").isin(16, 29), F.array(F.col("w"), F.lit("Uh,"))).when(F.col("p") == 7, F.array().cast("array<string>")).otherwise(F.array("w"))
    said = (
        F.when(F.col("p") == 3, F.array().cast("array<string>")).when(F.col("p") == 11, F.array("w", "w")).when(F.col("p") == 15, F.array(F.col("w"), F.lit("um"))).when(F.col("p") == 18, F.array(F.col("w"), F.lit("[laughs]")))
        .when(F.col("p") == 20, F.array(F.col("w"), F.lit("Mhm."))).when(F.col("p") == 22, F.array(F.col("w"), F.lit("pl-"))).when(F.col("p") == 33, F.array(F.col("w"), *[F.lit("hmm")] * 6)).otherwise(F.array("w"))
    )
    late = F.when(F.col("p") == 31, 6.0).otherwise(0.0)
    rec = rows.select("call_id", F.posexplode(own).alias("k", "word"), "n", (F.col("start_s") - late).alias("start_s"), (F.col("end_s") - late).alias("end_s"), F.col("turn_idx").cast("long").alias("segment"))
    ver = rows.select("call_id", F.posexplode(said).alias("k", "word"), "n", "start_s", "end_s")
    place = (F.col("n") * 8 + F.col("k")).alias("place")
    return rec.select("call_id", place, "word", "start_s", "end_s", "segment"), ver.select("call_id", place, "word", "start_s", "end_s")


@query(f"""WITH {WORDS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY turn_idx, word_idx) - 1 AS n FROM words), q AS (SELECT *, n % 35 AS p FROM m),
    u AS (SELECT a.call_id, bool_or(b.call_id IS NOT NULL) AS near FROM (SELECT * FROM q WHERE p IN (16, 29)) a LEFT JOIN (SELECT * FROM q WHERE p = 15) b ON a.call_id = b.call_id AND abs(a.start_s - b.start_s) <= 0.8 GROUP BY a.call_id, a.n),
    c AS (SELECT call_id, unnest(CASE p WHEN 3 THEN ['whisper_only'] WHEN 7 THEN ['dropped_content'] WHEN 11 THEN ['matched', 'kept_repetition'] WHEN 15 THEN ['matched', 'kept_filler'] WHEN 18 THEN ['matched', 'kept_event']
              WHEN 20 THEN ['matched', 'kept_vocalisation'] WHEN 22 THEN ['matched', 'kept_cutoff'] WHEN 25 THEN ['replaced'] WHEN 27 THEN ['replaced', 'replaced'] WHEN 31 THEN ['far_matches']
              WHEN 33 THEN ['matched', 'kept_vocalisation', 'kept_vocalisation', 'kept_vocalisation', 'kept_vocalisation', 'kept_vocalisation', 'kept_vocalisation', 'dropped_loop', 'dropped_loop'] ELSE ['matched'] END) AS counter FROM q
          UNION ALL SELECT call_id, CASE WHEN near THEN 'whisper_fillers_merged' ELSE 'whisper_fillers_kept' END FROM u)
    SELECT call_id, counter, count(*) AS n FROM c GROUP BY ALL""")
def merge_counters(spark, sf_dir):
    counts = merging.merged_words(*_numbered_words(spark, sf_dir), tasks=_tasks(spark, sf_dir))[1]
    return counts.groupBy("call_id", "counter").agg(F.sum("n").alias("n"))


@query(f"""WITH {WORDS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY turn_idx, word_idx) - 1 AS n FROM words),
    a AS (SELECT call_id, n, length(word) AS len, n % 5 < 3 AS nat, CASE WHEN n % 5 < 3 THEN start_s END AS s, CASE WHEN n % 5 < 3 THEN CASE WHEN n % 7 = 2 THEN end_s + 0.09 ELSE end_s END END AS e,
                 CASE WHEN n % 8 <> 0 THEN start_s + ((n * 37) % 100 - 50) / 50.0 END AS hs, CASE WHEN n % 8 <> 0 THEN end_s + ((n * 37) % 100 - 50) / 50.0 END AS he FROM m),
    b AS (SELECT *, last_value(s IGNORE NULLS) OVER p AS bs, last_value(e IGNORE NULLS) OVER p AS be, first_value(s IGNORE NULLS) OVER f AS xs, first_value(e IGNORE NULLS) OVER f AS xe,
                 sum(CASE WHEN nat THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY n) AS run, NOT nat AND hs IS NOT NULL AS kn,
                 CASE WHEN NOT nat THEN CASE WHEN he > hs THEN he - hs ELSE greatest(0.06 * len, 0.04) END END AS want
          FROM a WINDOW p AS (PARTITION BY call_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY call_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    c AS (SELECT *, sum(want) OVER r AS need, coalesce(sum(want) OVER rp, 0) AS done, count(*) FILTER (kn) OVER (PARTITION BY call_id, run ORDER BY n) AS kc,
                 coalesce(be, first_value(CASE WHEN kn THEN hs END IGNORE NULLS) OVER r, 0) AS low0, last_value(CASE WHEN kn THEN he END IGNORE NULLS) OVER r AS lasth,
                 avg(CASE WHEN kn THEN (hs + he) / 2 END) OVER r AS mid
          FROM b WINDOW r AS (PARTITION BY call_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), rp AS (PARTITION BY call_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    d AS (SELECT *, greatest(coalesce(xs, lasth, low0 + need), low0) AS high0 FROM c),
    e AS (SELECT *, CASE WHEN kn THEN least(greatest(hs, low0), high0) END AS ks, CASE WHEN kn THEN least(greatest(he, least(greatest(hs, low0), high0)), high0) END AS ke,
                 coalesce(sum(CASE WHEN NOT nat AND NOT kn THEN want END) OVER (PARTITION BY call_id, run, kc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d),
    g AS (SELECT *, coalesce(last_value(ke IGNORE NULLS) OVER (PARTITION BY call_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low0) + off AS fol FROM e),
    h AS (SELECT *, coalesce(ks, least(fol, high0)) AS fs, coalesce(ke, least(fol + want, high0)) AS fe, high0 - low0 >= 0.5 * need AS roomy FROM g),
    i AS (SELECT *, NOT roomy OR bool_or(fe - fs < 0.2 * want) FILTER (NOT nat) OVER (PARTITION BY call_id, run) AS packed, CASE WHEN nat THEN NULL WHEN roomy THEN 0 ELSE (0.5 * need - (high0 - low0)) / 2 END AS half FROM h),
    j AS (SELECT *, CASE WHEN NOT nat THEN CASE WHEN xs IS NULL THEN 0 ELSE least(half, 0.5 * (xe - xs)) END END AS late FROM i),
    k AS (SELECT *, CASE WHEN nat THEN coalesce(lag(late) OVER (PARTITION BY call_id ORDER BY n), 0) END AS taken FROM j),
    l AS (SELECT *, CASE WHEN NOT nat THEN CASE WHEN be IS NULL THEN 0 ELSE least(half, 0.5 * (be - bs - coalesce(max(taken) OVER (PARTITION BY call_id, run), 0))) END END AS early FROM k),
    o AS (SELECT *, low0 - coalesce(early, 0) AS low, high0 + coalesce(late, 0) AS high, coalesce(max(early) OVER (PARTITION BY call_id, run), 0) AS given FROM l),
    q AS (SELECT *, least((high - low) / need, 1) AS sc FROM o),
    t AS (SELECT *, least(greatest(coalesce(mid, (low + high) / 2) - need * sc / 2, low), high - need * sc) + done * sc AS beg FROM q),
    u AS (SELECT call_id, n, CASE WHEN nat THEN s + taken WHEN packed THEN beg ELSE fs END AS s, CASE WHEN nat THEN e - given WHEN packed THEN beg + want * sc ELSE fe END AS e FROM t),
    v AS (SELECT *, max(s) OVER (PARTITION BY call_id ORDER BY n) AS s2 FROM u), w2 AS (SELECT *, lead(s2) OVER (PARTITION BY call_id ORDER BY n) AS nx FROM v)
    SELECT call_id, n, CAST(floor(s2 * 1000 + 0.001) AS BIGINT) AS start_ms, CAST(floor(CASE WHEN nx IS NULL THEN greatest(e, s2) ELSE greatest(least(greatest(e, s2), nx), s2) END * 1000 + 0.001) AS BIGINT) AS end_ms FROM w2""")
def one_clock(spark, sf_dir):
    shift = ((F.col("n") * 37) % 100 - 50) / F.lit(50.0)
    native, hinted = F.col("n") % 5 < 3, F.col("n") % 8 != 0
    rows = _numbered(spark, sf_dir).select(
        "call_id", F.col("n").cast("long").alias("n"), "word", native.alias("native"), F.when(native, F.col("start_s")).alias("start_s"), F.when(native, F.when(F.col("n") % 7 == 2, F.col("end_s") + 0.09).otherwise(F.col("end_s"))).alias("end_s"),
        F.when(hinted, F.col("start_s") + shift).alias("hint_start"), F.when(hinted, F.col("end_s") + shift).alias("hint_end"),
    )
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.001).cast("long")
    return clock(rows, ["n"]).select("call_id", "n", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"))
