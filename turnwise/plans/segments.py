"""Queries over events as segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.functions.numbers import exact_sum, rounded
from turnwise.operators import segments as S
from turnwise.registry import query
from turnwise.sources.tables import SEGMENTS_SQL, segments

#: Events of a day are minutes apart, so turns here go on over longer gaps than in speech.
GAP = 120.0

TURNS_SQL = f"""{SEGMENTS_SQL},
    sf AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER o AND start_s - lag(end_s) OVER o <= {GAP} THEN 0 ELSE 1 END AS b FROM segs WINDOW o AS (PARTITION BY call_id ORDER BY seg_idx)),
    st AS (SELECT *, CAST(sum(b) OVER (PARTITION BY call_id ORDER BY seg_idx) - 1 AS BIGINT) AS turn_idx FROM sf),
    turns AS (SELECT call_id, turn_idx, min(speaker) AS speaker, arg_min(start_s, seg_idx) AS start_s, arg_max(end_s, seg_idx) AS end_s,
              (CAST(printf('%.2f', CAST(sum(greatest(end_s - start_s, 0)) AS DOUBLE)) AS DOUBLE) + 0.0) AS speech_seconds, count(*) AS segments FROM st GROUP BY ALL)"""
UTTERANCES_SQL = f"""{SEGMENTS_SQL},
    ur AS (SELECT *, max(end_s) OVER (PARTITION BY call_id, speaker ORDER BY start_s, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segs),
    ui AS (SELECT *, CAST(sum(CASE WHEN start_s - reach <= 1.5 THEN 0 ELSE 1 END) OVER (PARTITION BY call_id, speaker ORDER BY start_s, seg_idx) - 1 AS BIGINT) AS utterance FROM ur),
    utt AS (SELECT call_id, speaker, utterance, min(start_s) AS start_s, max(end_s) AS end_s FROM ui GROUP BY ALL)"""
OVERLAPS_SQL = f"""{UTTERANCES_SQL},
    ov AS (SELECT a.call_id, (CAST(printf('%.2f', CAST(b.start_s AS DOUBLE)) AS DOUBLE) + 0.0) AS start_s, (CAST(printf('%.2f', CAST(least(a.end_s, b.end_s) AS DOUBLE)) AS DOUBLE) + 0.0) AS end_s, (CAST(printf('%.2f', CAST(least(a.end_s, b.end_s) - b.start_s AS DOUBLE)) AS DOUBLE) + 0.0) AS seconds, b.speaker AS "by", a.speaker AS "over",
           CASE WHEN b.end_s <= a.end_s THEN 'backchannel' ELSE 'floor_taking' END AS kind
           FROM utt a JOIN utt b ON a.call_id = b.call_id AND a.speaker <> b.speaker AND (a.start_s, a.end_s, a.speaker) < (b.start_s, b.end_s, b.speaker)
           WHERE least(a.end_s, b.end_s) - b.start_s > 0.1)"""


def _turns(spark, sf_dir):
    return S.build_turns(segments(spark, sf_dir), GAP)


def _overlaps(spark, sf_dir):
    return S.overlap_events(S.utterances(segments(spark, sf_dir)))


@query(f"WITH {TURNS_SQL} SELECT call_id, turn_idx, speaker, start_s, end_s, speech_seconds, segments FROM turns")
def turns(spark, sf_dir):
    return _turns(spark, sf_dir).select("call_id", "turn_idx", "speaker", "start_s", "end_s", "speech_seconds", "segments")


@query(f"""WITH {TURNS_SQL} SELECT call_id, turn_idx, CASE WHEN speaker <> lag(speaker) OVER o THEN (CAST(printf('%.2f', CAST(start_s - lag(end_s) OVER o AS DOUBLE)) AS DOUBLE) + 0.0) END AS reply_latency
    FROM turns WINDOW o AS (PARTITION BY call_id ORDER BY turn_idx)""")
def reply_latency(spark, sf_dir):
    return S.reply_latencies(_turns(spark, sf_dir)).select("call_id", "turn_idx", "reply_latency")


@query(f"WITH {UTTERANCES_SQL} SELECT call_id, speaker, utterance, start_s, end_s FROM utt")
def utterances(spark, sf_dir):
    return S.utterances(segments(spark, sf_dir)).select("call_id", "speaker", "utterance", "start_s", "end_s")


@query(f'WITH {OVERLAPS_SQL} SELECT * FROM ov')
def overlap_events(spark, sf_dir):
    return _overlaps(spark, sf_dir)


@query(f"""WITH {OVERLAPS_SQL}, {TURNS_SQL.split(SEGMENTS_SQL + ",")[1]}, sp AS (SELECT call_id, CAST(CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE) AS speech FROM turns GROUP BY 1)
    SELECT ov.call_id, count(*) AS overlaps, CAST((CAST(printf('%.1f', CAST(CAST(sum(CAST(seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE)) AS DOUBLE) + 0.0) AS DOUBLE) AS overlap_seconds, max(seconds) AS longest, count(*) FILTER (kind = 'backchannel') AS backchannels,
           count(*) FILTER (kind = 'floor_taking') AS floor_takings, (CAST(printf('%.4f', CAST(CAST(CAST(sum(CAST(seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE) / any_value(speech) AS DOUBLE)) AS DOUBLE) + 0.0) AS share FROM ov JOIN sp USING (call_id) GROUP BY 1""")
def overlap_summary(spark, sf_dir):
    return S.overlap_summary(_overlaps(spark, sf_dir), _turns(spark, sf_dir))


@query(f"""WITH {OVERLAPS_SQL}, b AS (SELECT call_id, unnest(["by", "over"]) AS speaker, seconds, "by", kind FROM ov)
    SELECT call_id, speaker, CAST((CAST(printf('%.1f', CAST(CAST(sum(CAST(seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE)) AS DOUBLE) + 0.0) AS DOUBLE) AS seconds, count(*) FILTER (kind = 'floor_taking' AND "by" = speaker) AS floor_takes FROM b GROUP BY ALL""")
def overlap_by_speaker(spark, sf_dir):
    return S.overlap_by_speaker(_overlaps(spark, sf_dir))


@query(f"""WITH {TURNS_SQL}, c AS (SELECT *, CAST(speaker <> lag(speaker) OVER (PARTITION BY call_id ORDER BY turn_idx) AS INT) AS ch FROM turns)
    SELECT call_id, count(*) AS turns, count(DISTINCT speaker) AS speakers, CAST(coalesce(sum(ch), 0) AS BIGINT) AS speaker_changes, CAST((CAST(printf('%.1f', CAST(CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE)) AS DOUBLE) + 0.0) AS DOUBLE) AS speech,
           (CAST(printf('%.2f', CAST(CAST(CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE) / nullif(sum(ch), 0) AS DOUBLE)) AS DOUBLE) + 0.0) AS seconds_a_change, arg_max(turn_idx, (speech_seconds, -turn_idx)) AS longest_turn,
           count(*) FILTER (speech_seconds >= 4.0) AS scored_turns FROM c GROUP BY 1""")
def call_summary(spark, sf_dir):
    return S.call_summary(_turns(spark, sf_dir))


@query(f"WITH {TURNS_SQL}, g AS (SELECT *, start_s - lag(end_s) OVER (PARTITION BY call_id ORDER BY turn_idx) AS gap FROM turns) SELECT call_id, turn_idx, (CAST(printf('%.2f', CAST(gap AS DOUBLE)) AS DOUBLE) + 0.0) AS seconds FROM g WHERE gap >= 2.0")
def silence_gaps(spark, sf_dir):
    return S.silences(_turns(spark, sf_dir))


@query(f"WITH {SEGMENTS_SQL} SELECT call_id, seg_idx, speaker, event_id FROM segs WHERE start_s >= 3600 AND end_s <= 7200")
def trim_range(spark, sf_dir):
    return S.trimmed(segments(spark, sf_dir), 3600.0, 7200.0).select("call_id", "seg_idx", "speaker", "event_id")


@query(f"""WITH {SEGMENTS_SQL}, n AS (SELECT *, end_s - start_s AS l FROM segs), m AS (SELECT *, greatest(ceil(l / 30.0) - CASE WHEN l - floor(l / 30.0) * 30.0 > 0 AND l - floor(l / 30.0) * 30.0 < 1 THEN 1 ELSE 0 END, 1) AS k FROM n),
    p AS (SELECT call_id, seg_idx, start_s, end_s, k, unnest(range(CAST(k AS BIGINT))) AS piece FROM m)
    SELECT call_id, seg_idx, piece, start_s + piece * 30.0 AS piece_start, CASE WHEN piece = k - 1 THEN end_s ELSE start_s + (piece + 1) * 30.0 END AS piece_end FROM p""")
def span_pieces(spark, sf_dir):
    return S.pieces(segments(spark, sf_dir)).select("call_id", "seg_idx", "piece", "piece_start", "piece_end")


@query(f"WITH {TURNS_SQL} SELECT call_id, turn_idx, speech_seconds FROM turns WHERE speech_seconds >= 4.0")
def scored_turns(spark, sf_dir):
    return _turns(spark, sf_dir).where("speech_seconds >= 4.0").select("call_id", "turn_idx", "speech_seconds")


@query(f"""WITH {TURNS_SQL}, {OVERLAPS_SQL.split(SEGMENTS_SQL + ",")[1]} SELECT call_id, turn_idx FROM turns t
    WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.call_id = t.call_id AND ov.start_s < t.end_s AND ov.end_s > t.start_s)""")
def untouched_turns(spark, sf_dir):
    return S.untouched(_turns(spark, sf_dir), _overlaps(spark, sf_dir)).select("call_id", "turn_idx")


@query(f"""WITH {TURNS_SQL}, p AS (SELECT call_id, unnest(range(48)) AS point, unnest(range(48)) * 1800.0 AS at_s FROM (SELECT DISTINCT call_id FROM turns))
    SELECT p.call_id, p.point, p.at_s, t.turn_idx FROM p ASOF LEFT JOIN turns t ON p.call_id = t.call_id AND p.at_s >= t.start_s""")
def asof_turn(spark, sf_dir):
    found = _turns(spark, sf_dir)
    points = found.select("call_id").distinct().withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(47).cast("long")))).withColumn("at_s", F.col("point") * 1800.0)
    return S.as_of(points, found)


@query(f"""WITH {TURNS_SQL}, w AS (SELECT DISTINCT call_id, greatest(start_s - 10, 0) AS clip_start, least(end_s + 10, 86400) AS clip_end FROM turns WHERE turn_idx % 10 = 0)
    SELECT call_id, clip_start, clip_end, row_number() OVER (PARTITION BY call_id ORDER BY w.clip_start, w.clip_end) AS clip FROM w""")
def clip_ranges(spark, sf_dir):
    return _clips(spark, sf_dir).select("call_id", "clip_start", "clip_end", "clip")


def _clips(spark, sf_dir):
    return S.clip_windows(_turns(spark, sf_dir).where("turn_idx % 10 = 0"), 10.0, F.lit(86400.0))


@query(f"""WITH {TURNS_SQL}, w AS (SELECT DISTINCT call_id, greatest(start_s - 10, 0) AS clip_start, least(end_s + 10, 86400) AS clip_end FROM turns WHERE turn_idx % 10 = 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY clip_start, clip_end) AS clip FROM w)
    SELECT s.call_id, s.seg_idx AS span, min(c.clip) AS clip FROM segs s JOIN c ON s.call_id = c.call_id AND c.clip_start <= s.start_s AND s.end_s <= c.clip_end GROUP BY ALL""")
def covering_clip(spark, sf_dir):
    return S.first_covering(segments(spark, sf_dir).withColumnRenamed("seg_idx", "span"), _clips(spark, sf_dir))


@query(f"""WITH {TURNS_SQL}, p AS (SELECT call_id, unnest(range(24)) AS point, unnest(range(24)) * 3600.0 + 7.5 AS at_s FROM (SELECT DISTINCT call_id FROM turns)),
    d AS (SELECT p.call_id, p.point, t.speaker, greatest(t.start_s - at_s, at_s - t.end_s, 0) AS away, t.start_s, t.end_s FROM p JOIN turns t USING (call_id))
    SELECT call_id, point, arg_min(speaker, (away, start_s, end_s, speaker)) AS speaker, (CAST(printf('%.3f', CAST(min(away) AS DOUBLE)) AS DOUBLE) + 0.0) AS distance FROM d GROUP BY ALL""")
def assign_speaker(spark, sf_dir):
    found = _turns(spark, sf_dir)
    points = found.select("call_id").distinct().withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")))).withColumn("at_s", F.col("point") * 3600.0 + 7.5)
    return S.nearest_label(points, found)


@query(f"""WITH {TURNS_SQL}, r AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER o THEN 0 ELSE 1 END AS b FROM turns WINDOW o AS (PARTITION BY call_id ORDER BY turn_idx)),
    n AS (SELECT *, sum(b) OVER (PARTITION BY call_id ORDER BY turn_idx) AS run FROM r), g AS (SELECT call_id, run, min(speaker) AS speaker FROM n GROUP BY ALL),
    k AS (SELECT call_id, run, coalesce(lead(speaker) OVER o, lag(speaker) OVER o) AS nearby FROM g WINDOW o AS (PARTITION BY call_id ORDER BY run))
    SELECT n.call_id, n.turn_idx, k.nearby FROM n JOIN k USING (call_id, run)""")
def nearby_speaker(spark, sf_dir):
    return S.other_speaker_nearby(_turns(spark, sf_dir)).select("call_id", "turn_idx", "nearby")


@query(f"""WITH {SEGMENTS_SQL}, b AS (SELECT *, max(start_s) OVER (PARTITION BY call_id ORDER BY event_id) AS cs FROM segs), e AS (SELECT *, greatest(end_s, cs) AS en, lead(cs) OVER (PARTITION BY call_id ORDER BY event_id) AS nx FROM b)
    SELECT call_id, event_id, cs AS clock_start, greatest(least(en, coalesce(nx, en)), cs) AS clock_end FROM e""")
def one_clock_monotone(spark, sf_dir):
    return S.monotone(segments(spark, sf_dir), ["event_id"]).select("call_id", "event_id", "clock_start", "clock_end")


@query(f"""WITH {TURNS_SQL}, s AS (SELECT call_id, speaker, CAST((CAST(printf('%.1f', CAST(CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE)) AS DOUBLE) + 0.0) AS DOUBLE) AS speech, (CAST(printf('%.3f', CAST(CAST(CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS DOUBLE) / any_value(total) AS DOUBLE)) AS DOUBLE) + 0.0) AS share
    FROM (SELECT *, CAST(sum(CAST(speech_seconds AS DECIMAL(18, 2))) OVER (PARTITION BY call_id) AS DOUBLE) AS total FROM turns) GROUP BY ALL)
    SELECT call_id, speaker, speech, share, row_number() OVER (PARTITION BY call_id ORDER BY share DESC, speaker) AS place FROM s""")
def speakers_by_share(spark, sf_dir):
    from pyspark.sql import Window

    total = exact_sum("speech_seconds").over(Window.partitionBy("call_id")).cast("double")
    shares = _turns(spark, sf_dir).withColumn("_total", total).groupBy("call_id", "speaker").agg(rounded(exact_sum("speech_seconds"), 1).cast("double").alias("speech"), rounded(F.try_divide(exact_sum("speech_seconds").cast("double"), F.any_value("_total")), 3).alias("share"))
    return shares.withColumn("place", F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("share"), "speaker")).cast("long"))


@query(f"""WITH {TURNS_SQL} SELECT call_id, turn_idx, printf('T%03d', turn_idx + 1) AS turn_id, printf('%02d:%02d', CAST(floor(floor(start_s) / 60) AS BIGINT), CAST(floor(start_s) AS BIGINT) % 60) AS at FROM turns""")
def turn_ids(spark, sf_dir):
    return _turns(spark, sf_dir).select("call_id", "turn_idx", T.turn_id(F.col("turn_idx")).alias("turn_id"), T.minutes(F.col("start_s")).alias("at"))


@query(f"""WITH {SEGMENTS_SQL}, m AS (SELECT call_id, seg_idx, CAST(floor(end_s) AS BIGINT) AS w, least(CAST(round((end_s - floor(end_s)) * 1000) AS BIGINT), 999) AS ms FROM segs)
    SELECT call_id, seg_idx, printf('%02d:%02d:%02d,%03d', w // 3600, w // 60 % 60, w % 60, ms) AS stamp FROM m""")
def fmt_timestamp(spark, sf_dir):
    return segments(spark, sf_dir).select("call_id", "seg_idx", T.timestamp(F.col("end_s")).alias("stamp"))


@query(f"""WITH {SEGMENTS_SQL}, m AS (SELECT *, CAST(floor(start_s) AS BIGINT) AS a, CAST(floor(end_s) AS BIGINT) AS b, least(CAST(round((end_s - floor(end_s)) * 1000) AS BIGINT), 999) AS mb, least(CAST(round((start_s - floor(start_s)) * 1000) AS BIGINT), 999) AS ma FROM segs)
    SELECT call_id, seg_idx, row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600, a // 60 % 60, a % 60, ma) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600, b // 60 % 60, b % 60, mb)
        || chr(10) || '[' || speaker || '] ' || event_id AS cue FROM m WHERE speaker <> 'view'""")
def render_srt(spark, sf_dir):
    from pyspark.sql import Window

    rows = segments(spark, sf_dir).where("speaker <> 'view'")
    number = F.row_number().over(Window.partitionBy("call_id").orderBy("seg_idx")).cast("string")
    cue = F.concat(number, F.lit("\n"), T.timestamp(F.col("start_s")), F.lit(" --> "), T.timestamp(F.col("end_s")), F.lit("\n["), F.col("speaker"), F.lit("] "), F.col("event_id").cast("string"))
    return rows.select("call_id", "seg_idx", cue.alias("cue"))


@query(f"""WITH {SEGMENTS_SQL}, c AS (SELECT *, speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY call_id ORDER BY seg_idx) AS h FROM segs)
    SELECT call_id, string_agg(CASE WHEN h THEN speaker || ':' || chr(10) ELSE '' END || event_id, chr(10) ORDER BY seg_idx) AS body FROM c GROUP BY 1""")
def render_txt(spark, sf_dir):
    from pyspark.sql import Window

    head = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(Window.partitionBy("call_id").orderBy("seg_idx")))
    line = F.concat(F.when(head, F.concat("speaker", F.lit(":\n"))).otherwise(""), F.col("event_id").cast("string"))
    lines = segments(spark, sf_dir).withColumn("line", line)
    return lines.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "line"))), lambda x: x["line"]), "\n").alias("body"))


@query(f"""WITH {TURNS_SQL}, m AS (SELECT call_id, turn_idx, start_s, 'tick' AS kind FROM turns WHERE speech_seconds >= 100 UNION ALL
    SELECT call_id, turn_idx, g, 'silence' FROM (SELECT call_id, turn_idx, start_s AS g, start_s - lag(end_s) OVER (PARTITION BY call_id ORDER BY turn_idx) AS gap FROM turns) WHERE gap >= 1800)
    SELECT m.call_id, m.turn_idx, m.kind, (CAST(printf('%.2f', CAST(1000 * m.start_s / greatest(t.total, 0.001) AS DOUBLE)) AS DOUBLE) + 0.0) AS x FROM m JOIN (SELECT call_id, greatest(max(end_s), 86400.0) AS total FROM turns GROUP BY 1) t USING (call_id)""")
def timeline_marks(spark, sf_dir):
    found = _turns(spark, sf_dir)
    ticks = found.where("speech_seconds >= 100").select("call_id", "turn_idx", "start_s", F.lit("tick").alias("kind"))
    quiet = S.silences(found, 1800.0).join(found.select("call_id", "turn_idx", "start_s"), ["call_id", "turn_idx"]).select("call_id", "turn_idx", "start_s", F.lit("silence").alias("kind"))
    total = found.groupBy("call_id").agg(F.greatest(F.max("end_s"), F.lit(86400.0)).alias("total"))
    return ticks.union(quiet).join(total, "call_id").select("call_id", "turn_idx", "kind", rounded(1000 * F.col("start_s") / F.greatest("total", F.lit(0.001)), 2).alias("x"))
