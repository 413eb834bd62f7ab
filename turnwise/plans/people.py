"""Queries over the words of conversations. Words of the tables stand in for names and fillers."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import segments as S, words as W
from turnwise.registry import dround, query
from turnwise.sources.tables import WORDS_SQL, conversations, words

OPENING, ADDRESS = r"(?:^|\. )([A-Z][a-z]+)", r"([A-Z][a-z]+)\.$"
CLASS_SQL = r"""CASE WHEN b[1:1] = '[' THEN 'event' WHEN b IN ('um','uh','uhm','umm','uhh','erm','er','ehm','em') THEN 'filler' WHEN b IN ('hmm','hm','mm','mhm','mmm','mm-hmm','uh-huh','mhmm') THEN 'vocalisation' WHEN ends_with(b, '-') THEN 'cutoff' ELSE 'content' END"""
KIND_SQL = rf"""{WORDS_SQL}, kb AS (SELECT *, regexp_replace(lower(word), '^[^a-z0-9\[]+|[^a-z0-9\]-]+$', '', 'g') AS b FROM words), kw AS (SELECT *, {CLASS_SQL} AS kind FROM kb)"""
PAUSE_SQL = f"""{WORDS_SQL}, pl AS (SELECT *, lead(word) OVER o AS bw, lead(start_s) OVER o AS s2, lead(end_s) OVER o AS e2 FROM words WINDOW o AS (PARTITION BY call_id, turn_idx ORDER BY word_idx)),
    pauses AS (SELECT call_id, turn_idx, {dround("end_s", 2)} AS at, {dround("(s2 - end_s)", 2)} AS seconds, word AS after_word, bw AS before_word FROM pl
               WHERE s2 - end_s >= 1.0 AND end_s - start_s > 0 AND end_s - start_s <= 2.0 AND e2 - s2 > 0 AND e2 - s2 <= 2.0)"""


def _kinds(spark, sf_dir):
    return words(spark, sf_dir).withColumn("kind", W.word_class(F.col("word")))


@query(f"WITH {PAUSE_SQL} SELECT * FROM pauses")
def pauses(spark, sf_dir):
    return W.pauses(words(spark, sf_dir))


@query(f"""WITH {PAUSE_SQL}, s AS (SELECT call_id, turn_idx, count(*) AS word_count, greatest(max(end_s) - min(start_s), 0.01) AS wall FROM words GROUP BY ALL),
    h AS (SELECT call_id, turn_idx, CAST(sum(CAST(seconds AS DECIMAL(18, 2))) AS DOUBLE) AS held FROM pauses GROUP BY ALL)
    SELECT call_id, turn_idx, word_count, {dround("(word_count / (wall / 60))", 1)} AS wpm, {dround("(word_count / (greatest(wall - coalesce(held, 0), 0.01) / 60))", 1)} AS articulation_wpm FROM s LEFT JOIN h USING (call_id, turn_idx)""")
def pace(spark, sf_dir):
    rows = words(spark, sf_dir)
    return W.pace(rows, W.pauses(rows))


@query(f"WITH {KIND_SQL} SELECT call_id, kind, count(*) AS words FROM kw GROUP BY ALL")
def kind_counts(spark, sf_dir):
    return _kinds(spark, sf_dir).groupBy("call_id", "kind").agg(F.count("*").alias("words"))


@query(f"WITH {KIND_SQL} SELECT call_id, turn_idx, word_idx, kind FROM kw WHERE kind <> 'content'")
def classify_words(spark, sf_dir):
    return _kinds(spark, sf_dir).where("kind <> 'content'").select("call_id", "turn_idx", F.col("word_idx").cast("long").alias("word_idx"), "kind")


@query(f"WITH {KIND_SQL} SELECT call_id, bool_or(kind <> 'content') AS verbatim FROM kw GROUP BY 1")
def is_verbatim(spark, sf_dir):
    return _kinds(spark, sf_dir).groupBy("call_id").agg(F.bool_or(F.col("kind") != "content").alias("verbatim"))


@query(f"""WITH {KIND_SQL}, f AS (SELECT *, min(word_idx) FILTER (kind IN ('content','cutoff')) OVER t AS a, max(word_idx) FILTER (kind IN ('content','cutoff')) OVER t AS z FROM kw WINDOW t AS (PARTITION BY call_id, turn_idx)),
    c AS (SELECT call_id, turn_idx, count(*) AS n, count(*) FILTER (kind = 'filler') AS filled_pauses, count(*) FILTER (kind = 'filler' AND coalesce(a < word_idx, false) AND z > word_idx) AS medial,
          count(*) FILTER (kind = 'filler' AND NOT coalesce(a < word_idx, false) AND z > word_idx) AS initial, count(*) FILTER (kind = 'cutoff') AS cutoffs, count(*) FILTER (kind = 'vocalisation') AS vocalisations FROM f GROUP BY ALL)
    SELECT call_id, turn_idx, filled_pauses, initial, medial, filled_pauses - initial - medial AS final, cutoffs, vocalisations, {dround("(100 * filled_pauses / n)", 2)} AS per_100_words FROM c""")
def disfluency(spark, sf_dir):
    return W.disfluency(_kinds(spark, sf_dir))


@query(f"""WITH {WORDS_SQL}, r AS (SELECT *, CASE WHEN lower(word) = lag(lower(word)) OVER o THEN 0 ELSE 1 END AS b FROM words WINDOW o AS (PARTITION BY call_id ORDER BY turn_idx, word_idx)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY call_id ORDER BY turn_idx, word_idx) AS run FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY call_id, run ORDER BY turn_idx, word_idx) AS k FROM g)
    SELECT call_id, turn_idx, count(*) AS kept FROM p WHERE k <= 1 GROUP BY ALL""")
def drop_loops(spark, sf_dir):
    return W.without_loops(words(spark, sf_dir).withColumn("kind", F.lit("filler")), most=1).groupBy("call_id", "turn_idx").agg(F.count("*").alias("kept"))


@query(f"""WITH {WORDS_SQL}, r AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER o THEN 0 ELSE 1 END AS b FROM words WINDOW o AS (PARTITION BY call_id ORDER BY turn_idx, word_idx)),
    g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY call_id ORDER BY turn_idx, word_idx) - 1 AS BIGINT) AS run FROM r)
    SELECT call_id, run, min(speaker) AS speaker, count(*) AS words, string_agg(word, ' ' ORDER BY turn_idx, word_idx) AS text FROM g GROUP BY ALL""")
def interjections(spark, sf_dir):
    return W.speaker_runs(words(spark, sf_dir))


SPLIT_SQL = f"""{WORDS_SQL}, sw AS (SELECT *, CASE WHEN length(word) % 7 = 0 THEN NULL WHEN (word_idx // 6) % 2 = 0 THEN 'a' ELSE 'b' END AS word_speaker FROM words),
    s1 AS (SELECT *, coalesce(word_speaker, speaker) AS who FROM sw), s2 AS (SELECT *, CASE WHEN who = lag(who) OVER o THEN 0 ELSE 1 END AS nb FROM s1 WINDOW o AS (PARTITION BY call_id, turn_idx ORDER BY word_idx)),
    s3 AS (SELECT *, sum(nb) OVER (PARTITION BY call_id, turn_idx ORDER BY word_idx) AS run FROM s2),
    s4 AS (SELECT *, CASE WHEN count(*) OVER r >= 4 AND max(end_s) OVER r - min(start_s) OVER r >= 1.0 THEN who END AS held FROM s3 WINDOW r AS (PARTITION BY call_id, turn_idx, run)),
    s5 AS (SELECT *, last_value(held IGNORE NULLS) OVER (PARTITION BY call_id, turn_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS bf,
           first_value(held IGNORE NULLS) OVER (PARTITION BY call_id, turn_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ff, count(DISTINCT held) OVER (PARTITION BY call_id, turn_idx) AS d FROM s4),
    s6 AS (SELECT *, CASE WHEN d >= 2 THEN coalesce(bf, ff) ELSE speaker END AS piece_speaker FROM s5),
    s7 AS (SELECT *, CASE WHEN piece_speaker = lag(piece_speaker) OVER o THEN 0 ELSE 1 END AS pb FROM s6 WINDOW o AS (PARTITION BY call_id, turn_idx ORDER BY word_idx)),
    s8 AS (SELECT *, CAST(sum(pb) OVER (PARTITION BY call_id, turn_idx ORDER BY word_idx) - 1 AS BIGINT) AS piece FROM s7)"""


@query(f"WITH {SPLIT_SQL} SELECT call_id, turn_idx AS seg_idx, piece, min(piece_speaker) AS piece_speaker, count(*) AS words FROM s8 GROUP BY ALL")
def split_by_speaker(spark, sf_dir):
    who = F.when(F.length("word") % 7 == 0, F.lit(None)).when(F.floor(F.col("word_idx") / 6) % 2 == 0, "a").otherwise("b")
    pieces = W.split_by_speaker(words(spark, sf_dir).withColumn("word_speaker", who).withColumnRenamed("turn_idx", "seg_idx"))
    return pieces.groupBy("call_id", "seg_idx", "piece").agg(F.min("piece_speaker").alias("piece_speaker"), F.count("*").alias("words"))


@query(f"""WITH {WORDS_SQL}, o AS (SELECT *, CASE WHEN length(word) % 3 = 0 THEN turn_idx END AS owner FROM words),
    n AS (SELECT *, last_value(CASE WHEN owner IS NOT NULL THEN {{'o': owner, 't': end_s}} END IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY turn_idx, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
          first_value(CASE WHEN owner IS NOT NULL THEN {{'o': owner, 't': start_s}} END IGNORE NULLS) OVER (PARTITION BY call_id ORDER BY turn_idx, word_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM o),
    m AS (SELECT *, coalesce(start_s - b.t, 1e300) AS db, coalesce(a.t - end_s, 1e300) AS da FROM n),
    r AS (SELECT *, coalesce(owner, CASE WHEN b.o = a.o THEN b.o WHEN least(db, da) > 5.0 THEN NULL WHEN db < da THEN b.o ELSE a.o END) AS own FROM m)
    SELECT call_id, turn_idx, word_idx, own AS owner FROM r WHERE own IS NOT NULL""")
def owner_fill(spark, sf_dir):
    rows = words(spark, sf_dir).withColumn("owner", F.when(F.length("word") % 3 == 0, F.col("turn_idx")))
    return W.filled_owners(rows).select("call_id", "turn_idx", F.col("word_idx").cast("long").alias("word_idx"), "owner")


VOTES_SQL = r"""t AS (SELECT conv_id AS call_id, turn AS turn_idx, role AS speaker, text FROM conversations),
    rr AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER o THEN 0 ELSE 1 END AS b FROM t WINDOW o AS (PARTITION BY call_id ORDER BY turn_idx)),
    rn AS (SELECT *, sum(b) OVER (PARTITION BY call_id ORDER BY turn_idx) AS run FROM rr), rg AS (SELECT call_id, run, min(speaker) AS speaker FROM rn GROUP BY ALL),
    rk AS (SELECT call_id, run, coalesce(lead(speaker) OVER o, lag(speaker) OVER o) AS nearby FROM rg WINDOW o AS (PARTITION BY call_id ORDER BY run)),
    tn AS (SELECT rn.call_id, turn_idx, speaker, text, nearby FROM rn JOIN rk USING (call_id, run)),
    vv AS (SELECT call_id, turn_idx, speaker, unnest(regexp_extract_all(text, '(?:^|\. )([A-Z][a-z]+)', 1)) AS name, 3 AS votes FROM tn
           UNION ALL SELECT call_id, turn_idx, nearby, unnest(regexp_extract_all(text, '([A-Z][a-z]+)\.$', 1)), 1 FROM tn WHERE nearby IS NOT NULL),
    votes AS (SELECT call_id, speaker, upper(name[1:1]) || lower(name[2:]) AS name, CAST(sum(votes) AS BIGINT) AS votes, min(turn_idx) AS first_turn FROM vv WHERE lower(name) NOT IN ('the', 'a', 'of') AND name <> '' GROUP BY ALL)"""


def _votes(spark, sf_dir):
    turns = S.other_speaker_nearby(conversations(spark, sf_dir))
    return W.name_votes(turns, OPENING, ADDRESS, ["the", "a", "of"])


@query(f"WITH {VOTES_SQL} SELECT * FROM votes")
def name_votes(spark, sf_dir):
    return _votes(spark, sf_dir)


@query(f"""WITH {VOTES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY votes DESC, first_turn, name) AS k FROM votes WHERE votes >= 2),
    h AS (SELECT *, max(votes) OVER (PARTITION BY call_id, name) AS top FROM w WHERE k = 1), d AS (SELECT *, count(*) OVER (PARTITION BY call_id, name) AS heat FROM h WHERE votes = top)
    SELECT call_id, speaker, name, votes, CASE WHEN votes >= 3 THEN 'high' ELSE 'low' END AS confidence FROM d WHERE heat = 1""")
def guess_names(spark, sf_dir):
    return W.guessed_names(_votes(spark, sf_dir))
