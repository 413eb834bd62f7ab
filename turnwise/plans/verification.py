"""Queries over claims made of the tables: an order is a call's claim, its lines are evidence that cites turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import verifying as V
from turnwise.registry import query
from turnwise.plans.texts import NORM_SQL
from turnwise.sources.tables import conversations, read

CHANNELS = ["lexical", "timing", "prosody", "interaction"]
SHOWABLE, BANNED = ["2-HIGH", "1-URGENT", "3-MEDIUM"], "(?i)(ee|zz)"
EVIDENCE_SQL = f"""n AS (SELECT conv_id AS call_id, turn AS turn_idx, role AS speaker, {NORM_SQL.replace('{t}', 'text')} AS t FROM conversations),
    c AS (SELECT max(conv_id) + 1 AS m FROM conversations),
    ev AS (SELECT l_orderkey % m AS call_id, l_orderkey AS claim, l_linenumber - 1 AS turn_idx, CASE WHEN l_linestatus = 'O' THEN 'user' ELSE 'assistant' END AS claim_speaker,
        CASE WHEN l_partkey % 3 = 0 THEN 'the' WHEN l_partkey % 3 = 1 THEN '' ELSE 'Of' END AS quote, CASE l_suppkey % 4 WHEN 0 THEN 'lexical' WHEN 1 THEN 'timing' WHEN 2 THEN 'prosody' ELSE 'interaction' END AS channel FROM lineitem, c),
    ck AS (SELECT ev.*, CASE WHEN n.speaker IS NULL THEN 'turn_missing' WHEN n.speaker <> claim_speaker THEN 'wrong_speaker' WHEN quote <> '' AND NOT contains(' ' || n.t || ' ', ' ' || lower(quote) || ' ') THEN 'quote_mismatch' END AS problem
        FROM ev LEFT JOIN n USING (call_id, turn_idx))"""
REASON_SQL = f"""{EVIDENCE_SQL}, ch AS (SELECT call_id, claim, list_sort(list(DISTINCT channel) FILTER (problem IS NULL)) AS channels, coalesce(bool_or(problem = 'quote_mismatch'), false) AS q FROM ck GROUP BY ALL),
    cl AS (SELECT o_orderkey % m AS call_id, o_orderkey AS claim, o_custkey % 10 <> 0 AS has_baseline, o_orderpriority AS likelihood, o_orderkey % 7 <> 0 AS alt, printf('%x', o_orderkey) AS body, o_totalprice, o_orderstatus AS speaker FROM orders, c),
    rs AS (SELECT cl.*, CASE WHEN NOT has_baseline THEN 'no_baseline' WHEN NOT (len(coalesce(channels, [])) >= 2 AND (list_contains(coalesce(channels, []), 'lexical') OR list_contains(coalesce(channels, []), 'interaction'))) THEN CASE WHEN coalesce(q, false) THEN 'quote_mismatch' ELSE 'convergence' END
        WHEN likelihood NOT IN ('2-HIGH', '1-URGENT', '3-MEDIUM') THEN 'not_likely_enough' WHEN NOT alt THEN 'no_alternative' WHEN regexp_matches(body, '(?i)(ee|zz)') THEN 'wording' END AS reason FROM cl LEFT JOIN ch USING (call_id, claim))"""
CAPS_SQL = f"""{REASON_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY o_totalprice DESC, claim) AS own FROM rs WHERE reason IS NULL),
    caps AS (SELECT call_id, claim, row_number() OVER (PARTITION BY call_id, own <= 3 ORDER BY o_totalprice DESC, claim) AS place, own FROM p)"""


def _modulus(spark, sf_dir):
    return F.broadcast(read(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("m")))


def _evidence(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").crossJoin(_modulus(spark, sf_dir))
    channel = F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    quote = F.when(F.col("l_partkey") % 3 == 0, "the").when(F.col("l_partkey") % 3 == 1, "").otherwise("Of")
    made = line.select((F.col("l_orderkey") % F.col("m")).alias("call_id"), F.col("l_orderkey").alias("claim"), (F.col("l_linenumber") - 1).cast("long").alias("turn_idx"), F.when(F.col("l_linestatus") == "O", "user").otherwise("assistant").alias("claim_speaker"), quote.alias("quote"), channel.alias("channel"))
    return V.check_evidence(made, conversations(spark, sf_dir))


def _reasons(spark, sf_dir):
    order = read(spark, sf_dir, "orders").crossJoin(_modulus(spark, sf_dir))
    claims = order.select((F.col("o_orderkey") % F.col("m")).alias("call_id"), F.col("o_orderkey").alias("claim"), (F.col("o_custkey") % 10 != 0).alias("has_baseline"), F.col("o_orderpriority").alias("likelihood"), F.array(F.when(F.col("o_orderkey") % 7 != 0, "other").otherwise(" ")).alias("alternatives"), F.lower(F.hex("o_orderkey")).alias("text"), "o_totalprice", F.col("o_orderstatus").alias("speaker"))
    return V.claim_reasons(claims, _evidence(spark, sf_dir), SHOWABLE, BANNED)


def _capped(spark, sf_dir):
    return V.ranked_caps(_reasons(spark, sf_dir).where("reason is null"), [F.desc("o_totalprice"), F.col("claim")])


@query(f"WITH {EVIDENCE_SQL} SELECT coalesce(problem, 'holds') AS problem, channel, count(*) AS items FROM ck GROUP BY ALL")
def vf_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).groupBy(F.coalesce("problem", F.lit("holds")).alias("problem"), "channel").agg(F.count("*").alias("items"))


@query(f"WITH {EVIDENCE_SQL} SELECT call_id, claim, turn_idx, quote, problem FROM ck WHERE problem = 'quote_mismatch'")
def vf_quote(spark, sf_dir):
    return _evidence(spark, sf_dir).where("problem = 'quote_mismatch'").select("call_id", "claim", "turn_idx", "quote", "problem")


@query(f"WITH {REASON_SQL} SELECT call_id, claim, reason FROM rs")
def vf_convergence(spark, sf_dir):
    return _reasons(spark, sf_dir).select("call_id", "claim", "reason")


@query(f"WITH {REASON_SQL} SELECT call_id, coalesce(reason, 'kept') AS reason, count(*) AS claims FROM rs GROUP BY ALL")
def vf_accounting(spark, sf_dir):
    return V.accounting(_reasons(spark, sf_dir))


@query(f"WITH {CAPS_SQL} SELECT call_id, claim, place, own > 3 OR place > 8 AS capped FROM caps")
def ranked_caps(spark, sf_dir):
    return _capped(spark, sf_dir).select("call_id", "claim", "place", "capped")


@query("""WITH t AS (SELECT o_orderkey AS claim, min(l_linenumber) * 1000 AS a, max(l_linenumber) * 1000 + CAST(max(l_quantity) * 1000 AS BIGINT) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT claim, greatest(a - 1500, 0) AS from_ms, least(b, greatest(a - 1500, 0) + 30000) AS to_ms FROM t""")
def vf_audio_range(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg((F.min("l_linenumber") * 1000).cast("long").alias("start_ms"), (F.max("l_linenumber") * 1000 + (F.max("l_quantity") * 1000).cast("long")).alias("end_ms"))
    turns = line.select(F.lit("c").alias("call_id"), F.col("claim").alias("turn_idx"), "start_ms", "end_ms")
    evidence = read(spark, sf_dir, "orders").select(F.lit("c").alias("call_id"), F.col("o_orderkey").alias("claim"), F.col("o_orderkey").alias("turn_idx"))
    return V.audio_range(evidence, turns, longest=30_000).select("claim", "from_ms", "to_ms")


@query("""WITH r AS (SELECT conv_id, turn, '```json' || chr(10) || text || '{"a": 1}' || chr(10) || '```' AS reply FROM conversations), b AS (SELECT *, regexp_replace(reply, '```[a-z]*', '', 'g') AS s FROM r)
    SELECT conv_id, turn, CASE WHEN instr(s, '{') > 0 THEN s[instr(s, '{'):length(s) - instr(reverse(s), '}') + 1] END AS body FROM b""")
def strip_response(spark, sf_dir):
    reply = F.concat(F.lit("```json\n"), F.col("text"), F.lit('{"a": 1}\n```'))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.json_object(reply).alias("body"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'topics' ELSE '' END AS missing, CASE WHEN user_id % 2 = 0 THEN 'extra' ELSE '' END AS unknown FROM events")
def slot_diff(spark, sf_dir):
    template = F.concat(F.lit("a {{goal}} "), F.when(F.col("event_type") == "view", "{{topics}}").otherwise(""))
    given = F.filter(F.array(F.lit("goal"), F.when(F.col("user_id") % 2 == 0, "extra")), lambda x: x.isNotNull())
    missing, unknown = V.slots(template, given)
    return read(spark, sf_dir, "events").select("event_id", F.array_join(missing, ",").alias("missing"), F.array_join(unknown, ",").alias("unknown"))


CHECKED_CHANNELS = ("lexical", "timing", "prosody", "interaction", "disfluency", "smell")
LONG_QUOTE = " ".join(["the"] * 26)
VERIFIED_SQL = f"""n AS (SELECT conv_id AS call_id, turn AS turn_idx, role AS speaker, {NORM_SQL.replace('{t}', 'text')} AS t FROM conversations),
    c AS (SELECT max(conv_id) + 1 AS m FROM conversations),
    cl AS (SELECT o_orderkey % 40 AS call_id, o_orderkey AS claim, CASE WHEN o_orderkey % 9 = 1 THEN 'nobody' WHEN o_custkey % 2 = 0 THEN 'user' ELSE 'assistant' END AS speaker, CASE o_custkey % 7 WHEN 0 THEN 'unlikely' WHEN 1 THEN 'very likely' WHEN 2 THEN 'roughly even chance' ELSE 'likely' END AS likelihood,
        CASE o_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'low' END AS conf, o_orderkey % 7 <> 0 AS alt, o_orderkey % 11 = 0 AS bad FROM orders WHERE o_orderkey % 40 IN (SELECT conv_id FROM conversations)),
    sp AS (SELECT cl.*, CASE WHEN call_id % 4 = 0 AND speaker = 'user' THEN 'about_reader' WHEN speaker = 'nobody' THEN 'unknown_speaker' WHEN call_id % 10 = 3 THEN 'no_baseline' END AS who FROM cl),
    ev AS (SELECT sp.call_id, claim, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS item, sp.speaker, l_linenumber - 1 AS turn_idx, CASE WHEN l_suppkey % 17 = 0 THEN '{LONG_QUOTE}' WHEN l_partkey % 3 = 0 THEN 'The' WHEN l_partkey % 3 = 1 THEN '' ELSE 'of' END AS quote,
        ['{"', '".join(CHECKED_CHANNELS)}'][l_suppkey % 6 + 1] AS channel, l_quantity % 2 = 0 AS over, l_partkey % 4 AS mo FROM lineitem JOIN sp ON l_orderkey = claim WHERE who IS NULL),
    ck AS (SELECT ev.*, CASE WHEN n.speaker IS NULL THEN 'turn_missing' WHEN n.speaker <> ev.speaker THEN 'wrong_speaker' WHEN quote = '{LONG_QUOTE}' THEN 'quote_too_long' WHEN quote <> '' AND NOT contains(' ' || n.t || ' ', ' ' || lower(quote) || ' ') THEN 'quote_mismatch' END AS p FROM ev LEFT JOIN n USING (call_id, turn_idx)),
    ch AS (SELECT call_id, claim, item, CASE WHEN p IS NOT NULL THEN p WHEN channel = 'prosody' AND NOT (mo = turn_idx % 4 AND turn_idx % 3 = 1) THEN 'prosody_unsupported' WHEN channel = 'disfluency' AND NOT (mo = turn_idx % 4 AND turn_idx % 3 = 0) THEN 'disfluency_unsupported'
        WHEN channel = 'timing' AND NOT (turn_idx >= 3 OR call_id % 5 = 0) THEN 'timing_unsupported' WHEN channel = 'lexical' AND quote = '' THEN 'lexical_needs_quote' WHEN channel = 'interaction' AND over AND turn_idx % 2 = 1 THEN 'interaction_unsupported' WHEN channel = 'smell' THEN 'unknown_channel' END AS problem, channel FROM ck),
    se AS (SELECT call_id, claim, list_sort(list(DISTINCT channel) FILTER (problem IS NULL)) AS channels, bool_or(coalesce(problem IN ('quote_mismatch', 'quote_too_long'), false)) AS q FROM ch GROUP BY ALL),
    rs AS (SELECT sp.*, coalesce(channels, []) AS channels, CASE WHEN who IS NOT NULL THEN who WHEN NOT (len(coalesce(channels, [])) >= 2 AND (list_contains(coalesce(channels, []), 'lexical') OR list_contains(coalesce(channels, []), 'interaction'))) THEN CASE WHEN coalesce(q, false) THEN 'quote_mismatch' ELSE 'convergence' END
        WHEN likelihood = 'unlikely' THEN 'not_likely_enough' WHEN NOT alt THEN 'no_alternative' WHEN bad THEN 'wording' END AS reason FROM sp LEFT JOIN se USING (call_id, claim)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY call_id, reason IS NULL, speaker ORDER BY CASE conf WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END DESC, len(channels) DESC, CASE likelihood WHEN 'very likely' THEN 2 WHEN 'likely' THEN 1 ELSE 0 END DESC, claim) AS own FROM rs),
    rp AS (SELECT *, row_number() OVER (PARTITION BY call_id, reason IS NULL AND own <= 3 ORDER BY CASE conf WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END DESC, len(channels) DESC, CASE likelihood WHEN 'very likely' THEN 2 WHEN 'likely' THEN 1 ELSE 0 END DESC, claim) AS place FROM rk),
    vc AS (SELECT call_id, claim, array_to_string(channels, ',') AS channels, CASE WHEN reason IS NULL AND (own > 3 OR place > 4) THEN 'cap' ELSE reason END AS reason, CASE WHEN reason IS NULL AND own <= 3 AND place <= 4 THEN place ELSE 0 END AS shown_place FROM rp)"""


def _verified(spark, sf_dir):
    spoken = conversations(spark, sf_dir)
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    call = (F.col("o_orderkey") % 40).alias("call_id")
    claims = read(spark, sf_dir, "orders").select(
        call, F.col("o_orderkey").alias("claim"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderkey") % 9 == 1, "nobody").when(F.col("o_custkey") % 2 == 0, "user").otherwise("assistant").alias("speaker"), F.lit("a claim").alias("text"),
        F.when(F.col("o_orderkey") % 11 == 0, "Is he HIDING it?").otherwise("and then?").alias("follow_up"), pick(("unlikely", "very likely", "roughly even chance", "likely", "likely", "likely", "likely"), F.col("o_custkey") % 7).alias("likelihood"),
        pick(("high", "moderate", "low"), F.col("o_custkey") % 3).alias("evidence_confidence"), F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.lit("other"))).alias("alternatives"),
    ).join(spoken.select("call_id").distinct(), "call_id", "left_semi")
    evidence = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("call_id"), F.col("l_orderkey").alias("claim"), ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("item"), (F.col("l_linenumber") - 1).cast("long").alias("turn_idx"),
        F.when(F.col("l_suppkey") % 17 == 0, LONG_QUOTE).when(F.col("l_partkey") % 3 == 0, "The").when(F.col("l_partkey") % 3 == 1, "").otherwise("of").alias("quote"), pick(CHECKED_CHANNELS, F.col("l_suppkey") % 6).alias("channel"),
        F.when(F.col("l_quantity") % 2 == 0, "they talked over it").otherwise("a turn").alias("description"), F.array(F.concat(F.lit("M"), (F.col("l_partkey") % 4).cast("string"))).alias("moments"),
    )
    turns = spoken.select(
        "call_id", "turn_idx", "speaker", "text", F.array().cast("array<struct<norm:string,kind:string>>").alias("words"), F.col("turn_idx").cast("double").alias("reply_latency"),
        F.when(F.col("call_id") % 5 == 0, F.array(F.lit(2.5))).otherwise(F.array(F.lit(1.0))).alias("pauses"), (F.col("turn_idx") % 2 == 0).alias("overlapped"),
    )
    features = F.when(F.col("turn_idx") % 3 == 0, F.array(F.lit("medial_fillers"))).when(F.col("turn_idx") % 3 == 1, F.array(F.lit("arousal"))).otherwise(F.array(F.lit(None).cast("string")))
    moments = spoken.select("call_id", F.concat(F.lit("M"), (F.col("turn_idx") % 4).cast("string")).alias("moment_id"), "turn_idx", features.alias("features"))
    speakers = spoken.select("call_id").distinct().select("call_id", F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("speaker"), F.when(F.col("call_id") % 10 == 3, 0).otherwise(12).alias("baseline_turns"), F.lit(1.0).alias("median_reply_latency"))
    readers = spoken.where("call_id % 4 = 0").select("call_id", F.lit("user").alias("me")).distinct()
    return V.verified(claims, evidence, turns, moments, speakers, readers, a_call=4)


@query(f"WITH {VERIFIED_SQL} SELECT * FROM vc")
def verified_replies(spark, sf_dir):
    return _verified(spark, sf_dir)[0].select("call_id", "claim", F.array_join("channels", ",").alias("channels"), "reason", F.coalesce("shown_place", F.lit(0)).alias("shown_place"))


@query(f"WITH {VERIFIED_SQL} SELECT call_id, claim, item, problem FROM ch")
def verified_evidence(spark, sf_dir):
    return _verified(spark, sf_dir)[1].select("call_id", "claim", "item", "problem")
