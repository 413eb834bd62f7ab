"""Checks of claims that cite turns, with a reason for every rejection, and ranked caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.lexicons import BANNED
from turnwise.functions.text import holds, normalised
from turnwise.operators.checking import channel_problems, speaker_problems

#: fixed values: the order in which a claim's first reason counts (of speaker, evidence, likelihood, alternatives, wording and caps)
REASONS = ("about_reader", "unknown_speaker", "no_baseline", "quote_mismatch", "convergence", "not_likely_enough", "no_alternative", "wording", "cap")
#: fixed values: likelihoods that may be shown, and the ranks by which caps choose
SHOWABLE = ("roughly even chance", "likely", "very likely")
CONFIDENCE_RANK, LIKELIHOOD_RANK = {"high": 2, "moderate": 1, "low": 0}, {"very likely": 2, "likely": 1, "roughly even chance": 0}
QUOTE_PROBLEMS = ("quote_mismatch", "quote_too_long")
GROUNDED = ("lexical", "interaction")


def check_evidence(evidence: DataFrame, turns: DataFrame, longest_quote: int = 25) -> DataFrame:
    """evidence (call_id, claim, turn_idx, claim_speaker, quote, channel) with problem: null if it holds.

    turn_missing, wrong_speaker, quote_too_long or quote_mismatch; an empty quote is no mismatch. Texts are met by the quotes that
    are left to check, each different one once, and put into the form of quotes only where they have its letters and digits in a row.
    """
    known = turns.select("call_id", "turn_idx", F.col("speaker").alias("_who"))
    quote = F.coalesce("quote", F.lit(""))
    words = F.size(F.filter(F.split(quote, r"[ \t\n]+"), lambda w: w != ""))
    asked = evidence.join(known, ["call_id", "turn_idx"], "left").withColumn("problem", F.when(F.col("_who").isNull(), "turn_missing").when(F.col("_who") != F.col("claim_speaker"), "wrong_speaker").when(words > longest_quote, "quote_too_long"))
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    told = asked.where("problem is null and quote <> ''").select("call_id", "turn_idx", "quote").distinct().withColumn("_q", normalised(F.col("quote")))
    said = told.where("_q <> ''").join(turns.select("call_id", "turn_idx", "text"), ["call_id", "turn_idx"])
    near = F.contains(bare("text"), bare("_q"))
    said = said.select("call_id", "turn_idx", "quote", (near & holds(F.when(near, normalised(F.col("text"))), F.col("_q"))).alias("_held"))
    return asked.join(said, ["call_id", "turn_idx", "quote"], "left").withColumn("problem", F.when(F.col("problem").isNull() & ~F.col("_held"), "quote_mismatch").otherwise(F.col("problem"))).select(*evidence.columns, "problem")


def claim_reasons(claims: DataFrame, evidence: DataFrame, showable: list[str], banned: str) -> DataFrame:
    """Each claim's first reason against it, null if none: claims (call_id, claim, has_baseline, likelihood, alternatives, text).

    Evidence must converge: two channels of what holds, one of them lexical or interaction. Where it doesn't and a
    quote was rejected, that is the reason.
    """
    sound = F.when(F.col("problem").isNull(), F.col("channel"))
    seen = evidence.groupBy("call_id", "claim").agg(F.array_sort(F.collect_set(sound)).alias("channels"), F.coalesce(F.bool_or(F.col("problem") == "quote_mismatch"), F.lit(False)).alias("_quote"))
    both = claims.join(seen, ["call_id", "claim"], "left")
    channels = F.coalesce("channels", F.array().cast("array<string>"))
    apart = ~((F.size(channels) >= 2) & F.arrays_overlap(channels, F.array(*map(F.lit, GROUNDED))))
    reason = (
        F.when(~F.col("has_baseline"), "no_baseline")
        .when(apart, F.when(F.coalesce("_quote", F.lit(False)), "quote_mismatch").otherwise("convergence"))
        .when(~F.coalesce(F.col("likelihood").isin(*showable), F.lit(False)), "not_likely_enough")
        .when(F.size(F.filter("alternatives", lambda a: F.trim(a) != "")) <= 0, "no_alternative")
        .when(F.col("text").rlike(banned), "wording")
    )
    return both.withColumn("reason", reason).withColumn("channels", channels).drop("_quote")


def ranked_caps(kept: DataFrame, order: list[Column], a_speaker: int = 3, a_call: int = 8) -> DataFrame:
    """Adds place and capped: the first a_speaker of each speaker by order, and of those the first a_call of a call."""
    own = F.row_number().over(Window.partitionBy("call_id", "speaker").orderBy(*order))
    ranked = kept.withColumn("_own", own).withColumn("_in", (F.col("_own") <= a_speaker).cast("int"))
    among = F.row_number().over(Window.partitionBy("call_id", "_in").orderBy(*order))
    return ranked.withColumn("place", among.cast("long")).withColumn("capped", (F.col("_in") == 0) | (F.col("place") > a_call)).drop("_own", "_in")


def accounting(reasons: DataFrame) -> DataFrame:
    """Claims of each call: proposed, kept and dropped by reason (long form; reason null is kept)."""
    return reasons.groupBy("call_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("claims"))


def audio_range(evidence: DataFrame, turns: DataFrame, before: int = 1500, longest: int = 60_000) -> DataFrame:
    """Milliseconds to play for each claim: from before its first turn to the end of its last, `longest` at most."""
    timed = evidence.join(turns.select("call_id", "turn_idx", "start_ms", "end_ms"), ["call_id", "turn_idx"])
    low = F.greatest(F.min("start_ms") - before, F.lit(0))
    return timed.groupBy("call_id", "claim").agg(low.alias("from_ms"), F.least(F.max("end_ms"), low + longest).alias("to_ms"))


def slots(template: Column, given: Column) -> tuple[Column, Column]:
    """Names of {{slots}} in a template that aren't given, and given names that it hasn't."""
    named = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{([a-z_]+)\}\}"), F.lit(1)))
    return F.array_sort(F.array_except(named, given)), F.array_sort(F.array_except(given, named))


def verified(
    claims: DataFrame, evidence: DataFrame, turns: DataFrame, moments: DataFrame, speakers: DataFrame, readers: DataFrame,
    showable: tuple[str, ...] = SHOWABLE, banned: str = BANNED, a_speaker: int = 3, a_call: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """(claims, evidence) of replies after all rules: claims with reason (null: kept), channels and shown_place among the kept; evidence with problem.

    claims: call_id, claim, place (in the reply), speaker, text, follow_up, likelihood, evidence_confidence, alternatives. evidence: call_id,
    claim, item, turn_idx, quote, channel, description, moments (array of ids). turns: call_id, turn_idx, speaker, text, words (array of
    norm, kind), reply_latency, pauses (array of seconds), overlapped. moments: call_id, moment_id, turn_idx, features. speakers: call_id,
    speaker, baseline_turns, median_reply_latency. readers: call_id, me.

    In order: the speaker; then, of those left, each item's turn, speaker, quote and channel; two channels of what holds, one of them lexical
    or interaction (a rejected quote is the reason, if there is one); likelihood; an alternative; the wording of claim, follow-up and
    alternatives; at last a_speaker claims of a speaker and a_call of a call, best evidenced first. Evidence of claims that fall by
    their speaker isn't looked at, and isn't in the result.
    """
    key = ["call_id", "claim"]
    spoken = speaker_problems(claims, speakers, readers).withColumnRenamed("problem", "_speaker")
    asked = evidence.join(spoken.where("_speaker is null").select(*key, F.col("speaker").alias("claim_speaker")), key)
    checked = check_evidence(asked, turns)
    good = checked.where("problem is null").drop("problem", "claim_speaker").withColumn("matched", F.trim(F.coalesce("quote", F.lit(""))) != "")
    usual = speakers.select("call_id", "speaker", F.col("median_reply_latency").alias("median_latency"))
    view = turns.join(usual, ["call_id", "speaker"], "left").select("call_id", "turn_idx", "words", "reply_latency", "median_latency", "pauses", "overlapped")
    items = channel_problems(good, view, moments).select(*evidence.columns, "problem").unionByName(checked.where("problem is not null").select(*evidence.columns, "problem"))
    sound = F.when(F.col("problem").isNull(), F.col("channel"))
    seen = items.groupBy(*key).agg(F.array_sort(F.collect_set(sound)).alias("channels"), F.bool_or(F.coalesce(F.col("problem").isin(*QUOTE_PROBLEMS), F.lit(False))).alias("_quote"))
    both = spoken.join(seen, key, "left").withColumn("channels", F.coalesce("channels", F.array().cast("array<string>")))
    apart = ~((F.size("channels") >= 2) & F.arrays_overlap("channels", F.array(*map(F.lit, GROUNDED))))
    others = F.filter(F.coalesce("alternatives", F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit(""))) != "")
    said = F.concat(F.array(F.coalesce("text", F.lit("")), F.coalesce("follow_up", F.lit(""))), others)
    reason = (
        F.when(F.col("_speaker").isNotNull(), F.col("_speaker"))
        .when(apart, F.when(F.coalesce("_quote", F.lit(False)), "quote_mismatch").otherwise("convergence"))
        .when(~F.coalesce(F.col("likelihood").isin(*showable), F.lit(False)), "not_likely_enough")
        .when(F.size(others) == 0, "no_alternative")
        .when(F.exists(said, lambda t: t.rlike(banned)), "wording")
    )
    judged = both.withColumn("reason", reason)
    rank = lambda c, ranks: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in ranks.items()), F.lit(0))
    order = [rank("evidence_confidence", CONFIDENCE_RANK).desc(), F.size("channels").desc(), rank("likelihood", LIKELIHOOD_RANK).desc(), F.col("place"), F.col("claim")]
    kept = ranked_caps(judged.where("reason is null").withColumnRenamed("place", "_place").withColumn("place", F.col("_place")), order, a_speaker, a_call).select(*key, F.col("place").alias("shown_place"), "capped")
    out = judged.join(kept, key, "left").withColumn("reason", F.when(F.coalesce("capped", F.lit(False)), "cap").otherwise(F.col("reason"))).withColumn("shown_place", F.when(F.col("reason").isNull(), F.col("shown_place")))
    return out.select(*claims.columns, "channels", "reason", "shown_place"), items
