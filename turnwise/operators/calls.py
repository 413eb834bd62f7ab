"""Facts of speakers and calls, view and context checks, marks and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.numbers import exact_sum, rounded
from turnwise.operators.segments import reply_latencies


def speaker_baselines(turns: DataFrame, scored_seconds: float = 4.0, least: int = 12) -> DataFrame:
    """Of each speaker of a call: turns, scored turns, speech, share of talk, medians, and scored turns if there are `least`."""
    late = reply_latencies(turns).withColumn("_total", exact_sum("speech_seconds").over(Window.partitionBy("call_id")).cast("double"))
    scored = F.count_if(F.col("speech_seconds") >= scored_seconds)
    return late.groupBy("call_id", "speaker").agg(
        F.count("*").alias("turns"), scored.alias("scored_turns"), rounded(exact_sum("speech_seconds"), 1).cast("double").alias("speech_seconds"),
        rounded(F.try_divide(exact_sum("speech_seconds").cast("double"), F.any_value("_total")), 3).alias("talk_share"), F.median("speech_seconds").alias("median_turn_seconds"),
        F.median("reply_latency").alias("median_reply_latency"), F.when(scored >= least, scored).otherwise(0).alias("baseline_turns"),
    )


def speaker_facts(turns: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Average turn, floor-takes and backchannels of each speaker; who has none has 0."""
    spoken = turns.groupBy("call_id", "speaker").agg(F.count("*").alias("turns"), rounded(F.try_divide(exact_sum("speech_seconds").cast("double"), F.count("*")), 1).alias("average_turn"))
    by = overlaps.groupBy("call_id", F.col("by").alias("speaker")).agg(F.count_if(F.col("kind") == "floor_taking").alias("floor_takes"), F.count_if(F.col("kind") == "backchannel").alias("backchannels"))
    return spoken.join(by, ["call_id", "speaker"], "left").na.fill(0, ["floor_takes", "backchannels"])


def sample_ranges(turns: DataFrame, least_total: float = 5.0, offset: float = 1.0, length: float = 3.0) -> DataFrame:
    """Three seconds, one into the longest turn of each speaker who speaks for least_total; from its start if it is too short."""
    best = F.row_number().over(Window.partitionBy("call_id", "speaker").orderBy(F.desc("speech_seconds"), "turn_idx"))
    total = F.sum("speech_seconds").over(Window.partitionBy("call_id", "speaker"))
    first = turns.withColumn("_k", best).withColumn("_total", total).where((F.col("_k") == 1) & (F.col("_total") >= least_total))
    start = F.when(F.col("end_s") - F.col("start_s") >= offset + length, F.col("start_s") + offset).otherwise(F.col("start_s"))
    return first.select("call_id", "speaker", "turn_idx", start.alias("sample_start"), F.least(start + length, F.col("end_s")).alias("sample_end"))


def near_duplicates_dropped(rows: DataFrame, others: DataFrame, within: float, at: str = "at_s") -> DataFrame:
    """Rows with none of the others of the call within so many seconds; joined on time bins of that width."""
    place = lambda c: F.floor(c / within).cast("long")
    around = others.select("call_id", F.col(at).alias("_at"), F.explode(F.array(place(F.col(at)) - 1, place(F.col(at)), place(F.col(at)) + 1)).alias("_bin"))
    marked = rows.withColumn("_bin", place(F.col(at)))
    near = (marked["call_id"] == around["call_id"]) & (marked["_bin"] == around["_bin"]) & (F.abs(marked[at] - around["_at"]) <= within)
    return marked.join(around, near, "left_anti").drop("_bin")


def view_index(turns: DataFrame) -> DataFrame:
    """Milliseconds, words and the gap before each turn (0 for the first)."""
    gap = F.col("start_s") - F.lag("end_s").over(Window.partitionBy("call_id").orderBy("turn_idx"))
    return turns.withColumn("start_ms", F.floor(F.col("start_s") * 1000)).withColumn("end_ms", F.floor(F.col("end_s") * 1000)).withColumn("gap_before_s", F.coalesce(rounded(gap, 2), F.lit(0.0)))


def inconsistent(a: DataFrame, b: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Turns that two views of a call don't agree on: missing, another speaker, or times apart."""
    left, right = a.select("call_id", "turn_idx", F.col("speaker").alias("a_speaker"), F.col("start_s").alias("a_start")), b.select("call_id", "turn_idx", F.col("speaker").alias("b_speaker"), F.col("start_s").alias("b_start"))
    both = left.join(right, ["call_id", "turn_idx"], "full")
    problem = F.when(F.col("a_speaker").isNull() | F.col("b_speaker").isNull(), "missing").when(F.col("a_speaker") != F.col("b_speaker"), "speaker").when(F.abs(F.col("a_start") - F.col("b_start")) > tolerance, "time")
    return both.withColumn("problem", problem).where("problem is not null").select("call_id", "turn_idx", "problem")


def tier_of(rows: DataFrame, value: str, tiers: list[tuple[str, float]]) -> DataFrame:
    """The first tier (in order) whose least value is reached; null if none."""
    out = F.lit(None).cast("string")
    for name, least in reversed(tiers):
        out = F.when(F.col(value) >= least, name).otherwise(out)
    return rows.withColumn("tier", out)


def progress(stages: DataFrame, weight: str, order: list[str], key: str) -> DataFrame:
    """Where each stage begins and ends as a share of the whole, by weights."""
    group = Window.partitionBy(key)
    total, done = F.sum(weight).over(group), F.sum(weight).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stages.withColumn("begins", rounded(F.try_divide(done - F.col(weight), total), 4)).withColumn("ends", rounded(F.try_divide(done, total), 4))


def context_problems(meeting_type: Column, goal: Column, consent: Column, types: list[str]) -> Column:
    """What is wrong with a context, in words; an empty array if nothing is."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(meeting_type.isin(*types), F.lit(False)), "meeting_type is not one of the known types"),
        F.when(F.coalesce(F.trim(goal), F.lit("")) == "", "goal is empty"),
        F.when(~F.coalesce(consent.isin("yes", "no", "unknown"), F.lit(False)), "consent is not yes, no or unknown"),
    ))


def with_names(turns: DataFrame, typed: DataFrame, guessed: DataFrame) -> DataFrame:
    """The name shown for each turn's speaker: the typed one, the guessed one with a ?, or the label."""
    names = typed.select("call_id", "speaker", F.col("name").alias("_typed")), guessed.select("call_id", "speaker", F.col("name").alias("_guessed"))
    both = turns.join(names[0], ["call_id", "speaker"], "left").join(names[1], ["call_id", "speaker"], "left")
    return both.withColumn("shown", F.coalesce("_typed", F.concat("_guessed", F.lit("?")), "speaker")).drop("_typed", "_guessed")


def topic_contrast(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """Departures a turn for each topic: spans (call_id, topic, first, last) of turns; a turn counts once for a topic.

    turns: call_id, turn_idx, observations (a count), scored ones of one speaker only. most and least mark the extremes of a call with two topics or more.
    """
    covered = spans.select("call_id", "topic", F.explode(F.sequence("first", "last")).alias("turn_idx")).distinct()
    rates = covered.join(turns, ["call_id", "turn_idx"]).groupBy("call_id", "topic").agg(F.count("*").alias("turns"), rounded(F.sum("observations") / F.count("*"), 2).alias("rate"))
    call = Window.partitionBy("call_id")
    enough = F.count("*").over(call) >= 2
    return rates.withColumn("most", enough & (F.row_number().over(call.orderBy(F.desc("rate"), "topic")) == 1)).withColumn("least", enough & (F.row_number().over(call.orderBy("rate", "topic")) == 1))


def stamped_back(segments: DataFrame, scores: DataFrame) -> DataFrame:
    """A turn's score on every segment of it: segments and scores have call_id and turn_idx."""
    return segments.join(scores, ["call_id", "turn_idx"], "left")


def merged_names(typed: DataFrame, guessed: DataFrame) -> DataFrame:
    """Typed names, and guesses of labels without one."""
    return typed.select("call_id", "speaker", "name").union(guessed.join(typed, ["call_id", "speaker"], "left_anti").select("call_id", "speaker", "name"))
