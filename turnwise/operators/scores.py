"""Scores of segments as scores of turns, delivery features, coverage by audio, word intensity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from turnwise.functions.numbers import rounded


def turn_scores(segments: DataFrame, scored_seconds: float = 4.0, least_segment: float = 1.0) -> DataFrame:
    """A turn's score: null below scored_seconds of speech; that of the first segment measured over the turn, if there is one; else the
    mean over segments of at least least_segment, by their seconds. segments: call_id, turn_idx, seg_idx, seconds, score, measured."""
    long_ = (F.col("seconds") >= least_segment) & F.col("score").isNotNull()
    mean = F.try_divide(F.sum(F.when(long_, F.col("seconds") * F.col("score"))), F.sum(F.when(long_, F.col("seconds"))))
    made = segments.groupBy("call_id", "turn_idx").agg(F.sum("seconds").alias("_s"), F.bool_or("measured").alias("_m"), F.min_by("score", F.when(F.col("measured"), F.col("seg_idx"))).alias("_first"), mean.alias("_mean"))
    return made.select("call_id", "turn_idx", F.when(F.col("_s") >= scored_seconds, rounded(F.when(F.col("_m"), F.col("_first")).otherwise(F.col("_mean")), 3)).alias("score"))


def delivery(words: DataFrame, keys: list[str], per: int = 100) -> DataFrame:
    """Medial fillers, cutoffs and hedges a hundred words and articulation of each speaker; words have kind, medial, start_s and end_s."""
    n = F.count("*")
    rate = lambda c: rounded(per * F.count_if(c) / n, 2)
    spoken = F.sum((F.col("end_s") - F.col("start_s")).cast("decimal(18,3)")).cast("double")
    return words.groupBy(*keys).agg(n.alias("words"), rate(F.col("kind") == "filler").alias("fillers"), rate(F.col("kind") == "cutoff").alias("cutoffs"), rounded(F.try_divide(n, spoken / 60), 1).alias("articulation_wpm"))


def coverage(turns: DataFrame, tracks: DataFrame, slack: float = 1.0) -> DataFrame:
    """How many turns of each call lie within its track (begins, ends), and whether all do."""
    inside = (F.col("start_s") >= F.col("begins") - slack) & (F.col("end_s") <= F.col("ends") + slack)
    both = turns.join(tracks, "call_id")
    return both.groupBy("call_id").agg(F.count_if(inside).alias("covered"), F.count("*").alias("turns")).withColumn("complete", F.col("covered") == F.col("turns"))


def word_intensity(frames: DataFrame, words: DataFrame, least_frames: int = 9, least_words: int = 5, bin_frames: int = 256) -> DataFrame:
    """Loudness of the first and middle third of words against the whole word, in decibels: medians over a track's words.

    words: track, word, first and last (frames); those of fewer frames than least_frames don't count, nor tracks of fewer than least_words.
    Frames and words are joined on the track and bins of frames. A word's frames are added from its last to its first, so that sums don't
    depend on the order of rows.
    """
    bin_ = lambda c: F.floor(F.col(c) / bin_frames).cast("long")
    dealt = words.where("first <= last").withColumn("_bin", F.explode(F.sequence(bin_("first"), bin_("last"))))
    held = frames.withColumn("_bin", bin_("frame")).join(dealt, ["track", "_bin"]).where((F.col("frame") >= F.col("first")) & (F.col("frame") <= F.col("last")))
    third = F.floor(3 * (F.col("frame") - F.col("first")) / (F.col("last") - F.col("first") + 1))
    by_word = held.withColumn("_t", third).groupBy("track", "word").agg(F.count("*").alias("_n"), F.reverse(F.array_sort(F.collect_list(F.struct("frame", "_t", F.col("db").cast("double").alias("db"))))).alias("_f"))

    def mean(of=lambda f: f["db"].isNotNull()):
        values = F.transform(F.filter("_f", lambda f: of(f) & f["db"].isNotNull()), lambda f: f["db"])
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))

    by_word = by_word.select("track", "word", "_n", mean().alias("_m"), mean(lambda f: f["_t"] == 0).alias("_a"), mean(lambda f: f["_t"] == 1).alias("_b"))
    good = by_word.where(F.col("_n") >= least_frames)
    made = good.groupBy("track").agg(F.count("*").alias("words"), rounded(F.median(F.col("_a") - F.col("_m")), 2).alias("onset_db"), rounded(F.median(F.col("_b") - F.col("_m")), 2).alias("mid_db"))
    return made.where(F.col("words") >= least_words)


def steadier(current: DataFrame, usual: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """Whether each feature is steadier than usual: lower, or higher, by its direction; null where it is the same."""
    lower = F.col("feature").isin(*lower_is_better)
    both = current.join(usual, ["entity", "feature"])
    better = F.when(lower, F.col("value") < F.col("usual")).otherwise(F.col("value") > F.col("usual"))
    return both.withColumn("steadier", F.when(F.col("value") != F.col("usual"), better))


def enabled_models(models: DataFrame) -> DataFrame:
    return models.where(F.coalesce("enabled", F.lit(True)))


def repetitions(words: DataFrame) -> DataFrame:
    """Whether each word says the one before it again, or begins it anew (a cutoff that the next word goes on from)."""
    order = Window.partitionBy("call_id", "turn_idx").orderBy("word_idx")
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9']", "")
    own, before = bare(F.col("word")), bare(F.lag("word").over(order))
    again = (own != "") & (own == before)
    restart = F.lag("word").over(order).endswith("-") & (before != "") & F.startswith(own, before)
    return words.withColumn("repeats", F.coalesce(again | restart, F.lit(False)))
