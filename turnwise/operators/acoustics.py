"""Frame features: despiking, energy, semitones, pooled statistics, linear scores.

Frames have track, frame and values; energy and medians are windows of frames of a track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.numbers import rounded


def despiked(frames: DataFrame, value: str = "f0", voiced: str = "voiced", reach: int = 2) -> DataFrame:
    """Each value as the median of the voiced ones within `reach` frames; itself where there are none, or in tracks of under five frames."""
    track = Window.partitionBy("track")
    near = track.orderBy("frame").rowsBetween(-reach, reach)
    middle = F.percentile(F.when(F.col(voiced), F.col(value)), F.lit(0.5)).over(near)
    smooth = F.when(F.count("*").over(track) >= 5, F.coalesce(middle, F.col(value))).otherwise(F.col(value))
    return frames.withColumn("smooth", smooth)


def frame_energy(samples: DataFrame, window: int, value: str = "x") -> DataFrame:
    """Root mean square of each window of samples from this one on; null where the track ends sooner."""
    ahead = Window.partitionBy("track").orderBy("frame").rowsBetween(0, window - 1)
    mean = F.sum(F.col(value) * F.col(value)).over(ahead) / window
    return samples.withColumn("rms", F.when(F.count("*").over(ahead) == window, F.sqrt(mean)))


def pitch_summary(frames: DataFrame, least: int = 12, below_peak: float = 45.0) -> DataFrame:
    """Of each track: median pitch, p10-p90 range in semitones, spread of loudness over audible frames, share voiced.

    Audible is above the peak less below_peak decibels; voiced is marked and audible; tracks with fewer voiced frames than `least` give nothing.
    """
    peak = F.max("db").over(Window.partitionBy("track"))
    marked = frames.withColumn("_a", F.col("db") > peak - below_peak).withColumn("_v", F.col("voiced") & F.col("_a"))
    pitch = F.when(F.col("_v"), F.col("f0"))
    made = marked.groupBy("track").agg(F.count_if("_v").alias("_n"), F.count("*").alias("_all"), F.median(pitch).alias("_m"), F.percentile(pitch, F.lit(0.1)).alias("_lo"), F.percentile(pitch, F.lit(0.9)).alias("_hi"), F.stddev_pop(F.when(F.col("_a"), F.col("db"))).alias("_sd"))
    return made.where(F.col("_n") >= least).select("track", rounded("_m", 1).alias("f0_median"), rounded(12 * F.log2(F.col("_hi") / F.col("_lo")), 2).alias("range_semitones"), rounded("_sd", 2).alias("loudness_sd"), rounded(F.col("_n") / F.col("_all"), 3).alias("voiced_share"))


def terminal_rise(frames: DataFrame, tail: int = 40, least: int = 12) -> DataFrame:
    """Semitones from the body of a track to its last `tail` frames, of voiced medians; null unless both have `least`."""
    last = F.max(F.when(F.col("voiced"), F.col("frame"))).over(Window.partitionBy("track"))
    late = F.col("frame") >= last - tail
    voiced = frames.withColumn("_late", late).where("voiced")
    made = voiced.groupBy("track").agg(F.count_if("_late").alias("_t"), F.count_if(~F.col("_late")).alias("_b"), F.median(F.when(F.col("_late"), F.col("f0"))).alias("_mt"), F.median(F.when(~F.col("_late"), F.col("f0"))).alias("_mb"))
    enough = (F.col("_t") >= least) & (F.col("_b") >= least)
    return made.select("track", F.when(enough, rounded(12 * F.log2(F.col("_mt") / F.col("_mb")), 2)).alias("terminal_rise"))


def pooled(vectors: DataFrame, key: str, vector: str, places: int = 4) -> DataFrame:
    """Mean and population deviation of each component."""
    long_ = vectors.select(key, F.posexplode(vector).alias("component", "_x"))
    return long_.groupBy(key, "component").agg(rounded(F.avg(F.col("_x").cast("double")), places).alias("mean"), rounded(F.stddev_pop(F.col("_x").cast("double")), places).alias("deviation"))


def linear_scores(vector: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Softmax probabilities of a linear layer over an array column."""
    dots = [F.aggregate(F.zip_with(vector, F.array(*map(F.lit, map(float, w))), lambda x, y: x.cast("double") * y), F.lit(float(b)), lambda a, x: a + x) for w, b in zip(weights, bias)]
    z = F.array(*dots)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)
