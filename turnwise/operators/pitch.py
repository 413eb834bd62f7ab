"""Pitch by the difference of a signal and its shifted self, over chunks of samples of a track."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Seconds between frames and of a window, the range of pitch, the depth of a dip, lags to its bottom.
HOP, WINDOW, LOWEST, HIGHEST, DIP, DESCENT = 0.01, 0.04, 60.0, 400.0, 0.15, 32


def pitch_frames(signal: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hertz, confidence and root mean square of each frame that lies, with the longest lag after it, within the signal."""
    hop, window, least, most = round(HOP * rate), round(WINDOW * rate), max(1, int(rate / HIGHEST)), int(rate / LOWEST)
    reach = window + most
    if len(signal) < reach:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(signal, np.float64), reach)[::hop]
    size = 1 << (reach + window - 1).bit_length()
    product = np.fft.irfft(np.fft.rfft(frames[:, :window], size).conj() * np.fft.rfft(frames, size), size)[:, : most + 1]
    energy = np.lib.stride_tricks.sliding_window_view(frames**2, window, axis=1).sum(2)
    difference = np.maximum(energy[:, :1] + energy - 2 * product, 0)[:, 1:]
    mean = np.cumsum(difference, 1) / np.arange(1, most + 1)
    ratio = (difference / np.where(mean > 0, mean, 1e-9))[:, least - 1 :]
    row = np.arange(len(ratio))
    low = ratio < DIP
    first = np.where(low.any(1), low.argmax(1), ratio.argmin(1))
    # down to the bottom of that dip, then to between the samples by a parabola
    ahead = np.minimum(first[:, None] + np.arange(DESCENT), ratio.shape[1] - 1)
    bottom = ahead[row, ratio[row[:, None], ahead].argmin(1)]
    before, at, after = (ratio[row, np.clip(bottom + d, 0, ratio.shape[1] - 1)] for d in (-1, 0, 1))
    bend = before - 2 * at + after
    shift = np.divide(before - after, 2 * bend, out=np.zeros(len(bend)), where=np.abs(bend) > 1e-12)
    lag = np.maximum(least + bottom + np.clip(shift, -1, 1), least)
    return rate / lag, np.clip(1 - at, 0, 1), np.sqrt((frames[:, :window] ** 2).mean(1))


def overlapped(samples: DataFrame, rate: int, seconds: float = 10.0) -> DataFrame:
    """(track, chunk, frame, x): samples (track, i, x) dealt to chunks of this length, each with what its last frames reach."""
    hop = round(HOP * rate)
    length = max(1, round(seconds / HOP)) * hop
    # frames begin every hop; the last of a chunk begins a hop before its end, and reaches a window and the longest lag from there
    reach = round(WINDOW * rate) + int(rate / LOWEST) - hop
    first = F.greatest(F.lit(0), F.ceil((F.col("i") + 1 - F.lit(length + reach)) / F.lit(length)))
    return samples.select("track", "i", "x", F.explode(F.sequence(first.cast("long"), F.floor(F.col("i") / length).cast("long"))).alias("chunk")).withColumn("first", F.col("chunk") * F.lit(length // hop))


def tracked(samples: DataFrame, rate: int, seconds: float = 10.0) -> DataFrame:
    """(track, frame, f0, confidence, rms) of samples (track, i from 0, x).

    A task holds one chunk of a track at a time, with the overlap that its last frames need, so a track may have any
    length. Null samples are silence; a track shorter than a window and the longest lag has no frames.
    """

    def run(key, table):
        order = np.argsort(table.column("i").to_numpy(), kind="stable")
        x = np.nan_to_num(table.column("x").to_numpy().astype(float)[order])
        first = int(table.column("first")[0].as_py())
        f0, confidence, rms = pitch_frames(x, rate)
        own = round(seconds / HOP)
        n = min(len(f0), own)
        return pa.table({"track": pa.array([key[0].as_py()] * n, table.schema.field("track").type), "frame": pa.array(first + np.arange(n)), "f0": f0[:n], "confidence": confidence[:n], "rms": rms[:n]})

    kind = samples.schema["track"].dataType.simpleString()
    return overlapped(samples, rate, seconds).groupBy("track", "chunk").applyInArrow(run, f"track {kind}, frame long, f0 double, confidence double, rms double")
