"""Segment files as tables, and tables as files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnwise.functions.numbers import rounded

WORD = "struct<word:string,start:double,end:double,speaker:string,kind:string,score:double>"
SEGMENT = f"struct<start:double,end:double,speaker:string,text:string,words:array<{WORD}>,pacing:struct<word_count:int,duration_seconds:double,wpm:double>,emotion:struct<valence:double,arousal:double,dominance:double,measured_over:array<double>>,stance:struct<certainty:double,measured_over:array<double>>>"


def segment_files(spark: SparkSession, path: str) -> DataFrame:
    """call_id (the file's stem), seg_idx and the fields of each segment of files that hold a JSON list; other files give no rows.

    A file is one value, so that the place in its list is certain; unknown fields are dropped, missing ones null.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("call_id"), F.from_json("value", f"array<{SEGMENT}>").alias("list"))
    return files.select("call_id", F.posexplode("list").alias("seg_idx", "s")).select("call_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.speaker", "s.text", "s.words", "s.pacing", "s.emotion", "s.stance")


def call_meta(segments: DataFrame) -> DataFrame:
    """Length, speakers and segments of each call."""
    return segments.groupBy("call_id").agg(F.max("end_s").alias("media_seconds"), F.countDistinct("speaker").alias("speakers"), F.count("*").alias("segments"))


def wave_files(spark: SparkSession, path: str, piece_seconds: float = 30.0) -> DataFrame:
    """call_id, piece, rate and samples (mono, -1 to 1) of 16-bit PCM wave files, in pieces; files that aren't such give no rows."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    with wave.open(io.BytesIO(bytes(content))) as w:
                        if w.getsampwidth() != 2:
                            continue
                        rate, channels, step, k = w.getframerate(), w.getnchannels(), max(1, int(piece_seconds * w.getframerate())), 0
                        while raw := w.readframes(step):
                            yield pd.DataFrame({"call_id": [name.rsplit("/", 1)[-1].rsplit(".", 1)[0]], "piece": [k], "rate": [rate], "samples": [(np.frombuffer(raw, "<i2").reshape(-1, channels).mean(1) / 32768.0).tolist()]})
                            k += 1
                except (wave.Error, EOFError):
                    continue

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content").mapInPandas(read, "call_id string, piece long, rate long, samples array<double>")


def flat(segments: DataFrame) -> DataFrame:
    """One flat row for each segment, for CSV."""
    return segments.select("call_id", "seg_idx", rounded("start_s", 2).alias("start"), rounded("end_s", 2).alias("end"), "speaker", "text", "pacing.word_count", "pacing.wpm", "emotion.valence", "emotion.arousal", "emotion.dominance")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)
