"""Wave files as chunks of samples at one rate: a reader that deals byte ranges of files, so that no task holds a file."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fixed value: samples a second of what is read
RATE = 16_000
#: Bytes of a partition; frames of a chunk; input samples on each side that a sample is made of.
PART_BYTES, CHUNK, REACH = 32 << 20, 1 << 18, 16
SCHEMA = "call_id string, first long, samples array<float>, problem string"


def header(raw: bytes, size: int) -> tuple[int, int, int, int, int]:
    """(rate, channels, bytes a sample, first byte of the data, frames) of a PCM wave file by its first bytes and its size; ValueError says what is wrong."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("Could not open the file: it is no wave file.")
    at, form = 12, None
    while at + 8 <= len(raw):
        name, length = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(raw):
            form = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
        elif name == b"data":
            if form is None:
                break
            kind, channels, rate, _, _, bits = form
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels or not rate:
                raise ValueError(f"Could not open the file: format {kind} with {bits} bits is not read.")
            frames = length // (channels * bits // 8)
            if at + 8 + length > size:
                raise ValueError("The file is cut short.")
            if not frames:
                raise ValueError("No audio frames could be decoded from this file.")
            return rate, channels, bits // 8, at + 8, frames
        at += 8 + length + length % 2
    raise ValueError("This file has no audio track.")


def mono(raw: bytes, channels: int, width: int) -> np.ndarray:
    """Samples in [-1, 1], the mean of the channels."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1)


def outputs_in(first: int, end: int, rate: int) -> tuple[int, int]:
    """The samples at RATE (first, end) that lie at input frames first to end."""
    return -(-first * RATE // rate), -(-end * RATE // rate)


def resampled(x: np.ndarray, start: int, first: int, end: int, rate: int) -> np.ndarray:
    """Samples first to end at RATE, of input frames x that begin at frame start; each from REACH frames around its place, by a windowed sinc."""
    if rate == RATE:
        return x[first - start : end - start]
    place = np.arange(first, end) * (rate / RATE)
    near = np.floor(place).astype(np.int64)
    at = near[:, None] + np.arange(1 - REACH, REACH + 1)
    away = at - place[:, None]
    cut = min(1.0, RATE / rate)
    weight = cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / REACH, -1, 1)))
    inside = (at >= start) & (at < start + len(x))
    weight = weight / weight.sum(1, keepdims=True)
    return (weight * np.where(inside, x[np.clip(at - start, 0, max(len(x) - 1, 0))], 0)).sum(1)


class _Part(InputPartition):
    def __init__(self, path: str, size: int, low: int, high: int) -> None:
        self.path, self.size, self.low, self.high = path, size, low, high


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.part, self.chunk = options["path"], int(options.get("partBytes", PART_BYTES)), int(options.get("chunkFrames", CHUNK))

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else sorted(store.get_file_info(fs.FileSelector(root)), key=lambda f: f.path)
        return [_Part(f.path, f.size, low, low + self.part) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".wav") for low in range(0, max(f.size, 1), self.part)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        name = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        row = lambda first, samples, problem: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([samples], pa.list_(pa.float32())), pa.array([problem], pa.string())], ["call_id", "first", "samples", "problem"])
        try:
            with store.open_input_file(part.path) as file:
                rate, channels, width, data, frames = header(file.read_at(min(part.size, 1 << 16), 0), part.size)
                step = channels * width
                # frames that begin in this range of bytes
                low, high = (min(max(-(-(b - data) // step), 0), frames) for b in (part.low, part.high))
                for a in range(low, high, self.chunk):
                    b = min(a + self.chunk, high)
                    first, end = outputs_in(a, b, rate)
                    if first < end:
                        begin, stop = max(a - REACH, 0), min(b + REACH + 1, frames)
                        x = mono(file.read_at((stop - begin) * step, data + begin * step), channels, width)
                        yield row(first, resampled(x, begin, first, end, rate).astype(np.float32), None)
        except (ValueError, OSError) as e:
            if part.low == 0:
                yield row(None, None, str(e))


class WaveSource(DataSource):
    """Chunks of 16 kHz mono samples of PCM wave files (8 to 32 bits) in a folder that pyarrow reads; a file that can't be read is a row with its problem."""

    @classmethod
    def name(cls) -> str:
        return "wave_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def audio_chunks(spark: SparkSession, path: str, **options) -> DataFrame:
    """call_id, first (place of the chunk's first sample at 16 kHz), samples, problem. Chunks of a file make the whole, whatever their size and the partitions'."""
    spark.dataSource.register(WaveSource)
    return spark.read.format("wave_chunks").options(**{k: str(v) for k, v in options.items()}).load(path)


def audio_problems(chunks: DataFrame) -> DataFrame:
    """(call_id, problem) of calls whose audio can't be used: what the reader said, or that all samples are 0."""
    peak = F.max(F.array_max(F.transform("samples", lambda x: F.abs(x))))
    found = chunks.groupBy("call_id").agg(F.max("problem").alias("problem"), peak.alias("_peak"))
    return found.withColumn("problem", F.coalesce("problem", F.when(F.coalesce("_peak", F.lit(0.0)) == 0, "The audio track is completely silent."))).where("problem is not null").drop("_peak")


def media_beside(files: DataFrame, extensions: list[str]) -> DataFrame:
    """(stem, path) of the media file beside each stem: of the files (path), the one whose extension comes first in the list."""
    stem, extension = F.regexp_extract("path", r"^(.*?)(?:\.[^./]*)?$", 1), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    place = F.array_position(F.array(*map(F.lit, extensions)), extension)
    return files.where(place > 0).groupBy(stem.alias("stem")).agg(F.min(F.struct(place.alias("k"), "path")).alias("f")).select("stem", F.col("f.path").alias("path"))
