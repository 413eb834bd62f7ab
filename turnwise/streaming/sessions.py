"""Segments as a stream: utterances as sessions, and turns with the state of each call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streamed_utterances(segments: DataFrame, gap_seconds: float = 1.5, late: str = "10 minutes") -> DataFrame:
    """Utterances of a stream of segments (call_id, speaker, ts timestamp, seconds): sessions that end `gap_seconds` after the last end.

    Append mode: a session is given out once the watermark has passed it; later rows than `late` are dropped.
    """
    length = F.concat((F.col("seconds") + gap_seconds).cast("string"), F.lit(" seconds"))
    ended = segments.withColumn("end_ts", (F.col("ts").cast("double") + F.col("seconds")).cast("timestamp"))
    return ended.withWatermark("ts", late).groupBy("call_id", "speaker", F.session_window("ts", length).alias("session")).agg(F.min("ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("segments")).drop("session")


def streamed_turns(segments: DataFrame, gap_seconds: float = 2.0, idle_ms: int = 600_000) -> DataFrame:
    """Turns of a stream whose batches bring a call's segments (call_id, speaker, start_s, end_s) in order.

    A turn is given out when another begins, or when its call has been idle. State: the open turn of each call.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((*key, *state.get))
            state.remove()
        else:
            open_ = list(state.get) if state.exists else None
            rows = pd.concat(list(batches)).sort_values(["start_s", "end_s"], kind="stable")
            for speaker, start, end in zip(rows["speaker"], rows["start_s"], rows["end_s"]):
                if open_ and open_[1] == speaker and start - open_[3] <= gap_seconds:
                    open_[3], open_[4] = float(end), open_[4] + 1
                else:
                    if open_:
                        out.append((*key, *open_))
                    open_ = [open_[0] + 1 if open_ else 0, speaker, float(start), float(end), 1]
            state.update(tuple(open_))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["call_id", "turn_idx", "speaker", "start_s", "end_s", "segments"])

    shape = "turn_idx long, speaker string, start_s double, end_s double, segments long"
    return segments.groupBy("call_id").applyInPandasWithState(step, f"call_id string, {shape}", shape, "append", GroupStateTimeout.ProcessingTimeTimeout)
