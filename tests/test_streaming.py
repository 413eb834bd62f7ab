"""Streams run to their end give what the batch operators give."""

from pyspark.sql import functions as F

from turnwise.operators import segments as S
from turnwise.streaming.sessions import streamed_turns, streamed_utterances

ROWS = [("c", "A", 0.0, 1.0), ("c", "A", 2.0, 3.0), ("c", "B", 3.5, 4.0), ("c", "A", 10.0, 11.0), ("d", "A", 0.0, 9.0), ("d", "A", 1.0, 2.0)]


def run(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return spark.table(name)


def test_sessions_are_utterances(spark, tmp_path):
    rows = spark.createDataFrame([*ROWS, ("z", "Z", 1e6, 1e6 + 1)], "call_id string, speaker string, start_s double, end_s double")
    rows.select("call_id", "speaker", F.col("start_s").cast("timestamp").alias("ts"), (F.col("end_s") - F.col("start_s")).alias("seconds")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("call_id string, speaker string, ts timestamp, seconds double").parquet(str(tmp_path / "in"))
    got = {(r.call_id, r.speaker, r.start_ts.timestamp(), r.end_ts.timestamp()) for r in run(spark, streamed_utterances(stream), "utt").collect()}
    batch = S.utterances(spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "call_id string, speaker string, start_s double, end_s double, seg_idx long"))
    assert got == {(r.call_id, r.speaker, r.start_s, r.end_s) for r in batch.collect()}


def test_stateful_turns_close_when_another_begins(spark, tmp_path):
    spark.createDataFrame(ROWS, "call_id string, speaker string, start_s double, end_s double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("call_id string, speaker string, start_s double, end_s double").parquet(str(tmp_path / "in"))
    got = sorted((r.call_id, r.turn_idx, r.speaker, r.start_s, r.end_s, r.segments) for r in run(spark, streamed_turns(stream), "turns_out").collect())
    assert got == [("c", 0, "A", 0.0, 3.0, 2), ("c", 1, "B", 3.5, 4.0, 1)]
