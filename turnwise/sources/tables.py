"""Adapters from event, conversation and other tables to the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnwise.operators.storing import by_call


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments: a day is a call, an event type a speaker, and an event lasts `value` seconds."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(day)) / F.lit(1e6)
    rows = read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("call_id"), F.col("event_type").alias("speaker"), start.alias("start_s"), (start + F.col("value")).alias("end_s"), "event_id")
    order = Window.partitionBy("call_id").orderBy("start_s", "event_id")
    return rows.withColumn("seg_idx", (F.row_number().over(order) - 1).cast("long"))


#: The same in SQL, to follow WITH.
SEGMENTS_SQL = """segs AS (SELECT strftime(ts, '%Y-%m-%d') AS call_id, event_type AS speaker, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6 AS start_s,
    (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6 + value AS end_s, event_id,
    row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6, event_id) - 1 AS seg_idx FROM events)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns of a call."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("turn_idx"), F.col("role").alias("speaker"), "text")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one series of values for each user, in the order of time."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("series"), "ts", "event_id", "value", "event_type")


#: Messages whose words one task takes.
MESSAGES = 1_000


def tasks_of(turns: DataFrame) -> int:
    return turns.count() // MESSAGES + 1


def words(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """The words of the conversations as timed words: a word lasts 0.05 s a letter and is followed by 0.1 s, or by 1.3 s after a full stop.

    Messages are dealt by call before they are split, to as many tasks as there are MESSAGES of them, so that texts are shuffled in place
    of words and no task has more words the more calls there are; windows of a call or a turn stay where its words are. Where most columns
    of the words aren't needed (dealt is false), words are shuffled instead.
    """
    turns = conversations(spark, sf_dir)
    return timed_words(by_call(turns, tasks_of(turns)) if dealt else turns)


def timed_words(turns: DataFrame, *within: str) -> DataFrame:
    """The words of turns (call_id, turn_idx, speaker, text), timed as those of `words`; times begin anew with each value of the columns within a call."""
    key, split = ["call_id", *within], F.expr("filter(split(text, ' '), w -> w <> '')")
    rows = turns.select(*key, "turn_idx", "speaker", F.posexplode(split).alias("word_idx", "word"))
    lasts = F.length("word") * F.lit(50)
    order = Window.partitionBy(*key).orderBy("turn_idx", "word_idx")
    end = F.sum(lasts + F.when(F.col("word").endswith("."), F.lit(1300)).otherwise(F.lit(100))).over(order)
    rows = rows.withColumn("_next", end)
    start = F.coalesce(F.lag("_next").over(order), F.lit(0)) / F.lit(1000.0)
    return rows.withColumn("start_s", start).withColumn("end_s", (F.coalesce(F.lag("_next").over(order), F.lit(0)) + lasts) / F.lit(1000.0)).drop("_next")


WORDS_SQL = """w0 AS (SELECT conv_id AS call_id, turn AS turn_idx, role AS speaker, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word,
    generate_subscripts(list_filter(string_split(text, ' '), lambda w: w <> ''), 1) - 1 AS word_idx FROM conversations),
    w1 AS (SELECT *, CAST(sum(length(word) * 50 + CASE WHEN ends_with(word, '.') THEN 1300 ELSE 100 END) OVER (PARTITION BY call_id ORDER BY turn_idx, word_idx) AS BIGINT) AS nx FROM w0),
    words AS (SELECT call_id, turn_idx, speaker, word, word_idx, coalesce(lag(nx) OVER o, 0) / 1000.0 AS start_s, (coalesce(lag(nx) OVER o, 0) + length(word) * 50) / 1000.0 AS end_s
              FROM w1 WINDOW o AS (PARTITION BY call_id ORDER BY turn_idx, word_idx))"""
