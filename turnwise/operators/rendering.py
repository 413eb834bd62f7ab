"""Lines of text views as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.text import fixed, minutes, turn_id


def moment_lines(moments: DataFrame, keys: list[str], note: str = "note", z: str = "z", n: str = "n", order: str = "place") -> DataFrame:
    """One line for each key: `note (z +1.5, n 12)`, several joined by semicolons."""
    signed = F.concat(F.when(F.col(z) >= 0, "+").otherwise("-"), fixed(F.abs(F.col(z)), 1))
    line = F.concat(F.col(note), F.lit(" (z "), signed, F.lit(", n "), F.col(n).cast("string"), F.lit(")"))
    made = moments.withColumn("_line", line).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "_line"))).alias("_l"))
    return made.select(*keys, F.array_join(F.transform("_l", lambda x: x["_line"]), "; ").alias("line"))


def view_lines(turns: DataFrame, silence: float = 2.0) -> DataFrame:
    """A heading for each turn, `**T001 mm:ss speaker**`, with a line before it where it was silent for so long."""
    gap = F.col("start_s") - F.lag("end_s").over(Window.partitionBy("call_id").orderBy("turn_idx"))
    quiet = F.when(gap >= silence, F.concat(F.lit("[silence "), F.floor(gap).cast("string"), F.lit("s]\n"))).otherwise("")
    return turns.select("call_id", "turn_idx", F.concat(quiet, F.lit("**"), turn_id(F.col("turn_idx")), F.lit(" "), minutes(F.col("start_s")), F.lit(" "), F.col("speaker"), F.lit("**")).alias("line"))


def participants(facts: DataFrame) -> DataFrame:
    """A row of the table of participants: `| label | 50% | 19 |`."""
    return facts.select("call_id", "speaker", F.concat(F.lit("| "), F.col("speaker"), F.lit(" | "), F.floor(F.col("talk_share") * 100 + 0.5).cast("string"), F.lit("% | "), F.col("turns").cast("string"), F.lit(" |")).alias("line"))


def name_block(names: DataFrame) -> DataFrame:
    """Names of a call in the order of their labels, or `none`."""
    made = names.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("speaker", "name"))).alias("_n"))
    return made.select("call_id", F.coalesce(F.nullif(F.array_join(F.transform(F.filter("_n", lambda x: x["name"].isNotNull()), lambda x: F.concat(x["speaker"], F.lit(": "), x["name"])), ", "), F.lit("")), F.lit("none")).alias("block"))


def cell(value: Column) -> Column:
    """A table cell: - for null."""
    return F.coalesce(value.cast("string"), F.lit("-"))
