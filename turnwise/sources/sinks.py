"""One file a call: contents as a table, written by Spark and put in place by a commit that never takes a name that is there."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, functions as F

from turnwise.functions.numbers import rounded
from turnwise.functions.text import timestamp

#: fixed values: the order in which formats are written
FORMATS = ("json", "md", "txt", "srt", "csv")


def write_files(contents: DataFrame, folder: str, extension: str) -> list[str]:
    """Writes contents (name, content) as folder/name.extension, one file a row, and returns the paths; a name that is taken becomes `name (2)`, `(3)` ...

    Tasks write below a folder of their own, so a lost executor's files are written anew and none is seen before all are there; then each file is
    renamed, by the driver, on whatever store the folder is in. Rows without a name or content are left out; of repeated names each is a file.
    """
    spark = contents.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(conf)
    staged = f"{folder}/_staged-{uuid.uuid4().hex}"
    rows = contents.where("name is not null and content is not null").select("content", F.col("name").cast("string").alias("_name"), F.monotonically_increasing_id().alias("_row"))
    rows.write.partitionBy("_name", "_row").text(staged)
    written = []
    for named in sorted(store.listStatus(path(staged)), key=lambda s: s.getPath().getName()):
        if not named.isDirectory():
            continue
        name = unquote(named.getPath().getName().split("=", 1)[1]).replace("/", "_")
        for row in sorted(store.listStatus(named.getPath()), key=lambda s: int(s.getPath().getName().split("=")[1])):
            for part in store.listStatus(row.getPath()):
                if not part.getPath().getName().startswith("part-"):
                    continue
                target, k = path(f"{folder}/{name}.{extension}"), 2
                while store.exists(target) or not store.rename(part.getPath(), target):
                    target, k = path(f"{folder}/{name} ({k}).{extension}"), k + 1
                    if k > 100_000:
                        raise OSError(f"{part.getPath()} can't be put into {folder}")
                written.append(target.toString())
    store.delete(path(staged), True)
    return written


def _listed(rows: DataFrame, item: Column, order: str) -> DataFrame:
    """(call_id, items): an array of each call's items, in order. A file is written whole, so a call's items are one row."""
    return rows.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_k"), item.alias("_v")))).alias("_l")).select("call_id", F.transform("_l", lambda x: x["_v"]).alias("items"))


def segment_json(segments: DataFrame) -> DataFrame:
    """(name, content): each call's segments as a JSON list, as segment_files reads it; null fields are left out."""
    known = [c for c in ("speaker", "text", "words", "pacing", "emotion", "stance") if c in segments.columns]
    item = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), *known)
    return _listed(segments, item, "seg_idx").select(F.col("call_id").alias("name"), F.to_json("items", {"pretty": "true"}).alias("content"))


def subtitles(segments: DataFrame) -> DataFrame:
    """(name, content): numbered cues with their times and speakers."""
    who = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.col("speaker"), F.lit(": "))).otherwise("")
    items = _listed(segments, F.concat(timestamp(F.col("start_s")), F.lit(" --> "), timestamp(F.col("end_s")), F.lit("\n"), who, F.trim(F.coalesce("text", F.lit("")))), "seg_idx")
    numbered = F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x, F.lit("\n")))
    return items.select(F.col("call_id").alias("name"), F.array_join(numbered, "\n").alias("content"))


def plain_text(segments: DataFrame) -> DataFrame:
    """(name, content): a line a segment, with its time and speaker."""
    line = F.concat(F.lit("["), timestamp(F.col("start_s"), "."), F.lit("] "), F.coalesce("speaker", F.lit("?")), F.lit(": "), F.trim(F.coalesce("text", F.lit(""))))
    return _listed(segments, line, "seg_idx").select(F.col("call_id").alias("name"), F.array_join("items", "\n").alias("content"))


def comma_separated(segments: DataFrame) -> DataFrame:
    """(name, content): a header and a row a segment; texts with signs of the format are quoted."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = [rounded("start_s", 2).cast("string"), rounded("end_s", 2).cast("string"), quoted(F.coalesce("speaker", F.lit(""))), quoted(F.trim(F.coalesce("text", F.lit(""))))]
    items = _listed(segments, F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in cells)), "seg_idx")
    return items.select(F.col("call_id").alias("name"), F.concat(F.lit("start,end,speaker,text\n"), F.array_join("items", "\n")).alias("content"))


def turn_bodies(turns: DataFrame, pauses: DataFrame) -> DataFrame:
    """turns (call_id, turn_idx, text) with body: the text with each pause (at, seconds, after_word) marked behind the word that it follows.

    Pauses go in the order of time, and each is looked for behind the one before, as a whole word; one whose word isn't there is left out.
    """
    held = pauses.groupBy("call_id", "turn_idx").agg(F.array_sort(F.collect_list(F.struct("at", "seconds", F.trim(F.coalesce("after_word", F.lit(""))).alias("word")))).alias("_p"))
    both = turns.join(held, ["call_id", "turn_idx"], "left")

    def marked(state: Column, pause: Column) -> Column:
        word = pause["word"]
        pattern = F.concat(F.lit("(?U)"), F.when(word.rlike(r"^[\p{L}\p{N}]"), r"\b").otherwise(""), F.regexp_replace(word, r"([^\p{L}\p{N}_\s])", r"\\$1"), F.lit(r"(?!\w)"))
        at = F.when(word != "", F.regexp_instr(state["rest"], pattern)).otherwise(0)
        end = at + F.length(word) - 1
        note = F.concat(F.lit(" (..."), F.format_string("%.1f", rounded(pause["seconds"], 1)), F.lit("s)"))
        done = F.when(at > 0, F.concat(state["done"], F.substring(state["rest"], F.lit(1), end), note)).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(at > 0, F.substring(state["rest"], end + 1, F.length(state["rest"]))).otherwise(state["rest"]).alias("rest"))

    start = F.struct(F.lit("").alias("done"), F.coalesce("text", F.lit("")).alias("rest"))
    folded = F.aggregate(F.coalesce("_p", F.array().cast("array<struct<at:double,seconds:double,word:string>>")), start, marked, lambda s: F.concat(s["done"], s["rest"]))
    return both.withColumn("body", folded).drop("_p")


def minutes_markdown(turns: DataFrame, pauses: DataFrame, moments: DataFrame) -> DataFrame:
    """(name, content): the moments, each with what was observed, and the turns with their pauses."""
    body = turn_bodies(turns, pauses)
    clock = lambda c: F.substring(timestamp(F.col(c), "."), 1, 8)
    said = _listed(body, F.concat(F.lit("**"), F.coalesce("speaker", F.lit("?")), F.lit("** ["), clock("start_s"), F.lit("]\n\n"), F.col("body")), "turn_idx").withColumnRenamed("items", "turns")
    found = _listed(moments, F.concat(F.lit("- ["), clock("start_s"), F.lit("] "), F.coalesce("speaker", F.lit("?")), F.lit(": "), F.array_join("observations", "; ")), "turn_idx").withColumnRenamed("items", "moments")
    empty = F.array().cast("array<string>")
    return said.join(found, "call_id", "left").select(F.col("call_id").alias("name"), F.concat(F.lit("# Moments\n\n"), F.array_join(F.coalesce("moments", empty), "\n"), F.lit("\n\n# Transcript\n\n"), F.array_join("turns", "\n\n")).alias("content"))


def analysis_json(report: dict[str, DataFrame]) -> DataFrame:
    """(name, content): each call's speakers, moments and turns, of operators.report.analysed, as one JSON object."""
    whole = lambda df, order, name: _listed(df, F.struct(*[c for c in df.columns if c != "call_id"]), order).withColumnRenamed("items", name)
    both = whole(report["turns"], "turn_idx", "turns").join(whole(report["speakers"], "speaker", "speakers"), "call_id", "left").join(whole(report["moments"], "turn_idx", "moments"), "call_id", "left")
    return both.select(F.col("call_id").alias("name"), F.to_json(F.struct("speakers", "moments", "turns"), {"pretty": "true"}).alias("content"))


def write_all(segments: DataFrame, folder: str, formats: Iterable[str], report: dict[str, DataFrame] | None = None) -> list[str]:
    """Files of each call in the formats asked for, in the order of FORMATS; the numbers go beside them (.analysis.json) if both md and json are asked for.

    md and the numbers need the report of operators.report.analysed.
    """
    wanted = set(formats)
    if unknown := wanted - set(FORMATS):
        raise ValueError(f"no such formats: {sorted(unknown)}")
    if "md" in wanted and report is None:
        raise ValueError("md needs a report")
    made = {"json": segment_json, "txt": plain_text, "srt": subtitles, "csv": comma_separated}
    written = []
    for name in FORMATS:
        if name in wanted:
            contents = minutes_markdown(report["turns"], report["pauses"], report["moments"]) if name == "md" else made[name](segments)
            written += write_files(contents, folder, name)
    if {"md", "json"} <= wanted:
        written += write_files(analysis_json(report), folder, "analysis.json")
    return written
