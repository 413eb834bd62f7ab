"""Segments to turns, utterances, overlaps and lookups in time.

Segments have call_id, seg_idx, speaker, start_s and end_s; windows are always within a call.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.numbers import exact_sum, rounded
from turnwise.operators.storing import together

def _call():
    return Window.partitionBy("call_id")


def islands(rows: DataFrame, begins: Column, order: list, keys: tuple[str, ...] = ("call_id",), name: str = "island") -> DataFrame:
    """Number the runs of rows, from 0; `begins` is true for a run's first row (null counts as true)."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = rows.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("long"))
    return flagged.withColumn(name, F.sum("_begins").over(running) - 1).drop("_begins")


def with_turns(segments: DataFrame, gap: float = 2.0) -> DataFrame:
    """Each segment's turn_idx: a turn goes on while the speaker stays and starts at most `gap` after the last segment's end."""
    order = _call().orderBy("seg_idx")
    goes_on = (F.col("speaker") == F.lag("speaker").over(order)) & (F.col("start_s") - F.lag("end_s").over(order) <= gap)
    return islands(segments, ~goes_on, ["seg_idx"], name="turn_idx")


def build_turns(segments: DataFrame, gap: float = 2.0) -> DataFrame:
    """Turns with their speaker, bounds, speech and number of segments."""
    speech = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    return with_turns(segments, gap).groupBy("call_id", "turn_idx").agg(
        F.min("speaker").alias("speaker"), F.min_by("start_s", "seg_idx").alias("start_s"), F.max_by("end_s", "seg_idx").alias("end_s"),
        rounded(F.sum(speech), 2).alias("speech_seconds"), F.count("*").alias("segments"),
    )


def reply_latencies(turns: DataFrame) -> DataFrame:
    """reply_latency: from the turn before to this one, if the speaker changed."""
    order = _call().orderBy("turn_idx")
    changed = F.col("speaker") != F.lag("speaker").over(order)
    return turns.withColumn("reply_latency", F.when(changed, rounded(F.col("start_s") - F.lag("end_s").over(order), 2)))


def utterances(segments: DataFrame, gap: float = 1.5) -> DataFrame:
    """A speaker's segments joined while they start at most `gap` after the furthest end so far."""
    order = Window.partitionBy("call_id", "speaker").orderBy("start_s", "seg_idx")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(segments, ~(F.col("start_s") - reach <= gap), ["start_s", "seg_idx"], ("call_id", "speaker"), "utterance")
    return runs.groupBy("call_id", "speaker", "utterance").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def overlap_events(spoken: DataFrame, least: float = 0.1, bin_seconds: float = 600.0) -> DataFrame:
    """Pairs of utterances of different speakers that overlap by more than `least`; `by` begins later.

    The pairs are joined on the call and on time bins, so that a long call is many tasks; a pair counts in the bin of its later start.
    """
    rows = spoken.select("call_id", "speaker", "start_s", "end_s")
    bins = lambda a, b: F.expr(f"sequence(cast(floor({a} / {bin_seconds}) as long), cast(floor({b} / {bin_seconds}) as long))")
    over = rows.select("call_id", F.col("speaker").alias("over"), F.col("start_s").alias("a_start"), F.col("end_s").alias("a_end"), F.explode(bins("start_s", "greatest(start_s, end_s)")).alias("bin"))
    by = rows.select("call_id", F.col("speaker").alias("by"), F.col("start_s").alias("b_start"), F.col("end_s").alias("b_end"), F.floor(F.col("start_s") / bin_seconds).alias("bin"))
    # the later of two: by start, then end, then speaker
    later = F.struct("a_start", "a_end", "over") < F.struct("b_start", "b_end", "by")
    end = F.least("a_end", "b_end")
    pairs = over.join(by, ["call_id", "bin"]).where(later & (F.col("over") != F.col("by")) & (end - F.col("b_start") > least))
    kind = F.when(F.col("b_end") <= F.col("a_end"), "backchannel").otherwise("floor_taking")
    return pairs.select("call_id", rounded("b_start", 2).alias("start_s"), rounded(end, 2).alias("end_s"), rounded(end - F.col("b_start"), 2).alias("seconds"), "by", "over", kind.alias("kind"))


def overlap_summary(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Of each call with overlaps: their number and seconds, share of speech, longest, and kinds."""
    speech = turns.groupBy("call_id").agg(exact_sum("speech_seconds").cast("double").alias("speech"))
    found = events.groupBy("call_id").agg(F.count("*").alias("overlaps"), rounded(exact_sum("seconds"), 1).cast("double").alias("overlap_seconds"), F.max("seconds").alias("longest"), F.count_if(F.col("kind") == "backchannel").alias("backchannels"), F.count_if(F.col("kind") == "floor_taking").alias("floor_takings"), exact_sum("seconds").cast("double").alias("_s"))
    return found.join(speech, "call_id").select("call_id", "overlaps", "overlap_seconds", "longest", "backchannels", "floor_takings", rounded(F.expr("try_divide(_s, speech)"), 4).alias("share"))


def overlap_by_speaker(events: DataFrame) -> DataFrame:
    """Seconds of overlap of each speaker; an overlap counts for both."""
    both = events.select("call_id", F.explode(F.array("by", "over")).alias("speaker"), "seconds", "by", "kind")
    took = F.count_if((F.col("kind") == "floor_taking") & (F.col("by") == F.col("speaker")))
    return both.groupBy("call_id", "speaker").agg(rounded(exact_sum("seconds"), 1).cast("double").alias("seconds"), took.alias("floor_takes"))


def call_summary(turns: DataFrame, scored_seconds: float = 4.0) -> DataFrame:
    """Turns, changes of speaker, speech, seconds a change, the longest turn (the first of equals) and scored turns of each call."""
    order = _call().orderBy("turn_idx")
    marked = turns.withColumn("_change", (F.col("speaker") != F.lag("speaker").over(order)).cast("long"))
    changes = F.coalesce(F.sum("_change"), F.lit(0))
    return marked.groupBy("call_id").agg(
        F.count("*").alias("turns"), F.countDistinct("speaker").alias("speakers"), changes.alias("speaker_changes"), rounded(exact_sum("speech_seconds"), 1).cast("double").alias("speech"),
        rounded(F.try_divide(exact_sum("speech_seconds").cast("double"), F.sum("_change")), 2).alias("seconds_a_change"), F.max_by("turn_idx", F.struct("speech_seconds", -F.col("turn_idx"))).alias("longest_turn"), F.count_if(F.col("speech_seconds") >= scored_seconds).alias("scored_turns"),
    )


def silences(turns: DataFrame, least: float = 2.0) -> DataFrame:
    """Gaps between turns of a call, whoever speaks."""
    gap = F.col("start_s") - F.lag("end_s").over(_call().orderBy("turn_idx"))
    return turns.withColumn("_gap", gap).where(F.col("_gap") >= least).select("call_id", "turn_idx", rounded("_gap", 2).alias("seconds"))


def trimmed(segments: DataFrame, start: float, end: float) -> DataFrame:
    """Segments within [start, end]; their times stay."""
    return segments.where((F.col("start_s") >= start) & (F.col("end_s") <= end))


def pieces(spans: DataFrame, longest: float = 30.0, shortest: float = 1.0) -> DataFrame:
    """Spans cut into pieces of at most `longest`; a last piece below `shortest` belongs to the one before."""
    length = F.col("end_s") - F.col("start_s")
    count = F.greatest(F.ceil(length / longest) - ((length - F.floor(length / longest) * longest > 0) & (length - F.floor(length / longest) * longest < shortest)).cast("int"), F.lit(1))
    cut = spans.withColumn("_n", count).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)))
    return cut.withColumn("piece_start", F.col("start_s") + F.col("piece") * longest).withColumn("piece_end", F.when(F.col("piece") == F.col("_n") - 1, F.col("end_s")).otherwise(F.col("start_s") + (F.col("piece") + 1) * longest)).drop("_n")


def untouched(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Turns that no overlap touches: of the events that begin before a turn ends, none ends after it begins. One sorted pass, no join."""
    asked = turns.withColumn("_t", F.col("end_s")).withColumn("_event", F.lit(0)).withColumn("_end", F.lit(None).cast("double"))
    seen = events.select("call_id", F.col("start_s").alias("_t"), F.lit(1).alias("_event"), F.col("end_s").alias("_end"))
    # an event that begins when the turn ends comes after it
    furthest = F.max("_end").over(_call().orderBy("_t", "_event").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = asked.unionByName(seen, allowMissingColumns=True).withColumn("_far", furthest)
    return both.where((F.col("_event") == 0) & (F.col("_far").isNull() | (F.col("_far") <= F.col("start_s")))).select(*turns.columns)


def as_of(points: DataFrame, turns: DataFrame, at: str = "at_s") -> DataFrame:
    """The latest turn that starts at or before each point; null before the first. One sorted pass over a call, no pair of rows is made."""
    marks = turns.select("call_id", F.col("start_s").alias(at), F.lit(None).cast("long").alias("point"), F.col("turn_idx").alias("_turn"), F.lit(0).alias("_late"))
    asked = points.select("call_id", at, "point", F.lit(None).cast("long").alias("_turn"), F.lit(1).alias("_late"))
    order = _call().orderBy(at, "_late", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.union(asked).withColumn("turn_idx", F.last("_turn", ignorenulls=True).over(order))
    return both.where("point is not null").select("call_id", "point", at, "turn_idx")


def _swept(rows: DataFrame, order: list[str], schema: str, start) -> DataFrame:
    """What a sweep says of rows (call_id first), sorted by call and order: start() gives a function of a row that returns one for the result, or none.

    Each call is swept by a new function, which holds what is open at the moment; batches pass through, calls aren't gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, see, columns = None, None, [c.split()[0] for c in schema.split(",")]
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if see is None or row[0] != call:
                    call, see = row[0], start()
                if (found := see(row)) is not None:
                    out.append(found)
            yield pd.DataFrame(out, columns=columns)

    return together(rows, "call_id").sortWithinPartitions("call_id", *order).mapInPandas(run, schema)


def first_covering(spans: DataFrame, clips: DataFrame) -> DataFrame:
    """The first clip (by number) of the call that covers each span; spans that none covers have no row. A sweep with the clips that are open."""
    kind = spans.schema["call_id"].dataType.simpleString()
    opened = clips.select("call_id", F.col("clip_start").alias("t"), F.lit(0).alias("asks"), F.col("clip").cast("long").alias("n"), F.col("clip_end").alias("end"))
    asked = spans.select("call_id", F.col("start_s").alias("t"), F.lit(1).alias("asks"), F.col("span").cast("long").alias("n"), F.col("end_s").alias("end"))

    def start():
        open_: list[tuple[int, float]] = []

        def see(row):
            call, t, asks, n, end = row
            if not asks:
                insort(open_, (n, end))
                return None
            k = 0
            while k < len(open_):
                if open_[k][1] < t:
                    del open_[k]
                elif open_[k][1] >= end:
                    return call, n, open_[k][0]
                else:
                    k += 1
            return None

        return see

    return _swept(opened.union(asked).where("t is not null and end is not null"), ["t", "asks", "n"], f"call_id {kind}, span long, clip long", start)


def clip_windows(turns: DataFrame, pad: float, media_seconds: Column) -> DataFrame:
    """Distinct windows around turns, within the medium, numbered by time."""
    wide = turns.select("call_id", F.greatest(F.col("start_s") - pad, F.lit(0.0)).alias("clip_start"), F.least(F.col("end_s") + pad, media_seconds).alias("clip_end")).distinct()
    return wide.withColumn("clip", F.row_number().over(_call().orderBy("clip_start", "clip_end")).cast("long"))


def nearest_label(points: DataFrame, spans: DataFrame, at: str = "at_s") -> DataFrame:
    """The speaker of the span with the least distance to each point (0 inside); of equals the earlier. Calls without spans have no rows.

    The next span of each point comes from a window, the spans around and before it from a sweep: the first that is still open, else the
    one that ended last.
    """
    kind = points.schema["call_id"].dataType.simpleString()
    told = spans.groupBy("call_id", "start_s", "end_s").agg(F.min("speaker").alias("speaker"))
    marks = told.select("call_id", F.col("start_s").alias("t"), F.lit(0).alias("asks"), F.col("end_s").alias("end"), "speaker", F.lit(None).cast("long").alias("point"))
    asked = points.select("call_id", F.col(at).alias("t"), F.lit(1).alias("asks"), F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("speaker"), F.col("point").cast("long").alias("point"))
    both = marks.union(asked)
    later = F.when(F.col("asks") == 0, F.struct("t", "end", "speaker"))
    back = _call().orderBy(F.desc("t"), F.desc("asks"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_next", F.last(later, ignorenulls=True).over(back))
    rows = both.select("call_id", "t", "asks", "end", "speaker", "point", F.col("_next.t").alias("next_t"), F.col("_next.speaker").alias("next_speaker"))

    def start():
        open_: deque = deque()
        last = None

        def see(row):
            nonlocal last
            call, t, asks, end, speaker, point, next_t, next_speaker = row
            if not asks:
                open_.append((end, speaker))
                if last is None or end > last[0]:
                    last = (end, speaker)
                return None
            while open_ and open_[0][0] < t:
                open_.popleft()
            if open_:
                return call, int(point), open_[0][1], 0.0
            before = None if last is None else t - last[0]
            after = None if next_t is None or next_t != next_t else next_t - t
            if before is not None and (after is None or before <= after):
                return call, int(point), last[1], before
            return None if after is None else (call, int(point), next_speaker, after)

        return see

    found = _swept(rows, ["t", "asks", "end"], f"call_id {kind}, point long, speaker string, distance double", start)
    return found.withColumn("distance", rounded("distance", 3))


def other_speaker_nearby(turns: DataFrame) -> DataFrame:
    """The next other speaker's label, or else the one before."""
    order = _call().orderBy("turn_idx")
    runs = islands(turns, F.col("speaker") != F.lag("speaker").over(order), ["turn_idx"], name="run")
    near = runs.groupBy("call_id", "run").agg(F.min("speaker").alias("speaker"))
    by_run = _call().orderBy("run")
    near = near.withColumn("nearby", F.coalesce(F.lead("speaker").over(by_run), F.lag("speaker").over(by_run)))
    return runs.join(near.select("call_id", "run", "nearby"), ["call_id", "run"]).drop("run")


def monotone(words: DataFrame, order: list[str]) -> DataFrame:
    """One clock: starts never go back, ends are cut at the next start and not before the own start."""
    by = _call().orderBy(*order)
    begun = words.withColumn("clock_start", F.max("start_s").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = F.greatest("end_s", "clock_start")
    return begun.withColumn("clock_end", F.greatest(F.least(end, F.coalesce(F.lead("clock_start").over(by), end)), F.col("clock_start")))
