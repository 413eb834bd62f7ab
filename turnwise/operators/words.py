"""Operators on timed words: speaker runs, pauses, pace, disfluency, loops and names.

Words have call_id, turn_idx (or seg_idx), word_idx, word, start_s and end_s; kind and speaker are nullable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.numbers import rounded
from turnwise.functions.lexicons import FILLERS, VOCALISATIONS
from turnwise.operators.segments import islands

def word_class(word: Column) -> Column:
    """filler, vocalisation, event ([...]), cutoff (a closing -) or content."""
    bare = F.regexp_replace(F.lower(word), r"^[^a-z0-9\[]+|[^a-z0-9\]-]+$", "")
    return F.when(F.substring(bare, 1, 1) == "[", "event").when(bare.isin(*FILLERS), "filler").when(bare.isin(*VOCALISATIONS), "vocalisation").when(bare.endswith("-"), "cutoff").otherwise("content")


def split_by_speaker(words: DataFrame, least_words: int = 4, least_seconds: float = 1.0) -> DataFrame:
    """Cut segments where another speaker's words hold on: piece and piece_speaker of each word.

    A run of words of one speaker is sustained by its words and seconds. Where a segment has two sustained speakers,
    other runs go to the piece before them (leading ones to the first), and neighbours of one speaker are joined.
    Words have seg_idx, word_idx, word_speaker (null: the segment's speaker) and speaker.
    """
    key, by = ["call_id", "seg_idx"], ["word_idx"]
    own = words.withColumn("_who", F.coalesce("word_speaker", "speaker"))
    order = Window.partitionBy(*key).orderBy(*by)
    runs = islands(own, F.col("_who") != F.lag("_who").over(order), by, tuple(key), "_run")
    run = Window.partitionBy(*key, "_run")
    held = (F.count("*").over(run) >= least_words) & (F.max("end_s").over(run) - F.min("start_s").over(run) >= least_seconds)
    runs = runs.withColumn("_held", F.when(held, F.col("_who")))
    segment = Window.partitionBy(*key)
    before = F.last("_held", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("_held", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cut = F.size(F.collect_set("_held").over(segment)) >= 2
    named = runs.withColumn("piece_speaker", F.when(cut, F.coalesce(before, first)).otherwise(F.col("speaker")))
    return islands(named, F.col("piece_speaker") != F.lag("piece_speaker").over(order), by, tuple(key), "piece").drop("_who", "_run", "_held")


def pauses(words: DataFrame, least: float = 1.0, longest_word: float = 2.0, within: bool = False) -> DataFrame:
    """Gaps of at least `least` between timed words of a turn; not beside a word that lasts over `longest_word` or not at all.

    within: adds within_segment, whether the gap lies in the segment of either word (words have its bounds, _low and _high)."""
    order = Window.partitionBy("call_id", "turn_idx").orderBy("word_idx")
    fine = lambda a, b: (b - a > 0) & (b - a <= longest_word)
    timed = words.where("start_s is not null and end_s is not null")
    bounds = ["_low", "_high", F.lead("_low").over(order).alias("_low2"), F.lead("_high").over(order).alias("_high2")] if within else []
    seen = timed.select("call_id", "turn_idx", "word_idx", "word", "start_s", "end_s", F.lead("word").over(order).alias("before_word"), F.lead("start_s").over(order).alias("_s"), F.lead("end_s").over(order).alias("_e"), *bounds)
    gap = F.col("_s") - F.col("end_s")
    inside = lambda low, high: (F.col(low) <= F.col("end_s")) & (F.col("_s") <= F.col(high))
    extra = [(inside("_low", "_high") | inside("_low2", "_high2")).alias("within_segment")] if within else []
    kept = seen.where((gap >= least) & fine(F.col("start_s"), F.col("end_s")) & fine(F.col("_s"), F.col("_e")))
    return kept.select("call_id", "turn_idx", rounded("end_s", 2).alias("at"), rounded(gap, 2).alias("seconds"), F.col("word").alias("after_word"), "before_word", *extra)


def pace(words: DataFrame, held: DataFrame) -> DataFrame:
    """Words a minute of each turn, over its length and over its length without pauses."""
    spoken = words.groupBy("call_id", "turn_idx").agg(F.count("*").alias("word_count"), F.min("start_s").alias("_a"), F.max("end_s").alias("_b"))
    still = held.groupBy("call_id", "turn_idx").agg(F.sum(F.col("seconds").cast("decimal(18,2)")).cast("double").alias("_held"))
    wall = F.greatest(F.col("_b") - F.col("_a"), F.lit(0.01))
    speaking = F.greatest(wall - F.coalesce("_held", F.lit(0.0)), F.lit(0.01))
    return spoken.join(still, ["call_id", "turn_idx"], "left").select("call_id", "turn_idx", "word_count", rounded(F.col("word_count") / (wall / 60), 1).alias("wpm"), rounded(F.col("word_count") / (speaking / 60), 1).alias("articulation_wpm"))


def disfluency(words: DataFrame, segment: str | None = None, further: Sequence[Column] | None = None) -> DataFrame:
    """Counts of each turn by class; a filler is initial, medial or final by whether words stand before and after it in its segment.

    segment: the column of a word's segment; without one, a turn is one segment. further: aggregates that are taken as well, in place of
    rates; counts are then of each segment.
    """
    turn = Window.partitionBy("call_id", "turn_idx", *([segment] if segment else []))
    content = F.when(F.col("kind").isin("content", "cutoff", "repetition"), F.col("word_idx"))
    seen = words.withColumn("_first", F.min(content).over(turn)).withColumn("_last", F.max(content).over(turn))
    filler = F.col("kind") == "filler"
    before, after = F.col("_first") < F.col("word_idx"), F.col("_last") > F.col("word_idx")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    medial, initial = count(filler & before & after), count(filler & ~F.coalesce(before, F.lit(False)) & after)
    if further is not None:
        return seen.groupBy("call_id", "turn_idx", *([segment] if segment else [])).agg(count(filler).alias("filled_pauses"), medial.alias("medial"), *further)
    return seen.groupBy("call_id", "turn_idx").agg(
        count(filler).alias("filled_pauses"), initial.alias("initial"), medial.alias("medial"), (count(filler) - initial - medial).alias("final"), count(F.col("kind") == "cutoff").alias("cutoffs"),
        count(F.col("kind") == "vocalisation").alias("vocalisations"), rounded(100 * count(filler) / F.greatest(F.count("*"), F.lit(1)), 2).alias("per_100_words"),
    )


def without_loops(words: DataFrame, most: int = 4, keys: Sequence[str] = ("call_id",), order: Sequence[str] = ("turn_idx", "word_idx"), key: str | None = None) -> DataFrame:
    """Drop what a decoder repeats: the same word with a kind goes from its fifth in a row. key: the column by which words are equal (lower case, if none is given)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    same = F.col(key) if key else F.lower("word")
    runs = islands(words, F.col("kind").isNull() | (same != F.lag(same).over(window)), list(order), tuple(keys), "_run")
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))
    return runs.withColumn("_place", place).where(F.col("_place") <= most).drop("_run", "_place")


def speaker_runs(words: DataFrame) -> DataFrame:
    """Runs of words of one speaker with their text."""
    order = Window.partitionBy("call_id").orderBy("turn_idx", "word_idx")
    runs = islands(words, F.col("speaker") != F.lag("speaker").over(order), ["turn_idx", "word_idx"], name="run")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "word_idx", "word"))), lambda x: x["word"]), " ")
    return runs.groupBy("call_id", "run").agg(F.min("speaker").alias("speaker"), F.count("*").alias("words"), said.alias("text"))


def filled_owners(words: DataFrame, farthest: float = 5.0, order: Sequence[str] = ("turn_idx", "word_idx")) -> DataFrame:
    """Words without an owner take that of both neighbours with one, or of the nearer (the next, on a tie); over `farthest` from both: dropped."""
    past = (Window.unboundedPreceding, -1)
    on, back = Window.partitionBy("call_id").orderBy(*order).rowsBetween(*past), Window.partitionBy("call_id").orderBy(*(F.col(c).desc() for c in order)).rowsBetween(*past)
    owned = F.when(F.col("owner").isNotNull(), F.struct("owner", "start_s", "end_s"))
    seen = words.withColumn("_b", F.last(owned, ignorenulls=True).over(on)).withColumn("_a", F.last(owned, ignorenulls=True).over(back))
    far = F.lit(float("inf"))
    to_before, to_after = F.coalesce(F.col("start_s") - F.col("_b.end_s"), far), F.coalesce(F.col("_a.start_s") - F.col("end_s"), far)
    nearest = F.when(F.col("_b.owner") == F.col("_a.owner"), F.col("_b.owner")).when(F.least(to_before, to_after) > farthest, F.lit(None)).when(to_before < to_after, F.col("_b.owner")).otherwise(F.col("_a.owner"))
    return seen.withColumn("owner", F.coalesce("owner", nearest)).where("owner is not null").drop("_a", "_b")


def name_votes(turns: DataFrame, opening: str, address: str, implausible: list[str]) -> DataFrame:
    """Votes for (call_id, speaker, name): three to a label that introduces itself, one to the nearby one that is addressed.

    opening and address are patterns with one group, the name; turns have text and nearby (the other speaker's label).
    """
    found = lambda p: F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1)))
    own = turns.select("call_id", "turn_idx", "speaker", found(opening).alias("name"), F.lit(3).alias("votes"))
    other = turns.where("nearby is not null").select("call_id", "turn_idx", F.col("nearby").alias("speaker"), found(address).alias("name"), F.lit(1).alias("votes"))
    plausible = own.union(other).where(~F.lower("name").isin(*implausible) & (F.col("name") != ""))
    plain = F.concat(F.upper(F.substring("name", 1, 1)), F.lower(F.substring("name", 2, 1000)))
    return plausible.groupBy("call_id", "speaker", plain.alias("name")).agg(F.sum("votes").alias("votes"), F.min("turn_idx").alias("first_turn"))


def guessed_names(votes: DataFrame, least: int = 2) -> DataFrame:
    """The winner of each label (the first voted on a tie); a name goes to one label, to none on a dead heat."""
    best = F.row_number().over(Window.partitionBy("call_id", "speaker").orderBy(F.desc("votes"), "first_turn", "name"))
    won = votes.where(F.col("votes") >= least).withColumn("_k", best).where("_k = 1")
    name = Window.partitionBy("call_id", "name")
    top = F.max("votes").over(name)
    kept = won.withColumn("_top", top)
    heat = kept.where("votes = _top").withColumn("_heat", F.count("*").over(name))
    return heat.where("_heat = 1").select("call_id", "speaker", "name", "votes", F.when(F.col("votes") >= 3, "high").otherwise("low").alias("confidence"))
