"""Merging a verbatim transcript into a recognised one, word by word.

Content words are the recognised ones wherever both disagree; fillers, vocalisations, events, cut-offs and repetitions are the
verbatim ones; times are the verbatim ones where both heard the same word. Content words are aligned first
(operators.aligning); all else follows from the pairs by windows over a call's order and joins on a gap between pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.lexicons import FILLERS, VOCALISATIONS
from turnwise.functions.numbers import rounded
from turnwise.operators.aligning import word_pairs
from turnwise.operators.calls import near_duplicates_dropped
from turnwise.operators.clock import one_clock
from turnwise.operators.storing import ROWS, by_call, kept_by_call as kept
from turnwise.operators.words import filled_owners, without_loops

# fixed values: seconds within which equal words are one occurrence, and fillers of both streams one sound; words of a restart at
# most; copies of an inserted word in a row that stay; words that make no restart by themselves
SAME_WORD, SAME_FILLER, RESTART, COPIES = 5.0, 0.8, 12, 4
COMMON = ("you", "know", "like", "i", "the", "a", "and", "it", "its", "that", "to", "of", "so", "yeah", "um", "uh", "is", "in", "we", "just", "or", "but")

COUNTERS = (
    "matched", "far_matches", "whisper_only", "replaced", "kept_filler", "kept_vocalisation", "kept_event", "kept_cutoff", "kept_repetition",
    "dropped_content", "dropped_misplaced", "dropped_loop", "whisper_fillers_merged", "whisper_fillers_kept",
)


def word_key(word: Column) -> Column:
    """Lower case, without signs around; brackets and hyphens stay."""
    return F.regexp_replace(F.lower(F.trim(word)), r"(?U)^[^\w\[\]-]+|[^\w\[\]-]+$", "")


def token_kind(word: Column) -> Column:
    """filler, vocalisation, event, cutoff or content."""
    return key_kind(word_key(word))


def key_kind(key: Column) -> Column:
    """The same of a word's key."""
    bare = F.regexp_replace(key, r"^[\[\]]+|[\[\]]+$", "")
    return (
        F.when(bare.isin(*FILLERS), "filler").when(bare.isin(*VOCALISATIONS), "vocalisation").when(key.startswith("[") & key.endswith("]"), "event")
        .when((F.length(key) > 1) & key.endswith("-"), "cutoff").otherwise("content")
    )


def shown(word: Column, kind: Column) -> Column:
    """How a token that only the verbatim stream has is written."""
    bare = F.regexp_replace(word_key(word), r"^[\[\]]+|[\[\]]+$", "")
    return F.when(kind.isin("filler", "vocalisation"), bare).when(kind == "event", F.concat(F.lit("["), bare, F.lit("]"))).otherwise(F.trim(word))


def repeats(run: Column, before: Column, after: Column) -> Column:
    """Whether a run of words that only one stream has (arrays of keys) says again what stands around it: the same words up to three,
    or a restart, up to RESTART words that hold the next or the last two or three words, not all of them common."""
    n = F.size(run)
    last = lambda k: F.when(F.size(before) >= k, F.slice(before, F.size(before) - k + 1, k))
    same = (n <= 3) & (F.coalesce(run == F.slice(after, F.lit(1), F.greatest(n, F.lit(1))), F.lit(False)) | F.coalesce(run == last(n), F.lit(False)))

    def begun(anchor: Column, k: int) -> Column:
        held = F.exists(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.slice(run, i, F.lit(k)) == anchor)
        return F.coalesce((n >= k) & held & F.exists(anchor, lambda w: ~w.isin(*COMMON)), F.lit(False))

    again = F.lit(False)
    for k in (3, 2):
        again = again | begun(F.when(F.size(after) >= k, F.slice(after, 1, k)), k) | begun(last(k), k)
    return (n > 0) & (same | ((n >= 2) & (n <= RESTART) & again))


def _numbered(rows: DataFrame, name: str, counted: Column) -> DataFrame:
    """rows with the number of those counted, null for others. Filters follow, so that kinds are told once, before rows are sorted."""
    upto = Window.partitionBy("call_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.when(counted, F.count_if(counted).over(upto) - 1))


def walk(recognised: DataFrame, verbatim: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, dropped, fillers): the merged stream in order (k1, k2, k3) with what was done (op), before times are fitted; (call_id, counter, n) of
    what was left out; and the fillers of recognised.

    recognised: call_id, place, word, start_s, end_s (nullable), segment; verbatim: call_id, place, word, start_s, end_s.
    """
    told = lambda df, *more: df.where("trim(word) <> ''").select("call_id", "place", "word", word_key(F.col("word")).alias("key"), "start_s", "end_s", *more).withColumn("kind", key_kind(F.col("key")))
    rec = _numbered(told(recognised, "segment").withColumn("word", F.trim("word")), "i", F.col("kind") != "filler")
    ver = _numbered(told(verbatim), "j", F.col("kind") == "content")
    side = lambda df, at: df.where(F.col(at).isNotNull()).select("call_id", F.col(at).alias("at"), "key", F.col("start_s").alias("t"))
    pairs = kept(word_pairs(side(rec, "i"), side(ver, "j"), tasks=tasks))

    by_place = Window.partitionBy("call_id").orderBy("place")
    upto = by_place.rowsBetween(Window.unboundedPreceding, 0)
    around = lambda name, ks: F.filter(F.array(*(F.lag(name, k).over(by_place) if k > 0 else F.col(name) if k == 0 else F.lead(name, -k).over(by_place) for k in ks)), lambda x: x.isNotNull())

    def placed(rows: DataFrame, own: str, other: str, calls: DataFrame) -> DataFrame:
        """rows with their pair (other), how many pairs are before them (gap) and their place after the last (rank); calls of one stream alone aren't merged."""
        rows = rows.join(pairs, ["call_id", own], "left").join(calls.select("call_id").distinct(), "call_id", "left_semi")
        last = F.coalesce(F.last(F.when(F.col(other).isNotNull(), F.col(own)), ignorenulls=True).over(upto), F.lit(-1))
        return kept(rows.withColumn("gap", F.count(other).over(upto)).withColumn("rank", F.col(own) - last))

    rec = placed(rec, "i", "j", verbatim.where("trim(word) <> ''"))
    left = rec.where("i is not null").drop("kind")
    ver = placed(ver, "j", "i", left)
    right = ver.where("j is not null")
    # the keys around a pair are taken where gaps are looked at, so that they aren't kept with every word
    beside = left.withColumn("after", around("key", (0, -1, -2))).withColumn("before", around("key", (2, 1, 0))).where("j is not null")
    matched = left.where("j is not null").join(right.select("call_id", "j", F.col("place").alias("v"), F.col("start_s").alias("vs"), F.col("end_s").alias("ve")), ["call_id", "j"])
    near = F.col("start_s").isNull() | (F.abs(F.col("vs") - F.col("start_s")) <= SAME_WORD)

    word = lambda rows, k1, k2, op, native: rows.select(
        "call_id", F.col(k1).cast("long").alias("k1") if isinstance(k1, str) else k1.cast("long").alias("k1"), F.lit(k2).alias("k2"), F.col("i").cast("long").alias("k3"), "word", F.lit(None).cast("string").alias("kind"), op.alias("op"),
        native.alias("native"), F.when(native, F.col("vs")).alias("start_s"), F.when(native, F.col("ve")).alias("end_s"), F.col("start_s").alias("hint_start"), F.col("end_s").alias("hint_end"), "segment",
    )
    parts = [word(matched, "v", 0, F.when(near, "matched").otherwise("far_matches"), near)]

    # gaps: what stands between two pairs
    n_left = left.where("j is null").groupBy("call_id", "gap").agg(F.count("*").alias("n_left"))
    n_right = right.where("i is null").groupBy("call_id", "gap").agg(F.count("*").alias("n_right"), F.max("place").alias("last_v"), F.when(F.count("*") <= RESTART, F.transform(F.array_sort(F.collect_list(F.struct("j", "key"))), lambda x: x["key"])).alias("run"))
    ends = matched.select("call_id", "gap", F.col("v").alias("before_v")).join(beside.select("call_id", "gap", "before"), ["call_id", "gap"])
    begins = beside.select("call_id", (F.col("gap") - 1).alias("gap"), "after")
    gaps = n_left.join(n_right, ["call_id", "gap"], "full").join(ends, ["call_id", "gap"], "left").join(begins, ["call_id", "gap"], "left").fillna(0, ["n_left", "n_right"])
    gaps = kept(gaps.withColumn("repeats", F.coalesce((F.col("n_left") == 0) & repeats(F.col("run"), F.coalesce("before", F.array().cast("array<string>")), F.coalesce("after", F.array().cast("array<string>"))), F.lit(False))))
    slim = gaps.select("call_id", "gap", "n_left", "n_right", "last_v", "before_v", "repeats")
    ours = left.where("j is null").drop("j").join(slim, ["call_id", "gap"])
    theirs = right.where("i is null").drop("i").join(slim, ["call_id", "gap"])
    even = ours.where("n_left = n_right").join(theirs.where("n_left = n_right").select("call_id", "gap", "rank", F.col("place").alias("v"), F.col("start_s").alias("vs"), F.col("end_s").alias("ve")), ["call_id", "gap", "rank"])
    parts.append(word(even, "v", 0, F.lit("replaced"), F.lit(True)))
    uneven = ours.where("n_left <> n_right").withColumn("vs", F.lit(None).cast("double")).withColumn("ve", F.lit(None).cast("double"))
    parts.append(word(uneven, F.coalesce("last_v", "before_v", F.lit(-1)), 1, F.when(F.col("n_right") > 0, "replaced").otherwise("whisper_only"), F.lit(False)))

    only = lambda rows, kind, op: rows.select(
        "call_id", F.col("place").cast("long").alias("k1"), F.lit(0).alias("k2"), F.lit(-1).cast("long").alias("k3"), "word", kind.alias("kind"), op.alias("op"), F.lit(True).alias("native"), "start_s", "end_s",
        F.lit(None).cast("double").alias("hint_start"), F.lit(None).cast("double").alias("hint_end"), F.lit(None).cast(recognised.schema["segment"].dataType).alias("segment"),
    )
    parts.append(only(theirs.where("repeats"), F.lit("repetition"), F.lit("kept_repetition")))
    parts.append(only(ver.where("kind <> 'content'").withColumn("word", shown(F.col("word"), F.col("kind"))), F.col("kind"), F.concat(F.lit("kept_"), F.col("kind"))))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    dropped = theirs.where("n_left = 0 and not repeats").groupBy("call_id").agg(F.count("*").alias("n")).select("call_id", F.lit("dropped_content").alias("counter"), "n")
    return by_call(merged, tasks), kept(dropped), rec.where("kind = 'filler'").select("call_id", "place", "word", "start_s", "end_s", "segment")


def restored_fillers(walked: DataFrame, fillers: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """walked with the fillers that only the recognised stream has, in the gap where they were heard, and how many came back or were merged.

    walked: with times, in order (k1, k2, k3); fillers: call_id, place, word, start_s, end_s, segment. A filler within SAME_FILLER of one in
    walked is the same sound; one without a time goes. Fillers of one gap follow one another.
    """
    timed = fillers.where("start_s is not null").join(walked.select("call_id").distinct(), "call_id", "left_semi").withColumn("at_s", F.col("start_s"))
    heard = walked.where("kind = 'filler'").select("call_id", F.col("start_s").alias("at_s"))
    own = kept(near_duplicates_dropped(timed, heard, SAME_FILLER))
    n_all, n_own = timed.groupBy("call_id").agg(F.count("*").alias("a")), own.groupBy("call_id").agg(F.count("*").alias("b"))
    both = n_all.join(n_own, "call_id", "left").fillna(0)
    counts = both.select("call_id", F.lit("whisper_fillers_kept").alias("counter"), F.col("b").alias("n")).union(both.select("call_id", F.lit("whisper_fillers_merged").alias("counter"), (F.col("a") - F.col("b")).alias("n"))).where("n > 0")
    new = own.select(
        "call_id", F.lit(None).cast("long").alias("k1"), F.lit(1).alias("k2"), F.lit(None).cast("long").alias("k3"), shown(F.col("word"), F.lit("filler")).alias("word"), F.lit("filler").alias("kind"), F.lit("whisper_fillers_kept").alias("op"),
        F.lit(False).alias("native"), "start_s", "end_s", F.lit(None).cast("double").alias("hint_start"), F.lit(None).cast("double").alias("hint_end"), "segment", F.col("place").cast("long").alias("k4"),
    )
    rows = by_call(walked.withColumn("k4", F.lit(-1).cast("long")).union(new), tasks).withColumn("new", F.col("k4") >= 0).withColumn("t", F.col("start_s"))
    order = [F.col("t"), F.col("new"), F.col("k1"), F.col("k2"), F.col("k3"), F.col("k4")]
    on, back = Window.partitionBy("call_id").orderBy(*order), Window.partitionBy("call_id").orderBy(*(c.desc() for c in order))
    old = F.when(~F.col("new"), F.struct("k1", "k2", "k3", "start_s", "end_s"))
    past = (Window.unboundedPreceding, -1)
    rows = rows.withColumn("_b", F.last(old, ignorenulls=True).over(on.rowsBetween(*past))).withColumn("_a", F.last(old, ignorenulls=True).over(back.rowsBetween(*past)))
    low = F.coalesce("_b.end_s", "start_s")
    high = F.greatest(F.coalesce("_a.start_s", "end_s", "start_s"), low)
    start = F.least(F.greatest("start_s", low), high)
    end = F.least(F.greatest(F.coalesce("end_s", "start_s"), start), high)
    rows = rows.withColumn("_s", start).withColumn("_e", end)
    same_gap = Window.partitionBy("call_id", "_b.k1", "_b.k2", "_b.k3", "new").orderBy("t", "k4").rowsBetween(*past)
    done = F.coalesce(F.max("_e").over(same_gap), F.col("_s"))
    rows = rows.withColumn("_s", F.when(F.col("new"), F.greatest("_s", done))).withColumn("_e", F.greatest("_e", "_s"))
    placed = lambda c, first: F.when(F.col("new"), F.coalesce(f"_b.{c}", F.lit(first))).otherwise(F.col(c)).alias(c)
    out = rows.select("call_id", placed("k1", -2).cast("long").alias("k1"), placed("k2", 0).alias("k2"), placed("k3", 0).alias("k3"), "k4", "word", "kind", "op", "native", F.coalesce("_s", "start_s").alias("start_s"), F.when(F.col("new"), F.col("_e")).otherwise(F.col("end_s")).alias("end_s"), "segment", F.col("t"))
    return out, counts


def merged_words(recognised: DataFrame, verbatim: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(words, counts) of the merge of a verbatim transcript into a recognised one.

    words: call_id, word_idx, word, start_s, end_s (3 places), kind (null for recognised words), segment; counts: call_id, counter, n of COUNTERS, those above 0.
    recognised: call_id, place, word, start_s, end_s (nullable), segment; verbatim: call_id, place, word, start_s, end_s (all timed).
    Blank words don't count. A call without recognised content or without verbatim words stays as it is recognised. A token that only the
    verbatim stream has goes to the segment of its neighbours, or the nearer of two (the next, on a tie); over 5 s from both it goes.
    Words are dealt by call once, to `tasks` (as many as there are ROWS of them, if none is given), and stay there.
    """
    tasks = tasks or (recognised.count() + verbatim.count()) // ROWS + 1
    recognised, verbatim = by_call(recognised, tasks), by_call(verbatim, tasks)
    walked, dropped, fillers = walk(recognised, verbatim, tasks)
    timed = kept(one_clock(walked, ["k1", "k2", "k3"]))
    counts = timed.groupBy("call_id", F.col("op").alias("counter")).agg(F.count("*").alias("n")).union(dropped)
    whole, more = restored_fillers(timed, fillers, tasks)
    order = ["t", "k1", "k2", "k3", "k4"]
    number = F.row_number().over(Window.partitionBy("call_id").orderBy("k1", "k2", "k3", F.col("k4") >= 0, "t", "k4")) - 1
    rows = whole.withColumn("word_idx", number.cast("long")).withColumn("owner", F.col("segment")).drop(*order)
    owned = kept(filled_owners(rows, order=["word_idx"]))
    inserted = owned.withColumn("_key", word_key(F.col("word")))
    looped = without_loops(inserted, COPIES, ["call_id", "owner"], ["word_idx"], "_key")
    lost = lambda before, after, name: before.groupBy("call_id").agg(F.count("*").alias("a")).join(after.groupBy("call_id").agg(F.count("*").alias("b")), "call_id", "left").select("call_id", F.lit(name).alias("counter"), (F.col("a") - F.coalesce("b", F.lit(0))).alias("n")).where("n > 0")
    counts = counts.union(more).union(lost(rows, owned, "dropped_misplaced")).union(lost(owned, looped, "dropped_loop"))
    merged = looped.select("call_id", "word_idx", "word", rounded("start_s", 3).alias("start_s"), rounded("end_s", 3).alias("end_s"), "kind", F.col("owner").alias("segment"))
    alone = recognised.where("trim(word) <> ''").join(timed.select("call_id").distinct(), "call_id", "left_anti")
    alone = alone.select("call_id", (F.row_number().over(Window.partitionBy("call_id").orderBy("place")) - 1).cast("long").alias("word_idx"), F.trim("word").alias("word"), "start_s", "end_s", F.lit(None).cast("string").alias("kind"), "segment")
    return merged.union(alone), counts


def merged_segments(words: DataFrame) -> DataFrame:
    """(call_id, segment, start_s, end_s, text, words) of merged words, in their order."""
    said = F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_s", "end_s")))
    return words.groupBy("call_id", "segment").agg(said.alias("_w")).select("call_id", "segment", F.col("_w")[0]["start_s"].alias("start_s"), F.element_at("_w", -1)["end_s"].alias("end_s"), F.array_join(F.transform("_w", lambda w: w["word"]), " ").alias("text"), F.size("_w").alias("words"))
