"""From segments and words to turns with features, references of each speaker, and moments with their evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.lexicons import NOTES
from turnwise.functions.numbers import exact_sum, rounded, z_score
from turnwise.functions.text import sentiment, without_fillers
from turnwise.operators.baselines import BEHIND, LEAST, NOTABLE, finite, long_features, references
from turnwise.operators.scores import turn_scores
from turnwise.operators.segments import reply_latencies, with_turns
from turnwise.operators.storing import kept_by_call, together
from turnwise.operators.words import disfluency, pauses

#: fixed values: the features that are compared, and where they are on a turn
FEATURES = (
    "arousal", "valence", "articulation", "f0_range", "loudness_sd", "terminal_rise", "intensity_onset", "intensity_mid", "certainty", "medial_fillers", "lexical",
)
# fixed values: seconds of speech of a scored turn and of a recording with trailing references, both z of a mismatch, the least lean of a
# certainty note, fillers of a note on them, seconds of a long pause, letters of a preview
SCORED, TRAILING_AFTER, MISMATCH, LEAN, FILLERS, LONG_PAUSE, PREVIEW = 4.0, 900.0, 2.0, -0.25, 2, 2.0, 80


def paced(turns: DataFrame, held: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds word_count, wpm over the turn's length, and articulation_wpm over its speech less the pauses within segments."""
    still = held.where("within_segment").groupBy("call_id", "turn_idx").agg(exact_sum("seconds").cast("double").alias("_held"))
    both = turns.join(counts, ["call_id", "turn_idx"], "left").join(still, ["call_id", "turn_idx"], "left").withColumn("word_count", F.coalesce("word_count", F.lit(0).cast("long")))
    wall, voiced = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.01)), F.greatest(F.col("speech_seconds"), F.lit(0.01))
    speaking = F.greatest(voiced - F.coalesce("_held", F.lit(0.0)), F.lit(0.01))
    return both.withColumn("wpm", rounded(F.col("word_count") / (wall / 60), 1)).withColumn("articulation_wpm", rounded(F.col("word_count") / (speaking / 60), 1)).drop("_held")


def turn_stance(segments: DataFrame) -> DataFrame:
    """(call_id, turn_idx, certainty): that of a turn's first segment that has one; turns below SCORED seconds have none."""
    spoken = F.sum(F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0)))
    made = segments.groupBy("call_id", "turn_idx").agg(spoken.alias("_s"), F.min_by("certainty", F.when(F.col("certainty").isNotNull(), F.col("seg_idx"))).alias("certainty"))
    return made.select("call_id", "turn_idx", F.when(F.col("_s") >= SCORED, F.col("certainty")).alias("certainty"))


def annotated(segments: DataFrame, words: DataFrame, prosody: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, pauses): turns with reply latency, pace, emotion, stance, sentiment, disfluency and prosody.

    segments: call_id, seg_idx, speaker, start_s, end_s, text, arousal, valence, measured (whether they are the turn's), certainty.
    words: call_id, seg_idx, word_idx, word, start_s, end_s, kind; a call none of whose words has a kind has no disfluency (null, not 0).
    prosody: call_id, turn_idx and any of the features; it counts for turns of SCORED seconds. Segments without words count all the same.
    """
    dealt = with_turns(segments)
    key = ["call_id", "turn_idx"]
    seconds = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.trim(F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), " ")
    turns = reply_latencies(dealt.groupBy(*key).agg(F.min("speaker").alias("speaker"), F.min_by("start_s", "seg_idx").alias("start_s"), F.max_by("end_s", "seg_idx").alias("end_s"), F.sum(seconds).alias("speech_seconds"), F.trim(said).alias("text")))
    in_turns = words.join(dealt.select("call_id", "seg_idx", "turn_idx", F.col("start_s").alias("_low"), F.col("end_s").alias("_high")), ["call_id", "seg_idx"])
    place = F.row_number().over(Window.partitionBy(*key).orderBy("seg_idx", "word_idx")).alias("word_idx")
    in_turns = in_turns.select(*key, "seg_idx", place, "word", "start_s", "end_s", "kind", "_low", "_high")
    held = kept_by_call(pauses(in_turns, within=True))
    # events are no words; a segment without words has those of its text
    told = disfluency(in_turns.withColumn("_kind", F.col("kind")).withColumn("kind", F.coalesce("kind", F.lit("content"))), "seg_idx", [F.nullif(F.count_if(F.col("kind") != "event"), F.lit(0)).alias("_n"), F.bool_or(F.col("_kind").isNotNull()).alias("_known")])
    counted = dealt.select(*key, "seg_idx", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).alias("_text")).join(told, [*key, "seg_idx"], "left")
    facts = counted.groupBy(*key).agg(F.sum(F.coalesce("_n", "_text")).alias("word_count"), F.sum("medial").alias("medial"), F.sum("filled_pauses").alias("filled_pauses"), F.bool_or("_known").alias("_known"))
    turns = paced(turns, held, facts)
    scored = lambda name: turn_scores(dealt.select(*key, "seg_idx", seconds.alias("seconds"), F.col(name).alias("score"), "measured"), SCORED).withColumnRenamed("score", name)
    for name in ("arousal", "valence"):
        turns = turns.join(scored(name), key, "left")
    turns = turns.join(turn_stance(dealt), key, "left").withColumn("lexical", sentiment(without_fillers(F.col("text"))))
    turns = turns.withColumn("_verbatim", F.coalesce(F.bool_or("_known").over(Window.partitionBy("call_id")), F.lit(False)))
    turns = turns.select(*(c for c in turns.columns if c not in ("_known", "medial", "filled_pauses")), "medial", "filled_pauses")
    known = lambda c: F.when(F.col("_verbatim"), F.coalesce(c, F.lit(0).cast("long")))
    turns = turns.withColumn("filled_pauses", known("filled_pauses")).withColumn("medial", known("medial"))
    turns = turns.withColumn("medial_fillers", rounded(100 * F.col("medial") / F.greatest("word_count", F.lit(1)), 2)).drop("_verbatim")
    measured = [] if prosody is None else [c for c in prosody.columns if c not in key]
    if measured:
        turns = turns.join(prosody, key, "left").select([F.when(F.col("speech_seconds") >= SCORED, F.col(c)).alias(c) if c in measured else F.col(c) for c in [*turns.columns, *measured]])
    missing = [f for f in FEATURES if f not in (*turns.columns, "articulation")]
    return turns.select("*", F.col("articulation_wpm").alias("articulation"), *(F.lit(None).cast("double").alias(f) for f in missing)), held


def _window_references(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, scale and count of each window (windows, features, width), missing values left out; both are NaN below two values."""
    ordered = np.sort(values, axis=2)  # NaN last
    n = np.isfinite(values).sum(2)
    take = lambda a, k: np.take_along_axis(a, np.clip(k, 0, a.shape[2] - 1)[:, :, None], 2)[:, :, 0]
    middle = lambda a: (take(a, (n - 1) // 2) + take(a, n // 2)) / 2
    median = middle(ordered)
    scale = 1.4826 * middle(np.sort(np.abs(values - median[:, :, None]), axis=2))

    def quartile(i: int) -> np.ndarray:
        j = np.clip(i * (n + 1) // 4, 1, np.maximum(n - 1, 1))
        rest = i * (n + 1) - 4 * j
        return (take(ordered, j - 1) * (4 - rest) + take(ordered, j) * rest) / 4

    flat = ~(scale > 0)
    scale[flat] = np.maximum((quartile(3) - quartile(1)) / 1.349, 0)[flat]
    few = n < 2
    median[few] = scale[few] = np.nan
    return median, scale, n


def _trailing(turns: DataFrame, features: tuple[str, ...] = FEATURES, least: int = LEAST, behind: int = BEHIND, scored_seconds: float = SCORED, after: float = TRAILING_AFTER) -> DataFrame:
    """(call_id, turn_idx, and median, scale and count of feature k as _m<k>, _s<k>, _n<k>): references of the speaker's last `behind` scored turns before each scored turn.

    There are none in recordings shorter than `after` (media_seconds, null counts as short), and none until there are `least` such turns.
    turns: call_id, turn_idx, speaker, speech_seconds, media_seconds and the features. One sorted pass; between batches a speaker's last
    `behind` turns are kept for all features at once.
    """
    keys = ["call_id", "speaker"]
    scored = turns.where((F.col("speech_seconds") >= scored_seconds) & (F.col("media_seconds") >= after))
    rows = scored.select(*keys, "turn_idx", *(F.when(finite(F.col(f)), F.col(f).cast("double")).alias(f) for f in features))
    schema = rows.schema
    out = f"call_id {schema['call_id'].dataType.simpleString()}, turn_idx {schema['turn_idx'].dataType.simpleString()}, " + ", ".join(f"_m{k} double, _s{k} double, _n{k} long" for k in range(len(features)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, past, seen = None, np.zeros((0, len(features))), 0
        for frame in batches:
            values = frame[list(features)].to_numpy(float, na_value=np.nan)
            new = np.ones(len(frame), bool)
            if len(frame) > 1:
                new[1:] = np.logical_or.reduce([(frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1]) for k in keys])
            if len(frame):
                new[0] = (frame["call_id"].iloc[0], frame["speaker"].iloc[0]) != last_key
            starts = np.unique(np.append(np.flatnonzero(new), [0] if len(frame) else [])).astype(int)
            for a, b in zip(starts, np.append(starts[1:], len(frame))):
                if new[a]:
                    past, seen = np.zeros((0, len(features))), 0
                whole = np.concatenate([np.full((behind, len(features)), np.nan), past, values[a:b]])
                offset = behind + len(past)
                at = np.arange(max(0, least - seen), b - a)
                if len(at):
                    windows = np.lib.stride_tricks.sliding_window_view(whole, behind, axis=0)[at + offset - behind]
                    median, scale, n = _window_references(windows)
                    out = {c: frame[c].to_numpy()[a + at] for c in ("call_id", "turn_idx")}
                    for k in range(len(features)):
                        out |= {f"_m{k}": [round(x, 3) if x == x else None for x in median[:, k].tolist()], f"_s{k}": [round(x, 4) if x == x else None for x in scale[:, k].tolist()], f"_n{k}": n[:, k]}
                    yield pd.DataFrame(out)
                past, seen = whole[behind:][-behind:], seen + b - a
                last_key = (frame["call_id"].iloc[a], frame["speaker"].iloc[a])

    return together(rows, *keys).sortWithinPartitions(*keys, "turn_idx").mapInPandas(run, out)


def trailing_features(turns: DataFrame, features: tuple[str, ...] = FEATURES, **options) -> DataFrame:
    """(call_id, turn_idx, feature, median, scale, n): see _trailing, a row for each turn and feature."""
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_m{k}").alias("median"), F.col(f"_s{k}").alias("scale"), F.col(f"_n{k}").alias("n")) for k, f in enumerate(features)))
    return _trailing(turns, features, **options).select("call_id", "turn_idx", F.inline(each))


def feature_references(turns: DataFrame, features: tuple[str, ...] = FEATURES, least: int = LEAST, scored_seconds: float = SCORED) -> DataFrame:
    """(call_id, speaker, feature, median, scale, mad, n) over a speaker's scored turns, of speakers with `least` such turns."""
    scored = turns.where(F.col("speech_seconds") >= scored_seconds)
    keys = ["call_id", "speaker"]
    many = scored.select(*keys, *features).withColumn("_turns", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_turns") >= least)
    return references(long_features(many, keys, list(features)), [*keys, "feature"])


def pause_notes(pauses_: DataFrame, least: float = LONG_PAUSE) -> DataFrame:
    """(call_id, turn_idx, pause_note): how many long pauses a turn has, or how long its only one is."""
    long_ = pauses_.where(F.col("seconds") >= least).groupBy("call_id", "turn_idx").agg(F.count("*").alias("_n"), F.max("seconds").alias("_s"))
    one = F.concat(F.lit("pauses for "), F.format_string("%.1f", rounded("_s", 1)), F.lit("s"))
    return long_.select("call_id", "turn_idx", F.when(F.col("_n") >= 2, F.concat(F.col("_n").cast("string"), F.lit(" long pauses"))).otherwise(one).alias("pause_note"))


def turn_moments(turns: DataFrame, pauses_: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Scored turns that depart from their speaker's usual, or pause long: with what is said of them, the evidence and the scope.

    turns: call_id, turn_idx, speaker, start_s, speech_seconds, media_seconds, text, medial and the features. A turn is compared with its
    speaker's turns before it where there is a trailing reference, else with the whole call's; a feature counts with LEAST values.
    evidence: feature, note, z, arousal_z (of a mismatch of words and voice) and n, in the order of the notes.
    """
    key = ["call_id", "turn_idx"]
    scored = turns.where(F.col("speech_seconds") >= SCORED)
    late = _trailing(turns, features).withColumn("_late", F.lit(True))
    reference = F.struct("feature", F.struct("median", "scale", "n"))
    whole = feature_references(turns, features).groupBy("call_id", "speaker").agg(F.map_from_entries(F.collect_list(reference)).alias("_whole"))
    both = scored.join(late, key, "left").join(whole, ["call_id", "speaker"], "left")
    pick = lambda k, f, a, b: F.when(F.col("_late"), F.col(f"{a}{k}")).otherwise(F.try_element_at("_whole", F.lit(f))[b])
    # all features of a turn are judged in its row
    both = both.select("*", *(F.when(finite(F.col(f)), pick(k, f, "_n", "n")).alias(f"_of_{f}") for k, f in enumerate(features)))
    z = lambda k, f: F.when(F.col(f"_of_{f}") >= LEAST, z_score(F.col(f).cast("double"), pick(k, f, "_m", "median"), pick(k, f, "_s", "scale")))
    both = both.select("*", *(z(k, f).alias(f"_z_{f}") for k, f in enumerate(features)))
    guards: dict[str, Column] = {"medial_fillers": F.col("medial") >= FILLERS, "certainty": F.col("certainty") <= LEAN if "certainty" in features else F.lit(False)}
    none, items = F.lit(None).cast("double"), []

    def item(place: int, feature: str, note: Column, z: str, arousal_z: Column, n: str) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(feature).alias("feature"), note.alias("note"), F.col(z).alias("z"), arousal_z.alias("arousal_z"), F.col(n).alias("n"))

    for place, (feature, high, low) in enumerate(NOTES):
        if feature in features:
            note = F.when(F.col(f"_z_{feature}") > 0, F.lit(high)).otherwise(F.lit(low)).cast("string")
            allowed = (F.abs(f"_z_{feature}") >= NOTABLE) & note.isNotNull() & guards.get(feature, F.lit(True))
            items.append(F.when(allowed, item(place, feature, note, f"_z_{feature}", none, f"_of_{feature}")))
    if {"lexical", "arousal"} <= set(features):
        apart = (F.abs("_z_lexical") >= MISMATCH) & (F.abs("_z_arousal") >= MISMATCH) & ((F.col("_z_lexical") > 0) != (F.col("_z_arousal") > 0))
        note = F.when(F.col("_z_lexical") > 0, "positive words, subdued delivery").otherwise("negative words, energetic delivery")
        items.append(F.when(apart, item(99, "mismatch", note, "_z_lexical", F.col("_z_arousal"), "_of_lexical")))
    both = both.withColumn("_e", F.filter(F.array(*items), lambda e: e.isNotNull())).withColumn("_e", F.when(F.size("_e") > 0, F.col("_e"))).withColumn("_trailing", F.col("_late"))
    found = both.select(*turns.columns, "_e", "_trailing").join(pause_notes(pauses_), key, "left").where("_e is not null or pause_note is not null")
    voice = F.coalesce(F.transform("_e", lambda e: e["note"]), F.array().cast("array<string>"))
    items = F.transform("_e", lambda e: F.struct(e["feature"].alias("feature"), e["note"].alias("note"), e["z"].alias("z"), e["arousal_z"].alias("arousal_z"), e["n"].alias("n")))
    empty = F.array().cast("array<struct<feature:string,note:string,z:double,arousal_z:double,n:bigint>>")
    return found.select(
        *key, "start_s", "speaker", F.concat(voice, F.when(F.col("pause_note").isNotNull(), F.array("pause_note")).otherwise(F.array().cast("array<string>"))).alias("observations"), voice.alias("voice_observations"),
        F.coalesce(items, empty).alias("evidence"), F.when(F.col("_trailing"), "trailing").otherwise("call").alias("baseline"), F.coalesce(F.exists("_e", lambda e: e["feature"] == "mismatch"), F.lit(False)).alias("mismatch"),
        F.substring("text", 1, PREVIEW).alias("preview"),
    )


def analysed(segments: DataFrame, words: DataFrame, calls: DataFrame, prosody: DataFrame | None = None) -> dict[str, DataFrame]:
    """From segments to report: turns, pauses, speakers, references and moments. calls: call_id, media_seconds. See annotated for the rest."""
    turns, held = annotated(segments, words, prosody)
    turns = kept_by_call(turns.join(calls.select("call_id", "media_seconds"), "call_id", "left"))
    scored = F.count_if(F.col("speech_seconds") >= SCORED)
    total = exact_sum("speech_seconds", 3)
    shared = turns.groupBy("call_id").agg(total.cast("double").alias("_total"))
    speakers = turns.groupBy("call_id", "speaker").agg(
        F.count("*").alias("turns"), scored.alias("scored_turns"), total.cast("double").alias("_own"), rounded(F.median("speech_seconds"), 2).alias("median_turn_seconds"), rounded(F.median("reply_latency"), 2).alias("median_reply_latency"),
        rounded(F.median("articulation_wpm"), 1).alias("articulation_wpm"), F.when(scored >= LEAST, scored).otherwise(0).alias("baseline_turns"),
    )
    speakers = speakers.join(shared, "call_id").withColumn("speech_seconds", rounded("_own", 1)).withColumn("talk_share", rounded(F.try_divide("_own", "_total"), 3)).drop("_own", "_total")
    return {"turns": turns, "pauses": held, "speakers": speakers, "references": feature_references(turns), "moments": turn_moments(turns, held)}
