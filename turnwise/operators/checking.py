"""Further checks of a model's reply (its channels, speakers, note lines, topics, shape), and small joins around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.functions.lexicons import BANNED, NOT_NAMES
from turnwise.functions.text import json_object, normalised

# fixed values: what an interaction claim says of an overlap, how long a telling gap is, and how many times the usual one
OVERLAP_WORDS = r"(?i)\b(?:overlap\w*|interrupt\w*|floor|talks? over|talked over|cuts? in|cut in)\b"
GAP_SECONDS, GAP_TIMES, PAUSE_SECONDS = 2.0, 3.0, 2.0
# fixed values: kinds of words that are disfluent, and those that a clean text leaves out
DISFLUENT, TAGGED = ("filler", "cutoff", "repetition"), ("filler", "cutoff", "repetition", "vocalisation", "event")
# fixed values: the enumerations of a reply
LAYERS, CHANNELS = ("stance_commitment", "unsaid", "relational"), ("lexical", "timing", "prosody", "disfluency", "interaction")
LIKELIHOODS, CONFIDENCE = ("very unlikely", "unlikely", "roughly even chance", "likely", "very likely"), ("low", "moderate", "high")
DIMENSIONS = ("faithfulness", "usefulness", "non_obviousness", "over_reach", "tone")


def meets(rows: DataFrame, spans: DataFrame, name: str = "overlapped", bin_seconds: float = 30.0) -> DataFrame:
    """rows (call_id, turn_idx, start_s, end_s, ...) with a flag: whether one of the spans (call_id, start_s, end_s) overlaps it.

    Both are joined on the call and time bins, so that a call isn't joined with itself as a whole.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_seconds), F.floor(F.greatest(a, b) / bin_seconds)))
    left = rows.select("call_id", "turn_idx", F.col("start_s").alias("_a"), F.col("end_s").alias("_b"), bins("start_s", "end_s").alias("_bin"))
    right = spans.select("call_id", F.col("start_s").alias("_c"), F.col("end_s").alias("_d"), bins("start_s", "end_s").alias("_bin"))
    hit = left.join(right, ["call_id", "_bin"]).where("_c < _b and _a < _d").select("call_id", "turn_idx").distinct().withColumn(name, F.lit(True))
    return rows.join(hit, ["call_id", "turn_idx"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def stumbling_quotes(quotes: DataFrame, turns: DataFrame, least: int = 2) -> DataFrame:
    """quotes (call_id, turn_idx, _q: normalised) with _stumbles: whether the words that the quote first covers have `least` disfluent ones.

    turns: call_id, turn_idx, words (array of norm, kind); words without letters are passed over. Turns are met once for each of their quotes.
    """
    told = turns.select("call_id", "turn_idx", F.filter("words", lambda w: w["norm"] != "").alias("_told"))
    told = told.select("call_id", "turn_idx", F.transform("_told", lambda w: w["norm"]).alias("_norms"), F.transform("_told", lambda w: w["kind"].isin(*DISFLUENT).cast("int")).alias("_off"))
    both = quotes.join(told, ["call_id", "turn_idx"]).withColumn("_tokens", F.split("_q", " ")).withColumn("_k", F.size("_tokens"))
    both = both.where("size(_norms) >= _k and array_contains(_norms, _tokens[0])")
    starts = F.filter(F.sequence(F.lit(1), F.size("_norms") - F.col("_k") + 1), lambda i: F.slice("_norms", i, F.col("_k")) == F.col("_tokens"))
    found = both.withColumn("_start", F.get(starts, 0)).where("_start is not null")
    off = F.aggregate(F.slice("_off", F.col("_start"), F.col("_k")), F.lit(0), lambda a, x: a + x)
    return found.select("call_id", "turn_idx", "_q", (off >= least).alias("_stumbles"))


def channel_problems(evidence: DataFrame, turns: DataFrame, moments: DataFrame) -> DataFrame:
    """evidence (call_id, claim, item, turn_idx, channel, quote, matched, description, moments) with problem: null if its channel bears it.

    turns: call_id, turn_idx, words (array of norm, kind), reply_latency, median_latency, pauses (array of seconds), overlapped.
    moments: call_id, moment_id, turn_idx, features. A moment counts on its own turn only.
    """
    cited = evidence.select("call_id", "claim", "item", "turn_idx", F.explode("moments").alias("moment_id")).join(moments, ["call_id", "moment_id", "turn_idx"])
    cited = cited.groupBy("call_id", "claim", "item").agg(
        F.max(F.exists("features", lambda f: f.isNotNull() & (f != "medial_fillers"))).alias("_voice"), F.max(F.array_contains("features", "medial_fillers")).alias("_filled"),
    )
    asked = evidence.withColumn("_q", F.when(F.col("channel") == "disfluency", normalised(F.coalesce("quote", F.lit("")))))
    stumbling = stumbling_quotes(asked.where("_q <> ''").select("call_id", "turn_idx", "_q").distinct(), turns)
    both = asked.join(turns.drop("words"), ["call_id", "turn_idx"]).join(cited, ["call_id", "claim", "item"], "left").join(stumbling, ["call_id", "turn_idx", "_q"], "left")
    no = F.lit(False)
    late = (F.col("reply_latency") >= GAP_SECONDS) & (F.col("median_latency") > 0) & (F.col("reply_latency") >= GAP_TIMES * F.col("median_latency"))
    still = F.exists("pauses", lambda p: p >= PAUSE_SECONDS)
    over = F.coalesce("description", F.lit("")).rlike(OVERLAP_WORDS)
    channel = F.col("channel")
    problem = (
        F.when((channel == "prosody") & ~F.coalesce("_voice", no), "prosody_unsupported")
        .when((channel == "disfluency") & ~(F.coalesce("_filled", no) | F.coalesce("_stumbles", no)), "disfluency_unsupported")
        .when((channel == "timing") & ~(F.coalesce(late, no) | F.coalesce(still, no)), "timing_unsupported")
        .when((channel == "lexical") & ~F.coalesce("matched", no), "lexical_needs_quote")
        .when((channel == "interaction") & over & ~F.col("overlapped"), "interaction_unsupported")
        .when(~F.coalesce(channel.isin(*CHANNELS), no), "unknown_channel")
    )
    return both.select(*evidence.columns, problem.alias("problem"))


def speaker_problems(claims: DataFrame, speakers: DataFrame, readers: DataFrame) -> DataFrame:
    """claims (call_id, claim, speaker) with problem: about_reader, unknown_speaker or no_baseline, in that order; null if fine.

    speakers: call_id, speaker, baseline_turns. readers: call_id, me.
    """
    both = claims.join(readers, "call_id", "left").join(speakers.select("call_id", "speaker", "baseline_turns", F.lit(True).alias("_known")), ["call_id", "speaker"], "left")
    problem = F.when(F.col("speaker") == F.col("me"), "about_reader").when(F.col("_known").isNull(), "unknown_speaker").when(F.coalesce("baseline_turns", F.lit(0)) <= 0, "no_baseline")
    return both.select(*claims.columns, problem.alias("problem"))


def known_ids(rows: DataFrame, keys: list[str], ids: str, known: DataFrame, name: str) -> DataFrame:
    """rows with the array `ids` less what isn't in known (call_id, `name`), in order, repeats kept."""
    told = rows.select("call_id", *keys, F.posexplode(ids).alias("_place", name)).join(known.select("call_id", name).distinct(), ["call_id", name])
    cleaned = told.groupBy("call_id", *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", name))), lambda x: x[name]).alias("_clean"))
    kind = rows.schema[ids].dataType
    return rows.join(cleaned, ["call_id", *keys], "left").withColumn(ids, F.coalesce("_clean", F.array().cast(kind))).drop("_clean")


def note_lines(lines: DataFrame, turns: DataFrame, banned: str = BANNED) -> DataFrame:
    """lines (call_id, line, text, turn_ids) with problem and turn_ids less those that aren't there.

    wording_note_line: banned words; unverified_note_line: turns are cited and none of them is there; null: the line stays.
    """
    marked = lines.withColumn("_cited", F.coalesce(F.size("turn_ids"), F.lit(0)) > 0)
    cleaned = known_ids(marked, ["line"], "turn_ids", turns, "turn_idx")
    problem = F.when(F.coalesce("text", F.lit("")).rlike(banned), "wording_note_line").when(F.col("_cited") & (F.size("turn_ids") == 0), "unverified_note_line")
    return cleaned.withColumn("problem", problem).drop("_cited")


def topic_spans(topics: DataFrame, turns: DataFrame) -> DataFrame:
    """topics (call_id, topic, spans: arrays of first and last) with the spans both ends of which are there; topics without any go."""
    told = topics.select("call_id", "topic", F.posexplode("spans").alias("_place", "_span"))
    at = lambda k, name: turns.select("call_id", F.col("turn_idx").alias(name)).distinct()
    both = told.select("*", F.get("_span", 0).alias("_a"), F.get("_span", 1).alias("_b")).join(at(0, "_a"), ["call_id", "_a"]).join(at(1, "_b"), ["call_id", "_b"])
    return both.groupBy("call_id", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_span"))), lambda x: x["_span"]).alias("spans"))


def reply_accounts(claims: DataFrame, evidence: DataFrame, rejected: DataFrame) -> DataFrame:
    """Of each call: proposed, kept, dropped, evidence_proposed, evidence_quote_rejected and model_rejected (which no reason counts).

    claims: call_id, claim, reason (null is kept). evidence: call_id, problem. rejected: call_id, claim.
    """
    count = lambda c: F.count_if(c)
    own = claims.groupBy("call_id").agg(F.count("*").alias("proposed"), count(F.col("reason").isNull()).alias("kept"), count(F.col("reason").isNotNull()).alias("dropped"))
    items = evidence.groupBy("call_id").agg(F.count("*").alias("evidence_proposed"), count(F.coalesce(F.col("problem").isin("quote_mismatch", "quote_too_long"), F.lit(False))).alias("evidence_quote_rejected"))
    gone = rejected.where(F.coalesce("claim", F.lit("")) != "").groupBy("call_id").agg(F.count("*").alias("model_rejected"))
    zero = ["evidence_proposed", "evidence_quote_rejected", "model_rejected"]
    return own.join(items, "call_id", "left").join(gone, "call_id", "left").fillna(0, zero)


def kept_clusters(reviews: DataFrame, clusters: DataFrame, observations: DataFrame) -> DataFrame:
    """Clusters (call_id, cluster, supports) whose review (call_id, cluster, verdict) isn't to drop, with the ids of their observations that are there, sorted."""
    kept = reviews.where(F.coalesce("verdict", F.lit("")) != "drop").select("call_id", "cluster", "verdict").join(clusters, ["call_id", "cluster"])
    cited = kept.select("call_id", "cluster", F.explode("supports").alias("observation")).join(observations.select("call_id", "observation").distinct(), ["call_id", "observation"])
    found = cited.groupBy("call_id", "cluster").agg(F.array_sort(F.collect_set("observation")).alias("observations"))
    return kept.join(found, ["call_id", "cluster"], "left").select("call_id", "cluster", "verdict", F.coalesce("observations", F.array().cast("array<string>")).alias("observations"))


def clean_text(words: DataFrame, keys: list[str], tagged: Sequence[str] = TAGGED) -> DataFrame:
    """Text and number of words of each segment without the tagged kinds: words (keys, word_idx, word, kind). A segment keeps a row, if an empty one."""
    stays = ~F.coalesce(F.col("kind").isin(*tagged), F.lit(False))
    word = F.trim(F.coalesce("word", F.lit("")))
    told = F.array_sort(F.collect_list(F.when(stays, F.struct("word_idx", word.alias("word")))))
    joined = F.trim(F.regexp_replace(F.array_join(F.transform(told, lambda x: x["word"]), " "), r"[ \t\n]+", " "))
    return words.groupBy(*keys).agg(joined.alias("text"), F.count_if(stays).alias("word_count"))


def own_turns(items: DataFrame, turns: DataFrame, me: str, banned: str = BANNED) -> DataFrame:
    """Coaching items (call_id, item, text, advice, turn_idx) without banned words; a turn that isn't there or isn't `me`'s becomes null."""
    mine = turns.where(F.col("speaker") == me).select("call_id", "turn_idx", F.lit(True).alias("_mine"))
    told = items.where(~F.coalesce("text", F.lit("")).rlike(banned) & ~F.coalesce("advice", F.lit("")).rlike(banned))
    return told.join(mine, ["call_id", "turn_idx"], "left").withColumn("turn_idx", F.when(F.col("_mine"), F.col("turn_idx"))).select(items.columns)


def call_date(name: Column, modified: Column, today: Column) -> Column:
    """The date in a recording's name, else that of its file, else today's."""
    named = F.regexp_extract(name, r"(?:^|[^0-9A-Za-z_])(\d{4}-\d{2}-\d{2})(?:[^0-9A-Za-z_]|$)", 1)
    return F.coalesce(F.try_to_date(F.nullif(named, F.lit("")), "yyyy-MM-dd"), F.to_date(modified), today)


def candidate_turns(moments: DataFrame, order: list[str], a_call: int = 8) -> DataFrame:
    """The first a_call moments (call_id, order, ...) of each call."""
    return moments.withColumn("place", F.row_number().over(Window.partitionBy("call_id").orderBy(*order))).where(F.col("place") <= a_call)


def guess_me(speakers: DataFrame, calls: DataFrame, not_names: Sequence[str] = NOT_NAMES) -> DataFrame:
    """Which of a call's two main speakers is probably the reader: call_id, label, counterpart, counterpart_name; calls without a clear answer have no row.

    speakers: call_id, speaker, baseline_turns, name. calls: call_id, title. A main speaker has baseline_turns. Where
    exactly one of them has a name of the title, the other is the reader; where the title has other capitalised names
    and one of them alone is named, that one is.
    """
    low = F.array(*map(F.lit, sorted(set(not_names))))
    name = F.rtrim(F.trim(F.coalesce("name", F.lit(""))), F.lit("?"))
    pairs = speakers.where(F.col("baseline_turns") > 0).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("speaker", name.alias("name")))).alias("_s")).where(F.size("_s") == 2)
    title = F.coalesce("title", F.lit(""))
    tokens = F.filter(F.transform(F.regexp_extract_all(title, F.lit(r"([A-Za-z]+)"), F.lit(1)), lambda t: F.lower(t)), lambda t: (F.length(t) >= 2) & ~F.array_contains(low, t))
    names = F.filter(F.regexp_extract_all(title, F.lit(r"\b([A-Z][a-z]{2,})\b"), F.lit(1)), lambda t: ~F.array_contains(low, F.lower(t)))
    both = pairs.join(calls, "call_id").select("call_id", F.get("_s", 0).alias("_a"), F.get("_s", 1).alias("_b"), tokens.alias("_tokens"), F.array_sort(F.array_distinct(names)).alias("_names"))
    in_title = lambda s: F.array_contains(F.col("_tokens"), F.lower(F.col(f"{s}.name")))
    first, second = in_title("_a") & ~in_title("_b"), in_title("_b") & ~in_title("_a")
    named = lambda s: F.col(f"{s}.name") != ""
    strange = lambda s: ~F.array_contains(F.transform("_names", lambda t: F.lower(t)), F.lower(F.col(f"{s}.name")))
    some = F.size("_names") > 0
    third, fourth = named("_a") & ~named("_b") & some & strange("_a"), named("_b") & ~named("_a") & some & strange("_b")
    a, b, none = F.col("_a.speaker"), F.col("_b.speaker"), F.lit(None).cast("string")
    found = both.withColumn("label", F.when(first, b).when(second, a).when(third, a).when(fourth, b).otherwise(none))
    found = found.withColumn("counterpart", F.when(F.col("label") == a, b).when(F.col("label") == b, a))
    found = found.withColumn("counterpart_name", F.when(first, F.col("_a.name")).when(second, F.col("_b.name")).otherwise(F.get("_names", 0)))
    return found.where("label is not null").select("call_id", "label", "counterpart", "counterpart_name")


def frame_ranges(start: Column, end: Column, offset: Column, hop: Column, frames: Column, window: float = 0.04) -> tuple[Column, Column, Column, Column]:
    """Frames that cover start to end, and those that lie within: first and end (exclusive) of each, ends are cut toward 0."""
    whole = lambda x: x.cast("long")
    a, b = (start - offset) / hop, (end - offset) / hop
    low, inner = F.greatest(whole(a), F.lit(0)), F.greatest(F.ceil(a), F.lit(0))
    return low, F.least(whole(b) + 1, frames), inner, F.greatest(F.least(whole(b - window / hop) + 1, frames), inner)


def reading_key(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The turns that a reading cites, sorted, each once: what readings are matched by."""
    return evidence.groupBy(*keys).agg(F.array_sort(F.collect_set("turn_idx")).alias("turns"))


def judge_replies(replies: DataFrame, reply: str = "reply", swapped: str = "swapped") -> DataFrame:
    """The columns of replies with prefer (A, B or tie, as if not swapped) and problem: not JSON, a dimension without a number, or no such preference.

    Code fences and what stands around the outermost braces go first. A number in quotes is none; true and false count as numbers.
    """
    said = F.try_parse_json(json_object(F.col(reply)))
    kind = lambda s, d: F.schema_of_variant(F.try_variant_get("_said", f"$.{s}.{d}", "variant"))
    number = lambda s, d: F.coalesce(kind(s, d).rlike(r"^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"), F.lit(False))
    missing = F.filter(F.array(*(F.when(~number(s, d), F.lit(f"missing score {s}.{d}")) for s in "AB" for d in DIMENSIONS)), lambda x: x.isNotNull())
    prefer = F.when(F.schema_of_variant(F.try_variant_get("_said", "$.prefer", "variant")) == "STRING", F.try_variant_get("_said", "$.prefer", "string"))
    problem = F.when(F.col("_said").isNull(), "not JSON").when(F.size(missing) > 0, F.get(missing, 0)).when(~F.coalesce(prefer.isin("A", "B", "tie"), F.lit(False)), "prefer must be A, B or tie")
    turned = F.when(~F.col(swapped) | (prefer == "tie"), prefer).when(prefer == "A", "B").otherwise("A")
    return replies.withColumn("_said", said).withColumn("problem", problem).withColumn("prefer", F.when(F.col("problem").isNull(), turned)).drop("_said")


def shape_problems(claims: DataFrame) -> DataFrame:
    """claims (layer, speaker, claim, likelihood, evidence_confidence, evidence: array of turn_id, channel) with problems: what of a reply's shape is wrong,
    in the order of the fields' depth, then their names."""
    field = lambda name, wrong: F.when(wrong, F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit("missing"))))
    listed = lambda name, values: field(name, ~F.coalesce(F.col(name).isin(*values), F.lit(False)))
    upper = [field("claim", F.col("claim").isNull()), listed("evidence_confidence", CONFIDENCE), listed("layer", LAYERS), listed("likelihood", LIKELIHOODS), field("speaker", F.col("speaker").isNull())]
    at = lambda i, what: F.concat(F.lit("evidence "), i.cast("string"), F.lit(what))
    item = lambda e, i: F.array(F.when(~F.coalesce(e["channel"].isin(*CHANNELS), F.lit(False)), at(i, ".channel")), F.when(~F.coalesce(e["turn_id"].rlike(r"^T\d{3,}$"), F.lit(False)), at(i, ".turn_id")))
    lower = F.flatten(F.transform(F.coalesce("evidence", F.array().cast(claims.schema["evidence"].dataType)), item))
    return claims.withColumn("problems", F.filter(F.concat(F.array(*upper), lower), lambda x: x.isNotNull()))
