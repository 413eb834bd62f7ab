"""Column functions on text, times and identifiers. Keys are ASCII, so that engines agree on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from turnwise.functions.numbers import rounded
from turnwise.functions.lexicons import HEDGES, NEGATIVE, NEGATORS, POSITIVE


def turn_id(index: Column) -> Column:
    return F.format_string("T%03d", index + 1)


def minutes(seconds: Column) -> Column:
    """mm:ss, rounded down; minutes may pass 59, negatives are 0."""
    whole = F.greatest(F.floor(seconds), F.lit(0).cast("long"))
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def timestamp(seconds: Column, separator: str = ",") -> Column:
    """HH:MM:SS,mmm; a thousand milliseconds stay 999."""
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(s)
    milli = F.least(F.round((s - whole) * 1000).cast("long"), F.lit(999).cast("long"))
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, milli)


def letter_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1))


def sentiment(text: Column, scores: Mapping[str, float] = POSITIVE | NEGATIVE, negators: Sequence[str] = NEGATORS, flip: float = -0.6, alpha: float = 15.0) -> Column:
    """Sum of word scores, each turned around by `flip` after a negator, over the root of its square plus alpha; 3 places. No words: 0."""
    tokens = letter_tokens(text)
    known = F.create_map(*(F.lit(x) for pair in scores.items() for x in (pair[0], float(pair[1]))))
    # a token with the one before it; the first follows nothing
    pairs = F.filter(F.zip_with(tokens, F.concat(F.array(F.lit("")), tokens), lambda t, p: F.struct(t.alias("t"), p.alias("p"))), lambda x: x["t"].isin(*scores))
    scored = F.transform(pairs, lambda x: F.element_at(known, x["t"]) * F.when(x["p"].isin(*negators), flip).otherwise(1.0))
    total = F.aggregate(scored, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(rounded(total / F.sqrt(total * total + alpha), 3), F.lit(0.0))


#: fixed values: the filled pauses that are taken out before sentiment
FILLERS = ("um", "uh", "uhm", "umm", "uhh", "erm", "er", "ehm")


def without_fillers(text: Column, fillers: Sequence[str] = FILLERS) -> Column:
    """text less the filled pauses (with a comma or full stop after them) and [events]."""
    words = "|".join(sorted(fillers, key=len, reverse=True))
    return F.regexp_replace(F.regexp_replace(text, rf"(?iU)\b(?:{words})\b[,.]?", ""), r"\[[^\]]*\]", "")


def normalised(text: Column) -> Column:
    """The form in which quotes are compared: lower case, brackets as spaces, tokens of a-z 0-9 ' with one closing - kept.

    Whole texts are replaced by patterns, without a function on each token; \\x01 stands for a closing - meanwhile.
    """
    steps = (
        ("\x01", "_"), (r"[\[\]]", " "), (r"-(?=[.,!?;:]*(?:[ \t\n]|\z))", "\x01"), (r"[^a-z0-9' \t\n\x01]", ""), (r"(?<![^ \t\n])'+|'+(?=\x01?(?:[ \t\n]|\z))", ""),
        (r"(?<![a-z0-9'])\x01", ""), ("\x01", "-"), (r"[ \t\n]+", " "),
    )
    out = F.lower(text)
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def holds(text: Column, quote: Column) -> Column:
    """Whether the tokens of quote occur as such in text, both normalised; an empty quote doesn't."""
    return (quote != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), quote, F.lit(" ")))


def questions(text: Column) -> Column:
    """Question marks outside [events]: as many as sentences that end in one."""
    clean = F.regexp_replace(text, r"\[[^\]]*\]", "")
    return (F.length(clean) - F.length(F.replace(clean, F.lit("?"), F.lit("")))).cast("long")


def phrase_hits(text: Column, phrases: Sequence[str] = HEDGES) -> Column:
    """How often the phrases occur as whole tokens of a-z and '."""
    spaced = F.concat(F.lit(" "), F.array_join(letter_tokens(text), "  "), F.lit(" "))
    hits = F.lit(0)
    for phrase in phrases:
        wanted = " " + "  ".join(phrase.lower().split()) + " "
        hits = hits + F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(wanted), F.lit("")))) / len(wanted))
    return hits.cast("long")


def terms(text: Column) -> Column:
    """Comma or line separated terms, trimmed, without empty ones, the first of each kept."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,\n]"), lambda t: F.trim(t)), lambda t: t != ""))


def call_id(path: Column, size: Column) -> Column:
    return F.sha1(F.concat(path, F.lit("|"), size.cast("string")))


def insight_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def semitones(hz: Column, reference: Column) -> Column:
    return F.when((hz > 0) & (reference > 0), 12 * F.log2(hz / reference))


def json_object(reply: Column) -> Column:
    """A reply without code fences, from its first { to its last }; null if there is none."""
    bare = F.regexp_replace(reply, r"```[a-z]*", "")
    first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    return F.when((first > 0) & (F.instr(bare, "}") > 0) & (last >= first), F.substring(bare, first, last - first + 1))


def fixed(x: Column, places: int) -> Column:
    """A double with so many places, rounded by its exact value, without signs between thousands."""
    return F.translate(F.format_number(x, places), ",", "")
