"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The index is of the items, cut into units of UNIT words at most; a unit's impacts are its BM25 weights over
their sum, so a passage that holds the whole unit scores 1. Document frequencies and lengths are of all units, so
that a score doesn't depend on how items are dealt to indexes. Every window of 2 * UNIT words of every document,
UNIT words apart, is a query, so each unit lies whole in a window. Windows whose terms can't reach the
threshold for any unit, by the impacts of its rarer terms and by what the common terms give any one unit together,
are settled for a whole slice of texts at once; for the others WAND finds all units at or above it. What is found is verified by the n-grams of its question and of its answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnwise.llm._spark import give_back, kept, only, small_batches
from turnwise.llm._text import buffers, shingle_hashes, slices, word_hashes

#: Words of a unit, items of an index (and bytes of their texts), postings of a block, and BM25's constants.
UNIT, INDEX_ITEMS, INDEX_BYTES, POSTINGS, K1, B = 64, 20_000, 1 << 24, 16, 1.2, 0.75


def split_answer(text: str) -> tuple[str, str]:
    """Question and answer of an item that has one text: the last sentence is the answer, if there are two."""
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), letters=True)[0]


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, np.array([0, len(words)]), size)[0])


def item_units(question: str, answer: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """An item's words, those of its question and of its answer, and its units."""
    q, a = _words(question), _words(answer)
    words = np.concatenate([q, a])
    return q, a, np.array_split(words, max(1, -(-len(words) // UNIT))) if len(words) else []


@dataclass
class Frequencies:
    """Of all units: their number, their mean length, and in how many each term is (terms ascending; of an index's terms at least)."""

    units: int
    length: float
    terms: np.ndarray
    df: np.ndarray

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]

    @staticmethod
    def own(items: list[tuple]) -> "Frequencies":
        units = [u for _, question, answer in items for u in item_units(question, answer)[2]]
        terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, units)]), return_counts=True)
        return Frequencies(len(units), sum(map(len, units)) / max(1, len(units)), terms, df)


class Index:
    """Terms (sorted hashes), each with its postings: units ascending, impacts, and the largest impact of each block."""

    def __init__(self, items: list[tuple], ngram: int = 5, frequencies: Frequencies | None = None):
        every = frequencies or Frequencies.own(items)
        self.ids, self.questions, self.answers, self.lengths = [], [], [], []
        units, self.item_of = [], []
        for id_, question, answer in items:
            q, a, parts = item_units(question, answer)
            if not parts:
                continue
            self.ids.append(id_)
            self.questions.append(_grams(q, ngram))
            self.answers.append(_grams(a, ngram))
            self.lengths.append(len(q) + len(a))
            for part in parts:
                units.append(np.unique(part, return_counts=True))
                self.item_of.append(len(self.ids) - 1)
        n = len(units)
        terms = np.concatenate([u[0] for u in units]) if n else np.zeros(0, np.uint64)
        self.terms, places, df = np.unique(terms, return_inverse=True, return_counts=True)
        whole = every.of(self.terms) if n else df
        idf = np.log(1 + (every.units - whole + 0.5) / (whole + 0.5))
        length = np.array([u[1].sum() for u in units], float)
        unit = np.repeat(np.arange(n), [len(u[0]) for u in units])
        tf = np.concatenate([u[1] for u in units]).astype(float) if n else np.zeros(0)
        weight = idf[places] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[unit] / max(1e-9, every.length)))
        impact = weight / np.bincount(unit, weight, minlength=n)[unit] if n else weight
        order = np.lexsort((unit, places))
        cuts = np.concatenate([[0], np.cumsum(df)])
        self.postings = [(unit[o].tolist(), impact[o].tolist()) for o in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
        self.blocks = [[max(p[1][i : i + POSTINGS]) for i in range(0, len(p[1]), POSTINGS)] for p in self.postings]
        self.most = np.array([max(b) for b in self.blocks])
        # the commonest terms, in the order of their frequency, and what the first k of them give any one unit at most
        self.by_df = np.argsort(-df, kind="stable")
        sums, self.common_most = np.zeros(n), np.zeros(len(df))
        for k, t in enumerate(self.by_df):
            units_, impacts = self.postings[t]
            sums[units_] += impacts
            self.common_most[k] = max(self.common_most[k - 1] if k else 0.0, sums[units_].max())
        self.starts, self.unit, self.impact = cuts, unit[order], impact[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def common(self, most: float) -> tuple[np.ndarray, float]:
        """Which terms are common: as many as give no unit more than `most` together; and what they give one at most."""
        k = int(np.searchsorted(self.common_most, most, "right"))
        out = np.zeros(len(self.terms), bool)
        out[self.by_df[:k]] = True
        return out, float(self.common_most[k - 1]) if k else 0.0

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and the terms."""
        at = np.flatnonzero(self.maybe[(words & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.searchsorted(self.terms, words[at])
        real = self.terms[np.minimum(term, len(self.terms) - 1)] == words[at]
        return at[real], term[real]

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All units whose impacts for these distinct terms add up to the threshold."""
        cursors = [[self.postings[t][0], self.postings[t][1], self.blocks[t], float(self.most[t]), 0] for t in terms]
        out, slack = [], threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0][c[4]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[3]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return out
            unit = cursors[pivot][0][cursors[pivot][4]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][4]] == unit:
                pivot += 1
            bound, ends = 0.0, []
            for c in cursors[: pivot + 1]:
                block = self._seek(c, unit) // POSTINGS
                if block < len(c[2]):
                    bound += c[2][block]
                    ends.append(c[0][min((block + 1) * POSTINGS, len(c[0])) - 1])
            if bound < slack:
                # no unit up to the nearest end of these blocks, or before the next list begins, can reach it
                to = min(ends, default=unit) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0][cursors[pivot + 1][4]])
                to = max(to, unit + 1)
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    i = self._seek(c, unit)
                    if i < len(c[0]) and c[0][i] == unit:
                        score += c[1][i]
                if score >= slack:
                    out.append((unit, score))
                to = unit + 1
            for c in cursors[: pivot + 1]:
                c[4] = self._seek(c, to)
            cursors = [c for c in cursors if c[4] < len(c[0])]
        return out

    @staticmethod
    def _seek(cursor: list, unit: int) -> int:
        import bisect

        return bisect.bisect_left(cursor[0], unit, cursor[4])


def search(index: Index, words: np.ndarray, bounds: np.ndarray, threshold: float, overlap: float, ngram: int = 5) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of the verified finds in texts given as hashed words."""
    at, term = index.lookup(words)
    if not len(at):
        return []
    # half windows: UNIT words each, numbered through all rows; a window is a half and the next of its row
    halves = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // UNIT))])
    row = np.searchsorted(bounds, at, "right") - 1
    half = halves[row] + (at - bounds[row]) // UNIT
    pairs = np.unique(half * len(index.terms) + term)
    half, term = pairs // len(index.terms), pairs % len(index.terms)
    common, given = index.common(threshold / 2)
    rare = ~common[term]
    many = np.diff(index.starts)[term[rare]]
    posting = np.repeat(index.starts[term[rare]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    units = len(index.item_of)
    seen, place = np.unique(np.repeat(half[rare], many) * units + index.unit[posting], return_inverse=True)
    reach = np.bincount(place, index.impact[posting], minlength=len(seen))
    alone = reach
    after = np.searchsorted(seen, seen + units)
    follows = (seen[np.minimum(after, len(seen) - 1)] == seen + units) & ~np.isin(seen // units, halves[1:] - 1) if len(seen) else np.zeros(0, bool)
    reach = reach + np.where(follows, reach[np.minimum(after, len(seen) - 1)], 0.0) if len(seen) else reach
    best: dict[tuple[int, int], list[float]] = {}
    # a window is tried for what its second half has alone too: its first may have common terms of the unit only
    back = seen[alone + given >= threshold - 1e-9] // units
    back = back[~np.isin(back, halves[:-1])] - 1
    for h in np.unique(np.concatenate([seen[reach + given >= threshold - 1e-9] // units, back])).tolist():
        r = int(np.searchsorted(halves, h, "right") - 1)
        last = min(h + 1, halves[r + 1] - 1)
        terms = np.unique(term[np.searchsorted(half, h) : np.searchsorted(half, last, "right")]).tolist()
        for unit, score in index.wand(terms, threshold):
            item = index.item_of[unit]
            low = int(bounds[r] + (h - halves[r]) * UNIT)
            room = index.lengths[item]
            part = words[max(int(bounds[r]), low - room) : min(int(bounds[r + 1]), low + 2 * UNIT + room)]
            grams = {size: _grams(part, size) for size in {ngram}}
            share = [1.0 if not len(g) else _held(part, g, grams[ngram], ngram) for g in (index.questions[item], index.answers[item])]
            if min(share) >= overlap - 1e-9:
                found = best.setdefault((r, item), [0.0, 0.0, 0.0])
                best[r, item] = [max(x) for x in zip(found, [score, *share])]
    return [(r, i, *v) for (r, i), v in best.items()]


def _held(words: np.ndarray, wanted: np.ndarray, grams: np.ndarray, ngram: int) -> float:
    """The share of the wanted n-grams found; the one n-gram of a text of fewer words is looked for at its own length."""
    if len(wanted) == 1 and wanted[0] not in grams:
        for size in range(1, ngram):
            windows = [words[i : i + size] for i in range(len(words) - size + 1)]
            if windows and wanted[0] in shingle_hashes(np.concatenate(windows), np.arange(len(windows) + 1) * size, ngram)[0]:
                return 1.0
    return np.isin(wanted, grams).mean()


def _items(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> DataFrame:
    """(id, text, answer) of the items with a text; ids are longs or strings."""
    whole = benchmark.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    answer = F.coalesce(F.col(answer_col), F.lit("")) if answer_col else F.lit(None).cast("string")
    return benchmark.select(F.col(id_col).cast("long" if whole else "string").alias("id"), F.col(text_col).alias("text"), answer.alias("answer")).where("text is not null")


def _parts(text: str, answer: str | None) -> tuple[str, str]:
    return split_answer(text) if answer is None else (text, answer)


def _unit_terms(items: DataFrame) -> DataFrame:
    """(term, units, words): in how many units each term is; and for a null term how many units and words there are."""

    def run(batches):
        for batch in batches:
            units = [u for text, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for u in item_units(*_parts(text, answer))[2]]
            terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, units)]), return_counts=True)
            none = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(terms.view(np.int64)), none]), pa.array(np.append(df, len(units))), pa.array(np.append(0 * df, sum(map(len, units))))], ["term", "units", "words"])

    return items.select("text", "answer").mapInArrow(run, "term long, units long, words long").groupBy("term").agg(F.sum("units").alias("units"), F.sum("words").alias("words"))


def _indexes(items: DataFrame, ngram: int) -> Iterator[Index]:
    """Indexes of at most INDEX_ITEMS items and about INDEX_BYTES of text, by id, one at a time; weights are of all items."""
    counts = kept(_unit_terms(items))
    total = counts.where("term is null").first()
    if total is None or not total["units"]:
        return

    def index(own: list[tuple]) -> Index:
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(u for _, q, a in own for u in item_units(q, a)[2])]))
        wanted = items.sparkSession.createDataFrame([(int(t),) for t in terms.view(np.int64)], "term long")
        df = counts.join(F.broadcast(wanted), "term").select("term", "units").toPandas()
        of, n = df["term"].to_numpy(np.int64).view(np.uint64), df["units"].to_numpy(np.int64)
        order = np.argsort(of)
        return Index(own, ngram, Frequencies(int(total["units"]), total["words"] / total["units"], of[order], n[order]))

    own, size = [], 0
    for id_, text, answer in items.orderBy("id", "text", "answer").toLocalIterator():
        own.append((id_, *_parts(text, answer)))
        size += len(text)
        if len(own) >= INDEX_ITEMS or size >= INDEX_BYTES:
            yield index(own)
            own, size = [], 0
    if own:
        yield index(own)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    threshold: float = 0.7, overlap: float = 0.8, ngram: int = 5,
) -> DataFrame:
    """id_col, item_col, score, question_overlap and answer_overlap: a row for each row of docs and item found in it.

    A find is a window that scores at least `threshold` for a unit of the item, in whose surroundings at least `overlap`
    of the n-grams of the question, and of the answer, occur. Without answer_col, an item's last sentence is its answer.
    Words are runs of letters, digits and apostrophes, A-Z as a-z. score is the highest of a document's windows. Items
    without words, and null texts, are found nowhere and find nothing; repeated items and rows each count. Ids may be of
    any type that can be cast from and to a string. Items are taken in indexes of a fixed size (INDEX_ITEMS, INDEX_BYTES), each of which meets
    all documents; the term weights are of all items, whatever the index. Documents aren't shuffled. Further columns are left out.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    read, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    items = _items(benchmark, item_col, item_text_col, answer_col)
    schema = f"id {kind.simpleString()}, item {items.schema['id'].dataType.simpleString()}, score double, question double, answer double"
    item_kind = pa.int64() if items.schema["id"].dataType.typeName() == "long" else pa.string()
    for index in _indexes(items, ngram):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared, item_kind=item_kind):
            give_back()
            index = shared.value
            for batch in batches:
                data, offsets = buffers(batch.column(1))
                found = []
                for low, high in slices(offsets):
                    words, bounds, _ = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], letters=True)
                    found += [(low + r, index.ids[i], *v) for r, i, *v in search(index, words, bounds, threshold, overlap, ngram)] if len(index.ids) else []
                if found:
                    rows, items, *values = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(items, item_kind), *(pa.array(v, pa.float64()) for v in values)], ["id", "item", "score", "question", "answer"])

        part = read.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("id").alias(id_col), F.col("item").cast(benchmark.schema[item_col].dataType).alias(item_col), "score", F.col("question").alias("question_overlap"), F.col("answer").alias("answer_overlap"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is not that of a contaminated one. Null ids stay."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options).where(F.col(id_col).isNotNull()).select(id_col).distinct()
    with small_batches(docs.sparkSession):
        bad = kept(bad)
    return only(docs, bad, id_col, "left_anti").select(docs.columns)
