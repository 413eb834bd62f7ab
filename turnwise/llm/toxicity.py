"""Toxicity by a convolutional network over hashed word embeddings.

A word (a run of letters and digits) has the sum of three embeddings: two of hashes of the word, so that a rare
word seldom looks like a telling one, and one of a hash of its beginning, for forms not seen before. Filters one, two and three words wide slide
over the whole text and each keeps its highest answer; a logistic unit weighs these. The network is trained
in numpy by Adam on a bounded sample. For each language a threshold is set on all labelled rows that it didn't learn
from, whole texts of any length, scored in Spark. The language is told from the letters of the text alone, and the
score is 0.5 at its threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnwise.llm._spark import kept
from turnwise.llm._text import buffers, mix, slices, word_hashes
from turnwise.llm.quality_rules import majority, remainder

BUCKETS, SIZE, WIDTHS, FILTERS, EPOCHS = 1 << 16, 8, (1, 2, 3), 4, 10
#: The sample to learn from: labelled rows of each class at most (those with the least hash of the id), and words of a class at most.
POSITIVE_ROWS, NEGATIVE_ROWS, TRAIN_WORDS = 2500, 4000, 3_000_000
#: Width of the steps in which logits are counted for the thresholds, and rows of each label that a language must have for one of its own.
BIN, LEAST_ROWS = 0.02, 10
PAD, BEGINNING = 3 * BUCKETS, 5  # its embedding is 0
# fixed values: second bytes of the two-byte letters (after 0xC3) that mark a language
LANGUAGES = {"de": "äöüßÄÖÜ", "es": "ñóíáúÑÓÍÁÚ", "fr": "éèêçàÉÈÊÇÀ"}
_SECOND = [np.array([c.encode()[1] for c in letters]) for letters in LANGUAGES.values()]


def languages(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0, or 1 + the place in LANGUAGES of the language whose letters are most frequent, if one in 200 bytes is such a letter."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(out)):
        raw = data[offsets[i] : offsets[i + 1]]
        second = np.bincount(raw[1:][raw[:-1] == 0xC3], minlength=256)
        counts = [int(second[s].sum()) for s in _SECOND]
        best = int(np.argmax(counts))
        out[i] = 1 + best if counts[best] * 200 > len(raw) else 0
    return out


def word_ids(column: pa.Array):
    """Slices of a text column: its rows' hashed words end to end, each row with max(WIDTHS) pads after it, the bounds, and languages."""
    data, offsets = buffers(column)
    pad = max(WIDTHS)
    for low, high in slices(offsets):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        words, bounds, starts, ends = word_hashes(part, own, ends=True, letters=True)
        ids = np.full((len(words) + pad * (high - low), 3), PAD, np.int32)
        lengths = np.diff(bounds)
        to = np.arange(len(words)) + pad * np.repeat(np.arange(high - low), lengths)
        ids[to, 0] = words & np.uint64(BUCKETS - 1)
        ids[to, 1] = (words >> np.uint64(40) & np.uint64(BUCKETS - 1)) + np.uint64(BUCKETS)
        start = np.zeros(len(words), np.uint64)
        for j in range(BEGINNING):
            byte = part[np.minimum(starts + j, max(0, len(part) - 1))].astype(np.uint64)
            byte += ((byte >= 65) & (byte <= 90)).astype(np.uint64) * np.uint64(32)
            start = start << np.uint64(8) | np.where(starts + j < ends, byte, np.uint64(0))
        ids[to, 2] = (mix(start, 3) & np.uint64(BUCKETS - 1)) + np.uint64(2 * BUCKETS)
        yield ids, bounds + pad * np.arange(high - low + 1), languages(part, own)


@dataclass
class Network:
    embeddings: np.ndarray  # 3 * BUCKETS + 1, SIZE
    filters: np.ndarray  # SIZE, places, FILTERS; a width has as many places as words
    bias: np.ndarray
    weights: np.ndarray
    shift: float = 0.0
    trained: bool = True

    def table(self) -> np.ndarray:
        """What each word adds at each place of each filter."""
        return (self.embeddings @ self.filters.reshape(SIZE, -1)).astype(np.float32)

    def rows(self, ids: np.ndarray, table: np.ndarray | None) -> np.ndarray:
        if table is None:
            return (self.embeddings[ids[:, 0]] + self.embeddings[ids[:, 1]] + self.embeddings[ids[:, 2]]) @ self.filters.reshape(SIZE, -1)
        return table[ids[:, 0]] + table[ids[:, 1]] + table[ids[:, 2]]

    def answers(self, ids: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Of all filters where they begin at each word; rows are apart by their pads."""
        rows = self.rows(ids, table)
        out, at = np.empty((len(ids), len(WIDTHS) * FILTERS), rows.dtype), 0
        for k, width in enumerate(WIDTHS):
            own = rows[:, at : at + FILTERS].copy()
            for j in range(1, width):
                own[:-j] += rows[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            out[:, k * FILTERS : (k + 1) * FILTERS] = own
            at += width * FILTERS
        return out

    def logits(self, ids: np.ndarray, bounds: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        top = np.maximum.reduceat(self.answers(ids, table), bounds[:-1])
        return np.maximum(top + self.bias, 0) @ self.weights + self.shift


def slopes(net: Network, texts: list[np.ndarray], y: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Of the mean logistic loss of some texts: the gradient by name, and the embeddings it touches with theirs."""
    ids, starts = np.concatenate(texts), np.cumsum([0, *WIDTHS])
    bounds = np.cumsum([0, *map(len, texts)])
    answers = net.answers(ids)
    peak = np.array([a + answers[a:b].argmax(0) for a, b in zip(bounds[:-1], bounds[1:])])
    top = np.take_along_axis(answers, peak, 0) + net.bias
    hidden = np.maximum(top, 0)
    error = (1 / (1 + np.exp(-np.clip(hidden @ net.weights + net.shift, -30, 30))) - y) / len(y)
    back = (error[:, None] * net.weights) * (top > 0)
    grads = {"weights": hidden.T @ error, "bias": back.sum(0), "filters": np.zeros_like(net.filters), "shift": error.sum()}
    words, pushes = [], []
    for k, width in enumerate(WIDTHS):
        g, p = back[:, k * FILTERS : (k + 1) * FILTERS], peak[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(width):
            word = ids[np.minimum(p + j, len(ids) - 1)]
            grads["filters"][:, starts[k] + j] += np.einsum("bf,bfs->sf", g, net.embeddings[word].sum(2))
            push = (g[:, :, None] * net.filters[:, starts[k] + j].T[None]).reshape(-1, SIZE)
            words.append(word.reshape(-1, 3).ravel())
            pushes.append(np.repeat(push, 3, 0))
    touched, place = np.unique(np.concatenate(words), return_inverse=True)
    sums = np.zeros((len(touched), SIZE))
    np.add.at(sums, place, np.concatenate(pushes))
    sums[touched == PAD] = 0
    return grads, touched, sums


def new_network(draw: np.random.Generator) -> Network:
    net = Network(draw.normal(0, 0.05, (3 * BUCKETS + 1, SIZE)), draw.normal(0, 0.4, (SIZE, sum(WIDTHS), FILTERS)), np.zeros(len(WIDTHS) * FILTERS), np.abs(draw.normal(0, 0.5, len(WIDTHS) * FILTERS)))
    net.embeddings[PAD] = 0
    return net


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5, batch: int = 16, rate: float = 0.02) -> Network:
    """texts: hashed words with their pads. With labels of one class, or none, the network says the smoothed share."""
    draw = np.random.Generator(np.random.PCG64(seed))
    net = new_network(draw)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        net.weights[:] = 0
        net.shift, net.trained = float(np.log(share / (1 - share))), False
        return net
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("embeddings", "filters", "bias", "weights")} | {"shift": [0.0, 0.0]}
    rows, steps = np.arange(len(y)), 0
    for _ in range(epochs):
        draw.shuffle(rows)
        for low in range(0, len(rows), batch):
            at = rows[low : low + batch]
            grads, touched, sums = slopes(net, [texts[i] for i in at], y[at])
            steps += 1
            size, slope = 1 - 0.9**steps, 1 - 0.999**steps
            for k, g in grads.items():
                m = moments[k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - rate * (m[0] / size) / (np.sqrt(m[1] / slope) + 1e-8))
            m = moments["embeddings"]  # only of the words that were touched
            m[0][touched] = 0.9 * m[0][touched] + 0.1 * sums
            m[1][touched] = 0.999 * m[1][touched] + 0.001 * sums * sums
            net.embeddings[touched] -= rate * (m[0][touched] / size) / (np.sqrt(m[1][touched] / slope) + 1e-8)
    return net


def best_threshold(bins: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The middle of the gap between counted steps of logits (BIN wide) above which the F1 is highest."""
    order = np.argsort(-bins, kind="stable")
    bins, hits, said = bins[order], np.cumsum(positive[order]), np.cumsum(positive[order] + negative[order])
    k = int((2 * hits / (said + positive.sum())).argmax())
    return float((bins[k] + bins[k + 1] + 1) / 2 * BIN if k + 1 < len(bins) else bins[k] * BIN - 1)


def thresholds(counts: list[tuple[int, int, int, int]]) -> list[float]:
    """Of each language, from (language, label, step, rows); the common one where it has too few rows, 0 where there are none of a label."""
    table = np.array(counts, np.int64).reshape(-1, 4)

    def of(rows: np.ndarray, least: int, otherwise: float) -> float:
        one = rows[:, 1] == 1
        if rows[one, 3].sum() < least or rows[~one, 3].sum() < least:
            return otherwise
        bins, place = np.unique(rows[:, 2], return_inverse=True)
        return best_threshold(bins, *(np.bincount(place, rows[:, 3] * own, minlength=len(bins)) for own in (one, ~one)))

    common = of(table, 1, 0.0)
    return [of(table[table[:, 0] == k], LEAST_ROWS, common) for k in range(len(LANGUAGES) + 1)]


def fit(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, positive_rows: int, negative_rows: int, train_words: int) -> tuple[Network, DataFrame]:
    """The network, and (id) of the rows it may have learned from. known: id, label."""
    classes = [known.where(f"label = {k}") for k in (0, 1)]
    chosen = [c.orderBy(F.xxhash64("id"), "id").limit(n) for c, n in zip(classes, (negative_rows, positive_rows))]
    # some of the sample stay out, so that thresholds can be set where it takes in all rows
    chosen = kept(chosen[0].union(chosen[1]).where(remainder(F.col("id"), 7) >= 2))
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id", "label").agg(F.min("text").alias("text"))

    def hashed(batches):
        for batch in batches:
            low = 0
            for ids, bounds, _ in word_ids(batch.column(0)):
                raw = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), *(batch.column(k).slice(low, len(raw)) for k in (1, 2))], ["words", "label", "place"])
                low += len(raw)

    rows = kept(sample.select("text", "label", F.xxhash64("id").alias("place")).mapInArrow(hashed, "words binary, label int, place long"))
    so_far = F.sum(F.octet_length("words").cast("long")).over(Window.partitionBy("label").orderBy("place", "words"))
    held = rows.withColumn("bytes", so_far).where(F.col("bytes") <= 12 * train_words).select("words", "label").toPandas().sort_values(["label", "words"], kind="stable")
    return train([np.frombuffer(w, np.int32).reshape(-1, 3) for w in held["words"]], held["label"].to_numpy(float)), chosen.select("id")


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, threshold: float = 0.5,
    positive_rows: int = POSITIVE_ROWS, negative_rows: int = NEGATIVE_ROWS, train_words: int = TRAIN_WORDS,
) -> DataFrame:
    """id_col, held_out, score and predicted of every row of docs; repeated rows give a row each.

    Labels are taken from rows whose crc32(id) mod folds isn't 0. The driver trains on positive_rows and negative_rows of
    them at most, in the order of a hash of the id, up to train_words words of each class: whole texts, however long. The
    thresholds are taken from all others. Scoring reads whole texts, and nothing but texts. Null and empty texts score as
    a text without words; a null id is held out. With labels of one class, or none, every text scores about that class's
    smoothed share. Of repeated labels the more frequent counts. Further columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = kept(majority(labels, id_col, label_col).where(remainder(F.col("id"), folds) != 0))
    net, learned = fit(docs, known, id_col, text_col, positive_rows, negative_rows, train_words)
    shared = docs.sparkSession.sparkContext.broadcast((net, net.table()))

    def run(batches):
        own, table = shared.value
        for batch in batches:
            parts = [(own.logits(ids, bounds, table), language) for ids, bounds, language in word_ids(batch.column(1))]
            logits, language = (np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]).astype(kind) for k, kind in enumerate((np.float64, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits), pa.array(language)], ["id", "logit", "language"])

    scored = kept(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, logit double, language int"))
    lowest = [0.0] * (len(LANGUAGES) + 1)
    if net.trained:
        others = scored.join(known, "id").join(F.broadcast(learned), "id", "left_anti")
        step = F.floor(F.greatest(F.least("logit", F.lit(60.0)), F.lit(-60.0)) / BIN).alias("step")
        lowest = thresholds([tuple(r) for r in others.groupBy("language", "label", step).agg(F.count("*").alias("n")).collect()])
    distance = F.col("logit") - F.element_at(F.array(*map(F.lit, lowest)), F.col("language") + 1)
    score = 1 / (1 + F.exp(-F.greatest(F.least(distance, F.lit(30.0)), F.lit(-30.0))))
    held = F.coalesce(remainder(F.col("id"), folds) == 0, F.lit(True))
    return scored.withColumn("score", score).select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
