"""Ranked lexical search: items against documents as a blocked product of sparse matrices.

An item is a row of multiplicities over its terms, a document a column of integer impacts. Documents stay where they are
read: each task turns its rows into blocks of a term-by-document matrix, merges the rows that an item names (Gustavson's
row merging, all items of a block in one numpy expansion) and keeps the best k of each item over its blocks. Only those
are shuffled, by item and task first, then by item.

Terms are told apart by hashes of 64 bits. The items' matrix is broadcast in groups of at most about HELD_TERMS entries,
so its size in a task is bounded; each group reads the documents twice (statistics, scores).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnwise.llm._spark import kept
from turnwise.llm._text import TERMS, buffers, slices, word_hashes

#: Entries of the items' matrix (16 bytes each) that a group of items has, about.
HELD_TERMS = 1 << 22
#: Cells of scores (items by documents), and products, that a task works on at a time.
CELLS = 1 << 21
#: First stage of the reduction: keys an item's best rows of tasks are dealt to.
SALTS = 32
_LAST = np.iinfo(np.int64).max


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, occurrences) of every term of a row, and the number of terms of each row with repeats."""
    data, offsets = buffers(column)
    rows, terms, lengths = [], [], np.zeros(len(column), np.int64)
    for low, high in slices(offsets):
        hashes, bounds, _ = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], only=TERMS)
        lengths[low:high] = np.diff(bounds)
        rows.append(np.repeat(np.arange(low, high), lengths[low:high]))
        terms.append(hashes)
    row, term = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (terms, np.uint64)))
    return *_counted(row, term), lengths


def _counted(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(first)
    return row[at], term[at], np.diff(np.append(at, len(row)))


def _held(terms: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms are in the sorted vocabulary, and their places there."""
    if not len(vocabulary):
        return np.zeros(len(terms), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    hit = vocabulary[at] == terms
    return hit, at[hit]


def _vocabulary_entries(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_entries of the terms that are in the vocabulary, which are given by their place there."""
    data, offsets = buffers(column)
    rows, terms, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(column), np.int64)
    for low, high in slices(offsets):
        hashes, bounds, _ = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], only=TERMS)
        lengths[low:high] = np.diff(bounds)
        hit, at = _held(hashes, vocabulary)
        rows.append(np.repeat(np.arange(low, high), lengths[low:high])[hit])
        terms.append(at)
    key, count = np.unique(np.concatenate(rows) * max(len(vocabulary), 1) + np.concatenate(terms), return_counts=True)
    return key // max(len(vocabulary), 1), key % max(len(vocabulary), 1), count, lengths


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term, times): the terms of all rows of an item id, by their hash."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, count, _ = _entries(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(term.view(np.int64)), pa.array(count)], ["item", "term", "times"])

    kind = items.schema[item_id].dataType.simpleString()
    terms = items.select(F.col(item_id), F.col(text)).mapInArrow(split, f"item {kind}, term bigint, times bigint")
    return terms.groupBy("item", "term").agg(F.sum("times").alias("times"))


def _statistics(docs: DataFrame, vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and how many documents hold each term of the vocabulary (a broadcast)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary.value
        found, some, every = np.zeros(len(held), np.int64), 0, 0
        for batch in batches:
            _, term, _, lengths = _vocabulary_entries(batch.column(0), held)
            found += np.bincount(term, minlength=len(held))
            some, every = some + int((lengths > 0).sum()), every + int(lengths.sum())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(found[at], [some, every]))], ["term", "found"])

    rows = docs.mapInArrow(count, "term bigint, found bigint").groupBy("term").agg(F.sum("found").alias("found")).toPandas()
    at, found = rows["term"].to_numpy(np.int64), rows["found"].to_numpy(np.int64)
    df = np.zeros(len(vocabulary.value), np.int64)
    df[at[at >= 0]] = found[at >= 0]
    return int(found[at == -1].sum()), int(found[at == -2].sum()), df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of terms."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(times: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated, length-normalised impacts of terms in documents, as integers."""
    m = 100 - 90 + 90 * length * n_docs // max(n_terms, 1)
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each item, ties to the smaller document."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    start = np.searchsorted(item, item)
    keep = np.arange(len(item)) - start < k
    return item[keep], score[keep], doc[keep]


def product(first: np.ndarray, terms: np.ndarray, factors: np.ndarray, where: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (first item, scores of items by documents) of the product of two sparse matrices in rows.

    Item i names terms[first[i]:first[i + 1]] with factors; term t has the documents doc[where[t]:where[t + 1]] with impacts.
    """
    sizes = np.diff(where)[terms]
    done = np.concatenate([[0], np.cumsum(sizes)])
    low, items = 0, len(first) - 1
    while low < items:
        most = min(low + max(1, CELLS // max(n_docs, 1)), items)
        high = max(low + 1, min(most, int(np.searchsorted(done[first], done[first[low]] + CELLS, "right")) - 1))
        scores = np.zeros((high - low) * n_docs, np.int64)
        owner = np.repeat(np.arange(high - low), np.diff(first[low : high + 1])) * n_docs
        at, to = int(first[low]), int(first[high])
        while at < to:
            end = max(at + 1, min(to, int(np.searchsorted(done, done[at] + CELLS, "right")) - 1))
            size = sizes[at:end]
            place = np.repeat(where[terms[at:end]] - (done[at:end] - done[at]), size) + np.arange(size.sum())
            np.add.at(scores, np.repeat(owner[at - first[low] : end - first[low]], size) + doc[place], np.repeat(factors[at:end], size) * impact[place])
            at = end
        yield low, scores.reshape(high - low, n_docs)
        low = high


def _block(batch: pa.RecordBatch, matrix: dict, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, score, document) of the best of every item in a batch of documents."""
    ids = batch.column(0).cast(pa.int64()).fill_null(_LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    row, term, times, lengths = _vocabulary_entries(batch.column(1), matrix["vocabulary"])
    impact = impacts(times, lengths[row], matrix["n_docs"], matrix["n_terms"])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_term = np.argsort(term, kind="stable")
    where = np.searchsorted(term[by_term], np.arange(len(matrix["vocabulary"]) + 1))
    ids = ids[order]
    for low, scores in product(matrix["first"], matrix["terms"], matrix["factors"], where, place[row[by_term]], impact[by_term], len(ids)):
        limit = np.ones((len(scores), 1), np.int64)
        if len(ids) > k:
            limit = np.maximum(limit, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k :][:, :1])
        item, doc = np.nonzero(scores >= limit)
        yield best(item + low, scores[item, doc], ids[doc], k)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest scores above 0, ties to the smaller id.

    once: a term counts once in an item, whatever its repeats; else as often as the item has it. Null and empty texts have no
    term: such documents are not counted, such items have no rows. Rows of one item id are one item; a null item id is an id.
    Repeated documents are ranked each; rows without an id come after others of their score. Whole texts are read; no row,
    no term and no posting is left out. Empty tables give no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long"), F.col(text))
    terms = kept(item_terms(items, item_id, item_text))
    kind = items.schema[item_id].dataType.simpleString()
    found = []
    groups = -(-terms.count() // HELD_TERMS)
    for g in range(groups):
        group = terms if groups == 1 else terms.where(F.pmod(F.hash("item"), F.lit(groups)) == g)
        rows = group.orderBy("item", "term").toArrow()
        if not rows.num_rows:
            continue
        vocabulary, at = np.unique(rows.column("term").to_numpy().view(np.uint64), return_inverse=True)
        names = rows.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        owner = names.indices.to_numpy(zero_copy_only=False)
        held = spark.sparkContext.broadcast(vocabulary)
        n_docs, n_terms, df = _statistics(docs.select(text), held)
        factors = weights(df, n_docs)[at] * (1 if once else rows.column("times").to_numpy())
        matrix = spark.sparkContext.broadcast({
            "vocabulary": vocabulary, "first": np.searchsorted(owner, np.arange(len(names.dictionary) + 1)), "terms": at,
            "factors": factors, "names": names.dictionary, "n_docs": n_docs, "n_terms": n_terms,
        })
        found.append(docs.mapInArrow(_search(matrix, k), f"item {kind}, score bigint, doc bigint, task int"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("item", F.col("task") % SALTS).orderBy(*order))).where(F.col("rank") <= k)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return every.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def _search(matrix, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, top = matrix.value, (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for more in _block(batch, held, k) if batch.num_rows else ():
                top = best(*(np.concatenate(x) for x in zip(top, more)), k)
        item, score, doc = top
        task = TaskContext.get().partitionId()
        ids = pa.array(doc, mask=doc == _LAST)
        yield pa.RecordBatch.from_arrays([held["names"].take(pa.array(item)), pa.array(score), ids, pa.array(np.full(len(item), task, np.int32))], ["item", "score", "doc", "task"])

    return search
