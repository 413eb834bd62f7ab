"""Exact top-k inner products with bounds from segment means and deviations, coarse to fine.

Cut into segments of m components with means u, v and deviations s, t, two vectors have
sum m*u*v - m*s*t <= <x, y> <= sum m*u*v + m*s*t. The upper bound of the score (as the lower bound
of a distance) is taken with few long segments first; pairs whose bound is below the query's
present k-th score are left out, the others go on to shorter segments and at last to the exact product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Queries in one pass over the rows, and rows that meet them at once.
QUERY_BLOCK, ROW_BLOCK = 4096, 2048
#: Segments of the levels, coarse to fine.
LEVELS = (4, 16)
#: Below this size of a component, products of a thousand components are exact in float64.
SAFE = 2.0**21


def segments(x: np.ndarray, count: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length, side by side."""
    cuts = np.linspace(0, x.shape[1], min(count, x.shape[1]) + 1).astype(int)
    means, spreads = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = x[:, a:b]
        mean = part.mean(1, keepdims=True)
        means.append(mean * np.sqrt(b - a))
        spreads.append(np.sqrt(((part - mean) ** 2).sum(1, keepdims=True)))
    return np.hstack(means + spreads)


def quantise(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * vectors)


def search_block(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, best: list[np.ndarray], k: int, levels=LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """best: scores and ids of each query so far, descending; returns them with these rows taken in. Scores are float64 integers."""
    scores, found = best
    floor = scores[:, -1]
    alive = ids[:, None] != row_ids[None, :]
    for count in levels:
        slack = 1e-9 * np.abs(segments(queries, 1)).max(initial=0) * np.abs(segments(rows, 1)).max(initial=0) + 1e-6
        bound = segments(queries, count) @ segments(rows, count).T
        alive &= bound + slack >= floor[:, None]
    # exact products of the survivors, query by query
    for q in np.flatnonzero(alive.any(1)):
        at = np.flatnonzero(alive[q])
        exact = rows[at] @ queries[q]
        all_scores, all_ids = np.concatenate([scores[q], exact]), np.concatenate([found[q], row_ids[at]])
        order = np.lexsort((all_ids, -all_scores))[:k]
        scores[q], found[q] = all_scores[order], all_ids[order]
    return scores, found


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, levels=LEVELS) -> DataFrame:
    """query_id, rank, id_col and score of the k rows of vectors with the highest inner product with each query.

    Components become floor(scale * x) first. Ties go to the smaller id. Null vectors and vectors with a null or
    non-finite component take no part, nor do vectors of another length than the query's. A row with the query's own
    id is not its candidate; repeated rows of another id count one by one; a repeated query counts once. Queries go
    in blocks of QUERY_BLOCK, each of which meets all rows, so a block is all that the driver and a task hold;
    a task keeps k rows for each query. Further columns are left out.
    """
    spark = vectors.sparkSession
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(whole & F.col("id").isNotNull())
    rows, asked = take(vectors), take(queries).groupBy("id").agg(F.min("v").alias("v"))
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    found = None
    for block in _blocks(asked, scale):
        wanted = spark.sparkContext.broadcast(block)

        def run(batches, wanted=wanted):
            state, plain = {}, set()
            for batch in batches:
                lengths = np.asarray(batch.column(1).value_lengths())
                ids, lists = np.asarray(batch.column(0)), batch.column(1)
                for size in np.unique(lengths):
                    if int(size) not in wanted.value:
                        continue
                    q_ids, q = wanted.value[int(size)]
                    here = np.flatnonzero(lengths == size)
                    part = quantise(np.asarray(lists.take(pa.array(here)).flatten()).reshape(len(here), size), scale)
                    state.setdefault(int(size), (np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), np.iinfo(np.int64).max)))
                    if max(np.abs(q).max(), np.abs(part).max()) >= SAFE:
                        plain.add(int(size))  # from here on: what is found so far may not be exact in floats
                    for low in range(0, len(here), ROW_BLOCK):
                        sub, sub_ids = part[low : low + ROW_BLOCK], ids[here[low : low + ROW_BLOCK]]
                        if int(size) in plain:
                            state[int(size)] = _plain(q, q_ids, sub, sub_ids, state[int(size)], k)
                        else:
                            state[int(size)] = search_block(q, q_ids, sub, sub_ids, list(state[int(size)]), k, levels)
            for size, (scores, found_) in state.items():
                q_ids = wanted.value[size][0]
                at = np.nonzero(np.isfinite(scores.astype(float)))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[0]]), pa.array(found_[at]), pa.array(scores[at].astype(np.int64))], ["query_id", "id", "score"])

        part = rows.mapInArrow(run, "query_id long, id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty.withColumnRenamed("id", id_col)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _plain(q, q_ids, rows, row_ids, best, k):
    """Components too large for exact floats: products of whole numbers, without bounds; they must fit a long."""
    scores, found = best
    exact = q.astype(np.int64).astype(object) @ rows.astype(np.int64).astype(object).T
    for i in range(len(q_ids)):
        at = np.flatnonzero(row_ids != q_ids[i])
        all_scores, all_ids = [*scores[i], *exact[i][at]], [*found[i], *row_ids[at]]
        order = sorted(range(len(all_ids)), key=lambda j: (-all_scores[j], all_ids[j]))[:k]
        scores = scores.astype(object)
        scores[i], found[i] = [all_scores[j] for j in order], [all_ids[j] for j in order]
    return scores, found


def _blocks(asked: DataFrame, scale: int):
    """Blocks of at most QUERY_BLOCK queries, one at a time: vector length -> ids and quantised vectors."""
    low = None
    while True:
        more = asked if low is None else asked.where(F.col("id") > low)
        rows = more.orderBy("id").limit(QUERY_BLOCK).collect()
        if not rows:
            return
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
        yield {n: (np.array([i for i, _ in x], np.int64), np.floor(scale * np.array([v for _, v in x], float))) for n, x in by.items()}
        low = rows[-1]["id"]
        if len(rows) < QUERY_BLOCK:
            return
