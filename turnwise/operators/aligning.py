"""Alignment of two word streams of a call, without a call in one group.

Large calls are cut at anchors first: words that both streams hold once, of which the longest chain that rises in both is
kept. Pieces between anchors that are too large still are cut again, by words that are single within them, and where there
are none by time. Each piece is bounded, and aligned by a dynamic program: the most equal words, then the closest in time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnwise.operators.batches import begins
from turnwise.operators.storing import ROWS, by_call, kept_by_call as kept

#: Cells of a piece's table (words of one side times the other's), and words of a piece that is cut by time.
CELLS, A_SLICE = 160_000, 600
#: Words of the pieces that are aligned together, of both sides.
TOGETHER = 600
#: Words further apart in time count as this far when ties are broken.
FAR_SECONDS = 5.0


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence."""
    tops: list[int] = []
    at: list[int] = []
    behind: list[int] = []
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        behind.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[pile], at[pile] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = behind[k]
    return out[::-1]


def _grown(left: list[int], right: list[int]) -> np.ndarray:
    """[i, j]: the most equal words, rising in both, of the first i of left and j of right; a row of the table is a number's bits."""
    at: dict[int, int] = {}
    for j, w in enumerate(right):
        at[w] = at.get(w, 0) | 1 << j
    m, wide = len(right), len(right) // 8 + 1
    full = (1 << m) - 1
    flat, rows = full, [full.to_bytes(wide, "little")]
    for w in left:
        hit = flat & at.get(w, 0)
        flat = (flat + hit | flat - hit) & full
        rows.append(flat.to_bytes(wide, "little"))
    flats = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), wide), axis=1, count=m, bitorder="little")
    out = np.zeros((len(rows), m + 1), np.int16 if m < 1 << 15 else np.int32)
    np.cumsum(1 - flats, axis=1, dtype=out.dtype, out=out[:, 1:])
    return out


def best_pairs(a: Sequence[Hashable], b: Sequence[Hashable], times_a: np.ndarray, times_b: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j), rising in both, of the most equal words; of such, those closest in time, to the millisecond; of such, those that end first.

    Only equal words that lie on some longest chain are looked at: with k pairs before and all the others after. Those of one k hold the pair k
    of every longest chain, so chains are weighed from one k to the next.
    """
    codes: dict[Hashable, int] = {}
    left, right = ([codes.setdefault(w, len(codes)) for w in words] for words in (a, b))
    if not left or not right:
        return []
    before, after = _grown(left, right), _grown(left[::-1], right[::-1])[::-1, ::-1]
    most = int(before[-1, -1])
    place = np.argsort(right, kind="stable")
    low, high = (np.searchsorted(np.array(right)[place], left, side) for side in ("left", "right"))
    i = np.repeat(np.arange(len(left)), high - low)
    j = place[np.arange(len(i)) + np.repeat(high - np.cumsum(high - low), high - low)]
    chained = before[i, j] + after[i + 1, j + 1] == most - 1
    i, j = i[chained], j[chained]
    apart = np.rint(1000 * np.minimum(np.nan_to_num(np.abs(times_a[i] - times_b[j]), nan=FAR_SECONDS), FAR_SECONDS)).astype(np.int64)
    level = before[i, j]
    order = np.argsort(level, kind="stable")
    i, j = i[order], j[order]
    u, v, far = i.tolist(), j.tolist(), apart[order].tolist()
    ends = np.searchsorted(level[order], np.arange(most + 1)).tolist()
    for start, mid, end in zip(ends, ends[1:], ends[2:]):
        if mid - start == 1:
            for x in range(mid, end):
                far[x] += far[start]
        elif (mid - start) * (end - mid) <= 64:
            for x in range(mid, end):
                far[x] += min(far[y] for y in range(start, mid) if u[y] < u[x] and v[y] < v[x])
        else:
            past, now = slice(start, mid), slice(mid, end)
            behind = (i[past] < i[now][:, None]) & (j[past] < j[now][:, None])
            far[now] = (far[now] + np.where(behind, far[past], np.iinfo(np.int64).max).min(axis=1)).tolist()
    out, below, under = [], len(left), len(right)
    for start, end in zip(ends[-2::-1], ends[:0:-1]):
        if end - start == 1:
            below, under = u[start], v[start]
        else:
            _, below, under = min((far[x], u[x], v[x]) for x in range(start, end) if u[x] < below and v[x] < under)
        out.append((below, under))
    return out[::-1]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by call_id and piece as tables of whole groups, with the places at which these begin and the last one ends."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not len(table):
            continue
        edges = begins(table, ["call_id", "piece"]).tolist()
        if len(edges) > 1:
            yield table.slice(0, edges[-1]), edges
        held = table.slice(edges[-1])
    if held is not None:
        yield held, [0, len(held)]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, edges in _whole_groups(batches):
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        keep = [start + k for start, end in zip(edges, edges[1:]) for k in longest_rise(j[start:end].tolist())]
        yield from pa.table({"call_id": table.column("call_id").take(pa.array(keep, pa.int64())), "i": i[keep], "j": j[keep]}).to_batches()


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small pieces are aligned together, one after the other, with words that are equal within a piece only."""
    for table, edges in _whole_groups(batches):
        side, at, times, keys = table.column("side").to_numpy(), table.column("at").to_numpy(), table.column("t").to_numpy(), table.column("key").to_pylist()
        words = list(zip(np.repeat(np.arange(len(edges) - 1), np.diff(edges)).tolist(), keys))
        i, j, start = [], [], 0
        for end, after in zip(edges[1:], [*edges[2:], None]):
            if after is not None and after - start <= TOGETHER:
                continue
            left, right = (start + np.flatnonzero(side[start:end] == s) for s in (0, 1))
            pairs = best_pairs([words[k] for k in left.tolist()], [words[k] for k in right.tolist()], times[left], times[right])
            if pairs:
                one, two = np.array(pairs).T
                i.append(left[one])
                j.append(right[two])
            start = end
        if i:
            i, j = np.concatenate(i), np.concatenate(j)
            yield from pa.table({"call_id": table.column("call_id").take(pa.array(i)), "i": at[i], "j": at[j]}).to_batches()


def word_pairs(left: DataFrame, right: DataFrame, cells: int = CELLS, a_slice: int = A_SLICE, tasks: int | None = None) -> DataFrame:
    """(call_id, i, j): which word of left is which of right; each word once at most, rising in both.

    left, right: call_id, at (the word's place in its call's stream), key (words are equal by it), t (seconds, nullable).
    Calls of one side, empty tables and null keys (equal to nothing) have no pairs. A call within `cells` is aligned whole. Words are
    dealt by call once, to `tasks` (as many as there are ROWS of them, if none is given), and stay there.
    """
    kind = left.schema["call_id"].dataType.simpleString()
    pair = f"call_id {kind}, i bigint, j bigint"
    side = lambda df, n: df.where("key is not null").select("call_id", F.lit(n).alias("side"), F.col("at").cast("long").alias("at"), "key", F.col("t").cast("double").alias("t"))
    stream = Window.partitionBy("call_id", "side").orderBy("at")
    tasks = tasks or (left.count() + right.count()) // ROWS + 1
    rows = by_call(side(left, 0).union(side(right, 1)), tasks).withColumn("piece", F.lit(0).cast("long"))
    found, cuts = [], 0
    while True:
        whole = Window.partitionBy("call_id", "piece")
        rows = kept(rows.withColumn("n0", F.count_if(F.col("side") == 0).over(whole)).withColumn("n1", F.count_if(F.col("side") == 1).over(whole)).where("n0 > 0 and n1 > 0"))
        small = rows.where(F.col("n0") * F.col("n1") <= cells)
        found.append(small.select("call_id", "piece", "side", "at", "key", "t").sortWithinPartitions("call_id", "piece", "side", "at").mapInArrow(_aligned, pair))
        rows = rows.where(F.col("n0") * F.col("n1") > cells).drop("n0", "n1")
        if rows.isEmpty():
            break
        if not cuts:
            # times that never fall along a stream, so that cuts by time cut both streams
            rows = rows.withColumn("ever", F.coalesce(F.max("t").over(stream.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
        single = rows.groupBy("call_id", "piece", "key").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"), F.max(F.when(F.col("side") == 0, F.col("at"))).alias("i"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("j")).where("a = 1 and b = 1")
        chain = kept(single.select("call_id", "piece", "i", "j").sortWithinPartitions("call_id", "piece", "i").mapInArrow(_anchors, pair))
        found.append(chain)
        marks = chain.select("call_id", F.lit(0).alias("side"), F.col("i").alias("at")).union(chain.select("call_id", F.lit(1).alias("side"), F.col("j").alias("at"))).withColumn("mark", F.lit(1))
        # not sent to all tasks, however small Spark takes them to be
        marked = rows.join(marks.hint("merge"), ["call_id", "side", "at"], "left")
        before = F.count("mark").over(Window.partitionBy("call_id", "piece", "side").orderBy("at"))
        cut = marked.withColumn("cut", before).where("mark is null").drop("mark")
        # a piece without an anchor, cut by time
        by_time = F.floor((F.row_number().over(whole.orderBy("ever", "side", "at")) - 1) / a_slice)
        cut = cut.withColumn("any", F.max("cut").over(whole)).withColumn("cut", F.when(F.col("any") > 0, F.col("cut")).otherwise(by_time)).drop("any")
        cuts += 1
        rows = cut.withColumn("piece", F.xxhash64("piece", "cut", F.lit(cuts))).drop("cut")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
