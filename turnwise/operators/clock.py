"""One clock for words of two recognisers: words without a trusted time are fitted between those that have one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from turnwise.operators.batches import begins, running


def _times(rows: pa.Table, fresh: np.ndarray, taken: float, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of rows, the first row of each run and what each run's first row has lent to the run before.

    fresh: whether a call begins at a row. taken and top: what the first row has lent and the last start before it, where its call began before.
    A run is a trusted word and the others up to the next one; what holds for a run is computed once for it.
    """
    own_start, own_end, hint_start, hint_end = (rows.column(c).to_numpy() for c in ("start_s", "end_s", "hint_start", "hint_end"))
    native, length, n = rows.column("native").to_numpy(), pc.utf8_length(rows.column("word")).to_numpy(), len(rows)
    first = np.flatnonzero(native | fresh | (np.arange(n) == 0))
    stop = np.append(first[1:], n)
    run = np.repeat(np.arange(len(first)), stop - first)
    loose = ~native
    known = loose & ~np.isnan(hint_start) & ~np.isnan(hint_end)
    want = np.where(loose, np.where(known & (hint_end > hint_start), hint_end - hint_start, np.maximum(0.06 * length, 0.04)), 0.0)
    whole = lambda x: (part := running(x, first), part[stop - 1] + x[stop - 1])  # noqa: E731  sums before each row of a run, and of the run
    done, need = whole(want)

    led = native[first]
    follows = np.append(~fresh[first[1:]], False)
    after_start, after_end = (np.where(follows, np.append(x[first[1:]], 0.0), 0.0) for x in (own_start, own_end))
    at = np.flatnonzero(known)
    upto = np.searchsorted(at, first), np.searchsorted(at, stop)
    hinted = upto[0] < upto[1]
    at0 = np.append(at, 0)
    low = np.where(led, own_end[first], np.where(hinted, hint_start[at0[upto[0]]], 0.0))
    high = np.maximum(np.where(follows, after_start, np.where(hinted, hint_end[at0[upto[1] - 1]], low + need)), low)

    # by hints: what has none follows the last that has one
    lo, hi = low[run], high[run]
    fit = np.minimum(np.maximum(hint_start, lo), hi)
    fit_end = np.minimum(np.maximum(hint_end, fit), hi)
    last = np.searchsorted(at, np.arange(n)) - 1
    behind = at0[last]
    since = np.where((last >= 0) & (behind >= first[run]), fit_end[behind], lo)
    heads = known.copy()
    heads[first] = True
    follow = since + running(np.where(loose & ~known, want, 0.0), np.flatnonzero(heads))
    fit, fit_end = np.where(known, fit, np.minimum(follow, hi)), np.where(known, fit_end, np.minimum(follow + want, hi))
    some = np.logical_or.reduceat(loose, first)
    roomy = high - low >= 0.5 * need
    packed = ~roomy | np.logical_or.reduceat(loose & (fit_end - fit < 0.2 * want), first)

    # packed: the gap may borrow from the trusted words beside it
    half = np.where(roomy, 0.0, (0.5 * need - (high - low)) / 2)
    late = np.where(some & follows, np.minimum(half, 0.5 * (after_end - after_start)), 0.0)
    lent = np.append(0.0 if fresh[0] else taken, np.where(follows, late, 0.0)[:-1])
    early = np.where(some & led, np.minimum(half, 0.5 * (own_end[first] - own_start[first] - lent)), 0.0)
    low, high = low - early, high + late
    middle = whole(np.where(known, (hint_start + hint_end) / 2, 0.0))[1] / np.maximum(upto[1] - upto[0], 1)
    scale = np.minimum((high - low) / np.where(some, need, 1.0), 1.0)
    begin = np.minimum(np.maximum(np.where(hinted, middle, (low + high) / 2) - need * scale / 2, low), high - need * scale)
    begin = begin[run] + done * scale[run]

    start = np.where(native, own_start + lent[run], np.where(packed[run], begin, fit))
    end = np.where(native, own_end - early[run], np.where(packed[run], begin + want * scale[run], fit_end))
    calls = np.flatnonzero(fresh | (np.arange(n) == 0))
    if not fresh[0]:
        start[0] = max(start[0], top)
    for a, b in zip(calls, np.append(calls[1:], n)):
        np.maximum.accumulate(start[a:b], out=start[a:b])
    then = np.append(np.where(fresh[1:], np.inf, start[1:]), np.inf)
    return start, np.maximum(np.minimum(np.maximum(end, start), then), start), first, lent


def _pass(keys: list[str], columns: list[str]):
    """Fits rows sorted by call and order; of a call only the run that may go on is held, with what its first word has lent."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = [], None
        for batch in _closed(batches):
            if batch is not None:
                if not len(batch):
                    continue
                held.append(batch)
                if len(held) > 1 and not pc.any(batch.column("native")).as_py() and not len(begins(pa.Table.from_batches([held[-2].slice(len(held[-2]) - 1), batch]), keys)) > 1:
                    continue
            if not held:
                continue
            rows = pa.Table.from_batches(held)
            fresh = np.zeros(len(rows), bool)
            fresh[begins(rows, keys)] = True
            fresh[0] = state is None
            start, end, first, lent = _times(rows, fresh, *(state or (0.0, 0.0)))
            cut = len(rows) if batch is None else int(first[-1])
            if cut:
                out = rows.set_column(columns.index("start_s"), "start_s", pa.array(start)).set_column(columns.index("end_s"), "end_s", pa.array(end))
                yield from out.slice(0, cut).to_batches()
            if batch is not None and cut:
                held, state = rows.slice(cut).to_batches(), None if fresh[cut] else (float(lent[-1]), float(start[cut - 1]))

    return fitted


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def one_clock(words: DataFrame, order: list[str], keys: list[str] = ["call_id"]) -> DataFrame:  # noqa: B006
    """words with start_s and end_s everywhere; starts never fall in the order given, and no word runs into the next.

    words: keys, order, word, native (whether start_s and end_s are trusted), hint_start and hint_end (untrusted times of others, nullable).
    A run of untrusted words lies between two trusted ones. Where the gap between these holds half of the time that the run
    asks for, each word keeps its hint, clamped into the gap (a word without one follows the word before); if that crushes
    any word below a fifth of its length, or the gap is too small, the run is packed around the middle of its hints,
    and a gap that is too small borrows from its neighbours, at most half of each.
    Words are fitted in one pass over each call's order, which holds one run and not the call.
    """
    # the window deals words by call and sorts them, where they don't lie so already
    call = Window.partitionBy(*keys).orderBy(*order)
    rows = words.select(*words.columns, F.row_number().over(call).alias("_at")).sortWithinPartitions(*keys, *order)
    columns = words.columns
    return rows.select(*columns, "_at").mapInArrow(_pass(keys, [*columns, "_at"]), rows.schema).select(*columns)
