"""Near-duplicate passages by compact windows over min-hashes of word n-grams.

Under one hash, the n-grams of a text form a Cartesian tree by their hash values; a node stands for all
subsequences in its range that hold its n-gram, which is their min-hash. Nodes whose range is at least as
wide as a passage must be are just the runs of equal minima of windows of that width, so they are found
without building the narrower part of the tree: about 2 / width of the positions remain.

Windows that share hash and value are joined to the first of them (within a task, then over all). Pairs of documents
whose windows meet under enough hashes are aligned and their common passages verified exactly. Where a document's
windows led to nothing under so many hashes that another document could have been missed, because the first ones hold
only a part of what is there (a common line, an older text), the n-grams that it has in common with those are masked,
and windows of what is left are joined again, with those of the settled documents that share its keys, masked likewise
(one of them may be near to it though the first is not), until no document is left so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnwise.llm._spark import HELD_IDS, fresh, give_back, group_bounds, kept, only, small_batches, whole_groups
from turnwise.llm._text import buffers, mix, shingle_hashes, slices, word_hashes

#: Hash functions (8 at most: the number is kept in a key's low bits), how many must meet, and hash functions of masked texts.
HASHES, ENOUGH, AGAIN_HASHES = 5, 2, 8
#: How many of the hashes are left over: where all others led astray (one in five of near copies differs anyway), a text is joined again.
SPARE, AGAIN_SPARE = 3, 4
#: Windows that a task joins among themselves before it sends one for each value.
BLOCK_WINDOWS = 1_000_000
#: Rows of a batch that a task hands to Spark.
BATCH_ROWS = 50_000
#: Hashes of n-grams that are searched at once in a text of which parts are masked.
HASHED_AT_ONCE = 1 << 16
_U = np.uint64
_DRAW = np.random.Generator(np.random.PCG64(23))
_XOR, _MULTIPLY = _DRAW.integers(0, 2**63, 8, dtype=np.uint64), _DRAW.integers(0, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of this width, along the last axis."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[..., :-have], out[..., have:]), have * 2
    if have < width:
        out = np.minimum(out[..., : values.shape[-1] - width + 1], out[..., width - have :])
    return out


def _mixed(values: np.ndarray, f: np.ndarray) -> np.ndarray:
    """mix, with a hash function's number for each value."""
    return mix(values + f.astype(np.uint64))


def compact_windows(grams: np.ndarray, bounds: np.ndarray, width: int, hashes: int = HASHES) -> tuple[np.ndarray, ...]:
    """(row, key, first, last) of the Cartesian tree nodes at least `width` n-grams wide, of each hash; places within the row."""
    none = np.zeros(0, np.int64)
    if len(grams) < width:
        return none, none.view(np.uint64), none, none
    starts = np.arange(len(grams) - width + 1)
    row = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + width <= bounds[row + 1]
    starts, row = starts[inside], row[inside]
    if not len(starts):
        return none, none.view(np.uint64), none, none
    out = []
    for f in range(hashes):
        least = window_minima((grams ^ _XOR[f]) * _MULTIPLY[f], width)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        to = np.append(at[1:], len(starts)) - 1
        key = (mix(least[at], f) & ~_U(7)) | _U(f)
        out.append((row[at], key, starts[at] - bounds[row[at]], starts[to] + width - 1 - bounds[row[at]]))
    return tuple(map(np.concatenate, zip(*out)))


def _to_first(keys: np.ndarray, ids: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, id and span; for each row in that order its key's first row, and whether it is another row."""
    order = np.lexsort((spans, ids, keys))
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, order[first], ~new


_LINK = "key long, id long, span long, to_id long, to_span long"


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["key", "id", "span", "to_id", "to_span"])


def _parts(rows: np.ndarray):
    return (rows[k : k + BATCH_ROWS] for k in range(0, len(rows), BATCH_ROWS))


class _Block:
    """Windows of a task, joined among themselves: heads (to_id null: the first of each value) and links to them."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, spans: np.ndarray):
        self.parts.append([keys, ids, spans])
        self.size += len(keys)
        if self.size >= BLOCK_WINDOWS:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        keys, ids, spans = map(np.concatenate, zip(*self.parts))
        self.parts, self.size = [], 0
        order, first, other = _to_first(keys, ids, spans)
        # in small batches, as Spark holds each whole beside the heap
        for at in _parts(order[order == first]):
            yield _batch(keys[at].view(np.int64), ids[at], spans[at], pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()))
        for place in _parts(np.flatnonzero(other)):
            at, to = order[place], first[place]
            yield _batch(keys[at].view(np.int64), ids[at], spans[at], ids[to], spans[to])


def _windows(texts: DataFrame, width: int, ngram: int, hashes: int) -> DataFrame:
    """Rows to join over all (to_id null: the first of each value in a block), and links within a block. A span is first << 32 | last."""

    def run(batches):
        give_back()
        block, seen = _Block(), set()
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, high in slices(offsets):
                words, bounds, _ = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                grams, at = shingle_hashes(words, bounds, ngram)
                row, key, first, last = compact_windows(grams, at, width, hashes)
                fresh = np.array([not (t in seen or seen.add(t)) for t in ts[low:high].tolist()], bool)[row]
                yield from block.add(key[fresh], ids[low:high][row[fresh]], first[fresh] << 32 | last[fresh])
            if len(seen) > 1_000_000:
                seen.clear()
        yield from block.flush()

    return texts.mapInArrow(run, _LINK)


def _joined(windows: DataFrame) -> DataFrame:
    """The links within blocks, as they are, and those of the windows of the blocks to the first of all."""

    def run(batches):
        for table in whole_groups(batches, ["key"]):
            new = table.column("to_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
            if not new.all():
                yield from table.filter(pa.array(~new)).to_batches()
            if new.sum() > 1:
                keys, ids, spans = (table.column(c).to_numpy()[new] for c in ("key", "id", "span"))
                order, first, other = _to_first(keys, ids, spans)
                if other.any():
                    at, to = order[other], first[other]
                    yield _batch(keys[at], ids[at], spans[at], ids[to], spans[to])

    # links only pass, so those of one value needn't meet
    by = F.when(F.col("to_id").isNull(), F.col("key")).otherwise(F.col("id") + F.col("span"))
    return windows.repartition(by).sortWithinPartitions("key").mapInArrow(run, _LINK)


def masked_windows(grams: np.ndarray, width: int, starts: np.ndarray, places: np.ndarray, keys: np.ndarray, hashes: int = AGAIN_HASHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last) of the nodes of one text, as compact_windows has them, for windows beginning in the ranges `starts` (rows of first and last),
    without the n-grams at the places, and those of the keys."""
    last = max(len(grams) - width, -1)
    allowed = np.zeros(last + 2, np.int32)
    np.add.at(allowed, np.clip(starts[:, 0], 0, last + 1), 1)
    np.add.at(allowed, np.clip(starts[:, 1] + 1, 0, last + 1), -1)
    at = np.flatnonzero(np.cumsum(allowed[:-1]) > 0)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    dark, out = np.zeros(len(grams), bool), []
    dark[places] = True
    most = np.iinfo(np.uint64).max
    keys = np.sort(keys)
    # all hashes of a short text at once
    many = max(1, HASHED_AT_ONCE // len(grams))
    for low_f in range(0, hashes, many):
        f = np.arange(low_f, min(low_f + many, hashes))[:, None]
        drawn = (grams ^ _XOR[f]) * _MULTIPLY[f]
        if len(keys):
            own = (_mixed(drawn, f) & ~_U(7)) | f.astype(np.uint64)
            drawn[dark | (keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own)] = most
        else:
            drawn[:, dark] = most
        least = window_minima(drawn, width)[:, at]
        new = np.ones(least.shape, bool)
        new[:, 1:] = (least[:, 1:] != least[:, :-1]) | (np.diff(at) > 1)
        h, low = np.nonzero(new)
        high = np.append(np.where(h[1:] == h[:-1], low[1:], len(at)), len(at)) - 1
        value = least[h, low]
        bright = value != most
        h, low, high, value = h[bright], low[bright], high[bright], value[bright]
        h = f[h, 0]
        out.append(((_mixed(value, h) & ~_U(7)) | h.astype(np.uint64), at[low], at[high] + width - 1))
    return tuple(map(np.concatenate, zip(*out)))


def _windows_again(texts: DataFrame, opened: DataFrame, width: int, ngram: int) -> DataFrame:
    """As _windows, of the texts and ranges of _opened, less what is masked."""

    def run(batches):
        give_back()
        block = _Block()
        for batch in batches:
            ids, low = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(len(ids)):
                grams, starts, places, keys = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in zip((2, 3, 4, 5), ("<u8", np.int64, np.int32, np.uint64)))
                places = places - low[i]
                inside = places[(places >= 0) & (places < len(grams))]
                key, first, last = masked_windows(grams, width, starts.reshape(-1, 2) - low[i], inside, keys)
                yield from block.add(key, np.full(len(key), ids[i]), (first + low[i]) << 32 | (last + low[i]))
        yield from block.flush()

    own = _sequences(texts, opened.select("id", "low", "high"), ngram, whole=True).join(opened.select("id", "starts", "places", "keys"), "id")
    return own.select("id", "low", "grams", "starts", "places", "keys").mapInArrow(run, _LINK)


def _sequences(texts: DataFrame, ranges: DataFrame, ngram: int, whole: bool = False) -> DataFrame:
    """(id, low, grams): the n-gram hashes in order, low to high of each text, of the ids given; upper 32 bits, or all."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            own, first, last = (batch.column(k).to_numpy() for k in (0, 2, 3))
            for low, high in slices(offsets):
                words, bounds, _ = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                grams, at = shingle_hashes(words, bounds, ngram)
                grams = grams.astype("<u8") if whole else (grams >> _U(32)).astype("<u4")
                cut = [grams[min(a + x, b) : min(a + y + 1, b)].tobytes() for a, b, x, y in zip(at[:-1].tolist(), at[1:].tolist(), first[low:high].tolist(), last[low:high].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(own[low:high]), pa.array(first[low:high]), pa.array(cut, pa.binary())], ["id", "low", "grams"])

    near = F.broadcast(ranges) if ranges.count() <= HELD_IDS else ranges
    return texts.select("id", "text").join(near, "id").select("id", "text", "low", "high").mapInArrow(run, "id long, low long, grams binary").dropDuplicates(["id"])


def stretches(windows: list[tuple[int, int, int]], width: int, enough: int) -> list[tuple[int, int]]:
    """The ranges of the beginnings of passages of this width that lie in windows (hash, first, last) of enough hashes."""
    edges = sorted([(a, 0, f) for f, a, b in windows] + [(b - width + 2, -1, f) for f, a, b in windows])
    open_, many, out, k = {}, 0, [], 0
    while k < len(edges):
        at, before = edges[k][0], many
        while k < len(edges) and edges[k][0] == at:
            _, end, f = edges[k]
            was = open_.get(f, 0)
            open_[f] = was + (end or 1)
            many += (open_[f] > 0) - (was > 0)
            k += 1
        if before < enough <= many:
            out.append((at, at))
        elif many < enough <= before:
            out[-1] = (out[-1][0], at - 1)
    return [(a, b) for a, b in out if b >= a]


def covered(first: np.ndarray, last: np.ndarray, passages: list[tuple[int, int]]) -> np.ndarray:
    """Whether half of a window first to last (inclusive) at least is in the passages (first, end)."""
    marks = np.zeros(int(max(last.max(initial=0) + 1, max((b for _, b in passages), default=0))) + 1, np.int64)
    for a, b in passages:
        marks[a] += 1
        marks[b] -= 1
    inside = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
    return 2 * (inside[last + 1] - inside[first]) >= last - first + 1


def _sorted_places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes in order, and their places, those of equal ones in order."""
    both = np.sort(grams.astype(np.uint64) << _U(32) | np.arange(len(grams), dtype=np.uint64))
    return both >> _U(32), (both & _U(0xFFFFFFFF)).astype(np.int64)


def places_in(grams: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of the 32-bit hashes that are among the others, in order."""
    if not len(grams) or not len(others):
        return np.zeros(0, np.int64)
    (own, places), others = _sorted_places(grams), np.sort(others).astype(np.uint64)
    return np.sort(places[others[np.minimum(np.searchsorted(others, own), len(others) - 1)] == own])


def common_passages(a: np.ndarray, b: np.ndarray, width: int, ngram: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """(first, end, first, end) in n-grams of passages of a and b, `width` n-grams at least, as similar as asked.

    A stretch of a whose n-grams b holds is tried as a whole, each n-gram at its place in b nearest to the stretch's
    usual shift; if it doesn't pass, it is cut where the places jump the most, down to unbroken runs.
    """
    if not len(a) or not len(b):
        return []
    where = places_in(a, b)
    if len(where) < similarity * width / 2:
        return []
    ordered, places = _sorted_places(b)
    new = np.ones(len(b), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    places += (np.cumsum(new) - 1) * len(b)  # by n-gram, then place
    of = np.searchsorted(ordered[new], a[where].astype(np.uint64))

    def nearest(low: int, high: int, shift: float) -> np.ndarray:
        wish = np.clip(where[low:high] + int(shift), 0, len(b) - 1) + of[low:high] * np.int64(len(b))
        right = np.minimum(np.searchsorted(places, wish), len(places) - 1)
        sides = np.stack([places[np.maximum(right - 1, 0)], places[right]])
        distance = np.where(sides // len(b) == of[low:high], np.abs(sides - wish), np.iinfo(np.int64).max)
        return sides[distance.argmin(0), np.arange(high - low)] % len(b)

    out = []
    gaps = (np.flatnonzero(np.diff(where) > 4 * ngram) + 1).tolist()
    stack = list(zip([0, *gaps], [*gaps, len(where)]))
    while stack:
        low, high = stack.pop()
        if high - low < similarity * width / 2 or where[high - 1] - where[low] + 1 < width:
            continue
        shift = np.median(nearest(low, high, 0) - where[low:high])
        place = nearest(low, high, shift)
        first, end = int(where[low]), int(where[high - 1]) + 1
        near = place[np.abs(place - where[low:high] - np.median(place - where[low:high])) <= max(2 * ngram, 0.25 * (end - first))]
        if len(near):
            p, q = int(near.min()), int(near.max()) + 1
            x, y = np.unique(a[first:end]), np.unique(b[p:q])
            both = np.intersect1d(x, y, assume_unique=True).size
            if min(end - first, q - p) >= width and both >= similarity * (len(x) + len(y) - both) - 1e-9:
                out.append((first, end, p, q))
                continue
        breaks = np.maximum(np.diff(where[low:high]) - 1, np.abs(np.diff(place - where[low:high])))
        if len(breaks) and breaks.max() > 0:
            cuts = (low + 1 + np.flatnonzero(breaks >= max(1, breaks.max() / 2))).tolist()
            stack += zip([low, *cuts], [*cuts, high])
    return out


def _ranged(pairs: DataFrame, width: int) -> DataFrame:
    """pairs with low, high, to_low and to_high: the n-grams in which what their windows have in common lies; it may begin before a window, and end after it."""
    low = lambda name: F.greatest(F.expr(f"array_min(transform(met, m -> shiftright(m.{name}, 32)))") - width, F.lit(0))
    high = lambda name: F.expr(f"array_max(transform(met, m -> m.{name} & 4294967295L))") + width
    return pairs.select("*", low("span").alias("low"), high("span").alias("high"), low("to_span").alias("to_low"), high("to_span").alias("to_high"))


def _verified(pairs: DataFrame, sequences: DataFrame, width: int, ngram: int, similarity: float, enough: int) -> DataFrame:
    """Common passages (id, first, end, to_id, to_first, to_end), in words, of pairs (id, to_id, met: structs of hash, spans and whose window led
    to the other's), and masks: the id of a document whose windows led to another, the places of its n-grams that the other has, settled,
    whether its windows are covered by what both have in common, and near, whether these are as many as a third text that is near to both leaves."""
    cut = lambda a, b: F.expr(f"substring(grams, cast(4 * ({a} - own_low) + 1 as int), cast(4 * ({b} - {a} + 1) as int))")
    sequences = sequences.withColumnRenamed("low", "own_low")
    left = pairs.join(sequences, "id").withColumn("own", cut("low", "high")).drop("grams", "own_low")
    both = left.join(sequences.withColumnRenamed("id", "to_id"), "to_id").withColumn("other", cut("to_low", "to_high")).select("id", "to_id", "low", "to_low", "met", "own", "other")

    # what two near copies of one passage have in common at least
    chained = 2 * (2 * similarity - 1) / (2 * similarity) * width

    def mask(spans: np.ndarray, grams: np.ndarray, others: np.ndarray, low: int, passages) -> tuple[bytes | None, bool, bool]:
        settled = not len(spans) or bool(covered((spans >> 32) - low, (spans & 0xFFFFFFFF) - low, passages).all())
        if settled and not passages:
            return None, True, False
        places = places_in(grams, others)
        return (low + places).astype(np.int32).tobytes(), settled, len(places) >= chained

    def run(batches):
        give_back()
        for batch in batches:
            rows = []
            ids, to_ids, lows, to_lows = (batch.column(k).to_numpy().tolist() for k in range(4))
            met, own_grams, other_grams = (batch.column(k) for k in (4, 5, 6))
            bounds = met.offsets.to_numpy()
            f, span, to_span, mine = (met.values.field(name).to_numpy(zero_copy_only=False) for name in ("f", "span", "to_span", "mine"))
            for i, (id_, to_id, low, to_low) in enumerate(zip(ids, to_ids, lows, to_lows)):
                at = slice(bounds[i], bounds[i + 1])
                if enough > 1 and not stretches(list(zip(f[at].tolist(), (span[at] >> 32).tolist(), (span[at] & 0xFFFFFFFF).tolist())), width, enough):
                    continue
                own, other = np.frombuffer(own_grams[i].as_buffer(), "<u4"), np.frombuffer(other_grams[i].as_buffer(), "<u4")
                passages = common_passages(own, other, width, ngram, similarity)
                for a, b, p, q in passages:
                    rows.append((id_, low + a, low + b + ngram - 1, to_id, to_low + p, to_low + q + ngram - 1, None, None, None))
                led = mine[at]
                for one, (places, settled, near) in ((id_, mask(span[at][led], own, other, low, [x[:2] for x in passages])), (to_id, mask(to_span[at][~led], other, own, to_low, [x[2:] for x in passages]))):
                    if places is not None:
                        rows.append((one, None, None, None, None, None, places, settled, near))
            if rows:
                *numbers, masks, settled, near = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(masks, pa.binary()), pa.array(settled, pa.bool_()), pa.array(near, pa.bool_())], ["id", "first", "end", "to_id", "to_first", "to_end", "mask", "settled", "near"])

    return both.mapInArrow(run, "id long, first long, end long, to_id long, to_first long, to_end long, mask binary, settled boolean, near boolean")


def _opened(links: DataFrame, found: DataFrame, before: DataFrame | None, width: int, ngram: int, many: int) -> DataFrame:
    """(id, low, high, starts, places, keys) of the documents in which a passage may lie in windows of `many` hashes that led to
    other documents and to nothing: its n-grams, the ranges where it may begin, and what is masked so far (before: this table of the pass before)."""
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda kind, a, b, raw: [F.col("id"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), raw.alias("raw")]
    other = links.where("id <> to_id")
    passages = found.where("mask is null")
    passages = passages.select("id", "first", "end").union(passages.select(F.col("to_id").alias("id"), F.col("to_first").alias("first"), F.col("to_end").alias("end"))).distinct()
    parts = [
        other.select(row(0, F.col("key"), F.col("span"), none("binary"))), passages.select(row(1, F.col("first"), F.col("end") - (ngram - 1), none("binary"))),
        found.where("not settled").select(row(2, none("long"), none("long"), F.col("mask"))),
    ]
    if before is not None:
        parts += [before.select(row(2, none("long"), none("long"), F.col("places"))), before.select(row(3, none("long"), none("long"), F.col("keys")))]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)

    def run(batches):
        for table in whole_groups(batches, ["id"]):
            bounds, rows = group_bounds(table, ["id"]), []
            ids, kind = (table.column(c).to_numpy() for c in ("id", "kind"))
            a, b = (table.column(c).fill_null(0).to_numpy() for c in ("a", "b"))
            raw = table.column("raw")
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                cuts = low + np.searchsorted(kind[low:high], [1, 2, 3])
                if len(set((a[low : cuts[0]] & 7).tolist())) < many:
                    continue
                first, last = b[low : cuts[0]] >> 32, b[low : cuts[0]] & 0xFFFFFFFF
                left = ~covered(first, last, list(zip(a[cuts[0] : cuts[1]].tolist(), b[cuts[0] : cuts[1]].tolist())))
                starts = stretches(list(zip((a[low : cuts[0]][left] & 7).tolist(), first[left].tolist(), last[left].tolist())), width, many)
                if starts:
                    low_, high_ = starts[0][0], starts[-1][1] + width - 1
                    places = [np.frombuffer(raw[k].as_py(), np.int32) for k in range(cuts[1], cuts[2])]
                    keys = [a[low : cuts[0]][left], *(np.frombuffer(raw[k].as_py(), np.int64) for k in range(cuts[2], high))]
                    rows.append((int(ids[low]), low_, high_, np.array(starts, np.int64).tobytes(), np.unique(np.concatenate([np.zeros(0, np.int32), *places])).tobytes(), np.unique(np.concatenate(keys)).tobytes()))
            if rows:
                *numbers, starts, places, keys = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *(pa.array(x, pa.binary()) for x in (starts, places, keys))], ["id", "low", "high", "starts", "places", "keys"])

    return every.repartition("id").sortWithinPartitions("id", "kind").mapInArrow(run, "id long, low long, high long, starts binary, places binary, keys binary")


def _targets(links: DataFrame, found: DataFrame, opened: DataFrame, width: int) -> DataFrame:
    """Rows as those of _opened, of other documents that share a key with an opened one: it may be near to them, and not to the first of the key.

    What they have in common with the documents that they were compared with is masked, as it is for the opened one, so that both meet in the rest.
    """

    def keys_of(batches):
        for batch in batches:
            keys = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], ["key"])

    # only where the first of the key has so much of it that a third may be near to both
    near = kept(found.where("not settled and near").select("id").distinct())
    astray = kept(only(opened, near, "id").select("keys").mapInArrow(keys_of, "key long").distinct())
    shared = only(links.where("id <> to_id"), astray, "key")
    spans = shared.select("id", "span").union(shared.select(F.col("to_id").alias("id"), F.col("to_span").alias("span")))
    spans = spans.groupBy("id").agg(F.min(F.shiftright("span", 32)).alias("low"), F.max(F.col("span").bitwiseAND(0xFFFFFFFF)).alias("high"))
    spans = only(spans, opened, "id", "left_anti")

    def masked(batches):
        for table in whole_groups(batches, ["id"]):
            bounds, ids, rows = group_bounds(table, ["id"]), table.column("id").to_numpy(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                low, high = table.column("low")[a].as_py(), table.column("high")[a].as_py()
                places = np.unique(np.concatenate([np.frombuffer(table.column("mask")[k].as_py() or b"", np.int32) for k in range(a, b)]))
                rows.append((int(ids[a]), low, high, np.array([[low, max(low, high - width + 1)]], np.int64).tobytes(), places.tobytes(), b""))
            *numbers, starts, places, keys = zip(*rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *(pa.array(x, pa.binary()) for x in (starts, places, keys))], ["id", "low", "high", "starts", "places", "keys"])

    told = spans.join(found.where("mask is not null").select("id", "mask"), "id", "left")
    return told.repartition("id").sortWithinPartitions("id").mapInArrow(masked, "id long, low long, high long, starts binary, places binary, keys binary")


def _own_ids(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """texts with an id for each different text of an id, and (nid, real, t): the further texts' ids, and the first texts of such ids (nid = real)."""
    ids = kept(texts.select("id", "t").distinct())
    several = kept(ids.groupBy("id").agg(F.count("*").alias("n"), F.min("t").alias("least")).where("n > 1").select("id", "least"))
    if several.isEmpty():
        return texts, None
    few = F.broadcast(several) if several.count() <= HELD_IDS else several
    top, bottom = ids.agg(F.max("id"), F.min("id")).first()
    number = F.monotonically_increasing_id()
    number = F.lit(top + 1) + number if top < 1 << 62 else F.lit(bottom - 1) - number
    further = kept(ids.join(few, "id").select(F.when(F.col("t") == F.col("least"), F.col("id")).otherwise(number).alias("nid"), F.col("id").alias("real"), "t"))
    other = further.where("nid <> real").select("nid", F.col("real").alias("id"), "t")
    other = F.broadcast(other) if other.count() <= HELD_IDS else other
    return texts.join(other, ["id", "t"], "left").select(F.coalesce("nid", "id").alias("id"), "t", "text"), further


def _real_ids(rows: DataFrame, further: DataFrame) -> DataFrame:
    """Rows (id, a, b, to_id, to_a, to_b) with the ids that the texts came with, and the hashes t and to_t of texts of ids with several; the greater id first."""
    few = F.broadcast(further) if further.count() <= HELD_IDS else further
    rows = rows.join(few.select(F.col("nid").alias("id"), F.col("real").alias("_id"), "t"), "id", "left").join(few.select(F.col("nid").alias("to_id"), F.col("real").alias("_to"), F.col("t").alias("to_t")), "to_id", "left")
    rows = rows.withColumn("id", F.coalesce("_id", "id")).withColumn("to_id", F.coalesce("_to", "to_id")).where("id <> to_id")
    late = F.col("id") > F.col("to_id")
    side = lambda x, y: F.when(late, F.col(x)).otherwise(F.col(y))
    names = [("id", "to_id"), ("a", "to_a"), ("b", "to_b"), ("t", "to_t")]
    return rows.select(*(side(x, y).alias(x) for x, y in names), *(side(y, x).alias(y) for x, y in names))


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, similarity: float = 0.8, ngram: int = 5, hashes: int = HASHES, enough: int = ENOUGH,
) -> DataFrame:
    """Passages of at least min_words words that are near-duplicates of one in another document.

    A row has id_col, start_word, end_word (exclusive, words counted from 0), n_words, class_id and first. A later
    document's passage has the id of an earlier one (by id) that holds it as class_id, first false; the earlier
    one's passage is a row too, with its own id and first true. Passages are similar if the Jaccard similarity of
    their n-word runs reaches `similarity`. A text equal to an earlier one is a passage as a whole. What repeats
    within one document alone isn't reported, nor are texts below min_words; null texts have no words. Repeated rows
    of an id are one document; different texts of an id are compared each, and not with one another. Null ids take no part. Ids are
    longs; further columns are left out; an empty table gives no rows.
    """
    return _passages(docs, id_col, text_col, min_words, similarity, ngram, hashes, enough).drop("_t").distinct()


def _passages(docs: DataFrame, id_col: str, text_col: str, min_words: int = 50, similarity: float = 0.8, ngram: int = 5, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """The rows of repeated_passages, with _t, the hash of the text where an id has several, else null."""
    with small_batches(docs.sparkSession):
        return _all_passages(docs, id_col, text_col, min_words, similarity, ngram, hashes, enough)


def _all_passages(docs: DataFrame, id_col: str, text_col: str, min_words: int, similarity: float, ngram: int, hashes: int, enough: int) -> DataFrame:
    width = min_words - ngram + 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).where("id is not null")
    texts, further = _own_ids(texts)
    ids = kept(texts.select("id", "t"))
    copies = ids.groupBy("t").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("t", "least")
    copied = kept(ids.join(copies, "t").where("id <> least").select("id", "t", "least").distinct())
    links = _joined(_windows(texts, width, ngram, hashes))
    # a copy's windows count as those of its first copy
    first_copy = kept(copied.groupBy("id").agg(F.min("least").alias("least")))
    first_copy = F.broadcast(first_copy) if first_copy.count() <= HELD_IDS else first_copy
    links = links.join(first_copy, "id", "left").withColumn("id", F.coalesce("least", "id")).drop("least")
    links = links.join(first_copy.withColumnRenamed("id", "to_id"), "to_id", "left").withColumn("to_id", F.coalesce("least", "to_id")).drop("least").select("key", "id", "span", "to_id", "to_span")
    found = opened = targets = None
    while True:
        links = kept(links)
        need = enough if opened is None else 1
        # the later document is linked to the earlier one; mine: its window led to the other's
        late = F.col("id") > F.col("to_id")
        swap = lambda a, b, late=late: F.when(late, F.col(a)).otherwise(F.col(b))
        met = F.struct((F.col("key").bitwiseAND(7)).cast("int").alias("f"), swap("span", "to_span").alias("span"), swap("to_span", "span").alias("to_span"), late.alias("mine"))
        pairs = links.where("id <> to_id").select(swap("id", "to_id").alias("id"), swap("to_id", "id").alias("to_id"), met.alias("m")).groupBy("id", "to_id").agg(F.collect_set("m").alias("met"))
        pairs = kept(_ranged(pairs.where(F.size(F.expr("array_distinct(met.f)")) >= need), width))
        sides = pairs.select("id", "low", "high").union(pairs.select(F.col("to_id").alias("id"), F.col("to_low").alias("low"), F.col("to_high").alias("high")))
        needed = kept(sides.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        sequences = kept(_sequences(texts, needed, ngram))
        verified = kept(_verified(pairs, sequences, width, ngram, similarity, need))
        found = verified if found is None else found.union(verified)
        opened = _opened(links, found, opened, width, ngram, hashes - SPARE if opened is None else AGAIN_HASHES - AGAIN_SPARE)
        if targets is not None:
            opened = only(opened, targets, "id", "left_anti")
        opened = kept(opened)
        if opened.isEmpty():
            break
        if targets is not None:
            links = _joined(_windows_again(texts, opened, width, ngram))
            continue
        targets = kept(_targets(links, found, opened, width))
        links = _joined(_windows_again(texts, opened.union(targets), width, ngram))
        # links between targets alone are known
        settled = targets.select(F.col("id").alias("to_id")).withColumn("_known", F.lit(True))
        settled = F.broadcast(settled) if settled.count() <= HELD_IDS else settled
        links = links.join(settled, "to_id", "left").join(settled.select(F.col("to_id").alias("id"), F.col("_known").alias("_own")), "id", "left").where("_known is null or _own is null").select("key", "id", "span", "to_id", "to_span")
    found = found.where("mask is null").drop("mask", "settled", "near").distinct()
    words = _word_counts(only(texts, kept(copied.select("t").distinct()), "t"))
    whole = copied.join(words, "t").where(F.col("n") >= min_words)
    zero = F.lit(0).cast("long")
    every = found.select("id", F.col("first").alias("a"), F.col("end").alias("b"), "to_id", F.col("to_first").alias("to_a"), F.col("to_end").alias("to_b"))
    every = every.union(whole.select("id", zero, "n", F.col("least"), zero, "n"))
    every = _real_ids(every, further) if further is not None else every.withColumn("t", F.lit(None).cast("long")).withColumn("to_t", F.lit(None).cast("long"))
    row = lambda i, a, b, t, first: [F.col(i).alias(id_col), F.col(a).alias("start_word"), F.col(b).alias("end_word"), (F.col(b) - F.col(a)).alias("n_words"), F.col("to_id").alias("class_id"), F.lit(first).alias("first"), F.col(t).alias("_t")]
    return every.select(row("id", "a", "b", "t", False)).union(every.select(row("to_id", "to_a", "to_b", "to_t", True))).distinct()


def _word_counts(texts: DataFrame) -> DataFrame:
    """(t, n) of distinct texts."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            counts = [np.diff(word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1]) for a, b in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], ["t", "n"])

    return texts.select("t", "text").mapInArrow(run, "t long, n long").dropDuplicates(["t"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """docs with the later copies of repeated passages cut from their texts; a text of which nothing is left goes.

    Columns stay, and length_col becomes the length of the text where one was cut. The earliest document keeps its passage.
    """
    spans = _passages(docs, id_col, text_col, **options).where(~F.col("first"))
    cut, new = fresh(docs, "_cuts"), fresh(docs, "_text")
    cuts = kept(spans.groupBy(id_col).agg(F.collect_set(F.struct("start_word", "end_word", "_t")).alias(cut)))
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)))
            out = [cut_words(text or "", [(s["start_word"], s["end_word"]) for s in spans if s["_t"] is None or s["_t"] == t]) for text, spans, t in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[3:]], [new, *rest])

    untouched = only(docs, cuts, id_col, "left_anti").select(docs.columns)
    schema = ", ".join([f"`{new}` string", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)])
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    met = only(docs, cuts, id_col).join(cuts, id_col)
    if not cuts.where(F.exists(cut, lambda c: c["_t"].isNotNull())).isEmpty():
        # of ids with several texts, those that have nothing to cut
        own = F.exists(cut, lambda c: c["_t"].isNull() | (c["_t"] == text_hash))
        untouched, met = untouched.union(met.where(~own).select(docs.columns)), met.where(own)
    touched = met.select(text_col, cut, text_hash, *rest).mapInArrow(run, schema).where(F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    if length_col in docs.columns:
        touched = touched.withColumn(length_col, F.length(new).cast(docs.schema[length_col].dataType))
    return untouched.union(touched.select([F.col(new).alias(c) if c == text_col else F.col(c) for c in docs.columns]))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the white space after them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    _, _, starts, ends = word_hashes(raw, np.array([0, len(raw)]), ends=True)
    drop = np.zeros(len(starts) + 1, bool)
    for a, b in spans:
        drop[a:b] = True
    edges = np.append(starts, len(raw))
    keep = np.ones(len(raw), bool)
    change = np.flatnonzero(np.diff(np.concatenate([[False], drop[:-1], [False]]).astype(int)))
    for a, b in zip(change[::2], change[1::2]):
        keep[edges[a] : edges[b]] = False
    return raw[keep].tobytes().decode()
