"""Chosen-path similarity join of documents as sets of word n-grams.

A run hashes all n-grams anew. A set of n goes down to the bucket of each n-gram whose hash is below
1 / (threshold * n): about one of the n-grams that two similar sets share is chosen by both. Buckets
above the leaf size are split again on further chosen n-grams, with the bucket as the seed, unless their
sets are alike as they are. Within a leaf, sets are compared by min-hash sketches. Runs are repeated
until the target recall.

What shares a leaf and has a like sketch is a candidate; candidates form groups, in which all pairs are
compared exactly, each set being sent once (to block pairs, where a group is large).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnwise.llm._spark import HELD_IDS, connected_components, fresh, give_back, group_bounds, kept, only, small_batches, whole_groups
from turnwise.llm._text import buffers, mix, shingle_hashes, slices, word_hashes

#: Hashes of a sketch. In a leaf, a set goes with a leader if LOOSE of them agree and leads itself unless TIGHT of
#: them agree with some leader. Two sets that agree in 1 - (TIGHT - LOOSE) of them always share a leader.
SKETCH, TIGHT, LOOSE = 64, 0.70, 0.35
#: Sets in a leaf, levels below the first, sets of a leaf that meet in one task, sets in a block of the exact comparison.
LEAF, DEPTH, SALTED, BLOCK = 128, 4, 2048, 1000
#: Sketches that a task may hold; beyond that they are joined by a shuffle.
HELD_SKETCHES = 50_000
#: A bucket is not split if its sets agree with its first in this share of hashes on the mean.
DENSE = 0.25
_U = np.uint64
_DRAW = np.random.Generator(np.random.PCG64(11))
_FACTORS = _DRAW.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _DRAW.integers(0, 2**32, SKETCH, dtype=np.uint32)


def runs_for(recall: float, threshold: float, levels: int = 1) -> int:
    """Runs after which a pair at the threshold has shared a path of chosen n-grams of so many levels with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - _meets(levels))))


def _meets(levels: int) -> float:
    """How likely a pair at the threshold shares a path of so many levels: both choose one n-gram a level on the mean, with sizes as unlike as the threshold allows."""
    meets = 1.0
    for _ in range(levels):
        meets = 1 - math.exp(-meets)
    return meets


def further_runs(whole: Column, split: Column, recall: float, threshold: float, depth: int) -> Column:
    """Further runs of a set, so many of whose buckets are whole and split, after which a partner at the threshold is missed with 1 - recall at most.

    The partner is in each of the set's buckets with the probability `threshold` at least; from a split one they go down `depth` levels
    together, or part. A pair has the fewer further runs of both, and either's count may be that one, so each may miss half.
    """
    missed = whole * math.log(1 - threshold) + split * math.log(1 - threshold * _meets(depth))
    return F.greatest(F.ceil((F.lit(math.log((1 - recall) / 2)) - missed) / math.log(1 - _meets(depth + 1))), F.lit(0)).cast("int")


def sets_of(column: pa.Array, ngram: int):
    """Slices of a text column: rows that have words, their distinct n-gram hashes end to end, and the bounds of these."""
    data, offsets = buffers(column)
    for low, high in slices(offsets):
        words, bounds, _ = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        grams, at = shingle_hashes(words, bounds, ngram)
        own = [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:])]
        rows = np.array([low + i for i, x in enumerate(own) if len(x)], np.int64)
        own = [x for x in own if len(x)]
        if own:
            yield rows, np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def sketches(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    top = (grams >> _U(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, SKETCH), np.uint16)
    for k in range(SKETCH):
        out[:, k] = np.minimum.reduceat((top ^ _SHIFTS[k]) * _FACTORS[k], bounds[:-1]).astype(np.uint16)
    return out


def chosen(grams: np.ndarray, sizes: np.ndarray, seeds: int | np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the chosen n-grams and their bucket keys. sizes: of the set of each n-gram."""
    g = mix(grams ^ seeds) if isinstance(seeds, np.ndarray) else mix(grams, seeds)
    limit = np.minimum(1.0, 1.0 / (threshold * sizes)) * 2.0**64
    at = np.flatnonzero(g.astype(np.float64) < limit)
    return at, mix(g[at], 5)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signed(texts: DataFrame, ngram: int, runs: range, threshold: float) -> DataFrame:
    """(t, keys, sketch) of each distinct text with words; keys of these runs. A third column of texts says how many of the runs a text takes."""

    def run(batches):
        give_back()
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            takes = batch.column(2).to_numpy() if batch.num_columns > 2 else np.full(len(ids), len(runs))
            for rows, grams, bounds in sets_of(batch.column(1), ngram):
                sizes = np.repeat(np.diff(bounds), np.diff(bounds))
                marks = sketches(grams, bounds)
                found = [chosen(grams, sizes, (r + 1) * 0x9E3779B97F4A7C15, threshold) for r in runs]
                index, keys = map(np.concatenate, zip(*found))
                turn = np.repeat(np.arange(len(runs)), [len(at) for at, _ in found])
                of = np.searchsorted(bounds, index, "right") - 1
                own = turn < takes[rows][of]
                keys, of = keys[own], of[own]
                order = np.argsort(of, kind="stable")
                counts = np.bincount(of, minlength=len(rows))
                new = np.array([not (t in seen or seen.add(t)) for t in ids[rows].tolist()], bool)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), _longs(keys[order]))
                part = pa.RecordBatch.from_arrays([pa.array(ids[rows]), lists, pa.array([m.tobytes() for m in marks], pa.binary())], ["t", "keys", "sketch"])
                yield part.filter(pa.array(new))
            if len(seen) > 1_000_000:
                seen.clear()

    return texts.mapInArrow(run, "t long, keys array<long>, sketch binary").dropDuplicates(["t"])


def _sets(texts: DataFrame, ids: DataFrame, ngram: int) -> DataFrame:
    """(t, grams) of the texts whose hash t is in ids: little-endian 64-bit n-gram hashes, ascending."""

    def run(batches):
        give_back()
        for batch in batches:
            own = batch.column(0).to_numpy()
            for rows, grams, bounds in sets_of(batch.column(1), ngram):
                raw = grams.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["t", "grams"])

    return only(texts, kept(ids.select("t").distinct()), "t").mapInArrow(run, "t long, grams binary").dropDuplicates(["t"])


def _split(over: DataFrame, texts: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """(t, key) one level further down, of (t, key)."""

    def run(batches):
        for batch in batches:
            ts, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for t, node, raw in zip(ts, nodes, batch.column(2)):
                grams = np.frombuffer(raw.as_py(), np.uint64)
                _, keys = chosen(grams, np.full(len(grams), len(grams)), np.full(1, node), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t)), _longs(np.unique(keys))], ["t", "key"])

    return over.select("t", "key").join(_sets(texts, over, ngram), "t").mapInArrow(run, "t long, key long")


def _dense(over: DataFrame, signed: DataFrame) -> DataFrame:
    """The keys of the buckets of over (t, key, n) whose sets are alike."""
    marked = over.join(signed.select("t", "sketch"), "t")
    first = kept(marked.groupBy("key").agg(F.min(F.struct("t", "sketch")).alias("first")).select("key", F.col("first.sketch").alias("first")))
    # a hot bucket's rows stay where they are if the sketches of all buckets fit a task
    first = F.broadcast(first) if first.count() <= HELD_SKETCHES else first

    def run(batches):
        for batch in batches:
            own, first = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SKETCH) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((own == first).mean(1))], ["key", "alike"])

    alike = marked.join(first, "key").select("key", "sketch", "first").mapInArrow(run, "key long, alike double")
    return alike.groupBy("key").agg(F.avg("alike").alias("alike")).where(F.col("alike") >= DENSE).select("key")


def leaders(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (set, first set of those that leaders join to it) and the leaders, of sets with sketches, in order."""
    if len(ids) == 2:
        near = (marks[0] == marks[1]).mean() >= LOOSE
        return (ids[1:], ids[:1], ids[:1]) if near else (ids[:0], ids[:0], ids)
    open_, of, led = np.ones(len(ids), bool), np.arange(len(ids)), []
    while open_.any():
        k = int(open_.argmax())
        alike = (marks == marks[k]).mean(1)
        joined = np.unique(of[alike >= LOOSE])
        if len(joined) > 1:
            of[np.isin(of, joined)] = joined[0]
        led.append(k)
        open_ &= alike < TIGHT
        open_[k] = False
    at = np.flatnonzero(of != np.arange(len(ids)))
    return ids[at], ids[of[at]], ids[led]


def _candidates(members: DataFrame, signed: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets of a leaf and its leaders. members: t, key, n."""
    salt = F.expr(f"cast(pmod(xxhash64(t), greatest(1, ceil(n / {SALTED}))) as long)")
    salted = members.join(signed.select("t", "sketch"), "t").select("key", salt.alias("i"), salt.alias("j"), "t", "sketch", (F.col("n") > SALTED).alias("many"))

    def run(batches):
        for table in whole_groups(batches, ["key", "i", "j"]):
            bounds = group_bounds(table, ["key", "i", "j"])
            ts, keys, many = table.column("t").to_numpy(), table.column("key").to_numpy(), table.column("many").to_numpy()
            marks = np.frombuffer(table.column("sketch").combine_chunks().buffers()[2], np.uint16)
            start = int(np.frombuffer(table.column("sketch").combine_chunks().buffers()[1], np.int32)[table.column("sketch").combine_chunks().offset])
            marks = marks[start // 2 : start // 2 + SKETCH * len(ts)].reshape(-1, SKETCH)
            a, b, lead_t, lead_key, lead_mark = [], [], [], [], []
            for low, high in zip(bounds[:-1], bounds[1:]):
                if high - low > 1:
                    x, y, led = leaders(ts[low:high], marks[low:high])
                    a.append(x)
                    b.append(y)
                else:
                    led = ts[low:high]
                if many[low]:
                    of = {t: i for i, t in enumerate(ts[low:high].tolist(), low)}
                    lead_t += led.tolist()
                    lead_key += [int(keys[low])] * len(led)
                    lead_mark += [marks[of[t]].tobytes() for t in led.tolist()]
            n = sum(map(len, a))
            pairs = [pa.array(np.concatenate([*x, np.array(y, np.int64)]) if a else np.array(y, np.int64)) for x, y in ((a, lead_t), (b, lead_t))]
            yield pa.RecordBatch.from_arrays([*pairs, pa.array([None] * n + lead_key, pa.int64()), pa.array([None] * n + lead_mark, pa.binary())], ["a", "b", "key", "sketch"])

    def led(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "t").mapInArrow(run, "a long, b long, key long, sketch binary")

    first = kept(led(salted))
    # leaders of the parts of a bucket meet: in one task, or in blocks, each with each, where there are too many
    heads = first.where("key is not null").select("key", F.col("a").alias("t"), "sketch")
    heads = heads.join(heads.groupBy("key").agg(F.expr(f"cast(ceil(count(*) / {SALTED}) as long)").alias("blocks")), "key")
    own, other = F.expr("pmod(xxhash64(t, 5), blocks)").alias("own"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other")
    dealt = heads.select("key", "t", "sketch", own, "blocks").select("*", other)
    again = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "t", "sketch", F.lit(False).alias("many"))
    return first.where("key is null").select("a", "b").union(led(again).select("a", "b")).where("a <> b").distinct()


def linked(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Which pairs of sets have at least this Jaccard similarity, exactly; with left < len(sets), only pairs across left."""
    sizes = np.array([len(x) for x in sets], np.float64)
    if len(sets) == 2:
        common = np.array([[0.0, np.intersect1d(*sets, assume_unique=True).size]])
        common = np.vstack([common, common[:, ::-1]])
    else:
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), sizes.astype(int))
        shared = counts > 1
        column = np.cumsum(shared) - 1
        inside = shared[inverse]
        rows, columns = rows[inside], column[inverse[inside]]
        common, width = np.zeros((len(sets), len(sets))), max(1, (1 << 23) // len(sets))
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        for low in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(columns, [low, low + width])
            grid = np.zeros((len(sets), min(width, int(shared.sum()) - low)), np.float32)
            grid[rows[a:b], columns[a:b] - low] = 1
            common += grid @ grid.T
    out = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(out, False)
    if left < len(sets):
        out[:left, :left] = False
        out[left:, left:] = False
    return out


def roots(near: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    label = np.arange(len(near))
    while True:
        step = np.where(near, label[None, :], len(near)).min(1, initial=len(near))
        new = np.minimum(label, step)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(groups: DataFrame, texts: DataFrame, copies: DataFrame, ngram: int, threshold: float, block: int) -> DataFrame:
    """(t, root, links) of the texts that have links: root is the least t of the class, links counts rows of other texts."""
    sized = groups.groupBy("component").agg(F.count("*").alias("size"))
    members = groups.withColumnRenamed("node", "t").join(sized, "component").join(copies.select("t", "rows"), "t").join(_sets(texts, groups.withColumnRenamed("node", "t"), ngram), "t")
    blocks = F.expr(f"cast(ceil(size / {block}) as int)")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.expr("cast(pmod(xxhash64(t, 3), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "t", "rows", "blocks", "grams")

    def run(batches):
        give_back()
        for table in whole_groups(batches, ["component", "i", "j"]):
            bounds = group_bounds(table, ["component", "i", "j"])
            ts, rows, own, i = (table.column(c).to_numpy() for c in ("t", "rows", "own", "i"))
            j, blocks, raw = table.column("j").to_numpy(), table.column("blocks").to_numpy(), table.column("grams").combine_chunks()
            for low, high in zip(bounds[:-1], bounds[1:]):
                if high - low < 2:
                    continue
                left = int((own[low:high] == i[low]).sum()) if i[low] < j[low] else high - low
                near = linked([np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(low, high)], left, threshold)
                at = np.flatnonzero(near.any(1))
                if len(at):
                    here = ts[low:high]
                    # rows are in the order of own, then t; the root of a component is its least t
                    of = roots(near)
                    least = np.full(high - low, np.iinfo(np.int64).max)
                    np.minimum.at(least, of, here)
                    yield pa.RecordBatch.from_arrays([pa.array(here[at]), pa.array(least[of[at]]), pa.array((near @ rows[low:high])[at].astype(np.int64)), pa.array(np.full(len(at), blocks[low] > 1))], ["t", "root", "links", "cut"])

    found = kept(dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "own", "t").mapInArrow(run, "t long, root long, links long, cut boolean"))
    links = found.groupBy("t").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("cut").alias("cut"))
    if found.where("cut").isEmpty():
        return links.select("t", "root", "links")
    whole = connected_components(found.where("cut").select(F.col("t").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("t"), "component")
    return links.join(whole, "t", "left").select("t", F.coalesce("component", "root").alias("root"), "links")


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, ngram: int = 5, recall: float = 0.9999,
    leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK,
) -> DataFrame:
    """id_col, class_id and n_links of every row of docs.

    Two rows are linked if the Jaccard similarity of their sets of n-word runs is at least the threshold, or their
    texts are equal. class_id is the least id of those that links join; n_links counts the rows linked with this one.
    Texts of fewer words have one n-gram, of all words. Null texts, and texts without words, are linked with nothing.
    Repeated rows are copies of one another. Pairs of unlike texts at the threshold are found with probability
    `recall` at least, more similar ones and groups of three or more with a higher one; all else is exact.
    An id is a long; further columns are left out; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("t"), text.alias("text"))
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.rlike(r"[^\x20\x09-\x0D]").alias("words"))
    copies = kept(ids.where("words").groupBy("t").agg(F.count("*").alias("rows"), F.min("id").alias("least")))
    each = (1 + recall) / 2  # half of what may be missed is for pairs that share no bucket, half for those whose buckets are split
    first, deepest = runs_for(each, threshold), runs_for(each, threshold, depth + 1)
    signed = kept(_signed(texts, ngram, range(first), threshold))

    def sized(members: DataFrame) -> DataFrame:
        return members.join(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")

    def met(signed: DataFrame) -> DataFrame:
        return sized(signed.select("t", F.explode(F.array_distinct("keys")).alias("key"))).select("key", "t", "n")

    members = kept(met(signed))
    # a pair most of whose buckets are split has to share longer paths: its sets take further runs, as many as their other buckets leave to do
    split = members.where(F.col("n") > leaf)
    if depth and not split.isEmpty():
        split = split.join(kept(_dense(split, signed)), "key", "left_anti").groupBy("t").agg(F.count("*").alias("split"))
        both = split.join(signed.select("t", F.size(F.array_distinct("keys")).alias("all")), "t")
        takes = both.select("t", F.least(further_runs(F.col("all") - F.col("split"), F.col("split"), each, threshold, depth), F.lit(deepest)).alias("takes"))
        takes = kept(takes.where("takes > 0"))
        if not takes.isEmpty():
            takes = F.broadcast(takes) if takes.count() <= HELD_IDS else takes
            members = members.union(kept(met(_signed(texts.join(takes, "t").select("t", "text", "takes"), ngram, range(first, first + deepest), threshold))))
    leaves, over, level = members.where(F.col("n") <= leaf), members.where(F.col("n") > leaf), 0
    while level < depth and not over.isEmpty():
        alike = kept(_dense(over, signed))
        leaves, over = leaves.union(over.join(alike, "key", "left_semi").select("key", "t", "n")), over.join(alike, "key", "left_anti")
        members, level = kept(sized(_split(over, texts, ngram, threshold)).select("key", "t", "n")), level + 1
        leaves, over = leaves.union(members.where(F.col("n") <= leaf)), members.where(F.col("n") > leaf)
    groups = connected_components(_candidates(leaves.union(over), signed))
    found = _verified(groups, texts, copies, ngram, threshold, block)
    classed = copies.join(found, "t", "left").select("t", "rows", "least", F.coalesce("root", "t").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = classed.groupBy("root").agg(F.min("least").alias("class_id"))
    by_text = classed.join(named, "root").select("t", "class_id", (F.col("links") + F.col("rows") - 1).alias("n_links"))
    out = ids.join(by_text, (ids["t"] == by_text["t"]) & ids["words"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs less all but one of each class: the one with the least id stays, and one of equal rows. Null ids stay."""
    with small_batches(docs.sparkSession):
        classes = jaccard_classes(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull())
        by_id = kept(classes.groupBy(id_col).agg(F.max((F.col(id_col) == F.col("class_id")).cast("int")).alias("first"), F.count("*").alias("rows")).where("first = 1"))
    known = docs.where(F.col(id_col).isNotNull())
    stay = only(known, by_id.where("rows = 1"), id_col).select(docs.columns).union(docs.where(F.col(id_col).isNull()))
    again = by_id.where("rows > 1")
    if again.isEmpty():
        return stay
    mark = fresh(docs, "_t")
    repeated = only(known, again, id_col).withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return stay.union(repeated.dropDuplicates([id_col, mark]).select(docs.columns))
