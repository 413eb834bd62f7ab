"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is a product along a tree of classes: a softmax over at most BRANCHES classes, again
over the classes within the one chosen, down to the word. Frequent words have short paths. The leaves are the
words of the highest training counts, as many as a task may hold, and REST classes of all other tokens by their
last letters. A rare word has, within its leaf, its (smoothed) share of the counts there, the same for any context;
unknown tokens count as one more word of each such leaf. Every softmax adds up weights of hashed features to the
plain frequencies: the word before, the ones two and three before (skips), and the pair before (an n-gram).

Vocabulary, contexts and weight rows grow with the counted tokens, up to what a task may hold (HELD_WORDS,
MOST_ROWS). Training is in rounds over disjoint parts of the training texts. In a round each task takes gradient
steps over its texts from the weights of the round before; a row of weights becomes the mean over the tasks, by how
often each has met it. Counts are of all training texts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnwise.llm._spark import kept
from turnwise.llm._text import buffers, mix, slices, word_hashes
from turnwise.llm.quality_rules import remainder

#: Classes of a softmax, and classes of the words that no task holds, by their last letters.
BRANCHES, REST = 32, 4096
#: What a task may hold: words with their counts and paths, and rows of BRANCHES weights.
HELD_WORDS, MOST_ROWS, LEAST_ROWS = 1 << 19, 1 << 20, 1 << 14
#: Training tokens to a row of weights, and to a word that is a context of its own.
ROW_TOKENS, CONTEXT_TOKENS = 1 << 11, 1 << 13
#: Tokens of a task of a round (or so many to each row of weights, so that what is sent stays small beside what is read).
TASK_TOKENS, TASK_ROW_TOKENS = 1 << 21, 64
#: Softmaxes of a step, rows of a block sent between tasks, rounds, step size, features.
STEP, SENT_ROWS, ROUNDS, RATE, FEATURES = 2048, 256, 2, 0.25, 4
#: A row's squared gradients before any.
CALM = np.float32(1e-2)
_U = np.uint64
END = _U(0x0E0F0E0F0E0F0E0F)


def tokens(column: pa.Array):
    """Slices of a text column: rows low to high, token hashes with an end after each row, their bounds, and each token's class among the REST."""
    data, offsets = buffers(column)
    for low, high in slices(offsets):
        part = data[offsets[low] : offsets[high]]
        words, bounds, _, ends = word_hashes(part, offsets[low : high + 1] - offsets[low], ends=True)
        out, rest = np.full(len(words) + high - low, END), np.zeros(len(words) + high - low, np.int64)
        to = np.arange(len(words)) + np.repeat(np.arange(high - low), np.diff(bounds))
        out[to] = words
        if len(words):
            last = np.zeros(len(words), np.uint64)
            for j in range(3):
                byte = part[np.maximum(ends - 1 - j, 0)].astype(np.uint64)
                last |= (byte + ((byte >= 65) & (byte <= 90)).astype(np.uint64) * _U(32)) << _U(8 * j)
            rest[to] = (mix(last, 17) % _U(REST)).astype(np.int64)
        yield low, high, out, bounds + np.arange(high - low + 1), rest


@dataclass
class Tree:
    """Paths of leaves, end to end: those of leaf u are at starts[u] to starts[u + 1], from the root down."""

    starts: np.ndarray
    nodes: np.ndarray
    branches: np.ndarray
    prior: np.ndarray  # nodes, BRANCHES: log share of each branch


def class_tree(weights: np.ndarray, branches: int = BRANCHES) -> Tree:
    """The tree in which a leaf's path is the shorter the higher its weight: the least weights are joined first."""
    n = len(weights)
    least = sorted(zip(weights.tolist(), range(n)))
    if n == 1:
        least.append((1e-9, -1))
    first = (len(least) - 2) % (branches - 1) + 2  # so that the root is full
    parent, place, prior = np.full(n + len(least), -1, np.int64), np.zeros(n + len(least), np.int64), []
    # leaves in order of weight, and joined classes: those come in order of weight too
    leaves, joined, at, size = least, [], 0, n
    while True:
        chosen = []
        while len(chosen) < first and (at < len(leaves) or joined):
            if joined and (at == len(leaves) or joined[0] < leaves[at]):
                chosen.append(heapq.heappop(joined))
            else:
                chosen.append(leaves[at])
                at += 1
        total = sum(w for w, _ in chosen)
        row = np.full(branches, -30.0, np.float32)
        for k, (w, of) in enumerate(reversed(chosen)):
            row[k] = np.log(w / total)
            if of >= 0:
                parent[of], place[of] = size, k
        prior.append(row)
        if at == len(leaves) and not joined:
            break
        heapq.heappush(joined, (total, size))
        size, first = size + 1, branches
    root = size
    steps, own, up = [], np.arange(n), np.arange(n)
    while len(own):
        steps.append((own, parent[up] - n, place[up]))
        up = parent[up]
        own, up = own[up != root], up[up != root]
    leaf, node, branch = (np.concatenate(x) for x in zip(*steps))
    depth = np.concatenate([np.full(len(s[0]), k) for k, s in enumerate(steps)])
    order = np.lexsort((-depth, leaf))
    return Tree(np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n))]), node[order].astype(np.int16 if size - n < 1 << 15 else np.int32), branch[order].astype(np.int8), np.array(prior))


@dataclass
class Model:
    heads: np.ndarray  # hashes of the held words, by frequency
    counts: np.ndarray  # their counts
    slots: np.ndarray  # where in heads a hash is: at the slot of its upper bits, or the next ones up to an empty slot (-1)
    contexts: int  # so many of the most frequent are contexts of their own
    rest_total: np.ndarray  # what the (smoothed) counts of a class of the rest add up to
    tree: Tree  # of the held words by frequency, then the REST
    first: np.ndarray  # first row of weights of each node
    size: np.ndarray  # how many rows it has
    weights: np.ndarray  # rows, BRANCHES
    squares: np.ndarray  # of each row's gradients so far

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places among heads, or -1."""
        slot = (hashes >> _U(65 - len(self.slots).bit_length())).astype(np.int64)
        out = self.slots[slot]
        if not len(self.heads):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.heads[out] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            out[open_] = self.slots[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.heads[out[open_]] != hashes[open_])]
        return out

    def units(self, hashes: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """A token's leaf: a held word's place, or the number of held words and the class among the rest."""
        at = self.find(hashes)
        return np.where(at >= 0, at, len(self.heads) + rest)


def hash_slots(heads: np.ndarray) -> np.ndarray:
    """The slots of Model.find, four times as many as heads at least, so that most are found at once."""
    bits = max(4, (4 * len(heads)).bit_length())
    out, slot, own = np.full(1 << bits, -1, np.int32), (heads >> _U(64 - bits)).astype(np.int64), np.arange(len(heads), dtype=np.int32)
    while len(own):
        free = out[slot] < 0
        out[slot[free]] = own[free]
        left = out[slot] != own
        slot, own = (slot[left] + 1) & ((1 << bits) - 1), own[left]
    return out


def contexts(model: Model, units: np.ndarray, rest: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys (32 bits) of each token's features: words one, two and three before, and the two before together; starts of texts differ."""
    n = len(units)
    context = np.where(units < model.contexts, units, model.contexts + rest)
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    before = []
    for k in (1, 2, 3):
        b = np.full(n, model.contexts + REST, np.int64)
        b[k:] = context[:-k] if n > k else b[k:]
        b[place < k] = model.contexts + REST
        before.append(b.astype(np.uint64))
    keys = [before[0], before[1] + _U(1 << 40), before[2] + _U(2 << 40), before[0] * _U(1 << 20) + before[1] + _U(3 << 40)]
    return np.stack([mix(k) >> _U(32) for k in keys], 1)


def spans(tree: Tree, weights: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of each node's rows of weights, and how many: by its share of the softmaxes; small nodes overlap."""
    passed = np.bincount(tree.nodes, np.repeat(weights, np.diff(tree.starts)), minlength=len(tree.prior))
    size = np.clip(passed / passed.sum() * rows, 8, rows).astype(np.int64)
    return np.minimum((np.cumsum(size) - size) % rows, rows - size), size


def softmaxes(model: Model, units: np.ndarray, rest: np.ndarray, bounds: np.ndarray):
    """Steps of the softmaxes of all tokens, those of a node together: (token, node, branch, rows of weights by feature)."""
    keys, tree = contexts(model, units, rest, bounds), model.tree
    many = tree.starts[units + 1] - tree.starts[units]
    token = np.repeat(np.arange(len(units)), many)
    at = np.arange(len(token)) + np.repeat(tree.starts[units] - np.cumsum(many) + many, many)
    order = np.argsort(tree.nodes[at], kind="stable")
    for low in range(0, len(order), STEP):
        own = order[low : low + STEP]
        node = tree.nodes[at[own]].astype(np.int64)
        rows = (np.take(keys, token[own], 0) * model.size[node].astype(np.uint64)[:, None] >> _U(32)).astype(np.int64)
        rows += model.first[node][:, None]
        yield token[own], node, tree.branches[at[own]].astype(np.int64), np.ascontiguousarray(rows.T)


class Softmax:
    """Softmaxes in arrays that are used again."""

    def __init__(self, model: Model, weights: np.ndarray):
        self.prior, self.weights, self.ones = model.tree.prior, weights, np.ones(BRANCHES, np.float32)
        self.z, self.part = np.empty((STEP, BRANCHES), np.float32), np.empty((STEP, BRANCHES), np.float32)

    def __call__(self, node: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of each branch's sum (overwritten by the next call), and their totals."""
        z, part = self.z[: len(node)], self.part[: len(node)]
        np.take(self.prior, node, 0, out=z, mode="clip")
        for r in rows:
            z += np.take(self.weights, r, 0, out=part, mode="clip")
        np.clip(z, -60, 60, out=z)
        np.exp(z, out=z)
        return z, z @ self.ones


def score_units(model: Model, units: np.ndarray, rest: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's leaf."""
    softmax, out = Softmax(model, model.weights), np.zeros(len(units))
    for token, node, branch, rows in softmaxes(model, units, rest, bounds):
        z, total = softmax(node, rows)
        np.add.at(out, token, np.log(z[np.arange(len(z)), branch] / total))
    return out


class Learner:
    """Gradient steps over tokens, with a step size for each row of weights (its squared gradients so far)."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate = model, np.float32(rate)
        self.weights, self.squares, self.new = model.weights.copy(), model.squares.copy(), np.zeros(len(model.weights), np.float32)

    def learn(self, units: np.ndarray, rest: np.ndarray, bounds: np.ndarray) -> None:
        softmax, wide = Softmax(self.model, self.weights), BRANCHES // 2
        pairs = self.weights.reshape(-1).view(np.complex64)  # two weights at once
        step, across, cells = np.empty((STEP, BRANCHES), np.float32), np.arange(wide), np.empty((STEP, wide), np.int64)
        before = self.squares.copy()
        for _, node, branch, rows in softmaxes(self.model, units, rest, bounds):
            error, total = softmax(node, rows)
            n = len(error)
            error /= -total[:, None]
            error[np.arange(n), branch] += 1
            size = np.einsum("ij,ij->i", error, error)
            for r in rows:
                np.add.at(self.squares, r, size)
                np.multiply(error, (self.rate / np.sqrt(self.squares[r]))[:, None], out=step[:n])
                np.add((r * wide)[:, None], across, out=cells[:n])
                np.add.at(pairs, cells[:n].reshape(-1), step[:n].reshape(-1).view(np.complex64))
        self.new += self.squares - before

    def blocks(self):
        """(block of rows, what was added to their squared gradients, their weights) of what was met."""
        for low in range(0, len(self.new), SENT_ROWS):
            new = self.new[low : low + SENT_ROWS]
            if new.any():
                yield low, new, self.weights[low : low + SENT_ROWS].astype(np.float16)


def _train_round(model: Model, texts: DataFrame, rate: float, tasks: int) -> None:
    """texts: text. Rows of weights become the mean over the tasks, by the squared gradients that each has added."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learner = Learner(shared.value, rate)
        for batch in batches:
            for _, _, hashes, bounds, rest in tokens(batch.column(0)):
                learner.learn(learner.model.units(hashes, rest), rest, bounds)
        for low in range(0, len(rows := list(learner.blocks())), 64):
            block, new, weights = zip(*rows[low : low + 64])
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(pa.array([x.tobytes() for x in own], pa.binary()) for own in (new, weights))], ["block", "new", "weights"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for block, *raw in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.frombuffer(raw[0], np.float32).astype(np.float64)
                own = sums.setdefault(block, [0, np.zeros(len(new)), np.zeros((len(new), BRANCHES))])
                own[0] += new > 0
                own[1] += new
                own[2] += np.frombuffer(raw[1], np.float16).reshape(-1, BRANCHES) * new[:, None]
        if sums:
            new = [(n / np.maximum(tasks, 1)).astype(np.float32).tobytes() for tasks, n, _ in sums.values()]
            means = [(w / np.maximum(n, 1e-30)[:, None]).astype(np.float16).tobytes() for _, n, w in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(new, pa.binary()), pa.array(means, pa.binary())], ["block", "new", "weights"])

    schema = "block int, new binary, weights binary"
    learnt = texts.coalesce(tasks).mapInArrow(run, schema).repartition("block").mapInArrow(add, schema)
    for block, new, weights in learnt.collect():  # MOST_ROWS at most
        new = np.frombuffer(new, np.float32)
        at = block + np.flatnonzero(new > 0)
        model.weights[at] = np.frombuffer(weights, np.float16).reshape(-1, BRANCHES)[at - block]
        model.squares[at] += new[at - block]


def _counts(texts: DataFrame) -> DataFrame:
    """(h, c, rest): each token's count and its class among the rest."""

    def run(batches):
        hashes, counts, classes, size = [], [], [], 0

        def flush():
            every, place = np.unique(np.concatenate(hashes), return_inverse=True)
            total, of = np.zeros(len(every), np.int64), np.zeros(len(every), np.int32)
            np.add.at(total, place, np.concatenate(counts))
            of[place] = np.concatenate(classes)
            return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(total), pa.array(of)], ["h", "c", "rest"])

        for batch in batches:
            for _, _, own, _, rest in tokens(batch.column(0)):
                every, first, n = np.unique(own, return_index=True, return_counts=True)
                hashes.append(every)
                counts.append(n)
                classes.append(rest[first])
                size += len(every)
                if size > 2_000_000:
                    yield flush()
                    hashes, counts, classes, size = [], [], [], 0
        if hashes:
            yield flush()

    return texts.mapInArrow(run, "h long, c long, rest int").groupBy("h").agg(F.sum("c").alias("c"), F.min("rest").alias("rest"))


def fit(texts: DataFrame, counts: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> tuple[Model, int, int]:
    """The model, and the numbers of tokens and of distinct ones. texts: text, part."""
    whole = counts.agg(F.sum("c"), F.count("*")).first()
    n, distinct = int(whole[0] or 0), int(whole[1])
    least, total = 2**62, 0  # the lowest count of a held word: all words of a count are held, or none
    for row in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        total += row["n"]
        if total > HELD_WORDS:
            break
        least = row["c"]
    held = counts.where(F.col("c") >= least).select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True], kind="stable")
    hashes = held["h"].to_numpy(np.int64).view(np.uint64)
    rest_total = np.full(REST, 0.1)
    for k, c, types in counts.where(F.col("c") < least).groupBy("rest").agg(F.sum("c"), F.count("*")).collect():
        rest_total[k] += c + 0.1 * types
    shares = np.concatenate([held["c"].to_numpy(float) + 0.1, rest_total])
    tree = class_tree(shares)
    rows = int(np.clip(n // ROW_TOKENS, LEAST_ROWS, MOST_ROWS))
    own = min(len(hashes), max(1024, n // CONTEXT_TOKENS))
    zeros, calm = np.zeros((rows, BRANCHES), np.float32), np.full(rows, CALM)
    model = Model(hashes, held["c"].to_numpy(np.int64), hash_slots(hashes), own, rest_total, tree, *spans(tree, shares, rows), zeros, calm)
    partitions = texts.rdd.getNumPartitions()
    tasks = int(np.clip(-(-n // rounds // max(TASK_TOKENS, TASK_ROW_TOKENS * rows)), 1, max(1, partitions)))
    for part in range(rounds):
        _train_round(model, texts.where(F.col("part") == part).select("text"), rate, tasks)
    return model, n, distinct


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Tokens are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased, and one end of each text (a null text
    is empty: an end only). The model learns from rows whose crc32(id) mod folds isn't 0; a null id is held out.
    base_score: log10 probability by training frequencies with 0.1 added, one unknown token being a further type.
    score: the model's. Both take in all tokens of the whole text. Repeated rows give a row each (and count each in
    training); without any training row all tokens are unknown. Further columns are left out. Tokens are told apart by
    64-bit hashes. The driver and tasks hold weights and the highest counts, MOST_ROWS and HELD_WORDS of them at most;
    other counts are joined.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held_out = F.coalesce(remainder(F.col("id"), folds) == 0, F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("held_out", held_out)
    training = rows.where(~F.col("held_out")).select("text", F.pmod(F.xxhash64("id"), F.lit(rounds)).alias("part"))
    counts = kept(_counts(training.select("text")))
    model, n, distinct = fit(training, counts, rounds, rate)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    log_total = float(np.log10(n + 0.1 * (distinct + 1)))

    def run(batches):
        model = shared.value
        number = TaskContext.get().partitionId() << 33
        rest_log, count_log = np.log10(model.rest_total), np.log10(model.counts + 0.1)
        for batch in batches:
            for low, high_, own, bounds, rest in tokens(batch.column(1)):
                units = model.units(own, rest)
                score = score_units(model, units, rest, bounds) / np.log(10)
                found = units < len(model.heads)
                score -= np.where(found, 0.0, rest_log[rest])
                log_c = np.zeros(len(own))
                log_c[found] = count_log[units[found]]
                row = np.repeat(np.arange(high_ - low), np.diff(bounds))
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (log_c, score, found.astype(np.int64))]
                late = np.flatnonzero(~found)
                pairs = np.lexsort((own[late], row[late]))
                late = late[pairs]
                new = np.ones(len(late), bool)
                new[1:] = (own[late][1:] != own[late][:-1]) | (row[late][1:] != row[late][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(late)))
                ends = np.searchsorted(row[late[first]], np.arange(high_ - low + 1)).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(own[late[first]].view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(high_ - low)), *(batch.column(k).slice(low, high_ - low) for k in (0, 2)), pa.array(np.diff(bounds)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(ends), structs)], ["row", "id", "held_out", "n_tokens", "known", "base", "score", "late"])
                number += high_ - low

    scored = kept(rows.select("id", "text", "held_out").mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, score double, late array<struct<h:long,n:long>>"))
    late = scored.select("row", F.explode("late").alias("l")).select("row", "l.h", "l.n").join(counts.select("h", "c"), "h", "left")
    late = late.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rest"))
    out = scored.join(late, "row", "left")
    rest = F.coalesce("rest", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * F.lit(log_total)).alias("base_score"), (F.col("score") + rest).alias("score"),
    )
