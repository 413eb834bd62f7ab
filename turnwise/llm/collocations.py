"""Collocations of a corpus: phrases of two to four words whose parts seldom occur apart.

Texts are cut into pieces, equal pieces become one row with a multiplicity, and all that follows counts weighted pieces.

1. Frequent n-grams, by hash. A task hashes the n-grams of its pieces, sums the weights of equal ones, and sends them in
   blocks to buckets of the hash; a bucket is summed by duckdb, which spills beyond its memory limit. First one and two
   words; then three and four, only where all pairs of neighbours within are frequent, as a phrase is at most as frequent
   as its parts. What is frequent is passed on as a filter of at most FILTER_BITS bits: where it is too small for
   all, more n-grams are counted than need be, and none is lost.
2. Counts by text. N-grams that pass the filter are counted once more, now by their words, so that counts are exact.
3. Scores. Each candidate asks for the counts of its parts: requests are shuffled to the part, answers to the candidate.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnwise.llm._spark import kept
from turnwise.llm._text import buffers, mix, slices, word_hashes

MOST_WORDS = 4
#: N-grams that a task gathers before it sums them and sends them on.
GATHERED = 1 << 22
#: N-grams of a bucket, about; a filter's bits for each frequent n-gram, and at most (64 MB).
BUCKET = 1 << 23
BITS_EACH = 16
FILTER_BITS = 1 << 29
#: Memory of duckdb in a task; beyond it, it writes to the task's own temporary folder.
DUCKDB_MEMORY = "384MB"
_U = np.uint64
_STEP = np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, MOST_WORDS, dtype=np.uint64) * _U(2) + _U(1)


def pieces(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, piece, times): the different pieces of all texts, A-Z lowered, with how often each occurs."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.explode(F.split(lower, r"[.,;:!?\n\x0B\x0C\r]")).alias("piece"))
    rows = rows.select("lang", F.regexp_replace("piece", r"^[ \t]+|[ \t]+$", "").alias("piece")).where("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))


def _positions(batch: pa.RecordBatch, bits: np.ndarray | None) -> Iterator[tuple]:
    """(data, words' starts and ends, weight of each word's row, {n: (first word, key) of its n-grams}) of slices of a batch.

    Without a filter n is 1 and 2; with one, 3 and 4 where all pairs of neighbours pass it, and the 1 and 2 that pass it.
    """
    data, offsets = buffers(batch.column("piece"))
    langs, where = buffers(batch.column("lang"))
    seeds = np.array([_lang_seed(langs[a:b].tobytes()) for a, b in zip(where[:-1], where[1:])], np.uint64)
    times = batch.column("times").to_numpy()
    for low, high in slices(offsets):
        here = data[offsets[low] : offsets[high]]
        words, bounds, starts, ends = word_hashes(here, offsets[low : high + 1] - offsets[low], ends=True)
        row = np.repeat(np.arange(low, high), np.diff(bounds))
        grams, ok, key = {}, np.ones(len(words), bool), np.zeros(len(words), np.uint64)
        pairs = None
        for n in range(1, MOST_WORDS + 1):
            if len(words) < n or (bits is None and n > 2):
                break
            key = key[: len(words) - n + 1] + words[n - 1 :] * _STEP[n - 1]
            ok = ok[: len(key)] & (row[n - 1 :] == row[: len(key)])
            if n > 2:
                ok &= pairs[n - 2 :][: len(ok)]
            at = np.flatnonzero(ok)
            keys = mix(key[at] ^ seeds[row[at]], n)
            if bits is not None and n <= 2:
                passed = passes(bits, keys)
                at, keys = at[passed], keys[passed]
                if n == 2:
                    pairs = np.zeros(len(words), bool)
                    pairs[at] = True
                    ok = pairs[: len(ok)].copy()
            grams[n] = (at, keys)
        yield here, starts, ends, times[row], grams


def _lang_seed(name: bytes, known: dict = {}) -> int:  # noqa: B006  languages of this process
    if name not in known:
        if len(known) > 10_000:
            known.clear()
        known[name] = int(mix(np.frombuffer(name + b"\0" * (-len(name) % 8), np.uint64), len(name)).sum(dtype=np.uint64)) if name else 1
    return known[name]


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys & _U(bits - 1), (keys >> _U(32)) & _U(bits - 1)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys pass a filter, an array of 64-bit words."""
    out = np.ones(len(keys), bool)
    for place in _places(keys, 64 * len(bits)):
        out &= (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) != 0
    return out


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights, first)


def frequent_hashes(rows: DataFrame, least: int, buckets: int, bits=None) -> DataFrame:
    """(key): hashes of n-grams with a weight of at least `least`; of one and two words without a filter, else of three and four."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value if bits is not None else None
        keys, weights, n = [], [], 0
        for batch in batches:
            for _, _, _, weight, grams in _positions(batch, held):
                for size, (at, key) in grams.items():
                    if (size > 2) == (held is not None):
                        keys.append(key)
                        weights.append(weight[at])
                        n += len(key)
                if n >= GATHERED:
                    yield sent(keys, weights)
                    keys, weights, n = [], [], 0
        if n:
            yield sent(keys, weights)

    def sent(keys: list, weights: list) -> pa.RecordBatch:
        key, weight = _summed(np.concatenate(keys), np.concatenate(weights))
        bucket = (key % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, weight, bucket = key[order], weight[order], bucket[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(first[1:], len(key))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first]), pa.array([key[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()), pa.array([weight[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())],
            ["bucket", "keys", "weights"],
        )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        schema = pa.schema([("key", pa.int64()), ("weight", pa.int64())])

        def blocks() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, weights in zip(batch.column("keys"), batch.column("weights")):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), np.int64)), pa.array(np.frombuffer(weights.as_buffer(), np.int64))], schema=schema)

        with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as db:
            grams = pa.RecordBatchReader.from_batches(schema, blocks())  # noqa: F841  named in the SQL
            yield from db.sql("SELECT key FROM grams GROUP BY key HAVING sum(weight) >= ?", params=[least]).to_arrow_reader(1 << 16)

    sent_rows = rows.mapInArrow(count, "bucket bigint, keys binary, weights binary").repartition(buckets, "bucket")
    return sent_rows.mapInArrow(total, "key bigint")


def filter_of(keys: DataFrame) -> np.ndarray:
    """A filter that all keys pass, as an array of 64-bit words: the smallest power of two with BITS_EACH bits a key, at most FILTER_BITS bits."""
    n = keys.count()
    bits = min(FILTER_BITS, max(1 << 12, 1 << int(n * BITS_EACH).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((place >> _U(6)).astype(np.int64)), pa.array((_U(1) << (place & _U(63))).view(np.int64))], ["word", "ones"])

    rows = keys.mapInArrow(words, "word bigint, ones bigint").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("ones").to_numpy().view(np.uint64)
    return out


def phrase_counts(rows: DataFrame, least: int, bits) -> DataFrame:
    """(lang, phrase, size, a): n-grams of one to four words with a weight of at least `least`, by their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = bits.value, {}
        for batch in batches:
            langs, where = buffers(batch.column("lang"))
            name = {_lang_seed(langs[a:b].tobytes()): langs[a:b].tobytes().decode() for a, b in zip(where[:-1], where[1:])}
            for lang in name.values():
                mine = batch.filter(pc.equal(batch.column("lang"), lang)) if len(name) > 1 else batch
                for data, starts, ends, weight, grams in _positions(mine, held):
                    for n, (at, keys) in grams.items():
                        if n > 2:
                            passed = passes(held, keys)
                            at, keys = at[passed], keys[passed]
                        if not len(at):
                            continue
                        order = np.argsort(keys, kind="stable")
                        at, keys = at[order], keys[order]
                        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                        sums = np.add.reduceat(weight[at], first)
                        for key, i, total in zip(keys[first].tolist(), at[first].tolist(), sums.tolist()):
                            if (have := found.get(key)) is not None:
                                have[3] += total
                            else:
                                phrase = b" ".join(data[starts[i + j] : ends[i + j]].tobytes() for j in range(n)).decode()
                                found[key] = [lang, phrase, n, total]
                if len(found) >= GATHERED // 8:
                    yield flushed(found)
                    found = {}
        if found:
            yield flushed(found)

    def flushed(found: dict) -> pa.RecordBatch:
        lang, phrase, size, a = zip(*found.values())
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(phrase), pa.array(size, pa.int32()), pa.array(a, pa.int64())], ["lang", "phrase", "size", "a"])

    counted = rows.mapInArrow(count, "lang string, phrase string, size int, a bigint")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _words(start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def scored(counts: DataFrame, share: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, score): candidates with their lowest cut, less those that a longer candidate holds too often.

    counts: lang, phrase, size, a of all frequent n-grams, words included.
    """
    phrases = counts.where("size >= 2").withColumn("words", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    requests = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), _words(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )).alias("q")).select("lang", "phrase", "a", "k", "q.side", "q.part")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    cut = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    cut = cut.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(20,0)) as decimal(30,0)) div cast(cast(l as decimal(20,0)) + r as decimal(30,0))"))
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    within = phrases.where("size > 2").select("lang", F.col("a").alias("longer"), "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    within = within.select("lang", "longer", "words", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("at"))
    within = within.select("lang", _words(F.col("at"), F.col("n")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = "cast({} * cast({} as decimal(20,0)) as decimal(30,0))"
    return lowest.join(within, ["lang", "phrase"], "left").where(F.expr(f"longer is null or {wide.format(100, 'longer')} < {wide.format(share, 'a')}")).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` collocations of each language.

    a, l and r count the phrase and its two parts at the cut of the lowest score, n all words of the language; score is
    floor(2000000 a / (l + r)). Null texts are empty, a null language is `und`; pieces without a word, empty texts and
    empty tables give nothing. Repeated rows count as often as they occur. Ties go to the more frequent phrase, then to the
    smaller in byte order. Texts of any length are read whole; no count is sampled or cut. Further columns are ignored.
    """
    spark = docs.sparkSession
    if text == lang:
        raise ValueError("text and lang are one column")
    rows = kept(pieces(docs, text, lang))
    words = kept(rows.select("lang", (F.col("times") * F.regexp_count("piece", F.lit(r"[^ \t]+"))).alias("n"), F.regexp_count("piece", F.lit(r"[^ \t]+")).alias("here")).groupBy("lang").agg(F.sum("n").alias("n"), F.sum("here").alias("here")))
    distinct = words.agg(F.sum("here")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * distinct // BUCKET))
    short = kept(frequent_hashes(rows, least, buckets))
    pairs = spark.sparkContext.broadcast(filter_of(short))
    every = short.union(frequent_hashes(rows, least, buckets, pairs))
    bits = spark.sparkContext.broadcast(filter_of(kept(every)))
    found = scored(kept(phrase_counts(rows, least, bits)), share)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(words.select("lang", "n")) if words.count() <= 10_000 else words.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
