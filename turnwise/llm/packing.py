"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A piece of n tokens is estimated to cost linear * n + quadratic * n * n (attention stays within
a piece). Within a block of documents, pieces go by descending cost to the sequence with the
lowest cost that still has room for them; the few that fit nowhere are cut to fill what is left.
"""

from __future__ import annotations

import heapq
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnwise.llm._spark import give_back, store
from turnwise.llm.token_counts import byte_alphabet

#: Words, and chunks between spaces, whose ids a worker keeps; a full store keeps what the texts at hand use. Documents tokenised at once.
KEPT, CHUNKS_KEPT, AT_ONCE = 350_000, 450_000, 400
#: New words in one call of the tokenizer; longer calls take more time a word.
LEARNT = 200
#: Tokens of a block; a block is packed by itself, in the task that has tokenised it.
BLOCK_TOKENS = 1 << 20
SCHEMA = "id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words(dict):
    """A word of the pre-tokenizer, in lower case -> its ids as little-endian uint32 bytes.

    The tokenizer drops white space and never joins words, so a text's ids are those of its words. Words
    not seen before are encoded together and told apart by the ids that end a word. Texts with anything
    beyond Latin-1 letters, digits and signs, or with `<|`, go to the tokenizer as they are.
    """

    def __init__(self, text: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.chunks: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # words are in lower case and apart already, so they need the merges alone, over the letters that stand for their bytes
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for b, c in enumerate(byte_alphabet()) if b != 0x20}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # fixed values: the pre-tokenizer pattern of the word-end vocabulary
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.plain = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])

    def odd(self, text: str) -> bool:
        try:
            return bool(text.encode("latin-1").translate(None, self.plain)) or "<|" in text
        except UnicodeEncodeError:
            return True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        joined = [" ".join(words[i : i + LEARNT]) for i in range(0, len(words), LEARNT)]
        joined = [x if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in joined]
        ids = np.concatenate([np.array(self.merges.encode(x, add_special_tokens=False).ids, "<u4") for x in joined])
        ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
        if len(ends) == len(words) and ends[-1] == len(ids):
            raw = ids.tobytes()
            self.update(zip(words, (raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends))))
        else:
            self.update((w, self.encode(w).tobytes()) for w in words)

    def take(self, chunks: set[str]) -> None:
        """Put the ids of the chunks among those kept."""
        new = {c: (c,) if c.isalpha() else self.pattern.findall(c) for c in chunks}
        needed = set().union(*new.values())
        missing = needed - self.keys()
        if len(self) + len(missing) > KEPT:
            held = {w: self[w] for w in needed - missing}
            self.clear()
            self.update(held)
        if missing:
            self.learn(list(missing))
        self.chunks.update((c, self[w[0]] if len(w) == 1 else b"".join(map(self.__getitem__, w))) for c, w in new.items())

    def ids(self, texts: list[str]) -> list[bytes]:
        plain = [None if self.odd(t) else t.lower().split() for t in texts]
        every = set().union(*filter(None, plain))
        new = every - self.chunks.keys()
        if len(self.chunks) + len(new) > CHUNKS_KEPT:
            self.chunks = {c: self.chunks[c] for c in every - new}
        self.take(new)
        of = self.chunks.__getitem__
        return [self.encode(t).tobytes() if p is None else b"".join(map(of, p)) for t, p in zip(texts, plain)]


def words(text: str) -> Words:
    loaded: dict[str, Words] = store("packing")
    if text not in loaded:
        loaded.clear()
        loaded[text] = Words(text)
    return loaded[text]


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1e-3) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), all without padding.

    capacity is a power of two. Whole capacities of long documents are sequences by themselves. The
    others fill sequences of the capacity and, for what is over at the end, of smaller powers of two.
    """
    whole = [[(d, s, capacity)] for d, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rest = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    total = sum(n for n, _ in rest)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if total % capacity >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    filled: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    price = lambda n: linear * n + quadratic * n * n
    late = []
    for n, d in rest:
        open_ = np.where(room >= n, cost, np.inf)
        k = int(open_.argmin())
        if open_[k] == np.inf:
            late.append((n, d))
            continue
        filled[k].append((d, lengths[d] - n, n))
        room[k] -= n
        cost[k] += price(n)
    gaps = [(-int(r), k) for k, r in enumerate(room) if r]
    heapq.heapify(gaps)
    for n, d in late:  # as much room is left as these need
        at = lengths[d] - n
        while n:
            r, k = heapq.heappop(gaps)
            m = min(n, -r)
            filled[k].append((d, at, m))
            at, n = at + m, n - m
            if -r > m:
                heapq.heappush(gaps, (r + m, k))
    return whole + filled


def pack_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1,
    linear: float = 1.0, quadratic: float = 1e-3, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: path of a tokenizer.json that drops white space; the driver reads and broadcasts it.
    Each document's ids end with end_id, so null and empty texts are one token. Every id lies in one
    piece. A block of about block_tokens tokens is packed in the task that reads it: no shuffle, and
    memory for one block and one document. Sequences are numbered partition * 2**33 + count, the same
    in a repeated task. Repeated rows and ids are documents of their own; further columns are left out.
    """
    vocabulary_text = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    ids = docs.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        give_back("packing")
        known, number = words(vocabulary_text.value), (TaskContext.get().partitionId()) << 33

        def flush(block, number):
            rows = []
            for k, pieces in enumerate(pack([len(b) // 4 for _, b in block], capacity, linear, quadratic)):
                offset = 0
                for d, start, n in pieces:
                    own, b = block[d]
                    rows.append((own, start, n, zlib.crc32(memoryview(b)[4 * start : 4 * (start + n)]), len(b) // 4, number + k, offset))
                    offset += n
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), [own_type, *[pa.int64()] * 6])], names), number + k + 1

        block, size, names, own_type = [], 0, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], None
        for batch in batches:
            own_type = batch.schema.field(0).type
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                for own, b in zip(part.column(0).to_pylist(), known.ids([t or "" for t in part.column(1).to_pylist()])):
                    block.append((own, b + end))
                    size += len(b) // 4 + 1
                if size >= block_tokens:
                    out, number = flush(block, number)
                    yield out
                    block, size = [], 0
        if block:
            yield flush(block, number)[0]

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, SCHEMA.format(ids.simpleString())).withColumnRenamed("id", id_col)
