"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted.

The count of a piece is its number of bytes less the merges made in it: the lowest-rank
adjacent pair is popped again and again, its two list nodes become one, and the pairs with
the new neighbours are pushed. Pieces repeat, so each task keeps the counts it has made.
"""

from __future__ import annotations

import heapq
import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Counts of pieces, and of chunks between spaces, kept by a worker; a store is emptied when it is full.
KEPT, CHUNKS_KEPT, CHUNK_CHARS = 800_000, 400_000, 32
_LOADED: dict[str, "Merger"] = {}


def byte_alphabet() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 ones themselves, then U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


class Merger(dict):
    """piece -> number of tokens, from the text of a byte-level BPE tokenizer.json."""

    def __init__(self, text: str):
        super().__init__()
        import regex

        file = json.loads(text)
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(file["model"]["merges"])}
        self.alphabet = byte_alphabet()
        self.specials = sorted((t["content"] for t in file.get("added_tokens", []) if t.get("special")), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.spaces = regex.compile(r" \s|\s ")
        self.chunks = Chunks(self)
        # fixed values: the pre-tokenizer pattern of the byte-level vocabulary
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = self[piece] = self.merge_count([self.alphabet[b] for b in piece.encode()])
        return n

    def merge_count(self, symbols: list[str]) -> int:
        rank, n = self.ranks.get, len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not symbols[i] or rank((symbols[i], symbols[j])) != r:
                continue  # a pair that an earlier merge has taken apart
            symbols[i] += symbols[j]
            symbols[j] = ""
            count -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            k = before[i]
            if k >= 0 and (r := rank((symbols[k], symbols[i]))) is not None:
                heapq.heappush(heap, (r, k))
        return count

    def count(self, text: str) -> int:
        if self.special and any(s in text for s in self.specials):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count_plain, parts))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        """A space next to no other white space begins a piece, so what lies between such spaces is counted by itself."""
        if self.spaces.search(text):
            return sum(map(self.__getitem__, self.pattern.findall(text)))
        first, _, rest = text.partition(" ")
        count = sum(map(self.__getitem__, self.pattern.findall(first)))
        return count + sum(map(self.chunks.__getitem__, rest.split(" "))) if _ else count


class Chunks(dict):
    """What follows a space, up to the next -> number of tokens, with that space."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, chunk: str) -> int:
        n = sum(map(self.merger.__getitem__, self.merger.pattern.findall(" " + chunk)))
        if len(chunk) <= CHUNK_CHARS and "\n" not in chunk:
            if len(self) >= CHUNKS_KEPT:
                self.clear()
            self[chunk] = n
        return n


def merger(text: str) -> Merger:
    """One per worker and vocabulary."""
    if text not in _LOADED:
        _LOADED.clear()
        _LOADED[text] = Merger(text)
    return _LOADED[text]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    vocabulary: path of a byte-level BPE tokenizer.json; the driver reads it and broadcasts it
    (a vocabulary file has a fixed size). Null text counts as empty: 0 bytes, 0 tokens. Each row
    of docs gives a row, repeated ones too; an empty table gives none; further columns are left out.
    A special token's string inside a text is one token. A text may have any length.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(Path(vocabulary).read_text())
    ids = docs.schema[id_col].dataType

    def count(batches):
        m = merger(words.value)
        for batch in batches:
            n = [m.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = read.mapInArrow(count, f"id {ids.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
