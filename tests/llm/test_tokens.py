"""Token counts and packing against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from turnwise.llm.packing import pack, pack_documents
from turnwise.llm.queries import vocabulary
from turnwise.llm.token_counts import token_counts

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
ODD = ["  a  b\n\n c\t\td ", "x<|endoftext|> y", "É́ Σας ÇA\xa0b c \x85d\x1ce", "it's WE'LL ١٢ 12345 !!?? ###", "\U0001f600 日本語", "x\n \ny", "½ªab"]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    more = spark.createDataFrame([(900 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    return corpus[0].select("doc_id", "text").union(more), corpus[1] + [(900 + k, t) for k, t in enumerate(ODD)]


def encode(name, text):
    return tokenizers.Tokenizer.from_file(vocabulary(name)).encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library(docs, no_docs):
    frame, rows = docs
    got = sorted(tuple(r) for r in token_counts(frame, vocabulary("byte_bpe_50k.json")).collect())
    want = [(i, len((t or "").encode()), len(encode("byte_bpe_50k.json", t or ""))) for i, t in rows]
    assert got == sorted((*w, w[2] > 512) for w in want)
    assert token_counts(no_docs, vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_packing_is_a_round_trip(docs, block):
    frame, rows = docs
    pieces = pack_documents(frame, vocabulary("word_bpe_49k.json"), block_tokens=block).collect()
    ids = {i: [*encode("word_bpe_49k.json", t or ""), 1] for i, t in rows}
    times = defaultdict(int)
    for i, _ in rows:
        times[i] += 1
    held, sequences = defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        sequences[p.sequence_id].append((p.offset, p.length))
        for k in range(p.start, p.start + p.length):
            held[p.doc_id][k] += 1
    assert all(held[i] == {k: times[i] for k in range(len(own))} for i, own in ids.items())
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # nothing is padded


def test_costs_are_balanced():
    lengths = [100 + 7 * (k % 90) for k in range(400)]
    costs = [sum(n + 1e-3 * n * n for _, _, n in s) for s in pack(lengths, 2048) if sum(n for _, _, n in s) == 2048]
    assert len(costs) > 50 and max(costs) < 1.25 * min(costs)


def test_no_documents(no_docs):
    assert pack_documents(no_docs, vocabulary("word_bpe_49k.json")).count() == 0
