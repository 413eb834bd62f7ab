"""Near-duplicate classes and repeated passages against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnwise.llm import jaccard_join as J, substring_dedup as S
from turnwise.llm._text import shingle_hashes, word_hashes


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def grams(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes_by_hand(rows, least=0.8):
    links, label = defaultdict(int), list(range(len(rows)))
    sets = [grams(t) for _, t in rows]
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                label[find(i)] = find(j)
    least_id = defaultdict(lambda: 10**9)
    for i, (own, _) in enumerate(rows):
        least_id[find(i)] = min(least_id[find(i)], own)
    return sorted((own, least_id[find(i)], links[i]) for i, (own, _) in enumerate(rows))


@pytest.mark.parametrize("leaf, block, salted", [(128, 400, 2048), (2, 2, 2), (128, 400, 3)])
def test_classes_equal_brute_force(corpus, leaf, block, salted, monkeypatch):
    monkeypatch.setattr(J, "SALTED", salted)
    frame, rows = corpus
    got = J.jaccard_classes(frame, leaf=leaf, block=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == classes_by_hand(rows)


def test_recall_of_pairs_at_the_threshold(spark):
    """Lone pairs of similarity 0.8 to 0.85: what is found of them, counted."""
    r, rows = np.random.default_rng(17), []
    for k in range(300):
        own = [f"w{x}" for x in r.integers(0, 10**7, 100)]
        changed = [w if i not in (20, 60) else "changed" for i, w in enumerate(own)][: 100 - k % 2]
        a, b = grams(" ".join(own)), grams(" ".join(changed))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.85
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(changed))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id // 2 for x in J.jaccard_classes(frame).collect() if x.n_links}
    assert len(got) >= 0.99 * 300


def test_one_of_each_class_stays(corpus, spark):
    frame, rows = corpus
    kept = J.one_of_each(frame.union(spark.createDataFrame([(None, "no id", "t", 1, "k", 0.5, 7)], frame.schema)))
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, c, _ in classes_by_hand(rows)})
    assert kept.where("doc_id is null").count() == 1


def test_no_rows_give_no_rows(no_docs):
    assert J.jaccard_classes(no_docs).count() == 0 and S.repeated_passages(no_docs).count() == 0 and S.without_repeats(no_docs).count() == 0


def test_runs_reach_the_recall():
    assert J.runs_for(0.9999, 0.8) == 10


def test_passages_hold_what_repeats(corpus):
    frame, rows = corpus
    got = S.repeated_passages(frame).collect()
    texts = {i: split(t) for i, t in rows}
    seen = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    assert {i for ids in seen.values() if len(ids) > 1 for i in ids} <= {r.doc_id for r in got}
    for r in got:
        own = grams(" ".join(texts[r.doc_id][r.start_word : r.end_word]))
        other = grams(" ".join(texts[r.class_id]))
        assert r.n_words == r.end_word - r.start_word >= 50 and len(own & other) >= 0.8 * len(own)
    assert not {403, 404, 405, 406, 20, 30} & {r.doc_id for r in got}


def test_cutting_keeps_the_first_and_the_columns(corpus):
    frame, rows = corpus
    got = S.without_repeats(frame, length_col=None)
    assert got.dtypes == frame.dtypes
    texts = {r.doc_id: r.text for r in got.collect()}
    assert 1 not in texts and texts[0] == dict(rows)[0]  # a whole copy goes
    assert len(split(texts[300])) == 130 and {len(split(texts[k])) for k in (301, 302, 303, 304)} == {70}
    assert texts[400] is None and texts[401] == ""


def test_compact_windows_are_all_windows_that_share_a_minimum():
    r = np.random.default_rng(2)
    values, bounds, width = r.integers(0, 2**63, 90).astype(np.uint64), np.array([0, 50, 53, 90]), 7
    row, key, first, last = S.compact_windows(values, bounds, width, 2)
    covered = defaultdict(int)
    for x, k, a, b in zip(row, key, first, last):
        for start in range(a, b - width + 2):
            covered[int(x), start, int(k & np.uint64(7))] += 1
    wanted = {(x, s, f) for x in range(3) for s in range(bounds[x + 1] - bounds[x] - width + 1) for f in range(2)}
    assert set(covered) == wanted and set(covered.values()) == {1}


def test_cut_words_with_wide_letters():
    assert S.cut_words("é ñ ß  a b", [(1, 3)]) == "é a b"


def test_hashes_do_not_depend_on_neighbours():
    texts = ["Ab c", "", "c ab", " x ", "é\u00e9 ab"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, b, _ = word_hashes(data, offsets)
    assert np.diff(b).tolist() == [2, 0, 2, 1, 2] and h[0] == h[3] == h[6] and h[1] == h[2]
    g, at = shingle_hashes(h, b, 2)
    assert np.diff(at).tolist() == [1, 0, 1, 1, 1] and len(set(g.tolist())) == 4


def without_some(words, places):
    return [f"x{k}" if k in places else w for k, w in enumerate(words)]


def test_later_copies_of_a_changed_text_are_found(spark):
    """F, an older text, is near neither A nor B, which are near each other; both share values with it."""
    r = np.random.default_rng(8)
    rows = []
    for k in range(24):
        a = [f"w{x}" for x in r.integers(0, 10**6, 60)]
        f, b = without_some(a, {9, 27, 45}), without_some(a, {30})  # Jaccard 41/71 of F and A, 51/61 of A and B
        rows += [(3 * k, " ".join(f)), (3 * k + 1, " ".join(a)), (3 * k + 2, " ".join(b))]
    for k in range(12):  # one passage in many texts
        rows.append((900 + k, " ".join([f"y{x}" for x in r.integers(0, 10**6, 30)] + [f"p{x}" for x in range(60)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.repeated_passages(frame).collect()
    found = {(x.doc_id, x.class_id) for x in got if not x.first}
    assert sum((3 * k + 2, 3 * k + 1) in found for k in range(24)) == 24
    assert {900 + k for k in range(1, 12)} <= {d for d, _ in found}
    assert not {3 * k for k in range(24)} & {d for d, _ in found}


@pytest.mark.parametrize("passage, line", [(60, 40), (55, 45), (60, 0), (52, 48)])
def test_passages_beside_a_common_line_are_found(spark, passage, line):
    """A has a line of a passage that B and C share; the first windows are often A's."""
    r = np.random.default_rng(passage)
    some = lambda n: [f"w{x}" for x in r.integers(0, 10**7, n)]
    common, rows = some(line), []
    for k in range(60):
        own = some(passage - line)
        shared = own[: k % (passage - line)] + (common if k % 2 else (line_ := some(line))) + own[k % (passage - line) :]
        rows += [(3 * k, some(30) + (common if k % 2 else line_) + some(30)), (3 * k + 1, some(25) + shared + some(20)), (3 * k + 2, some(35) + shared + some(40))]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(5)
    found = {(x.doc_id, x.class_id) for x in S.repeated_passages(frame).collect() if not x.first}
    assert {(3 * k + 2, 3 * k + 1) for k in range(60)} <= found
    assert not {d for d, _ in found} & {3 * k for k in range(60)}


@pytest.mark.parametrize("size, first, second", [(64, {10}, {40}), (100, {10, 50}, {30, 75}), (150, {10, 60, 110}, {35, 85, 135})])
def test_chains_of_edits_are_found(spark, size, first, second):
    """F, its near copy C, and C's near copy B, which isn't near to F: B is found with C; and pairs without F."""
    r = np.random.default_rng(size)
    some = lambda n: [f"w{x}" for x in r.integers(0, 10**7, n)]
    jaccard = lambda x, y: len(grams(" ".join(x)) & grams(" ".join(y))) / len(grams(" ".join(x)) | grams(" ".join(y)))
    rows, alone = [], []
    for k in range(60):
        f = some(size)
        c = [f"c{k}" if i in first else w for i, w in enumerate(f)]
        b = [f"b{k}" if i in second else w for i, w in enumerate(c)]
        assert jaccard(f, c) >= 0.8 and jaccard(c, b) >= 0.8 > jaccard(f, b)
        rows += [(3 * k + j, some(40) + x + some(40)) for j, x in enumerate((f, c, b))]
        alone += [(3 * k + j, some(40) + x + some(40)) for j, x in ((1, c), (2, b))]
    found = lambda rows: {x.doc_id for x in S.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(5)).collect() if not x.first}
    got, lone = found(rows), found(alone)
    assert sum(3 * k + 1 in got for k in range(60)) >= 58 and sum(3 * k + 2 in got for k in range(60)) >= 57
    assert sum(3 * k + 2 in lone for k in range(60)) >= 59


@pytest.mark.parametrize("turn", [False, True])
def test_ids_with_two_texts(spark, turn):
    r = np.random.default_rng(5)
    some = lambda n: [f"w{x}" for x in r.integers(0, 10**7, n)]
    rows = []
    for k in range(20):
        passage = some(70)
        pair = [(100 + k, " ".join(some(90))), (100 + k, " ".join(some(20) + passage + some(20)))]
        rows += [(k, " ".join(some(30) + passage)), *(pair[::-1] if turn else pair)]
    rows += [(500, " ".join(some(60))), (500, None), (500, ""), (501, rows[-1][1]), (501, rows[-1][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(x.doc_id, x.class_id, x.n_words) for x in S.repeated_passages(frame).collect() if not x.first}
    assert {(100 + k, k, 70) for k in range(20)} <= got and {d for d, _, _ in got} <= {*range(100, 120), 501}
    left = S.without_repeats(frame).collect()
    texts = Counter((x.doc_id, x.text) for x in left)
    cut = {(100 + k) for k in range(20)}
    assert all(texts[i, t] == 1 for i, t in rows if i not in cut and i != 501) and sum(n for (i, t), n in texts.items() if i in cut) == 40
    assert sorted(len((t or "").split()) for i, t in texts if i in cut) == [40] * 20 + [90] * 20


def test_recall_of_near_passages_beside_common_lines(spark):
    """Passages of 80 words, changed so that they are just as similar as asked, beside lines that all texts have."""
    r = np.random.default_rng(31)
    some = lambda n: [f"w{x}" for x in r.integers(0, 10**7, n)]
    lines, rows = [some(30) for _ in range(3)], []
    for k in range(150):
        own, at = some(80), set(r.choice(np.arange(6, 74, 9), 1).tolist())
        changed = [w if i not in at else "changed" for i, w in enumerate(own)]
        a, b = grams(" ".join(own)), grams(" ".join(changed))
        assert 0.8 <= len(a & b) / len(a | b) < 0.9
        rows += [(2 * k, lines[k % 3] + own + some(30)), (2 * k + 1, some(15) + lines[(k + 1) % 3] + changed)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(5)
    found = {(x.doc_id, x.class_id) for x in S.repeated_passages(frame).collect() if not x.first}
    assert sum((2 * k + 1, 2 * k) in found for k in range(150)) >= 0.95 * 150


def test_stretches_and_cover():
    assert S.stretches([(0, 0, 9), (1, 4, 20), (0, 12, 30)], 5, 2) == [(4, 5), (12, 16)]
    assert S.stretches([(0, 0, 9), (0, 2, 12)], 5, 2) == [] and S.stretches([], 5, 1) == []
    assert S.covered(np.array([0, 10]), np.array([9, 19]), [(2, 7), (16, 18)]).tolist() == [True, False]


def test_masked_windows_are_those_of_the_rest():
    r = np.random.default_rng(2)
    grams, width = r.integers(0, 2**63, 60).astype(np.uint64), 7
    whole = np.array([[0, 53]])
    none = np.zeros(0, np.int64)
    key, first, last = S.masked_windows(grams, width, whole, none, none.view(np.uint64), 2)
    plain = S.compact_windows(grams, np.array([0, 60]), width, 2)
    assert (key == plain[1]).all() and (first == plain[2]).all() and (last == plain[3]).all()
    again, *_ = S.masked_windows(grams, width, whole, none, key[:3], 2)
    assert not set(key[:3].tolist()) & set(again.tolist()) and len(again)
    assert not len(S.masked_windows(grams, width, whole, np.arange(60), key[:0], 2)[0])
    assert not len(S.masked_windows(grams[:5], width, whole, none, key[:0], 2)[0])  # a shorter text of the same id
    assert set(S.masked_windows(grams, width, np.array([[5, 8]]), none, key[:0], 2)[1].tolist()) <= {5, 6, 7, 8}


def test_pairs_that_meet_only_in_split_buckets_reach_the_recall(spark):
    assert [J.runs_for(0.9999, 0.8, k) for k in (1, 2, 5)] == [10, 15, 30]
    r = np.random.default_rng(6)
    common = [f"c{x}" for x in range(100)]  # lines that all texts are made of, in other orders
    rows = []
    for k in range(150):
        text = [w for x in r.choice(10, 6, replace=False) for w in common[10 * x : 10 * x + 10]]
        for j, at in enumerate([None, 20]):
            rows.append((2 * k + j, " ".join(w if i != at else "changed" for i, w in enumerate(text))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = J.jaccard_classes(frame, leaf=4).collect()
    assert sorted((x.doc_id, x.class_id, x.n_links) for x in got) == classes_by_hand(rows)


def test_windows_are_handed_over_in_small_batches(monkeypatch):
    """Heads and links of a block, each window once, in batches of BATCH_ROWS at most."""
    monkeypatch.setattr(S, "BATCH_ROWS", 7)
    r = np.random.default_rng(3)
    keys, ids, spans = r.integers(0, 40, 100).astype(np.uint64), np.arange(100), r.integers(0, 9, 100)
    block = S._Block()
    assert not list(block.add(keys, ids, spans))
    out = list(block.flush())
    assert max(b.num_rows for b in out) <= 7
    got = [x for b in out for x in zip(*(b.column(k).to_pylist() for k in range(5)))]
    first = {k: min(i for i in ids.tolist() if keys[i] == k) for k in keys.tolist()}
    assert sorted(x[:3] for x in got) == sorted(zip(keys.tolist(), ids.tolist(), spans.tolist()))
    assert {x[1]: x[3:] for x in got} == {i: (None, None) if first[k] == i else (first[k], spans[first[k]]) for i, k in zip(ids.tolist(), keys.tolist())}


def test_masked_windows_are_the_same_however_many_hashes_at_once(monkeypatch):
    r = np.random.default_rng(4)
    grams, width = r.integers(0, 2**63, 90).astype(np.uint64), 7
    key = S.compact_windows(grams, np.array([0, 90]), width, 5)[1][::2]
    given = (grams, width, np.array([[3, 30], [41, 80]]), np.array([5, 6, 44]), key)
    whole = S.masked_windows(*given)
    for at_once in (1, 200):
        monkeypatch.setattr(S, "HASHED_AT_ONCE", at_once)
        assert all(np.array_equal(x, y) for x, y in zip(whole, S.masked_windows(*given)))


def test_places_in_are_those_of_isin():
    r = np.random.default_rng(5)
    for n, m in ((0, 3), (3, 0), (50, 40), (300, 7)):
        a, b = (r.integers(0, 60, k).astype("<u4") for k in (n, m))
        assert np.array_equal(S.places_in(a, b), np.flatnonzero(np.isin(a, b)))


def test_python_gets_small_batches(spark, monkeypatch):
    """Steps that hand whole texts to Python hand over few at a time, and the session is as it was afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    seen = []
    monkeypatch.setattr(S, "kept", lambda df, kept=S.kept: seen.append(spark.conf.get(name)) or kept(df))
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text + " a b"), (2, "c d " + text)], "doc_id long, text string")
    assert {r["doc_id"] for r in S.repeated_passages(docs).collect()} == {1, 2}
    assert seen and max(map(int, seen)) <= 2_000 and spark.conf.get(name) == before
