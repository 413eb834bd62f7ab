"""Top-k, url rules and decontamination against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import decontamination as D, topk as K, url_filter as U


@pytest.mark.parametrize("scale, size", [(1.0, 16), (1e5, 3)])
def test_topk_equals_brute_force(spark, scale, size):
    r = np.random.default_rng(4)
    v = [(int(i), [float(x) for x in scale * r.normal(size=size)]) for i in range(150)]
    v[7] = (7, v[8][1])  # a tie
    rows = [*v, (500, None), (501, [1.0, None] * (size // 2) + [0.0] * (size % 2)), (502, [float("nan")] * size), (503, [1.0]), (None, v[0][1]), v[20]]
    frame = spark.createDataFrame([(*x, "k") for x in rows], "vec_id long, embedding array<double>, score string")
    got = sorted((g.query_id, g.rank, g.vec_id, g.score) for g in K.exact_topk(frame, frame.where("vec_id % 20 = 0 or vec_id = 503"), k=5).collect())
    whole = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e in v + [v[20]]]
    want = []
    for q, e in {i: e for i, e in whole if i % 20 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in whole if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_bounds_hold():
    r = np.random.default_rng(5)
    x, y = r.normal(size=(40, 19)), r.normal(size=(60, 19))
    assert all((K.segments(x, c) @ K.segments(y, c).T >= x @ y.T - 1e-9).all() for c in (1, 4, 16, 19, 50))


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.exact_topk(none, none).count() == 0


RULES = "allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/"
URLS = {
    "http://a.EXAMPLE.org/es/1?x=/en/": ("a.example.org", "/es/1", "example.org/es/", "block"),
    "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
    "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://shop.com/de/a b\n": ("shop.com", "/de/a b\n", "com/de/", "block"),
    "http://shop.com": ("shop.com", "", None, "allow"),
    "http://shop.com?/de/": ("shop.com", "", None, "allow"),
    "http://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
    "http://u@shop.com:80/de/": ("u@shop.com:80", "/de/", None, "allow"),
    "no scheme/de/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


@pytest.mark.parametrize("rules_of_an_index", [100_000, 2])
def test_url_rules(spark, monkeypatch, rules_of_an_index):
    monkeypatch.setattr(U, "INDEX_RULES", rules_of_an_index)
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS)] + [(0, next(iter(URLS)), "h", "r")], "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.url_verdicts(pages, U.parse_rules(RULES)).collect())
    want = [(k, *v) for k, v in enumerate(URLS.values())]
    assert got == sorted([want[0], *want], key=str) or sorted(got, key=str) == sorted([want[0], *want], key=str)
    assert U.url_verdicts(pages.limit(0), U.parse_rules(RULES)).count() == 0
    assert {r.verdict for r in U.url_verdicts(pages, []).collect()} == {"allow"}


def test_rules_are_kept_under_their_rarest_token():
    rules = U.parse_rules("block example.org/en/1")
    assert rules[0].tokens() == ["example", "org", "en"]  # 1 is no whole token


@pytest.fixture(scope="module")
def leaks(spark, corpus):
    frame, rows = corpus
    items = [(1, "What is the capital of the far country beyond the hills? It is the old town of stone."), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, None), (4, ""), (5, "one two three four. Five six.")]
    long_ = " ".join(f"w{k}" for k in range(300))
    items.append((6, long_))
    more = [(801, "noise " * 90 + items[0][1].upper() + " noise" * 50), (802, "What is the capital of the far country beyond the hills? " + "noise " * 30), (803, "start " + items[1][1].replace(" ", ", ") + " end"), (804, "x " * 700 + items[4][1]), (805, "y " * 33 + long_ + " z" * 40), (806, "y " * 33 + " ".join(long_.split()[:150]))]
    docs = frame.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("score", F.lit(1))
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("items_of_an_index", [20_000, 1])
def test_leaks_are_found_and_clean_documents_are_not(leaks, monkeypatch, items_of_an_index):
    monkeypatch.setattr(D, "INDEX_ITEMS", items_of_an_index)
    docs, items = leaks
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()) == [(801, 1), (803, 2), (804, 5), (805, 6)]
    left = D.without_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 4


@pytest.mark.parametrize("kind", ["long", "string"])
def test_scores_do_not_depend_on_how_items_are_dealt(spark, leaks, monkeypatch, kind):
    docs, items = leaks
    got = []
    for n in (20_000, 2, 1):
        monkeypatch.setattr(D, "INDEX_ITEMS", n)
        found = D.contaminated(docs, items.withColumn("item_id", F.col("item_id").cast(kind)))
        assert dict(found.dtypes)["item_id"] == {"long": "bigint"}.get(kind, kind)
        got.append(sorted((r.doc_id, str(r.item_id), round(r.score, 9), r.question_overlap, r.answer_overlap) for r in found.collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 4


def found_by_hand(docs, items, threshold=0.7, overlap=0.8, unit=64):
    """Every window of every text against every unit, with BM25 written out."""
    words = lambda t: re.findall(r"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parts, units = {}, []
    for i, text in items:
        q, a = (words(x) for x in D.split_answer(text))
        parts[i] = (grams(q), grams(a), len(q + a))
        units += [(i, list(u)) for u in np.array_split(q + a, max(1, -(-len(q + a) // unit)))]
    df = Counter(t for _, u in units for t in set(u))
    mean = sum(len(u) for _, u in units) / len(units)
    impacts = []
    for i, u in units:
        weight = {t: math.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5)) * n * (D.K1 + 1) / (n + D.K1 * (1 - D.B + D.B * len(u) / mean)) for t, n in Counter(u).items()}
        impacts.append((i, {t: x / sum(weight.values()) for t, x in weight.items()}))
    out = set()
    for d, text in docs:
        w = words(text)
        for low in range(0, len(w), unit):
            inside = set(w[low : low + 2 * unit])
            for i, impact in impacts:
                if sum(x for t, x in impact.items() if t in inside) >= threshold - 1e-9:
                    q, a, room = parts[i]
                    near = grams(w[max(0, low - room) : low + 2 * unit + room])
                    if all(not g or len(g & near) / len(g) >= overlap - 1e-9 for g in (q, a)):
                        out.add((d, i))
    return out


def test_finds_equal_brute_force_at_every_offset(spark):
    r = np.random.default_rng(12)
    common, rare = [f"c{k}" for k in range(30)], [f"r{k}" for k in range(400)]
    some = lambda n: [str(r.choice(common)) if r.random() < 0.6 else str(r.choice(rare)) for _ in range(n)]
    items = []
    for i in range(40):
        begin = [str(x) for x in r.choice(common, 8)] if i % 2 else []  # begins with common words only
        items.append((i, " ".join(begin + some(22)) + ". " + " ".join(some(6))))
    docs = []
    for k in range(256):
        text = items[k % 40][1].split()
        if k % 3 == 0:
            text[r.integers(len(text))] = "changed"
        docs.append((k, " ".join(some(100 + k % 64) + text + some(int(r.integers(0, 150))))))
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = found_by_hand(docs, items)
    assert {(x.doc_id, x.item_id) for x in got} == want and len(want) >= 200


def test_no_items_and_no_documents(leaks, no_docs):
    docs, items = leaks
    assert D.contaminated(docs, items.limit(0)).count() == 0 and D.contaminated(no_docs, items).count() == 0


def test_wand_equals_brute_force():
    r = np.random.default_rng(6)
    vocabulary = [f"t{k}" for k in range(80)]
    index = D.Index([(i, " ".join(r.choice(vocabulary, 12)), "") for i in range(120)])
    for _ in range(150):
        terms = r.choice(len(index.terms), r.integers(1, 40), replace=False).tolist()
        threshold = float(r.choice([0.1, 0.3, 0.6]))
        scores: dict[int, float] = {}
        for t in terms:
            for u, x in zip(*index.postings[t]):
                scores[u] = scores.get(u, 0) + x
        assert sorted(u for u, _ in index.wand(terms, threshold)) == sorted(u for u, s in scores.items() if s >= threshold - 1e-9)
