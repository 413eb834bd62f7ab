"""HTML extraction, lexical search and collocations against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from copy import deepcopy
from fractions import Fraction

import numpy as np
import pytest

from turnwise.llm import collocations as C, html_extraction as H, lexical_search as L
from turnwise.llm.html_tree import Page, Wrapper, _nodes, matched

# ---------------------------------------------------------------- HTML


def tree(r, depth=0):
    return [r.choice("abc"), 1, [tree(r, depth + 1) for _ in range(r.randrange(0, 4 - depth))]]


def best_matching(a, b):
    """Most pairs of a matching, over all ways to align the siblings."""
    if a[0] != b[0]:
        return 0

    def rows(x, y):
        if not x or not y:
            return 0
        return max(rows(x[1:], y), rows(x, y[1:]), best_matching(x[0], y[0]) + rows(x[1:], y[1:]) if x[0][0] == y[0][0] else 0)

    return 1 + rows(a[2], b[2])


def test_tree_matching_equals_brute_force():
    r = random.Random(1)
    for _ in range(200):
        a, b = tree(r), tree(r)
        assert matched(a, b, {}) == best_matching(a, b) == matched(b, a, {})


def test_wrapper_counts_every_page():
    r = random.Random(2)
    trees = [["#page", 1, [tree(r) for _ in range(3)]] for _ in range(30)]
    want = sum((Counter(n[0] for n in _nodes(t)) for t in trees), Counter())
    most = 10 + max(sum(1 for _ in _nodes(t)) for t in trees)
    wrapper, small = Wrapper(), Wrapper(most=10)
    for t in trees:
        small.merge(deepcopy(t))
        assert small.size <= most
        wrapper.merge(t)
    assert wrapper.root[1] == 30 and wrapper.size == sum(1 for _ in _nodes(wrapper.root))
    totals = Counter()
    for n in _nodes(wrapper.root):
        totals[n[0]] += n[1]
    assert totals == want


def around(i, body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style></head><body class="has-sidebar">
    <header><a href="/">Site</a> of {i}</header><nav><ul><li><a>One</a><li><a>Two {i}</a></ul></nav>
    <div class="cookie-notice">We set cookies {i}</div><div id=top><p>Welcome to all of our readers</p></div>{body}
    <form><label>Name {i}</label><input name="a>b"></form><aside>Side {i}</aside><div class='ad'>Buy {i}</div>
    <section id="comments"><article class="comment"><p>Nice {i}</p></article></section>{extra}<footer>&copy; {i}</footer></body></html>"""


PAGES = {
    "article": (around("{i}", '<article><header><h1>Head {i}</h1></header><p>First &amp; <b>bold</b>\n  text&nbsp;{i}<br>more<p>Second {i}<div class="share">Tweet {i}</div><script>var a="</p>";</script></article>'), "Head {i}\nFirst & bold text {i} more\nSecond {i}"),
    "divs": (around("{i}", '<div class="x{i}"><h2>Title {i}</h2><p>Para {i}</p><p>Other {i}</p><ul><li>a {i}<li>b {i}</ul></div><div class=tail><a href="/x">See {i}</a> <a href="/y">also {i}</a></div>'), "Title {i}\nPara {i}\nOther {i}\na {i}\nb {i}"),
    "main": (around("{i}", "<main><p>Only {i}</p><p>Read us daily on the web</p><table><tr><td>c {i}<td>d {i}</table></main>"), "Only {i}\nc {i}\nd {i}"),
}


@pytest.fixture(scope="module")
def site():
    rows, want = [], {}
    for k, (name, (source, text)) in enumerate(PAGES.items()):
        for i in range(12):
            n = 100 * k + i
            rows.append((n, f"http://WWW.{name}.org/{i}?q", source.replace("{i}", "abcdefghijkl"[i])))
            want[n] = text.replace("{i}", "abcdefghijkl"[i])
    odd = [
        (900, "http://odd.org/1", None, ""), (901, "http://odd.org/2", "", ""), (902, None, "plain <i>te</i>xt &lt;b&gt;", "plain text <b>"), (903, "no host", "<p>a<p>b<div>c", "a\nb\nc"),
        (904, "http://odd.org/3", "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), (905, "http://odd.org/4", "<article>" + "<p>w</p>" * 20_000 + "</article>", "\n".join(["w"] * 20_000)),
        (906, "http://odd.org/5", "<p>open <button>gone</p><p>next <a href='x", "open\nnext <a href='x"), (907, "http://odd.org/6", "<script>never closed <p>x", ""), (908, "http://odd.org/7", "<p hidden>x</p><p style='display: none'>y</p><span class=ad>z</span> w", "w"),
        (None, "http://odd.org/8", "<p>no id</p>", "no id"),
    ]
    rows += [o[:3] for o in odd] + [rows[3]]
    want |= {o[0]: o[3] for o in odd}
    return rows, want


@pytest.mark.parametrize("fold", [4096, 2])
def test_main_texts(spark, site, monkeypatch, fold):
    monkeypatch.setattr(H.wrappers, "__defaults__", (fold, 4096))
    rows, want = site
    frame = spark.createDataFrame([(*x, "h", "t", 3) for x in rows], "page_id long, url string, html string, host string, text string, tree int")
    got = H.main_texts(frame).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.text == want[g.page_id], g.page_id
        assert g.n_chars == len(g.text)
    assert sorted(str((g.page_id, g.url)) for g in got) == sorted(str(x[:2]) for x in rows)


def test_main_texts_by_join(spark, site, monkeypatch):
    monkeypatch.setattr(H, "HELD_BYTES", 0)
    rows, want = site
    got = H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {g.page_id: g.text for g in got} == want and len(got) == len(rows)


def test_copies_of_an_article_stay(spark):
    """Half of a host's pages hold one article: its slots vary still."""
    rows = [(i, "http://h.org/x", around(i, f"<article><p>{'same' if i % 2 else i}</p></article>")) for i in range(20)]
    rows += [(i, "http://g.org/x", around(i, "<article><p>all the same</p></article>")) for i in range(20, 40)]
    got = {g.page_id: g.text for g in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "same" if i % 2 else str(i) for i in range(20)} | {i: "all the same" for i in range(20, 40)}


def test_no_pages(spark):
    assert H.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_blocks_of_inline_elements():
    assert [t for _, t, _ in Page("a <b>b</b>c<hr>d<table><tr><td>e</td><th>f</table><svg><text>g</text></svg>h").blocks] == ["a bc", "d", "e", "f", "h"]


# ---------------------------------------------------------------- search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k, once=True):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    by_item = defaultdict(Counter)
    for i, t in items:
        by_item[i].update(terms(t))
    out = []
    for item, wanted in by_item.items():
        scores = []
        for i, c, n in counted:
            s = 0
            for t, m in wanted.items():
                if c[t]:
                    s += (1 if once else m) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("k, held, cells, once", [(10, 1 << 22, 1 << 21, True), (3, 5, 7, True), (500, 1 << 22, 100, False)])
def test_search_equals_brute_force(spark, corpus, monkeypatch, k, held, cells, once):
    monkeypatch.setattr(L, "HELD_TERMS", held)
    monkeypatch.setattr(L, "CELLS", cells)
    frame, rows = corpus
    docs = rows + [(None, rows[0][1]), (None, rows[20][1])]
    items = [(1, rows[0][1]), (2, "Two WORDS, two; ñandú"), (2, "one"), (3, None), (4, ""), (5, "zzzz"), (None, "one two"), (6, rows[14][1]), (7, " ".join(t or "" for _, t in rows[:3]))]
    more = frame.unionByName(spark.createDataFrame([(None, rows[0][1], "t", 1, "k", 0.5, 7), (None, rows[20][1], "t", 1, "k", 0.5, 7)], frame.schema)).withColumnRenamed("key", "task").withColumnRenamed("t", "item")
    bench = spark.createDataFrame([(*x, 3, 1) for x in items], "item_id long, text string, doc_id int, rank int")
    got = [tuple(g) for g in L.ranked_documents(more.repartition(3), bench, k, once).collect()]
    assert Counter(got) == Counter(ranking(docs, items, k, once))


def test_product_equals_dense():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 3, (7, 11)), r.integers(0, 4, (11, 9))
    item, term = np.nonzero(a)
    t, doc = np.nonzero(b)
    blocks = dict(L.product(np.searchsorted(item, np.arange(8)), term, a[item, term], np.searchsorted(t, np.arange(12)), doc, b[t, doc], 9))
    assert (np.concatenate([blocks[k] for k in sorted(blocks)]) == a @ b).all()


def test_search_of_nothing(spark, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.ranked_documents(no_docs, items).count() == 0
    assert L.ranked_documents(no_docs, items.limit(0)).count() == 0


# ---------------------------------------------------------------- collocations


def phrases(rows, least, most, share=80):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if a >= least and " " in p}
        ranked = []
        for p, a in candidates.items():
            w = p.split(" ")
            score, k = min((math.floor(Fraction(2_000_000 * a, c[" ".join(w[:k])] + c[" ".join(w[k:])])), k) for k in range(1, len(w)))
            if any(f" {p} " in f" {q} " and 100 * b >= share * a for q, b in candidates.items() if len(q.split(" ")) > len(w)):
                continue
            ranked.append((-score, -a, p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:most])]
    return out


@pytest.fixture(scope="module")
def chatter():
    r = random.Random(5)
    words = ["alpha", "Beta", "gämma", "d e", "x'y", "日本", "a-b", "q"]
    rows = []
    for i in range(400):
        lang = [None, "en", "de", ""][i % 4]
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", "\n", ", ", "\x0b"]) for _ in range(r.randrange(0, 60)))
        rows.append((lang, text))
    rows += [("en", None), (None, ""), ("en", " .,\n\t"), ("de", "hot potato " * 5000), ("en", "New York City. " * 50), ("en", "new york")] + [("en", "Copy of this line, again")] * 60
    return rows


@pytest.mark.parametrize("least, most, bits, gathered", [(30, 2000, 1 << 29, 1 << 22), (3, 7, 128, 50)])
def test_collocations_equal_brute_force(spark, chatter, monkeypatch, least, most, bits, gathered):
    """A filter that is far too small and blocks of few n-grams change nothing."""
    monkeypatch.setattr(C, "FILTER_BITS", bits)
    monkeypatch.setattr(C, "GATHERED", gathered)
    frame = spark.createDataFrame([(*x, "p", 1, 2) for x in chatter], "lang string, text string, piece string, times int, a int").repartition(3)
    got = [tuple(g) for g in C.collocations(frame, least=least, most=most).collect()]
    assert sorted(got) == sorted(phrases(chatter, least, most))


def test_no_texts(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(none).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None)], none.schema)).count() == 0


def test_filter_passes_all_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    bits = C.filter_of(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert C.passes(bits, keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 2**63, 20_000).astype(np.uint64)
    assert C.passes(bits, other).mean() < 0.05
