"""Block trees of HTML pages, and the simple tree matching that aligns them."""

from __future__ import annotations

import html
import json
import re

# Element names of HTML, and the roles and class words that pages give to what isn't their main text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
OUT = frozenset("aside dialog footer form head menu nav search".split())
INLINE_OUT = frozenset("button canvas datalist object option select svg".split())
REPEATED = frozenset("blockquote dd dt figure h1 h2 h3 h4 h5 h6 li p pre td th tr".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form navigation search".split())
OUT_WORDS = frozenset(
    "ad ads adsbygoogle adsense advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related reply respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
MAIN_WORDS = frozenset("articlebody entrycontent maincontent postbody postcontent storybody".split())
#: What a start tag ends: an open element of these names, up to the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
HOLDS_P = frozenset("td th caption table object".split())

#: Deeper elements count as children of the one at this depth; siblings of one name after so many runs share a place.
DEPTH, RUNS = 100, 8
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|<[!?/][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PLAIN, _MAIN, _BODY, _ARTICLE, _HEADER, _GONE = 0, 1, 2, 3, 4, 5


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _label_and_kind(tag: str, attributes: str) -> tuple[str, int]:
    """An element's name with its first class (no digits), and what it is to the main text."""
    kind = _GONE if tag in OUT else _ARTICLE if tag == "article" else _MAIN if tag == "main" else _HEADER if tag == "header" else _PLAIN
    if not (found := _attributes(attributes)):
        return tag, kind
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower())
    first = re.sub(r"[^a-z-]+", "", (found.get("class") or found.get("id") or "").split(" ")[0].lower())
    role = found.get("role", "").lower()
    if tag not in ("html", "body"):
        shown = found.get("aria-hidden", "").lower() != "true" and "hidden" not in found and not re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
        if not shown or (role in OUT_ROLES and tag != "header"):
            kind = _GONE
        elif role == "main" or (kind == _PLAIN and "main" in words and "content" in words):
            kind = _MAIN
        elif kind not in (_MAIN, _ARTICLE) and OUT_WORDS & set(words):
            kind = _GONE
        elif kind == _ARTICLE and {"comment", "comments", "teaser", "related"} & set(words):
            kind = _GONE
        elif kind == _PLAIN and MAIN_WORDS & {a + b for a, b in zip(words, words[1:])}:
            kind = _BODY
    return f"{tag}.{first}" if first else tag, kind


class Page:
    """The block elements of a page in page order, and its blocks of text.

    label, parent, kind: of each element. blocks: (element, text, characters within links), white space joined, never empty.
    """

    def __init__(self, source: str) -> None:
        self.label, self.parent, self.kind = ["#page"], [-1], [_PLAIN]
        self.blocks: list[tuple[int, str, int]] = []
        tags, stack, gone, links = ["#page"], [0], [], 0
        marks = [0]
        runs: list[tuple[str, bool]] = []
        raw_end, at, size = None, 0, len(source)

        def flush() -> None:
            if runs:
                text = " ".join("".join(t for t, _ in runs).split())
                if text:
                    linked = len("".join("".join(t for t, inside in runs if inside).split()))
                    self.blocks.append((stack[-1], text, linked))
                runs.clear()

        def close(depth: int) -> None:
            flush()
            del gone[marks[depth] :], stack[depth:], tags[depth:], marks[depth:]

        while at < size:
            m = _TOKEN.search(source, at)
            end = m.start() if m else size
            if end > at and not gone:
                text = source[at:end]
                runs.append((html.unescape(text) if "&" in text else text, links > 0))
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, ending, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if tag in BLOCKS:
                if ending:
                    if tag in tags:
                        close(len(tags) - 1 - tags[::-1].index(tag))
                    else:
                        flush()
                    links = 0 if tag not in ("li", "p") else links
                    continue
                flush()
                if tag == "hr":
                    continue
                if "p" in tags:
                    k = len(tags) - 1 - tags[::-1].index("p")
                    if not HOLDS_P & set(tags[k:]):
                        close(k)
                if tag in ENDS:
                    names, fence = ENDS[tag]
                    for k in range(len(tags) - 1, 0, -1):
                        if tags[k] in fence:
                            break
                        if tags[k] in names:
                            close(k)
                            break
                label, kind = _label_and_kind(tag, attributes)
                above = min(len(stack), DEPTH) - 1
                self.parent.append(stack[above])
                self.label.append(label)
                self.kind.append(kind)
                stack.append(len(self.label) - 1)
                tags.append(tag)
                marks.append(len(gone))
            elif tag in RAW:
                if not ending and not attributes.endswith("/"):
                    raw_end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                    at = raw_end.start() if raw_end else size
            elif tag == "br":
                runs.append((" ", False))
            elif tag in INLINE_OUT:
                if ending and tag in gone[marks[-1] :]:
                    while gone.pop() != tag:
                        pass
                elif not ending and not attributes.endswith("/"):
                    gone.append(tag)
            elif tag == "a":
                links = 0 if ending else 1
            elif tag not in VOID and attributes and not ending and _label_and_kind(tag, attributes)[1] == _GONE:
                gone.append(tag)
            elif ending and tag in gone[marks[-1] :]:
                while gone.pop() != tag:
                    pass
        flush()

    def skeleton(self) -> tuple[list, list[int]]:
        """The page's tree as nested [label, children], and the node of each element, in the tree's own order.

        Siblings of one label that follow one another, if such repeat by nature (paragraphs, items, rows), are one node.
        """
        tree, of = ["#page", [], {}, {}], [[]] * len(self.label)
        of[0] = tree
        for i in range(1, len(self.label)):
            up, label = of[self.parent[i]], self.label[i]
            runs, places = up[3], up[2]
            if not (runs.get("#last") == (label, self.parent[i]) and label.split(".")[0] in REPEATED):
                owner = ("#of", label)
                if runs.get(owner) != self.parent[i]:
                    runs[owner] = self.parent[i]
                    runs[label] = -1
                runs[label] = min(runs[label] + 1, RUNS)
            runs["#last"] = (label, self.parent[i])
            key = (label, runs[label])
            if key not in places:
                places[key] = [label, [], {}, {}]
                up[1].append(places[key])
            of[i] = places[key]
        numbers: dict[int, int] = {}

        def plain(node: list) -> list:
            numbers[id(node)] = len(numbers)
            return [node[0], [plain(c) for c in node[1]]]

        out = plain(tree)
        return out, [numbers[id(node)] for node in of]

    def standing(self) -> list[int]:
        """Of each element: 5 if it is out of the main text, else the strongest main element that it is in (article, body, main), or 0."""
        out = [0] * len(self.label)
        for i in range(1, len(self.label)):
            above, kind = out[self.parent[i]], self.kind[i]
            if kind == _HEADER:
                kind = above if above in (_MAIN, _BODY, _ARTICLE) else _GONE
            out[i] = max(above, kind)
        return out


def dumped(tree: list) -> str:
    return json.dumps(tree, separators=(",", ":"))


class Wrapper:
    """A template tree: nodes [label, pages, children] of all pages of a host, aligned."""

    def __init__(self, tree: list | None = None, most: int = 4096) -> None:
        self.root, self.most = tree or ["#page", 0, []], most
        self.size = _size(self.root)

    @staticmethod
    def counted(tree: list, pages: int) -> list:
        return [tree[0], pages, [Wrapper.counted(c, pages) for c in tree[1]]]

    def merge(self, other: list) -> None:
        """Aligns another tree of counted nodes with this one and adds it: what matches is counted, what doesn't is put in its place."""
        self._merge(self.root, other, {})
        if self.size > self.most:
            self._prune()

    def _merge(self, mine: list, other: list, known: dict) -> None:
        mine[1] += other[1]
        at = 0
        merged: list = []
        for i, j in pairs(mine[2], other[2], known):
            if i is not None:
                merged.append(mine[2][i])
                if j is not None:
                    self._merge(mine[2][i], other[2][j], known)
            else:
                merged.append(other[2][j])
                self.size += _size(other[2][j])
            at += 1
        mine[2] = merged

    def _prune(self) -> None:
        """Leaves out the nodes of the fewest pages until three quarters of `most` remain."""
        counts = sorted((c[1] for c in _nodes(self.root)), reverse=True)
        least = counts[min(len(counts) - 1, self.most * 3 // 4)]

        def rare(node: list) -> None:
            node[2] = [c for c in node[2] if c[1] > least]
            for c in node[2]:
                rare(c)

        rare(self.root)
        self.size = _size(self.root)

    def slots(self, tree: list) -> list[int]:
        """The node of this wrapper that each node of a page's tree is aligned with, or -1; both numbered in their own order."""
        number = {id(n): k for k, n in enumerate(_nodes(self.root))}
        out, order, known = [], {}, {}

        def counted(node: list) -> list:
            return [node[0], 1, [counted(c) for c in node[1]]]

        page = counted(tree)
        for node in _nodes(page):
            order[id(node)] = len(out)
            out.append(-1)

        def walk(mine: list, other: list) -> None:
            out[order[id(other)]] = number[id(mine)]
            for i, j in pairs(mine[2], other[2], known):
                if i is not None and j is not None:
                    walk(mine[2][i], other[2][j])

        walk(self.root, page)
        return out


def _nodes(node: list):
    yield node
    for c in node[2]:
        yield from _nodes(c)


def _size(node: list) -> int:
    return 1 + sum(_size(c) for c in node[2])


def matched(a: list, b: list, known: dict) -> int:
    """Simple tree matching: the most pairs of nodes of two ordered trees that keep labels, parents and the order of siblings."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key not in known:
        known[key] = 1 + _table(a[2], b[2], known)[-1][-1]
    return known[key]


def _table(mine: list, other: list, known: dict) -> list[list[int]]:
    rows = [[0] * (len(other) + 1)]
    for a in mine:
        above, row = rows[-1], [0]
        for j, b in enumerate(other):
            best = max(above[j + 1], row[j])
            if a[0] == b[0] and (with_both := above[j] + matched(a, b, known)) > best:
                best = with_both
            row.append(best)
        rows.append(row)
    return rows


def pairs(mine: list, other: list, known: dict) -> list[tuple[int | None, int | None]]:
    """The alignment of two lists of siblings, in order: (i, j) matched, (i, None) and (None, j) not."""
    if len(mine) == len(other) and all(a[0] == b[0] and not a[2] and not b[2] for a, b in zip(mine, other)):
        return [(i, i) for i in range(len(mine))]
    rows = _table(mine, other, known)
    i, j, out = len(mine), len(other), []
    while i or j:
        if i and j and mine[i - 1][0] == other[j - 1][0] and rows[i][j] == rows[i - 1][j - 1] + matched(mine[i - 1], other[j - 1], known):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif j and rows[i][j] == rows[i][j - 1]:
            j -= 1
            out.append((None, j))
        else:
            i -= 1
            out.append((i, None))
    return out[::-1]
