"""Main text of HTML pages by wrapper induction.

Pages become trees of block elements. The trees of a host are aligned by simple tree matching and folded into one wrapper, whose
nodes are the host's slots. A text that nearly all pages of a host have in a slot is template; other slots vary and are
content, but for those whose elements say that they are something else (menus, footers, adverts, forms, comments)
and, outside of an article, those whose text is mostly links.

1. (host, tree) with its number of pages, an aggregate; different trees are folded FOLD at a time into wrappers, by as many
   rounds as a host needs, so no task meets all trees of a host.
2. Every page is aligned with its host's wrapper; (host, slot, text) are counted.
3. Every page is read once more with the wrapper and the template texts of its host.

Pages stay where they are read while wrappers are small (HELD_BYTES); else pages and wrappers are joined on the host.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from turnwise.llm._spark import kept
from turnwise.llm.html_tree import _ARTICLE, _BODY, _GONE, _MAIN, Page, Wrapper, dumped

#: Trees that a task folds into one wrapper; nodes of a wrapper, the most frequent ones (others count as varying).
FOLD, NODES = 4096, 4096
#: Bytes of wrappers and template texts of all hosts that are broadcast.
HELD_BYTES = 48 << 20
#: A text is template where so many pages of a host have the slot and this share of them the text.
LEAST_PAGES, SHARE = 5, 0.9
#: Slots outside of articles with this share of characters within links are menus.
LINKED = 0.5
#: Alignments that a task remembers.
REMEMBERED = 20_000


def host_of(url: Column) -> Column:
    """The host of a url, A-Z lowered; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _page_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [dumped(Page(h or "").skeleton()[0]) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string())], ["host", "tree"])


def _fold(most: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper, pages = None, None, 0
        for batch in batches:
            for host, part, tree, n, whole in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "tree", "pages", "counted"))):
                if (host, part) != key:
                    if key is not None:
                        yield _row(key[0], wrapper, pages)
                    key, wrapper, pages = (host, part), Wrapper(most=most), 0
                tree = json.loads(tree)
                wrapper.merge(tree if whole else Wrapper.counted(tree, n))
                pages += n
        if key is not None:
            yield _row(key[0], wrapper, pages)

    def _row(host: str, wrapper: Wrapper, pages: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([dumped(wrapper.root)]), pa.array([pages], pa.int64()), pa.array([True])], ["host", "tree", "pages", "counted"])

    return fold


def wrappers(pages: DataFrame, fold: int = FOLD, most: int = NODES) -> DataFrame:
    """(host, tree): the wrapper of every host, of pages (host, html)."""
    trees = kept(pages.select("host", "html").mapInArrow(_page_trees, "host string, tree string").groupBy("host", "tree").agg(F.count(F.lit(1)).alias("pages")).withColumn("counted", F.lit(False)))
    while True:
        sizes = trees.groupBy("host").agg(F.count(F.lit(1)).alias("parts"))
        parts = trees.join(sizes, "host").withColumn("part", F.pmod(F.hash("tree"), F.ceil(F.col("parts") / fold).cast("int")))
        sorted_parts = parts.drop("parts").repartition("host", "part").sortWithinPartitions("host", "part", F.col("pages").desc(), "tree")
        trees = kept(sorted_parts.mapInArrow(_fold(most), "host string, tree string, pages bigint, counted boolean"))
        if trees.groupBy("host").count().where("count > 1").isEmpty():
            return trees.select("host", "tree", "pages")


class _Aligned:
    """Pages read with the wrapper of their host; alignments of equal trees are remembered."""

    def __init__(self) -> None:
        self.wrappers: dict[str, Wrapper] = {}
        self.slots: dict[tuple[str, str], list[int]] = {}

    def read(self, source: str | None, host: str, tree: str | None) -> tuple[Page, list[int]]:
        """A page, and the slot of each of its elements (-1 where none is aligned)."""
        page = Page(source or "")
        skeleton, node = page.skeleton()
        if tree is None:
            return page, [-1] * len(node)
        key = (host, dumped(skeleton))
        if key not in self.slots:
            if len(self.slots) >= REMEMBERED:
                self.slots.clear()
            if host not in self.wrappers:
                if len(self.wrappers) >= 256:
                    self.wrappers.clear()
                self.wrappers[host] = Wrapper(json.loads(tree))
            self.slots[key] = self.wrappers[host].slots(skeleton)
        slots = self.slots[key]
        return page, [slots[n] for n in node]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _slot_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligned = _Aligned()
    for batch in batches:
        hosts, slots, texts, sizes, links = [], [], [], [], []
        for host, source, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "tree"))):
            page, slot_of = aligned.read(source, host, tree)
            seen: dict[tuple[int, int | None], list[int]] = {}
            for element, text, linked in page.blocks:
                slot = slot_of[element]
                if slot >= 0:
                    seen.setdefault((slot, _hash(text)), [0, 0])
                    whole = seen.setdefault((slot, None), [0, 0])
                    whole[0] += len(text)
                    whole[1] += linked
            for (slot, text), (size, linked) in seen.items():
                hosts.append(host)
                slots.append(slot)
                texts.append(text)
                sizes.append(size)
                links.append(linked)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, pa.int32()), pa.array(texts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(links, pa.int64())], ["host", "slot", "text", "size", "linked"])


def templates(pages: DataFrame, trees: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, tree, constant, menu): wrappers with their template texts and the slots that are mostly links; pages: host, html, tree."""
    found = pages.mapInArrow(_slot_texts, "host string, slot int, text bigint, size bigint, linked bigint")
    counts = kept(found.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked")).where(F.col("text").isNull() | (F.col("n") >= least_pages)))
    slots = counts.where("text is null").select("host", "slot", F.col("n").alias("pages"), "size", "linked")
    texts = counts.where("text is not null").select("host", "slot", "text", "n").join(slots.where(F.col("pages") >= least_pages), ["host", "slot"]).where(F.col("n") >= share * F.col("pages"))
    constant = texts.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "text"))).alias("constant"))
    menu = slots.where(F.col("linked") > LINKED * F.col("size")).groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("menu"))
    return trees.select("host", "tree").join(constant, "host", "left").join(menu, "host", "left")


def main_blocks(page: Page, slots: list[int], constant: set, menu: set) -> list[str]:
    """The blocks of a page's main text: what varies, within its articles if it has any; if all is template, those articles as they are."""
    standing = page.standing()
    blocks = [(standing[e], slots[e], text) for e, text, _ in page.blocks if standing[e] != _GONE]
    for level in (_ARTICLE, _BODY, _MAIN):
        inner = [b for b in blocks if b[0] >= level]
        if inner:
            varying = [text for _, slot, text in inner if (slot, _hash(text)) not in constant]
            return varying or [text for _, _, text in inner]
    return [text for _, slot, text in blocks if slot not in menu and (slot, _hash(text)) not in constant]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligned, known = _Aligned(), {}
    for batch in batches:
        texts = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("host", "html", "tree")))
        for i, (host, source, tree) in enumerate(rows):
            page, slots = aligned.read(source, host, tree)
            if host not in known:
                if len(known) >= 256:
                    known.clear()
                known[host] = ({(c["slot"], c["text"]) for c in batch.column("constant")[i].as_py() or ()}, set(batch.column("menu")[i].as_py() or ()))
            texts.append("\n".join(main_blocks(page, slots, *known[host])))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _with(pages: DataFrame, table: DataFrame, size: Column) -> DataFrame:
    """pages joined on the host with a kept table; broadcast if its bytes are within HELD_BYTES."""
    small = (table.agg(F.sum(size)).first()[0] or 0) <= HELD_BYTES
    return pages.join(F.broadcast(table) if small else table, "host", "left")


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, its blocks joined by newlines.

    Character references are decoded, white space in a block (line breaks of <br> too) is one space. Null and empty pages have
    an empty text. Pages with a null url or one without a host count as of one host, ''. A host of fewer than LEAST_PAGES pages has
    no template texts; what its elements say still holds. Repeated rows are pages each; null ids stay. Long pages are read whole;
    elements deeper than 100 count as children of the hundredth. Empty tables give no rows. Further columns are ignored.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(F.col(url)).alias("host"))
    trees = wrappers(rows)
    models = kept(templates(_with(rows.select("host", "html"), trees.select("host", "tree"), F.length("host") + F.length("tree")), trees))
    size = F.length("host") + F.length("tree") + 16 * F.coalesce(F.size("constant"), F.lit(0)) + 8 * F.coalesce(F.size("menu"), F.lit(0))
    kind = pages.schema[id].dataType.simpleString()
    return _with(rows, models, size).select("id", "url", "html", "host", "tree", "constant", "menu").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars bigint")
