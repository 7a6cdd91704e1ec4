"""Main text of web pages after removing what a site repeats.

A forgiving parser reads a page into blocks of text and containers (elements
that hold blocks: divisions, lists, navigation, forms and so on). Every
container subtree is hashed. Spark counts per host on how many different pages
each subtree occurs; one that recurs on many pages of its host is template and
is deleted, with everything below it. What is boilerplate on any page (scripts,
navigation, forms, adverts, comments by their marks) goes without counting.

A page whose article or main element is known keeps the text inside it; text
blocks themselves are never deleted for recurring, as passages repeat across
articles. Copies of one article count as one page, so that a copied page does
not delete itself.

The parse is written once to the scratch folder. Counts are two partial
aggregations, so a host with a third of all pages does not meet one task.

Defined results: a null html is an empty page and has no text; broken or cut
mark-up is read as far as it goes; a page without an article is read whole; a
null URL is a host of its own; repeated rows get equal results and count once;
an empty table gives no rows. Columns other than `page_id`, `url` and `html` are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept, mapped
from plumbline.llm.urls import host_of
from plumbline.session import ship

ship(__name__)

#: Different pages of one host on which a subtree must occur, and their least share.
LEAST_PAGES = 5
LEAST_SHARE = 0.1

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z))""", re.S)
_MARKED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z0-9]+(?:[-_][a-z0-9]+)*")
#: Elements whose content is no mark-up.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a text block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Block elements that hold text rather than other blocks.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote address caption figcaption summary legend option".split())
ROOTS = frozenset("article main".split())
#: Elements that are never part of the main text.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe svg canvas object dialog menu noembed noframes".split())
#: Parts of class, id and role names that mark boilerplate.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription popup modal overlay comment comments disqus respond replies nav navbar navigation menu breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended widget login signup search pagination pager complementary contentinfo skip".split())
#: Name parts of elements that hold the article, whatever else they say.
GOOD = frozenset("article main content post entry story body".split())


def noisy(attributes: str) -> bool:
    for found in _MARKED.finditer(attributes):
        value = (found[1] or found[2] or found[3] or "").lower()
        for name in _NAME.findall(value):
            parts = re.split("[-_]", name)
            if NOISE.intersection(parts) and not GOOD.intersection(parts):
                return True
            if name in ("header", "site-header", "page-header", "top-bar", "topbar"):
                return True
    return False


class Page:
    """The blocks of a page: `text`, the numbers of the `containers` around it,
    and whether it stands `inside` an article; per container its hash."""

    def __init__(self, html: str):
        import xxhash

        self.blocks: list[tuple[str, tuple[int, ...], bool]] = []
        self.hashes: list[int] = []
        self._digest = xxhash.xxh3_64
        self._run: list[str] = []
        # open elements: name, dropped, in a root, container number or -1
        self._open: list[tuple[str, bool, bool, int]] = [("", False, False, -1)]
        self._content: list = []
        at, raw = 0, None
        for found in _TAG.finditer(html):
            if found.start() < at:
                continue
            self._text(html[at:found.start()])
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                self._end(name)
                continue
            self._start(name, found[3] or "")
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = close.start() if close else len(html)
                raw = None
        self._text(html[at:])
        while len(self._open) > 1:
            self._pop()
        self._flush()
        self.hashes = [h.intdigest() - (1 << 64) if h.intdigest() >> 63 else h.intdigest() for h in self._content]
        self.main = any(inside for _, _, inside in self.blocks)
        whole = self._digest()
        for text, _, inside in self.blocks:
            if inside or not self.main:
                whole.update(text.encode("utf-8", "replace") + b"\0")
        self.digest = whole.intdigest() - (1 << 64) if whole.intdigest() >> 63 else whole.intdigest()

    def _text(self, text: str) -> None:
        if text and not self._open[-1][1]:
            self._run.append(text)
        elif text:
            self._mark(text)

    def _mark(self, token: str) -> None:
        for _, _, _, number in self._open:
            if number >= 0:
                self._content[number].update(token.encode("utf-8", "replace"))

    def _flush(self) -> None:
        if self._run:
            text = " ".join(unescape("".join(self._run)).split())
            self._run = []
            if text:
                self._mark(text)
                containers = tuple(e[3] for e in self._open if e[3] >= 0)
                self.blocks.append((text, containers, self._open[-1][2]))

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "hr":
                self._flush()
            elif not self._open[-1][1]:
                self._run.append(" " if name == "br" else "")
            return
        if name in BLOCKS:
            self._flush()
            if name in TEXTS or name not in ("html", "body", "head"):
                self._close_text(name)
        _, dropped, root, _ = self._open[-1]
        dropped = dropped or name in DROPPED or (name == "header" and not root) or noisy(attributes)
        root = root or (name in ROOTS and not dropped)
        number = -1
        if name in BLOCKS and name not in TEXTS and name not in ROOTS and name not in ("html", "body", "head"):
            number = len(self._content)
            self._content.append(self._digest())
        self._open.append((name, dropped, root, number))
        self._mark(f"<{name}>")

    def _close_text(self, name: str) -> None:
        """A block ends an open paragraph; an item ends an open item."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}.get(name, ()) + ("p",)
        for i in range(len(self._open) - 1, 0, -1):
            open_name = self._open[i][0]
            if open_name in ends:
                while len(self._open) > i:
                    self._pop()
                return
            if open_name in BLOCKS and open_name not in TEXTS:
                return

    def _end(self, name: str) -> None:
        if name in BLOCKS or name == "br":
            self._flush()
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == name:
                while len(self._open) > i:
                    self._pop()
                return
            if self._open[i][0] in BLOCKS and name not in BLOCKS:
                return

    def _pop(self) -> None:
        if self._open[-1][0] in BLOCKS or self._open[-1][1]:
            self._flush()
        self._open.pop()
        self._mark("</>")


def parsed(pages: DataFrame) -> DataFrame:
    """The parse of every page, written once: texts of its blocks, the hashes of
    the containers around each, and all candidate hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, texts, around, subtrees = [], [], [], []
            for html in batch.column(4).to_pylist():
                page = Page(html or "")
                kept = [(t, [page.hashes[c] for c in cs]) for t, cs, inside in page.blocks if inside or not page.main]
                digests.append(page.digest)
                texts.append([t for t, _ in kept])
                around.append([cs for _, cs in kept])
                subtrees.append(sorted({h for _, cs in kept for h in cs}.union(page.hashes)))
            columns = [*batch.columns[:4], pa.array(digests, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(around, pa.list_(pa.list_(pa.int64()))), pa.array(subtrees, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "page_id", "url", "host", "digest", "texts", "around", "subtrees"])

    wanted = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    return kept(mapped(wanted, run, "row long, page_id long, url string, host string, digest long, texts array<string>, around array<array<long>>, subtrees array<long>"), "parsed")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, subtree) of the subtrees that recur on many pages of their host.
    `pages` as made by `parsed`."""
    size = pages.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    seen = pages.select("host", "digest", F.explode("subtrees").alias("subtree")).distinct()
    counts = seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    return counts.join(size, "host").filter(F.col("n") >= F.col("host_pages") * least_share).select("host", "subtree")


def main_texts(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per page its main text, blocks joined by an empty line."""
    parts = parsed(pages)
    repeated = templates(parts, least_pages, least_share)
    inside = F.array_distinct(F.flatten("around"))
    inner = parts.select("row", "host", F.explode(inside).alias("subtree"))
    deleted = inner.join(repeated, ["host", "subtree"]).groupBy("row").agg(F.collect_list("subtree").alias("deleted"))
    blocks = F.filter(F.arrays_zip("texts", "around"), lambda b: ~F.arrays_overlap(b["around"], F.coalesce(F.col("deleted"), F.array().cast("array<long>"))))
    plain = parts.filter(F.size(inside) == 0).select("page_id", "url", F.array_join("texts", "\n\n").alias("text"))     # nothing to look up
    others = (parts.filter(F.size(inside) > 0).select("row", "page_id", "url", "texts", "around").join(deleted, "row", "left")
              .select("page_id", "url", F.array_join(F.transform(blocks, lambda b: b["texts"]), "\n\n").alias("text")))
    return plain.union(others).withColumn("n_chars", F.length("text").cast("long"))
