"""HTML extraction by equivalence-class template deduction.

Tokens are elements with their place: the path of element names (with class and
id) from the root; and the blocks of text in the content, headings apart, with
their place.  Over all pages of a host, each token has an occurrence
vector: how often each page holds it.  Tokens with equal vectors form an
equivalence class; classes that enough pages share are valid and nest by path
into the host's template.  Vectors are compared by an additive hash -- the sum of
page hash times count -- so they are aggregated like any sum and no host's pages
ever meet in one task.

What fills the template are slots.  The content slots of a page are its article
and main elements together, if they hold half of the text outside links or more;
else the deepest container beside which no other holds text, so nothing that is
read is left out but lists of links.  Slots that most of a host's pages agree on
are the host's, and add to those of each page without article.  Text is taken
block by block, without the texts that stand word for word on every page of the
slot; where these are over half of a page's text, nothing shows what varies and
all of it is kept.

Boilerplate names skip an element by whole class tokens and whole ids alone, and
not if it holds the main element, the only articles or most of the text.

Defined cases: null or empty html gives an empty text; a null url is a host of its
own; repeated rows are pages of their own; a page with no text outside
boilerplate elements gives an empty text, but one whose boilerplate names cover
most of its text is read; cut-off markup ends where the page ends; extra
columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of a host's pages that a class must occur in, and the least number.
SUPPORT, LEAST_PAGES = 0.5, 2
#: Tokens in a valid class, at least.
LEAST_CLASS = 2
#: Pages that a template text must occur on, at least.
LEAST_TEXT = 3
#: About 200 bytes a row: a broadcast of at most some 20 MB.
BROADCAST_HOSTS = 100_000

# Elements by role.
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
SKIPPED = RAW | frozenset("head nav footer aside button select dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: A class token, or a container's whole id, is boilerplate if its parts are among these words and the
#: qualifiers and one at least is a word; a part of a longer name says nothing.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement adsense banner promo promotion sponsor sponsored sidebar side widget menu navbar navigation nav breadcrumb breadcrumbs footer masthead topbar comments commentlist respond reply replies disqus cookie cookies consent gdpr popup modal overlay newsletter subscribe signup share sharing social related recommended toolbar pagination pager".split()
)
QUALIFIERS = frozenset("alert area bar block box buttons comment container link links list notice notices posts skip wrapper".split())
CONTAINERS = frozenset("body center div dl html main article aside ol section table tbody td tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
_OWN_HEADER = frozenset(("article", "main"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*(?:>|\Z)", re.I) for name in RAW}


class _Node:
    __slots__ = ("all", "articles", "hard", "key", "kids", "linked", "link", "mains", "name", "own", "parent", "skip", "soft", "text")

    def __init__(self, name: str, key: int, parent: _Node | None):
        self.name, self.key, self.parent = name, key, parent
        self.hard = self.soft = self.skip = False
        self.link = name == "a" or (parent is not None and parent.link)
        self.kids: list[_Node] = []
        self.own = self.all = self.text = self.linked = self.mains = self.articles = 0


def _child_key(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, parent & 0xFFFFFFFFFFFFFFFF)


def _boilerplate(token: str) -> bool:
    parts = [x for part in re.split("[-_]", token.lower()) if (x := part.strip("0123456789"))]
    return any(x in BOILERPLATE for x in parts) and all(x in BOILERPLATE or x in QUALIFIERS for x in parts)


_BREAK = _Node("div", 0, None)  # ends a block, as the end tag of one does wherever it stands


class Page:
    """The elements of a page, from one pass over it, and its text by blocks."""

    def __init__(self, source: str):
        self._root = _Node("", 1, None)
        self._stack = [self._root]
        self.nodes = [self._root]
        self._events: list[tuple[_Node, str | bool]] = []  # True opens, False closes, else text
        self._parse(source)
        self._judge()

    def _text(self, raw: str) -> None:
        top = self._stack[-1]
        text = html_lib.unescape(raw) if "&" in raw else raw
        top.own += len(text.strip())
        self._events.append((top, text))

    def _open(self, name: str, attrs: str) -> None:
        stack = self._stack
        if name in ENDS_PARAGRAPH and any(n.name == "p" for n in stack[-6:]):
            self._close("p")
        if name in SAME_CLOSES:
            for n in reversed(stack[-6:]):
                if n.name in SAME_CLOSES[name]:
                    self._close(n.name)
                    break
                if n.name in ("ul", "ol", "dl", "table"):
                    break
        values = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
        top = stack[-1]
        label = f"{name}.{values.get('class', '')}#{values.get('id', '') if not re.search(r'[0-9]', values.get('id', '')) else ''}"
        node = _Node(name, _child_key(top.key, label), top)
        role = values.get("role", "").lower()
        node.hard = name in SKIPPED or role in ROLES or (name == "header" and not any(n.name in _OWN_HEADER for n in stack))
        node.soft = name == "form" or role == "form"
        if values and name not in _OWN_HEADER and name not in HEADINGS and name not in ("html", "body"):
            node.soft = node.soft or any(map(_boilerplate, values.get("class", "").split())) or (name in CONTAINERS and _boilerplate(values.get("id", "").strip()))
        self.nodes.append(node)
        top.kids.append(node)
        self._events.append((node, True))
        if name not in VOID:
            stack.append(node)

    def _pop(self) -> None:
        self._events.append((self._stack.pop(), False))

    def _close(self, name: str) -> None:
        stack = self._stack
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].name == name:
                while len(stack) > at:
                    self._pop()
                return
            if name == "p" and stack[at].name in ("article", "main", "body", "table"):
                return

    def _parse(self, source: str) -> None:
        at = 0
        while True:
            tag = _TAG.search(source, at)
            if tag is None:
                self._text(source[at:])
                break
            if tag.start() > at:
                self._text(source[at : tag.start()])
            at = tag.end()
            name = tag[2]
            if name is None:
                continue
            name = name.lower()
            if tag[1]:
                if name in BLOCKS:
                    self._events.append((_BREAK, False))
                self._close(name)
                continue
            self._open(name, tag[3])
            if name in RAW:
                end = _RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
                if self._stack[-1].name == name:
                    self._pop()
        while len(self._stack) > 1:
            self._pop()

    def _judge(self) -> None:
        """Which elements are skipped, and the text outside them.

        A boilerplate name does not skip an element that holds a main element, the
        page's only articles or, on a page without either, most of its text.
        """
        for n in reversed(self.nodes):
            n.all += n.own
            n.mains += n.name == "main"
            n.articles += n.name == "article"
            if n.parent is not None and not n.hard:
                n.parent.all += n.all
                n.parent.mains += n.mains
                n.parent.articles += n.articles
        under: set[int] = set()
        loose = 0
        for n in self.nodes:
            if n.hard or n.soft or (n.parent is not None and id(n.parent) in under):
                under.add(id(n))
            else:
                loose += n.name in _OWN_HEADER and n.all > 0
        for n in self.nodes:
            spared = n.mains or (not loose and (n.articles or 2 * n.all > self._root.all))
            n.skip = n.hard or (n.soft and not spared) or (n.parent is not None and n.parent.skip)
        for n in reversed(self.nodes):
            if not n.skip:
                n.text += n.own
                n.linked += n.own if n.link else 0
                if n.parent is not None:
                    n.parent.text += n.text
                    n.parent.linked += n.linked

    def roots(self) -> list[_Node]:
        """The content slots by this page's elements alone: together they hold all its main text."""
        tops, inside = [], set()
        for n in self.nodes:
            if n.parent is not None and id(n.parent) in inside:
                inside.add(id(n))
            elif n.name in _OWN_HEADER and not n.skip and n.text:
                tops.append(n)
                inside.add(id(n))
        if tops and 2 * sum(n.text - n.linked for n in tops) >= self._root.text - self._root.linked:
            return tops
        node = self._root
        while not node.own:
            told = [k for k in node.kids if not k.skip and k.text and not (k.name in CONTAINERS and k.text == k.linked)]
            if len(told) != 1 or told[0].name not in CONTAINERS:
                break
            node = told[0]
        return [node] if node.text else []

    def blocks(self, roots: list[_Node]) -> list[tuple[int, str]]:
        """(token, text) of each block inside ``roots``: the token is of the text in its place, 0 for a heading."""
        out: list[tuple[int, str]] = []
        parts: list[str] = []
        wanted, inside, place = {id(n) for n in roots}, 0, self._root

        def flush() -> None:
            if parts:
                if block := " ".join("".join(parts).split()):
                    heads = place.name in HEADINGS or (place.parent is not None and place.parent.name in HEADINGS)
                    out.append((0 if heads else _child_key(place.key, "=" + block), block))
                parts.clear()

        whole = self._root in roots
        for node, what in self._events:
            if what is True:
                if node.name in BLOCKS:
                    flush()
                elif node.name == "br" and (inside or whole) and not node.skip:
                    parts.append(" ")
                inside += id(node) in wanted
            elif what is False:
                if node.name in BLOCKS or id(node) in wanted:
                    flush()
                inside -= id(node) in wanted
            elif (inside or whole) and not node.skip:
                if not parts:
                    place = node
                parts.append(what)
        flush()
        return out


def extract(source: str | None, slots: frozenset[int] = frozenset(), texts: frozenset[int] = frozenset()) -> str:
    """The main text of one page; ``slots``, ``texts``: the host's content slots and template texts, if known."""
    if not source:
        return ""
    page = Page(source)
    roots = page.roots()
    if slots and not any(n.name in _OWN_HEADER for n in roots):
        roots += [n for n in page.nodes if n.key in slots and not n.skip and n not in roots]
    blocks = page.blocks(roots)
    varying = [block for key, block in blocks if key not in texts]
    if 2 * sum(map(len, varying)) < sum(len(block) for _, block in blocks):
        varying = [block for _, block in blocks]  # pages so alike show no template
    return "\n".join(varying)


def _signed(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >= 1 << 63 else x


_TOKENS = "host string, key long, pages long, vector long, total long, clean long, roots long, skip boolean, is_text boolean"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of each (host, token) over the pages of a task."""
    sums: dict[tuple[str, int], list] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, _signed(k), *v) for (h, k), v in sums.items()]
        types = [pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.bool_()]
        names = [p.split()[0] for p in _TOKENS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for host, seed, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            page = Page(source)
            own = page.roots()
            roots = {id(n) for n in own}
            found: dict[int, list] = {}
            for n in page.nodes:
                at = found.setdefault(n.key, [0, 0, False, n.skip])
                at[0] += 1
                at[1] += n.text - n.linked
                at[2] = at[2] or id(n) in roots
            elements = len(found)
            for key, _ in page.blocks(own):
                if key:
                    found.setdefault(key, [0, 0, False, False])[0] += 1
            for i, (key, (count, clean, root, skip)) in enumerate(found.items()):
                at = sums.setdefault((host, key), [0, 0, 0, 0, 0, False, i >= elements])
                at[0] += 1
                at[1] += seed * count
                at[2] += count
                at[3] += clean
                at[4] += root
                at[5] = at[5] or skip
        if len(sums) > 200_000:
            yield out()
            sums.clear()
    if sums:
        yield out()


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots, texts): the content slots and template texts of each host whose pages show a template.

    A text is the template's, not the slot's filling, if it stands in the class of
    a content slot: on every page that has the slot, and on none else.  Paths are
    rooted, so an element's class lies inside those of the elements around it.
    """
    from . import common

    hosted = _hosted(pages)
    rows = hosted.select("host", F.xxhash64("page_id", "url", F.length("html")).bitwiseAND((1 << 40) - 1).alias("seed"), "html")
    tokens = rows.mapInArrow(_tokens, _TOKENS).groupBy("host", "key").agg(
        F.sum("pages").alias("pages"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.sum("total").alias("total"),
        F.sum("clean").alias("clean"), F.sum("roots").alias("roots"), F.max("skip").alias("skip"), F.min("is_text").alias("is_text"),
    )
    size = hosted.groupBy("host").agg(F.count("*").alias("of"))
    frequent = tokens.where(F.col("pages") >= LEAST_PAGES).join(size, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    frequent, _ = common.written(frequent, "frequent")
    classes = frequent.groupBy("host", "pages", "vector").agg(F.count("*").alias("members"))
    valid = frequent.join(classes.where(F.col("members") >= LEAST_CLASS), ["host", "pages", "vector"])
    once = valid.where((F.col("total") == F.col("pages")) & ~F.col("skip") & ~F.col("is_text") & (F.col("clean") > 0) & (2 * F.col("roots") > F.col("pages")))
    texts = frequent.where(F.col("is_text") & (F.col("pages") >= LEAST_TEXT)).join(once.select("host", "pages", "vector").distinct(), ["host", "pages", "vector"], "left_semi")
    both = once.select("host", "key", "is_text").unionByName(texts.select("host", "key", "is_text"))
    return both.groupBy("host").agg(F.collect_set(F.expr("if(is_text, null, key)")).alias("slots"), F.collect_set(F.expr("if(is_text, key, null)")).alias("texts"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of each row of ``pages``."""
    from . import common

    slots, _ = common.written(templates(pages), "templates")
    if slots.count() <= BROADCAST_HOSTS:
        slots = F.broadcast(slots)
    rows = _hosted(pages).join(slots, "host", "left").select("page_id", "url", "html", "slots", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = lambda ks: frozenset(k & 0xFFFFFFFFFFFFFFFF for k in ks or ())
            texts = [extract(h, keys(s), keys(t)) for h, s, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
