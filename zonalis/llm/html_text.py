"""Main text of web pages by removal of site templates.

Every element subtree of a page is hashed by its tags and its text, those inside articles too.
Spark counts, for each host, on how many different pages a subtree occurs.  A subtree that
recurs on ``PAGES`` or more is part of the site's template and is deleted wherever it
stands on that host.  Running text where the article may be (inside an article mark, or anywhere on a
page without marks) can be quoted on many pages, so it must recur on twice as many and on over half of the host's.

Copies of an article are one page: pages whose longest block is the same count once.  Blocks
that stand on over half of the host's pages do not serve for that, so a notice
longer than any story does not make all pages one.

Sites with few pages show no templates.  For these, elements that HTML itself names as no part of the
article (menus, headers, footers, sidebars, forms, scripts, and class names all of whose parts say so)
go too, and what an article or main mark leaves out: all but the headline, unless the marked
articles are only teasers beside the story.

Defined results: null and empty html give an empty text.  A null or odd URL counts as one
host.  Malformed markup is read as browsers do: unclosed paragraphs and items end where the next
begins.  Repeated pages each keep their row.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Different pages of a host on which a subtree stands to be a template.
PAGES = 5
#: Keys that are broadcast at most, 8 bytes each.
TABLE = 4_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")

RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " legend li main menu nav ol option p pre search section select summary table caption tbody td tfoot th thead tr ul".split()
)
#: Never text, and never part of an article.
STRICT = frozenset("head script style noscript template form button select textarea input iframe object svg math canvas video audio dialog title noembed noframes".split())
CHROME = STRICT | frozenset(("nav", "footer", "aside", "menu", "search"))
#: Words of class and id names, and roles, that say the same.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup"
    " sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond share sharing social related recommended popup modal"
    " overlay login paywall pagination pager widget widgets toolbar skip copyright contentinfo complementary search".split()
)
#: Words that may stand beside them; a name with any other word says something else.
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global mobile desktop sticky fixed box wrap wrapper container content inner outer area section list item items block bar slot unit group row col"
    " column links link buttons button icons icon form panel text message policy posts post articles media reply count thread en js to the a of up in my".split()
)
_CONTENT = frozenset("content main-content article-body post-content entry-content article-content".split())
SITE_HEADERS = frozenset("header site-header page-header top-header siteheader pageheader".split())
#: What an element ends that is still open.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: An element beyond which such an end does not reach.
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
_WHOLE = frozenset(("html", "body"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _named_chrome(attributes: dict[str, str], names: list[str]) -> bool:
    if attributes.get("role", "").lower() in NAMES | {"banner", "dialog", "form"}:
        return True
    for name in names:
        parts = [p.lower() for p in _NAME_PART.findall(name) if not p.isdigit()]
        if name.lower() in SITE_HEADERS or not NAMES.isdisjoint(parts) and all(p in NAMES or p in BESIDE for p in parts):
            return True
    return False


class Element:
    """An element that is still open; links have no number of their own."""

    __slots__ = ("tag", "number", "strict", "article", "links", "text", "parts", "own")

    def __init__(self, tag: str, number: int, strict: bool, article: int):
        self.tag, self.number, self.strict, self.article = tag, number, strict, article
        self.links = self.text = self.own = 0
        #: What the subtree's hash is made of: texts, and hashes of the subtrees inside.
        self.parts: list[str] = []


class Page:
    """Text blocks of a page, the subtree that holds each, and what is known of every subtree."""

    def __init__(self, markup: str):
        #: (text, number of the enclosing subtree)
        self.blocks: list[tuple[str, int]] = []
        #: By number: tag, enclosing subtree, hash (0 without text), length of the longest block of its own,
        #: rank of its own article mark and of the greatest one around it, whether links make up half, whether it has a link.
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.digests: list[int] = []
        self.sizes: list[int] = []
        self.marks: list[int] = []
        self.within: list[int] = []
        self.linked: list[tuple[bool, bool]] = []
        #: Never text (scripts, forms, what is hidden), and by tag or name no part of an article.
        self.strict: list[bool] = []
        self.chrome: list[bool] = []
        self.named: list[bool] = []
        self._stack: list[Element] = []
        self._open_tags: Counter = Counter()
        self._pieces: list[str] = []
        self._counted = 0
        self._read(markup)

    # Reading -----------------------------------------------------------------

    def _read(self, markup: str) -> None:
        at, token, lower = 0, _TOKEN, None
        self._open("body", {})
        while m := token.search(markup, at):
            if m.start() > at:
                self._pieces.append(markup[at : m.start()])
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                lower = lower if lower is not None else markup.lower()
                end = lower.find(f"</{tag}", at)
                end = len(markup) if end < 0 else end
                if tag not in CHROME:
                    self._pieces.append(markup[at:end])
                at = end
        self._pieces.append(markup[at:])
        while self._stack:
            self._close()

    def _start(self, tag: str, rest: str) -> None:
        if tag in _WHOLE:
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._pieces.append(" ")
            return
        if tag in BLOCK:
            self._flush()
            if tag in _ENDS:
                self._end_open(_ENDS[tag], _SCOPE[tag])
            self._end_open({"p"}, {"button", "table", "article", "main", "section", "div"})
        elif tag not in CHROME:
            if tag == "a":
                self._text()
                above = self._stack[-1]
                self._stack.append(Element(tag, above.number, above.strict, above.article))
                self._open_tags[tag] += 1
            return
        attributes = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
        self._open(tag, attributes)

    def _open(self, tag: str, attributes: dict[str, str]) -> None:
        self._flush()
        above = self._stack[-1] if self._stack else None
        mark, named, strict = 3 if tag == "article" else 2 if tag == "main" else 0, False, tag in STRICT or bool(above and above.strict)
        if attributes:
            names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
            strict = strict or _hidden(attributes)
            mark = mark or (2 if attributes.get("role") == "main" else 1 if any(n.lower() in _CONTENT for n in names) else 0)
            named = _named_chrome(attributes, names) and (mark < 2 or any(n.lower().startswith("comment") for n in names))
        around = above.article if above else 0
        self._stack.append(Element(tag, len(self.tags), strict, max(around, mark)))
        self._open_tags[tag] += 1
        self.tags.append(tag)
        self.parents.append(above.number if above else -1)
        self.digests.append(0)
        self.sizes.append(0)
        self.marks.append(mark)
        self.within.append(max(around, mark))
        self.linked.append((False, False))
        self.strict.append(strict)
        self.chrome.append(tag in CHROME or tag == "header" and not around)
        self.named.append(named)

    def _text(self) -> None:
        """Count pending text for the link share of what is open; it stays pending."""
        size = sum(map(len, self._pieces)) - self._counted
        if size > 0:
            self._counted += size
            self._stack[-1].text += size
            if self._stack[-1].tag == "a":
                self._stack[-1].links += size

    def _flush(self) -> None:
        if not self._pieces:
            return
        self._text()
        self._counted = 0
        text = " ".join(entities.unescape("".join(self._pieces)).split())
        self._pieces.clear()
        if text:
            top = self._stack[-1]
            top.parts.append(text)
            if not top.strict:
                self.blocks.append((text, top.number))
                top.own = max(top.own, len(text))

    def _close(self) -> None:
        top = self._stack[-1]
        link = top.tag == "a"
        if link:
            self._text()
        else:
            self._flush()
        self._stack.pop()
        self._open_tags[top.tag] -= 1
        if not self._stack:
            return
        above = self._stack[-1]
        above.text += top.text
        above.links += top.links
        if link:
            above.parts += top.parts
            return
        own = _DIGITS.sub("0", "\x00".join((top.tag, *top.parts)))
        digest = xxhash.xxh64_intdigest(own.encode("utf-8", "replace"), 2)
        above.parts.append(f"\x01{digest:x}")
        self.linked[top.number] = (2 * top.links >= top.text, top.links > 0)
        if top.parts:
            self.digests[top.number] = digest or 1
            self.sizes[top.number] = top.own

    def _end(self, tag: str) -> None:
        if tag in _WHOLE:
            return
        if tag == "br":
            self._pieces.append(" ")
        if tag in BLOCK:
            self._flush()
        if not self._open_tags[tag]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].tag == tag:
                while len(self._stack) > k:
                    self._close()
                return
            if tag == "a" and self._stack[k].tag != "a":
                return

    def _end_open(self, tags: set[str], scope: set[str]) -> None:
        if not any(self._open_tags[t] for t in tags):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].tag in tags:
                while len(self._stack) > k:
                    self._close()
                return
            if self._stack[k].tag in scope:
                return

    # Results -----------------------------------------------------------------

    def keys(self) -> list[int]:
        """By number: the subtree's key, 0 without text; odd where running text of an article may stand."""
        marked, around = any(self.marks), [False] * len(self.tags)
        for i in range(len(self.tags) - 1, 0, -1):  # a subtree comes after what encloses it
            if self.marks[i] or around[i]:
                around[self.parents[i]] = True
        out = []
        for digest, (links, _), within, holds in zip(self.digests, self.linked, self.within, around, strict=True):
            prose = not links and (not marked or within > 0 or holds)
            out.append(((digest >> 1 << 1) | prose) - (1 << 63) if digest else 0)
        return out

    def subtrees(self) -> dict[int, int]:
        """Keys of the subtrees with the length of the longest block of their own that may be the article's, 0 if none is."""
        gone, found = self._chrome(), {}
        for key, size, out in zip(self.keys(), self.sizes, gone, strict=True):
            if key:
                found[key] = max(found.get(key, 0), 0 if out else size)
        return found

    def _chrome(self) -> list[bool]:
        """By number: whether tags or names say that the subtree is no part of an article."""
        whole, heads = [0] * len(self.tags), [False] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            whole[i] = max(whole[i], self.marks[i] * (not self.named[i]))
            heads[i] |= self.tags[i] == "h1"
            if (above := self.parents[i]) >= 0:
                whole[above], heads[above] = max(whole[above], whole[i]), heads[above] or heads[i]
        gone: list[bool] = []
        for i, above in enumerate(self.parents):
            # A name does not say that of what holds the article and its headline.
            gone.append(self.strict[i] or self.chrome[i] or self.named[i] and not (whole[i] >= 2 and heads[i]) or above >= 0 and gone[above])
        return gone

    def text(self, templates: frozenset[int] = frozenset(), rules: bool = True) -> str:
        """The page's text without templates; without ``rules``, tags and names count for nothing."""
        chrome = self._chrome() if rules else self.strict
        gone: list[bool] = []
        for key, above, out in zip(self.keys(), self.parents, chrome, strict=True):
            gone.append(out or key in templates or above >= 0 and gone[above])
        kept = [(t, holder) for t, holder in self.blocks if not gone[holder]]
        if rules and any(self.within[holder] for _, holder in kept):
            kept = self._marked(kept)
        return "\n\n".join(t for t, _ in kept)

    def _marked(self, kept: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """The blocks inside article and main marks, and the headline; teasers are left out."""
        articles, roots = [], []  # by number: innermost article, outermost mark
        for i, above in enumerate(self.parents):
            articles.append(i if self.tags[i] == "article" else articles[above] if above >= 0 else -1)
            roots.append(roots[above] if above >= 0 and roots[above] >= 0 else i if self.marks[i] else -1)
        size, plain = Counter(), set()  # text by article (-1: outside articles), articles with more than headings
        for t, holder in kept:
            size[articles[holder]] += len(t)
            if self.tags[holder] not in _HEADINGS:
                plain.add(articles[holder])
        story = max(size.values())
        teasers = {a for a, n in size.items() if a >= 0 and (n < story and a not in plain or 4 * n < story and self.linked[a][1])}
        kept = [(t, holder) for t, holder in kept if articles[holder] not in teasers]
        found = Counter()
        for t, holder in kept:
            found[roots[holder]] += len(t)
        found.pop(-1, None)
        if not found:
            return kept
        # A wrapper that only its class name marks counts if it holds as much as half of the largest part.
        best = max(found.values())
        stay = {r for r, n in found.items() if self.marks[r] >= 2 or 2 * n >= best}
        inside = [roots[holder] in stay for _, holder in kept]
        first = inside.index(True)
        if not any(i and self.tags[holder] == "h1" for i, (_, holder) in zip(inside, kept, strict=True)):
            head = [k for k in range(first) if self.tags[kept[k][1]] == "h1"]
            if head:
                inside[head[-1]] = True
        return [b for b, i in zip(kept, inside, strict=True) if i]


SUBTREES = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("size", T.IntegerType())]))


@F.arrow_udf(SUBTREES)
def subtrees(pages: pa.Array) -> pa.Array:
    keys, sizes, ends = [], [], [0]
    for markup in pages:
        found = Page(markup.as_py() or "").subtrees()
        keys += found.keys()
        sizes += found.values()
        ends.append(len(keys))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "size"]))


@F.arrow_udf(T.StringType())
def _texts_by_list(pages: pa.Array, templates: pa.Array) -> pa.Array:
    return pa.array([Page(h.as_py() or "").text(frozenset(t.as_py() or ())) for h, t in zip(pages, templates, strict=True)], pa.string())


def _texts_by_table(known):
    """Main texts where ``known`` holds the keys of all templates, sorted."""

    @F.arrow_udf(T.StringType())
    def run(pages: pa.Array, hosts: pa.Array) -> pa.Array:
        own, out = known.value, []
        for markup, name in zip(pages, hosts, strict=True):
            page = Page(markup.as_py() or "")
            found = np.array(page.keys(), dtype=np.int64)
            mixed = found ^ np.int64(name.as_py())
            place = np.minimum(np.searchsorted(own, mixed), max(len(own) - 1, 0))
            out.append(page.text(frozenset(found[own[place] == mixed].tolist() if len(own) else ())))
        return pa.array(out, pa.string())

    return run


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _digest(host_column, html_column):
    return F.md5(F.concat_ws("\x00", host_column, html_column).cast("binary"))


def read_shapes(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, page, subtrees) of every page, written; ``host`` is a hash and ``page`` a digest."""
    name = host(F.col(url))
    own = pages.select(F.xxhash64(name).alias("host"), _digest(name, F.col(html)).alias("page"), subtrees(F.col(html)).alias("subtrees"))
    return materialise(own, "shapes")


def _signed(read: DataFrame) -> DataFrame:
    """(host, signature, keys): the key of the page's longest block that is not on over half of the host's pages, or just the longest."""
    blocks = F.sort_array(F.transform(F.filter("subtrees", lambda x: x["size"] > 0), lambda x: F.struct(x["size"].alias("size"), x["key"].alias("key"))), asc=False)
    own = read.select("host", F.transform("subtrees", lambda x: x["key"]).alias("keys"), F.transform(blocks, lambda x: x["key"]).alias("blocks"))
    pages = own.groupBy("host").agg(F.count("*").alias("pages"))
    often = own.select("host", F.explode("blocks").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).join(pages, "host").filter("2 * n > pages")
    # Fewer than twice as many as a page of the host has blocks.
    usual = materialise(often.groupBy("host").agg(F.collect_set("key").alias("usual")), "usual")
    if (usual.agg(F.sum(F.size("usual"))).first()[0] or 0) <= TABLE:
        usual = F.broadcast(usual)
    rare = F.get(F.filter("blocks", lambda k: ~F.array_contains("usual", k)), 0)
    return own.join(usual, "host", "left").select("host", F.coalesce(rare, F.get("blocks", 0), F.lit(0)).alias("signature"), "keys")


def templates(read: DataFrame, least: int = PAGES) -> DataFrame:
    """(host, subtree) of the subtrees that recur on ``least`` different pages of a host, prose on twice as many and over half of all."""
    signed = materialise(_signed(read), "signatures")
    hosts = signed.select("host", "signature").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    found = signed.select("host", "signature", F.explode("keys").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    often = found.join(hosts, "host").filter((F.col("subtree").bitwiseAND(F.lit(1)) == 0) | (F.col("n") >= 2 * least) & (2 * F.col("n") > F.col("pages")))
    return materialise(often.select("host", "subtree"), "templates")


def main_text(pages: DataFrame, *, url: str = "url", html: str = "html", into: str = "text", least: int = PAGES, table: int = TABLE) -> DataFrame:
    """``pages`` with the main text of each.

    Up to ``table`` templates go to the workers as one broadcast array; beyond that
    every page gets its own list by a join.
    """
    kept = [c for c in pages.columns if c.lower() != into.lower()]
    read = read_shapes(pages, url=url, html=html)
    found = templates(read, least)
    own = pages.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(html).alias("html"), host(F.col(url)).alias("host"))
    if found.count() <= table:
        # Both are hashes, so their exclusive or names a subtree on a host.
        keys = found.select(F.col("subtree").bitwiseXOR(F.col("host")).alias("key")).toArrow()["key"].to_numpy()
        known = pages.sparkSession.sparkContext.broadcast(np.sort(keys))
        done = own.select("row", _texts_by_table(known)(F.col("html"), F.xxhash64("host")).alias("body"))
    else:
        # A page copied word for word has one digest and so one list.
        lists = read.select("host", "page", F.explode("subtrees.key").alias("subtree")).distinct().join(found, ["host", "subtree"]).groupBy("page").agg(F.collect_list("subtree").alias("subtrees"))
        joined = own.withColumn("page", _digest(F.col("host"), F.col("html"))).join(lists, "page", "left")
        done = joined.select("row", _texts_by_list("html", "subtrees").alias("body"))
    return done.select("row.*", F.col("body").alias(into))
