"""Main text of web pages along paths that a host's pages agree on.

A page is parsed into blocks of text under a tree of elements. Elements that
are no part of an article by tag, role or class (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) are left out;
within an article only where a whole class says so. The page's container is
scored by the share of the remaining text below it: from the root the search
goes down while one container holds most of the text and nothing beside it but
containers, and an article element wins if it holds a fair part; it is widened
to the heading that belongs to it. The container's path, tags and classes with
numbers generalised, is the page's vote. Spark counts the votes of each host,
and every page is extracted again along its host's winning path; a page without
that path keeps its own container, and so does one that would lose a good part
of its own container by it.

A page is scanned once from left to right; tags, ends and ancestors are found
without going back or up, so time and memory grow with a page's length however
deep it is nested or badly it is written.

Votes are pre-aggregated, so a host with a third of all pages is a few rows.
The winners (one row a host) are broadcast if they are counted to be few;
else the join is a shuffle whose skewed hosts Spark splits.

Defined results: null and empty html give the empty text; cut-off pages keep
their last block; an unfinished tag or comment at the end is dropped, as are a
script and a style without an end; a quote that is never closed is no quote; a
null url has the empty host, whose pages vote together; of paths with equally
many votes the one with more text, then the greater, wins; repeated rows give
equal rows; an empty table gives an empty result. A line break element is
white space; character references are decoded once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, small, table

#: Share of a container's text that its part must hold for the search to go on into it.
DOMINANT = 0.8
#: Share of a page's text that an article element must hold to be taken, and the host's path where the page has no container.
FAIR = 0.25

# HTML's vocabulary, and the names that mark what is no part of an article.
_ARTICLE = frozenset("article content entry post story".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_EMBEDDED = frozenset("audio canvas math object select svg video".split())
_CONTAINERS = frozenset("article blockquote center div dd dl main section span table tbody td tr".split())
_DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form head header iframe input map math menu nav noscript object option script select style svg template textarea title video".split())
_RAW = frozenset("script style noscript textarea iframe title noembed noframes xmp".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
_NAMES = frozenset(
    (
        "ad ads adbox adslot adsense adunit advert adverts advertisement advertising alert announcement banner banners breadcrumb breadcrumbs "
        "comment comments commentlist consent contentinfo cookie cookies copyright disclaimer discussion disqus dock footer footnav form gdpr "
        "header hidden login masthead menu menus modal nav navbar navigation navs newsletter notice notices notification outbrain overlay "
        "pager pagination paywall popup privacy promo promos promotion rail reaction reactions recommend recommended recommendations related "
        "replies reply respond responses search share sharing sharebar shares sidebar sidebars signin signup skip skyscraper social sponsor sponsored "
        "subscribe subscription taboola teaser teasers toolbar topbar tracking widget widgets"
    ).split()
)
#: Words beside those names in a class that still names no more than such a part.
_NEUTRAL = frozenset("area bar block blocks box button buttons container customer guest reader readers user users visitor content count form group inner item items label left link links list message messages outer panel post posts right row section signup slot small text title top bottom unit widget wrap wrapper us js".split())
#: Names that an article's own sections may have as well.
_OWN = frozenset("alert announcement consent copyright disclaimer discussion header hidden notice notices pager privacy promotion rail reaction reactions respond responses search skip tracking".split())
#: A class that only says what a container has beside it or is without.
_BESIDE = re.compile(r"^(?:has|with|no|without|is|js|wp|single|page|layout|template)[-_]", re.I)
_CLOSES_P = frozenset("address article aside blockquote center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = ("ul", "ol", "dl", "table", "select")
_SCOPE = frozenset("table td th ul ol dl body html article section main div aside nav header footer form".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
# A tag as most are written; none goes on past the next angle bracket.
_PLAIN = re.compile(r"""((?:\s++[^\s"'<>=/]++(?:="[^"<>]*+"|='[^'<>]*+'|=[^\s"'<>=`/]++)?+)*+\s*+/?+)>""")
_NEXT = re.compile(r"[>=]")
_BARE = re.compile(r"[^\s>]*+")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_NUMBER = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Scanner:
    """A page's tags from left to right: (text before, end tag?, name, attributes).

    Comments, declarations and raw elements with their text are passed over.
    What isn't found once isn't looked for again further on.
    """

    def __init__(self, html: str):
        self.html = html
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        if (found := self.html.find(what, at)) < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag that goes on at ``at`` has its closing bracket; -1 if nowhere."""
        html = self.html
        while (m := _NEXT.search(html, at)) is not None:
            if m[0] == ">":
                return m.start()
            at = m.end()
            while at < len(html) and html[at].isspace():
                at += 1
            if html[at : at + 1] in ('"', "'") and (close := self.find(html[at], at + 1)) >= 0:
                at = close + 1
            else:
                at = _BARE.match(html, at).end()
        return -1

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of a raw element; -1 if it has none."""
        if tag in self.missing:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(self.html, at)
        if m is None:
            self.missing.add(tag)
            return -1
        return m.end()

    def tags(self) -> Iterator[tuple[str, bool, str, str]]:
        html, at, begin = self.html, 0, 0
        while (at := html.find("<", at)) >= 0:
            c = html[at + 1 : at + 2]
            end = c == "/"
            if c in ("!", "?"):
                if html.startswith("<!--", at):
                    empty = html.startswith((">", "->"), at + 4)
                    stop = self.find(">", at + 4) if empty else self.find("-->", at + 4)
                    after = stop + (1 if empty else 3)
                else:
                    stop = self.find(">", at + 1)
                    after = stop + 1
                yield html[begin:at], False, "", ""
                if stop < 0:
                    return
                begin = at = after
                continue
            m = _NAME.match(html, at + 1 + end)
            if m is None:
                if end:  # an end tag without a name is a comment; at the end of the page it is unfinished
                    yield html[begin:at], False, "", ""
                    if (stop := self.find(">", at)) < 0:
                        return
                    begin = at = stop + 1
                elif at + 1 == len(html):
                    yield html[begin:at], False, "", ""
                    return
                else:
                    at += 1
                continue
            plain = _PLAIN.match(html, m.end())
            stop = plain.end() - 1 if plain else self.tag_end(m.end())
            if stop < 0:
                yield html[begin:at], False, "", ""
                return
            tag, attributes = m[0].lower(), html[m.end() : stop]
            before, begin = html[begin:at], stop + 1
            at = begin
            if tag in _RAW and not end:
                after = self.raw_end(tag, begin)
                if after < 0 and tag in ("script", "style"):
                    yield before, False, "", ""
                    return
                if after >= 0:
                    yield before, False, "", ""
                    begin = at = after
                    continue
            yield before, end, tag, attributes
        yield html[begin:], False, "", ""


@dataclass
class Node:
    tag: str
    parent: int
    name: str
    dropped: bool
    #: Whether it is in an article or main element; the nearest element that is no inline one, itself included.
    inside: bool = False
    block: int = 0
    chars: int = 0


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[str, int]]
    #: The blocks that are main headings.
    headings: list[int] = field(default_factory=list)

    def path(self, at: int) -> str:
        names = []
        while at > 0:
            names.append(self.nodes[at].name)
            at = self.nodes[at].parent
        return "/".join(reversed(names))

    def under(self, path: str) -> list[bool]:
        """For every node whether it, or one above it, has this path."""
        names = path.split("/") if path else []
        # How many names of the path lead to a node, if all above it fit; -1 if not.
        fits, inside = [0], [not names]
        for n in self.nodes[1:]:
            above = fits[n.parent]
            mine = above + 1 if 0 <= above < len(names) and names[above] == n.name else -1
            fits.append(mine)
            inside.append(inside[n.parent] or mine == len(names))
        return inside


def _named(words: list[str]) -> bool:
    """Whether a class says nothing but that its element is no part of an article."""
    return any(p in _NAMES and p not in _OWN for p in words) and all(p in _NAMES or p in _NEUTRAL for p in words)


def _foreign(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is no part of an article, and its name in a path."""
    if not attributes.strip(" /\t\n"):
        return tag in _DROPPED, tag
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    classes, ids = found.get("class", "").split(), found.get("id", "").split()
    name = ".".join([tag, *dict.fromkeys(_NUMBER.sub("#", c.replace("/", "|")) for c in (*classes, *ids))])
    if tag in _DROPPED or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _ROLES:
        return True, name
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, name
    if tag in ("html", "body", "article", "main"):
        return False, name
    words = [[p.lower() for p in _PARTS.split(c) if p] for c in (*classes, *ids) if not _BESIDE.match(c)]
    if inside:
        return any(map(_named, words)), name
    return any(p in _NAMES for w in words for p in w if p != "header" or _ARTICLE.isdisjoint(w)), name


def parse(html: str) -> Page:
    """The blocks of a page and the elements they are in."""
    page = Page([Node("", -1, "", False)], [])
    nodes, blocks, stack = page.nodes, page.blocks, [0]
    text: list[str] = []
    # Where each open tag, and each open element that closes nothing beyond it, stands in the stack.
    where: dict[str, list[int]] = defaultdict(list)
    scopes: list[int] = []

    def flush() -> None:
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                at = nodes[stack[-1]].block
                if nodes[at].tag == "h1":
                    page.headings.append(len(blocks))
                blocks.append((block, at))

    def close(i: int) -> None:
        """Close all elements from place ``i`` of the stack on."""
        while len(stack) > i:
            tag = nodes[stack.pop()].tag
            where[tag].pop()
            if tag in _SCOPE:
                scopes.pop()

    def last(tags: tuple[str, ...]) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=0)

    for before, end, tag, attributes in Scanner(html).tags():
        if before and not nodes[stack[-1]].dropped:
            text.append(before)
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        inline, quiet = tag in _INLINE, tag in _INLINE or tag in _EMBEDDED
        scope = scopes[-1] if scopes else 0
        if end:  # an end tag closes down to its element, if that is open within the nearest scope
            if (i := last((tag,))) and not ((inline or tag in ("p", "li")) and scope > i):
                if not quiet or any(nodes[s].tag not in _INLINE and not nodes[s].dropped for s in stack[i:]):
                    flush()
                close(i)
            continue
        if tag in ("html", "body"):
            flush()
            continue
        if not quiet:
            flush()
            if tag in _CLOSES_P and (i := last(("p",))) > scope:
                close(i)
            if (same := _CLOSES_SELF.get(tag)) and (i := last(same)) > last(_LISTS):
                close(i)
        if tag in _VOID or attributes.endswith("/") and quiet:
            continue
        up = nodes[stack[-1]]
        foreign, name = _foreign(tag, attributes, up.inside)
        if foreign and not up.dropped:
            # A heading's wrapper inside an article belongs to the article.
            if tag == "header" and up.inside:
                foreign = False
            elif not quiet:
                flush()
        at = len(nodes)
        nodes.append(Node(tag, stack[-1], name, foreign or up.dropped, up.inside or tag in ("article", "main"), up.block if quiet else at))
        where[tag].append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(at)
    flush()
    return page


def container(page: Page) -> int:
    """The node that holds the page's article, by its share of the text."""
    nodes = page.nodes
    for block, at in page.blocks:
        nodes[at].chars += len(block)
    for n in reversed(nodes[1:]):
        nodes[n.parent].chars += n.chars
    # The nearest container of every node, itself included; what each holds in no smaller one.
    holder, parts, own = [0], defaultdict(list), defaultdict(int)
    for i, n in enumerate(nodes[1:], 1):
        up = holder[n.parent]
        holder.append(i if n.tag in _CONTAINERS else up)
        if n.chars and n.tag in _CONTAINERS:
            parts[up].append(i)
    for block, at in page.blocks:
        own[holder[at]] += len(block)
    largest = lambda some: max(some, key=lambda i: (nodes[i].chars, -i))
    total, best = nodes[0].chars, 0
    for tag in ("article", "main"):
        found = [i for i, n in enumerate(nodes) if n.tag == tag and n.chars]
        if found and nodes[i := largest(found)].chars >= FAIR * total:
            best = i
            break
    else:
        # Down to the part that holds most, as long as what is left behind is other containers only.
        while parts[best] and nodes[i := largest(parts[best])].chars >= DOMINANT * nodes[best].chars and (not best or not own[best]):
            best = i
    return widened(page, best, holder)


def widened(page: Page, best: int, holder: list[int]) -> int:
    """The container, or one around it that has the page's main heading and little else."""
    nodes = page.nodes
    if not best or len(page.headings) != 1:
        return best
    above = {best}
    at = best
    while at > 0:
        at = nodes[at].parent
        above.add(at)
    at = holder[page.blocks[page.headings[0]][1]]
    while at not in above:
        at = nodes[at].parent
    at = holder[at]
    return at if at > 0 and nodes[best].chars >= DOMINANT * nodes[at].chars else best


def along(page: Page, path: str) -> str:
    """The blocks of all nodes with this path, in page order."""
    inside = page.under(path)
    return "\n".join(block for block, at in page.blocks if inside[at])


def extract(html: str, path: str | None) -> str:
    """The main text along the host's path, or the page's own container's."""
    page = parse(html)
    if not page.blocks:
        return ""
    best = container(page)
    own = page.path(best)
    chosen = along(page, own)
    if path is not None and path != own:
        agreed = along(page, path)
        # Without a container of its own the page follows its host; else only if it loses little.
        if agreed and len(agreed) >= (DOMINANT if best else FAIR) * len(chosen):
            return agreed
    return chosen


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "(?s)^([^/?#]*)", 1)
    lowered = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(at > 0, lowered), F.lit(""))


def vote(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes): the path that most pages of a host vote for, the most text breaking ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hosts, paths, chars = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(source or "")
                if page.blocks:
                    best = container(page)
                    hosts.append(host)
                    paths.append(page.path(best))
                    chars.append(page.nodes[best].chars)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(chars, pa.int64())], names=["host", "path", "chars"])

    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, path string, chars long")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("chars").alias("chars"))
    best = counted.groupBy("host").agg(F.max(F.struct("votes", "chars", "path")).alias("best"))
    return best.select("host", "best.path", "best.votes")


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without their html, with the main text of each."""
    winners = cut(vote(pages, url, html)).select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    kept = [c for c in pages.columns if c not in (html, out)]
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField(out, T.StringType())])
    joined = pages.select(*kept, F.col(html).alias("_html"), host_of(F.col(url)).alias("_host")).join(small(winners), "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            pairs = zip(batch.column(names.index("_html")).to_pylist(), batch.column(names.index("_path")).to_pylist(), strict=True)
            texts = [extract(h, p) if h else "" for h, p in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, out])

    return joined.select(*kept, "_html", "_path").mapInArrow(run, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
