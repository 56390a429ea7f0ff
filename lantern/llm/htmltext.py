"""Main text of web pages with a site style tree per host.

Each page is read into its elements; an element's path is the chain of signatures (tag and
classes) from the body to it, held as a digest of its parent's path and its own signature. The style tree of a host merges the elements of one path over
its pages. Its presentation is the sequence of its children's signatures, its content the
text below it; the importance of a node weighs the entropies of both over the host's pages
(each divided by the logarithm of the number of pages): a menu that is the same everywhere
has none, an article that differs from page to page has all of it. Pages of a host with equal
trees count once. A branch of low importance is removed from those pages on which its content
repeats (on 2 pages, and a share of REPEATS of the host's, at least); what lies below one that
repeats stays or goes with it. Never removed are article and main elements themselves, plain
paragraphs, headings, lists and tables in them, and branches that hold over half of the
page's text.

Independently of the host, elements that are no article text by tag, role or class are
removed (navigation, headers and footers outside an article, asides, forms, adverts, notices,
reader comments, scripts, styles); no class removes an article or main element, or a
paragraph or heading in one. Where a single article or main element holds a share of SINGLE
of the text that is left, or several hold SEVERAL, text outside them is left out.

The tree is counts of (host, path, presentation, content) over different pages: sums, so
that no task sees a host's pages together.

Reading takes time in proportion to the page, however deep its elements are nested: paths
and contents are digests that go on from those of the parent and of the children, and which
element a tag closes follows from the places of the open ones of each tag.

Defined results: null and empty html give empty text; a null or unreadable url is a host of
its own; pages cut off anywhere are read as far as they go; each row stands for itself; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Mapping, Set
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from lantern.llm.batches import map_rows
from lantern.session import table, written

LOW = 0.35
#: Share of a host's pages from which a content counts as repeated (2 pages at least).
REPEATS = 0.01
#: Characters of low branches, all hosts together, that may be broadcast.
BROADCAST_CHARS = 1 << 23
#: Share of the text left that a single article or main element, or several, must hold for
#: the text outside to be left out.
SINGLE, SEVERAL = 0.25, 0.5
#: Weight of presentation against content in a node's importance.
PRESENTATION = 0.3

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
DROPPED = frozenset("aside button canvas dialog fieldset footer form head iframe input label legend menu nav noscript object script select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|masthead|site-?header|page-?header|top-?bar|footer|cookies?|consent|gdpr"
    r"|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommended|comments?|respond|disqus\w*|replies|pagination|pager|skip-?link)"
)
#: Elements that a new block looks for to close a paragraph.
BOUNDS = frozenset("p td th li article body".split())
#: Elements that no class removes inside an article.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
AMBIGUOUS = frozenset(("header",))
COMPOUND = frozenset("ad ads advert advertisement sidebar comment comments cookie cookies footer nav navbar menu breadcrumb breadcrumbs newsletter sponsored".split())

TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$))", re.DOTALL)
#: One attribute: its whole name, and its whole value if it has one.
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>][^\s>]*)))?")
READ = frozenset(("class", "id", "role", "hidden", "aria-hidden"))


#: Contents are polynomials of their texts' digests, modulo a Mersenne prime.
PRIME, BASE = (1 << 127) - 1, 0x5BD1E9955BD1E9955BD1E9955BD1E995


@dataclass
class Content:
    """A sequence of texts: its polynomial, and what a sequence before it is multiplied by."""

    value: int = 0
    shift: int = 1

    def add(self, text: str) -> None:
        x = int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), "big")
        self.value, self.shift = (self.value * BASE + x) % PRIME, self.shift * BASE % PRIME

    def extend(self, other: Content) -> None:
        self.value, self.shift = (self.value * other.shift + other.value) % PRIME, self.shift * other.shift % PRIME

    def digest(self) -> str:
        return f"{self.value & (1 << 64) - 1:016x}"


@dataclass
class Element:
    tag: str
    sign: str
    path: str
    parent: str
    dropped: bool
    main: bool
    #: Place among the open elements of the nearest paragraph, or of what bounds one.
    near: int = 0
    held: int = 0
    children: list[str] = field(default_factory=list)
    text: Content = field(default_factory=Content)


def attributes(source: str) -> dict[str, str]:
    """The attributes that the rules read; of two of one name the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        if (name := m[1].lower()) in READ:
            out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


def by_rule(tag: str, a: dict[str, str], main: bool) -> bool:
    """Whether an element is no article text, whatever its host."""
    if tag in DROPPED or (tag == "header" and not main) or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if tag in ("body", "html", "article", "main") or (main and tag in PLAIN):
        return False
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    return any(NAMES.fullmatch(x) or (x in AMBIGUOUS and not main) or COMPOUND.intersection(re.split(r"[-_]+", x)) for x in names)


def read(source: str | None):
    """Events of a page in order: ("open", element), ("close", element), ("text", str)."""
    source = source or ""
    stack = [Element("html", "html", "", "", False, False)]
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    at, n = 0, len(source)

    def opened(tag: str, a: dict[str, str]) -> Element:
        top = stack[-1]
        names = ".".join(sorted(a.get("class", "").lower().split()))
        sign = f"{tag}.{names}" if names else tag
        main = top.main or tag in ("article", "main")
        path = hashlib.md5(f"{top.path}/{sign}".encode("utf-8", "surrogatepass")).hexdigest()[:16]
        e = Element(tag, sign, path, top.path, top.dropped or by_rule(tag, a, top.main), main)
        top.children.append(sign)
        return e

    def push(e: Element) -> None:
        e.near = len(stack) if e.tag in BOUNDS else stack[-1].near
        places.setdefault(e.tag, []).append(len(stack))
        stack.append(e)

    def close(k: int):
        while len(stack) > k:
            e = stack.pop()
            places[e.tag].pop()
            yield "close", e

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    while at < n:
        m = TAG.search(source, at)
        if m is None:
            yield "text", source[at:]
            break
        if m.start() > at:
            yield "text", source[at : m.start()]
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if k := last(tag):
                yield from close(k)
            continue
        if tag in ("html", "body"):
            continue  # one of each is there
        if tag in BLOCK:
            k = stack[-1].near
            if k and stack[k].tag == "p":
                yield from close(k)
        if tag in CLOSES:
            # All that it closes above the innermost element that may hold it.
            inner = max(map(last, HOLDS.get(tag, ())), default=0)
            above = [x[i] for t in CLOSES[tag] if (x := places.get(t)) and (i := bisect_right(x, inner)) < len(x)]
            if above:
                yield from close(min(above))
        e = opened(tag, attributes(m[3] or m[6] or ""))
        yield "open", e
        if tag in VOID:
            yield "close", e
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.IGNORECASE).search(source, at)
            at = end.start() if end else n
            push(e)
        else:
            push(e)
    yield from close(1)


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def digest(parts: list[str]) -> str:
    return hashlib.md5("\x00".join(parts).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def nodes(events: Iterable) -> dict[str, tuple[list[str], Content]]:
    """For each path of a page its elements' children and the text below them."""
    seen: dict[str, tuple[list[str], Content]] = {}
    opened: list[Element] = []
    for what, x in events:
        if what == "open":
            opened.append(x)
        elif what == "text":
            if opened and (t := " ".join(x.split())):
                opened[-1].text.add(t)
        else:
            opened.pop()
            if opened:
                opened[-1].text.extend(x.text)
            if x.tag in BLOCK:
                style, text = seen.setdefault(x.path, ([], Content()))
                style.append(",".join(x.children))
                text.extend(x.text)
    return seen


def styles(source: str | None) -> list[tuple[str, str, str, str]]:
    """(page, path, presentation, content) of a page: digests of its whole tree, and for each
    path of the children and of the text."""
    rows = [(p, digest(s), t.digest()) for p, (s, t) in nodes(read(source)).items()]
    page = digest([x for r in rows for x in r])
    return [(page, *r) for r in rows]


def most_text(events: list) -> Set[str]:
    """Paths whose elements hold over half of the text that the rules leave."""
    held: Counter[str] = Counter()
    opened: list[Element] = []
    total = 0
    for what, x in events:
        if what == "open":
            x.held = total
            opened.append(x)
        elif what == "close":
            opened.pop()
            held[x.path] += total - x.held
        elif not (opened and opened[-1].dropped):
            total += len(" ".join(x.split()))
    return {path for path, n in held.items() if 2 * n > total}


def main_text(source: str | None, low: Mapping[str, Set[str] | None]) -> str:
    """Text of the page without what the rules remove, and without the paths in low where
    their content is one that low has for them (None: whatever it is)."""
    events = list(read(source))
    repeated = {p for p, (_, t) in nodes(events).items() if p in low and (low[p] is None or t.digest() in low[p])} if low else set()
    gone = repeated - most_text(events) if repeated else set()
    everything: list[tuple[bool, str]] = []
    articles = 0
    block: list[str] = []
    opened: list[Element] = [Element("body", "body", "", "", False, False)]

    def end_block():
        if block:
            if t := " ".join(html.unescape("".join(block)).split()):
                everything.append((opened[-1].main, t))
            block.clear()

    for what, x in events:
        if what == "text":
            if not opened[-1].dropped:
                block.append(x)
            continue
        if x.tag in BLOCK:
            end_block()
        elif x.tag == "br" and not opened[-1].dropped:
            block.append(" ")
        if what == "open":
            articles += x.main and not opened[-1].main
            flow = opened[-1].main and x.sign == x.tag and x.tag not in ("div", "section")
            branch = x.path in gone and x.parent not in gone
            x.dropped = x.dropped or opened[-1].dropped or (branch and not flow and x.tag not in ("article", "main"))
            opened.append(x)
        else:
            opened.pop()
    end_block()
    inside = [t for main, t in everything if main]
    whole = [t for _, t in everything]
    # Several articles that hold the lesser part are teasers beside the text, as is one that
    # holds little.
    share = SEVERAL if articles > 1 else SINGLE
    return "\n\n".join(inside if sum(map(len, inside)) >= share * sum(map(len, whole)) else whole)


def style_counts(pages: DataFrame) -> DataFrame:
    """host, path, style, content, n: different pages of a host with a node so."""
    rows = lambda b: [(host(u), *s) for u, h in zip(b["url"], b["html"]) for s in styles(h)]
    seen = map_rows(pages.select("url", "html"), rows, "host string, page string, path string, style string, content string", text="html")
    return seen.distinct().groupBy("host", "path", "style", "content").agg(F.count(F.lit(1)).alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """host, path, pages, importance: the nodes of all hosts' style trees."""
    # Entropy of counts c that add up to m: ln m - sum(c ln c) / m.
    def entropy(by: str):
        c = counts.groupBy("host", "path", by).agg(F.sum("n").alias("c"))
        c = c.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        h = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
        return c.select("host", "path", F.col("m").alias("pages"), h.alias(f"h_{by}"))
    both = entropy("style").join(entropy("content").drop("pages"), ["host", "path"])
    return both.select("host", "path", "pages", (PRESENTATION * F.col("h_style") + (1 - PRESENTATION) * F.col("h_content")).alias("importance"))


def low_branches(counts: DataFrame) -> DataFrame:
    """host, path, content: contents that repeat at a path of low importance."""
    low = importance(counts).filter(F.col("importance") < LOW).select("host", "path", "pages")
    often = counts.groupBy("host", "path", "content").agg(F.sum("n").alias("n")).filter("n >= 2")
    return often.join(low, ["host", "path"]).filter(F.col("n") >= REPEATS * F.col("pages")).select("host", "path", "content")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: a row for each row of pages."""
    pages = pages.select("page_id", "url", "html")
    low = written(low_branches(written(style_counts(pages), "styles")), "low")
    n_chars = low.agg(F.sum(F.length("host") + F.length("path") + F.length("content"))).first()[0] or 0
    schema = "page_id long, url string, text string"
    if n_chars <= BROADCAST_CHARS:
        by_host: dict[str, dict[str, set[str]]] = {}
        for r in low.toLocalIterator():
            by_host.setdefault(r["host"], {}).setdefault(r["path"], set()).add(r["content"])
        held = pages.sparkSession.sparkContext.broadcast(by_host)
        rows = lambda b: [(i, u, main_text(h, held.value.get(host(u), {}))) for i, u, h in zip(b["page_id"], b["url"], b["html"])]
        return map_rows(pages, rows, schema, text="html")
    # Else each page gets its own low paths, by a hash of the page: no host's list goes with
    # every page, and pages are not dealt by host.
    page = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    named = pages.withColumn("key", page)
    rows = lambda b: [(k, host(u), p, c) for k, u, h in zip(b["key"], b["url"], b["html"]) for _, p, _, c in styles(h)]
    own = map_rows(named.select("key", "url", "html"), rows, "key long, host string, path string, content string", text="html").distinct()
    own = own.join(low, ["host", "path", "content"]).groupBy("key").agg(F.collect_list("path").alias("low"))
    rows = lambda b: [(i, u, main_text(h, dict.fromkeys(low or ()))) for i, u, h, low in zip(b["page_id"], b["url"], b["html"], b["low"])]
    return map_rows(named.join(written(own, "low"), "key", "left").drop("key"), rows, schema, text="html")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
