"""Main text of web pages by removing site templates.

A page is parsed to elements and text blocks. Every block-level element's subtree
(tags and text, in order) is hashed. Spark counts, for each host, on how many
different pages a subtree occurs; one that recurs on ``min_pages`` pages, however many
others the host has, is part of the site's template and is deleted from its pages.
Pages with the same content count once, so copies of an article do not
make it a template. Elements that name themselves as no content (by tag, role, class
or id) are deleted as well, headings never by a name. In an article whole classes and
ids count, not single words of a slug (``related-work``), in a main element whole ids;
an article element nested in an article or in a named subtree goes if its class says that it
is a comment or a related item. If a page has an article (else a main) element, the text
inside it is the main text, otherwise all text that is left is. In an article or main
element pages count by what these hold, so that copies of an article beside other
adverts count once; paragraphs, list items, quotations and captions (QUOTABLE) are
deleted there only if they are on more than half of the host's different ones, and
headings and table cells, which label the text of the page, never.

White space inside a block becomes one space, blocks are joined by one space, and
character references are decoded.

Defined cases: null, empty or markup-free html gives its plain text (empty for
null); a null url or one without a host shares the host ``''``; cut-off tags at the
end are dropped; unclosed and stray tags are tolerated; repeated rows get the same
text; a null key is returned as it is; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.llm.common import bounded, join_hot, stage

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "object", "canvas")
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr caption figcaption article main body html".split())
QUOTABLE = frozenset("p li dd blockquote pre figcaption".split())
NO_CONTENT = frozenset("head nav footer aside form button select option optgroup dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsbox banner sponsor sponsored sponsors promo promos "
    "promotion cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "newsletter subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "sidebars widget widgets related recommended recommendations share sharing social comment comments commentlist "
    "disqus reply replies respond footer footers masthead toolbar pagination pager login search skip "
    "toc tags".split())
#: Words that make no slug: a class of NAMES and these is a whole name (``comment-list``).
GENERIC = frozenset("list box block area body wrap wrapper container bar button buttons post posts article articles link "
                    "links item items section inner thread".split())
#: Words of a place or kind that a name outside of articles may have besides (``site-footer``, ``ad-slot``).
PLACES = frozenset("site page global main primary secondary top bottom left right side sticky fixed mobile desktop slot unit "
                   "placeholder form icons icon bar row col column inline google dfp".split())
#: What an article element may be called that is no article of its own.
ITEMS = frozenset("comment comments reply replies related recommended recommendations promo sponsored ad advert "
                  "advertisement".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE_NAMES = frozenset("header headers topbar".split())
#: An open element of the key ends before a start tag of the values.
ENDS_BEFORE = {
    "p": BLOCK - {"button", "option", "optgroup", "select", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
ENDING = frozenset().union(*ENDS_BEFORE.values())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?:svg|math)(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"  # foreign elements may close themselves
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>"  # or an open quote
    r"|</?[a-z][^>]*\Z|</\Z", re.S | re.I)
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
_NAME = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    area: str = ""  # "article" or "main" if it holds the content
    dropped: bool = False  # names itself as no content
    named: bool = False  # only its class or id says so
    parts: list = field(default_factory=list)
    mark: int = 0
    has_text: bool = False


@dataclass
class Page:
    elements: list[Element]
    blocks: list[tuple[int, str]]  # (element, text) in page order


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in _ATTR.findall(raw)} if raw.strip(" /") else {}


def _whole(name: str, wanted: frozenset[str], generic: frozenset[str] = frozenset()) -> bool:
    """Whether a class or id is made of ``wanted`` (and ``generic``) words alone."""
    own = set(_NAME.findall(name))
    return not own.isdisjoint(wanted) and all(w in NAMES or w in wanted or w in generic or w.isdigit() for w in own)


def _named(tag: str, a: dict[str, str], area: str, clutter: bool) -> bool:
    classes, own_id = a.get("class", ""), a.get("id", "")
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return (area == "article" or clutter) and any(_whole(c, ITEMS, GENERIC) for c in classes.split())
    if area == "article":
        return _whole(own_id, NAMES) or any(_whole(c, NAMES, GENERIC) for c in classes.split())
    wanted = NAMES if area else NAMES | OUTSIDE_NAMES
    return any(_whole(c, wanted, GENERIC | PLACES) for c in (*classes.split(), own_id))


def _element(tag: str, raw: str, parent: int, area: str, clutter: bool) -> Element:
    """``area``: "article" or "main" if the element lies in one; ``clutter``: it lies in a named subtree."""
    e = Element(tag, parent, tag if tag in ("article", "main") else "")
    e.dropped = tag in NO_CONTENT or (tag == "header" and not area)
    if not raw:
        return e
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        e.dropped = True
    if (role := a.get("role")) in ROLES:
        e.dropped = True
    elif role == "main":
        e.area = "main"
    if "articlebody" in a.get("itemprop", ""):
        e.area = "article"
    if "class" in a or "id" in a:
        e.named = _named(tag, a, area, clutter)
        if e.named and tag == "article":
            e.area = ""
    return e


def parse(text: str | None) -> Page:
    """Elements (the first is the document) and text blocks of a page."""
    elements, blocks, stack, buffer = [Element("", -1)], [], [0], []
    text = text or ""
    depth = {"article": 0, "main": 0, "named": 0}  # open elements of a kind

    def flush():
        if not buffer:
            return
        joined = " ".join("".join(buffer).split())
        buffer.clear()
        if joined:
            owner = stack[-1]
            blocks.append((owner, joined))
            elements[owner].parts.append(joined)
            elements[owner].has_text = True

    def close():
        e = elements[stack[-1]]
        block = e.tag in BLOCK or e.dropped or e.named
        if block:
            flush()
        stack.pop()
        if e.area:
            depth[e.area] -= 1
        depth["named"] -= e.named
        up = elements[e.parent]
        if block:
            e.mark = xxhash.xxh64_intdigest("\x1f".join([e.tag, *e.parts])) >> 1
            up.parts.append(f"\x1e{e.mark}")
        else:
            up.parts.extend(e.parts)
        up.has_text |= e.has_text

    at = 0
    for m in _TAG.finditer(text):
        if m.start() > at:
            buffer.append(html.unescape(text[at:m.start()]))
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() in ("iframe", "textarea", "object"):
                buffer.append(" ")
            continue
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if tag == "br":
                buffer.append(" ")
            k = len(stack) - 1
            while k and elements[stack[k]].tag != tag:
                k -= 1
            if k:
                while len(stack) > k:
                    close()
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK or tag in ("br", "hr"):
            if tag == "br":
                buffer.append(" ")
            else:
                flush()
        if tag in VOID:
            continue
        if tag in ENDING:
            for k in range(len(stack) - 1, 0, -1):
                was = elements[stack[k]].tag
                if tag in ENDS_BEFORE.get(was, ()):
                    while len(stack) > k:
                        close()
                    break
                if was in BLOCK and was not in ENDS_BEFORE:
                    break
        area = "article" if depth["article"] else "main" if depth["main"] else ""
        e = _element(tag, m["attrs"], stack[-1], area, depth["named"] > 0)
        if e.area:
            depth[e.area] += 1
        depth["named"] += e.named
        if e.dropped or e.named:  # its text must not join the text before it
            flush()
        elements.append(e)
        stack.append(len(elements) - 1)
    buffer.append(html.unescape(text[at:]))
    flush()
    while len(stack) > 1:
        close()
    return Page(elements, blocks)


def subtree_marks(page: Page) -> list[int]:
    """Hashes of the block-level subtrees that hold text."""
    return sorted({e.mark for e in page.elements[1:] if e.mark and e.has_text})


def regions(page: Page) -> list[str]:
    """For each element, "article" or "main" if it lies in one or is one."""
    out = [""] * len(page.elements)
    for n, e in enumerate(page.elements[1:], start=1):
        out[n] = "article" if e.area == "article" else out[e.parent] or e.area
    return out


def inner_marks(page: Page) -> tuple[list[int], list[int]]:
    """Hashes of the subtrees that hold text in an article or main element: blocks, and running text."""
    blocks, running = set(), set()
    for e, r in zip(page.elements, regions(page)):
        if r and e.mark and e.has_text and not e.area:
            if e.tag in QUOTABLE:
                running.add(e.mark)
            elif e.tag not in RUNNING:
                blocks.add(e.mark)
    return sorted(blocks), sorted(running)


def main_text(page: Page, template: frozenset[int] | set[int], inner: frozenset[int] | set[int] | None = None) -> str:
    """``template``: marks to delete outside of article and main elements, ``inner``: inside."""
    elements = page.elements
    inner = template if inner is None else inner
    holds = [False] * len(elements)  # an article or main element below
    for n in range(len(elements) - 1, 0, -1):
        holds[elements[n].parent] |= holds[n] or bool(elements[n].area)
    gone, region = [False] * len(elements), regions(page)
    for n, e in enumerate(elements[1:], start=1):
        if region[n]:
            recurs = e.mark in inner and not holds[n] and not e.area and (e.tag not in RUNNING or e.tag in QUOTABLE)
        else:
            recurs = e.mark in template and not holds[n]
        # A named wrapper of an article is layout, but not inside another article.
        named = e.named and (not holds[n] or region[e.parent] == "article")
        # A form around the article is the page's frame, as some servers write it.
        dropped = e.dropped and not (e.tag == "form" and holds[n] and not region[e.parent])
        gone[n] = gone[e.parent] or dropped or named or recurs
    kept = [(region[n], t) for n, t in page.blocks if not gone[n]]
    for wanted in ("article", "main"):
        if any(r == wanted for r, _ in kept):
            return " ".join(t for r, t in kept if r == wanted)
    return " ".join(t for _, t in kept)


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


ANYWHERE, INNER_BLOCK, INNER_TEXT = range(3)  # kinds of marks


def _digest(parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) >> 1


def _marks(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            out, row = [], []
            for n, page in enumerate(parse(h) for h in part.column("html").to_pylist()):
                out.append((ANYWHERE, _digest(t for _, t in page.blocks), subtree_marks(page)))
                if any(inner := inner_marks(page)):
                    content = _digest([main_text(page, frozenset())])
                    out += [(kind, content, m) for kind, m in zip((INNER_BLOCK, INNER_TEXT), inner)]
                row += [n] * (len(out) - len(row))
            kind, content, marks = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column("host").take(pa.array(row)), part.column("page").take(pa.array(row)), pa.array(kind, pa.int32()),
                 pa.array(content, pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                names=["host", "page", "kind", "content", "marks"])


def page_marks(pages: DataFrame, *, url: str = "url", source: str = "html") -> DataFrame:
    """Rows (host, page, kind, content, marks) of each page; page is the digest of its html."""
    return stage(pages.select(_host(F.col(url)).alias("host"), _page(F.col(source)).alias("page"), F.col(source).alias("html"))
                 .transform(bounded).mapInArrow(_marks, "host string, page binary, kind int, content bigint, marks array<bigint>"))


def _page(source) -> F.Column:
    return F.unhex(F.md5(F.coalesce(source, F.lit(""))))


def site_marks(seen: DataFrame, *, min_pages: int = 5) -> DataFrame:
    """Rows (host, kind, mark): subtrees that recur on many different pages of the host."""
    different = seen.groupBy("host", "kind", "content").agg(F.min("marks").alias("marks"))
    counts = stage(different.select("host", "kind", F.explode("marks").alias("mark")).groupBy("host", "kind", "mark").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages))
    # Running text must be on most of the host's pages; a host with many marks may hold a third of them all.
    running = counts.filter(F.col("kind") == INNER_TEXT)
    n_pages = different.filter(F.col("kind") == INNER_TEXT).groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    hosts = stage(running.groupBy("host").agg(F.count(F.lit(1)).alias("marks")).join(n_pages, "host"))
    most = join_hot(running, hosts, "host", "marks").filter(F.col("n") * 2 > F.col("n_pages"))
    return counts.filter(F.col("kind") != INNER_TEXT).select("host", "kind", "mark").unionByName(
        most.select("host", "kind", "mark"))


def site_templates(pages: DataFrame, *, url: str = "url", source: str = "html", min_pages: int = 5) -> DataFrame:
    """Rows (host, marks): subtrees deleted outside of article and main elements."""
    found = site_marks(page_marks(pages, url=url, source=source), min_pages=min_pages).filter(F.col("kind") == ANYWHERE)
    return found.groupBy("host").agg(F.collect_set("mark").alias("marks"))


def _found(page: Page, codes: np.ndarray, host: int) -> set[int]:
    """The marks of a page that are among the sorted ``codes``, each a mark xor its host's hash."""
    marks = np.array(subtree_marks(page), np.int64)
    if not len(marks) or not len(codes):
        return set()
    own = marks ^ np.int64(host)
    return set(marks[codes[np.minimum(np.searchsorted(codes, own), len(codes) - 1)] == own].tolist())


def _texts(codes):
    """Main texts; template marks come from the broadcast ``codes``, or without them in the rows."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                pages = [parse(h) for h in part.column("html").to_pylist()]
                if codes:
                    marks = [[_found(p, c, h) for c in codes.value] for p, h in zip(pages, part.column("code").to_pylist())]
                else:
                    marks = [(set(m or ()), set(n or ())) for m, n in zip(*(part.column(c).to_pylist() for c in ("marks", "inner")))]
                texts = [main_text(p, m, n) for p, (m, n) in zip(pages, marks)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])
    return run


def extract_main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html",
                      min_pages: int = 5, broadcast_hosts: int = 100_000, broadcast_marks: int = 2_000_000) -> DataFrame:
    """One row per page: key, url, text, n_chars. Up to ``broadcast_marks`` template marks of
    ``broadcast_hosts`` hosts are broadcast; beyond that each page is joined with its own."""
    seen = page_marks(pages, url=url, source=source)
    templates = stage(site_marks(seen, min_pages=min_pages))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(source).alias("html"),
                        _host(F.col(url)).alias("host"), _page(F.col(source)).alias("page"))
    code, inside = F.xxhash64("host"), F.col("kind") != ANYWHERE
    if templates.count() <= broadcast_marks and templates.select("host").distinct().count() <= broadcast_hosts:
        codes = templates.select(F.col("mark").bitwiseXOR(code).alias("code"), inside.alias("inside")).toArrow()
        value, inner = codes.column("code").to_numpy(), codes.column("inside").to_numpy().astype(bool)
        shared = pages.sparkSession.sparkContext.broadcast((np.unique(value[~inner]), np.unique(value[inner])))
        out = rows.select("id", "url", "html", code.alias("code"))
    else:
        own = (seen.select("host", "page", "kind", F.explode("marks").alias("mark")).distinct()
               .join(templates, ["host", "kind", "mark"]).groupBy("host", "page")
               .agg(F.collect_set(F.when(~inside, F.col("mark"))).alias("marks"),
                    F.collect_set(F.when(inside, F.col("mark"))).alias("inner")))
        shared, out = None, rows.join(own, ["host", "page"], "left").select("id", "url", "html", "marks", "inner")
    out = bounded(out).mapInArrow(_texts(shared), f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", key).withColumnRenamed("url", url)
