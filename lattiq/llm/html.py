"""Main text of web pages by removal of site templates.

A page is parsed into elements and text blocks. Every block element, be it nav, div or paragraph, has a
hash of its subtree (tags, classes, text). Spark counts, per host, on how many distinct pages each hash
occurs (exact copies of a page count once). A subtree that recurs on MIN_PAGES pages of its host, however many the
host has, is template and is deleted. In a second step go elements that are menus, forms, notices,
adverts, comments and the like by tag, role or whole class tokens, since such parts can differ on every
page. Nothing in an article that a page names, nor what holds it, is counted or deleted as template; inline
elements are never looked at by name. What is left of the article (of the body, if a page names none) is the text.

On a page that names no article, near copies of the page make its own paragraphs recur. Of the recurring subtrees there,
those under one parent that have the most text together therefore stay if that is more than MIRROR times what no
template takes.

The recurring hashes go to the tasks as one sorted array if there are at most BROADCAST_HASHES of
them; beyond that, each page's own ones are joined to it by a hash of its html.

Defined results: a null or empty page has empty text; pages without a host in the url (or a null url) share
the host ""; unclosed and stray tags are repaired as browsers do in simple cases; character references
are decoded; repeated rows, null page_ids and ties are extracted alike, and count as one page; a page of any
length is read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Stash, arrow_map, table

#: A subtree is template from so many distinct pages of its host on.
MIN_PAGES = 5
#: Recurring text of so many times the rest of a page without article is the article.
MIRROR = 2
BROADCAST_HASHES = 1 << 20

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed values of the HTML standard and of common practice.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
UNWANTED = frozenset("nav footer aside form script style noscript template iframe head title svg button select textarea dialog menu object canvas audio video xmp noframes option".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar".split())
#: Words of class and id tokens that name parts beside the article, and words that may stand with them.
NAMES = frozenset("ad ads adverts advert advertising advertisement sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices notification newsletter subscribe subscription popup modal overlay share sharing social related recommended comment comments commentlist respond disqus replies login signup search pagination pager toolbar widget widgets masthead skip skiplink".split())
BESIDE = frozenset("site page top bottom main global left right primary secondary list box bar block area section container wrapper wrap inner outer links link buttons button posts articles items item form panel".split())
#: What an opening tag closes when left open, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_FLOW = BLOCKS - {"li", "dd", "dt", "tr", "td", "th", "option", "body", "html", "tbody", "thead", "tfoot"}


class Element:
    """``own``: unwanted by itself; ``article``: marked as article; ``skip``: inline and not shown."""

    __slots__ = ("tag", "parent", "own", "header", "article", "skip", "text", "sum", "hash")

    def __init__(self, tag, parent, attrs):
        self.tag, self.parent, self.hash, self.text = tag, parent, None, 0
        block = tag in BLOCKS
        tokens = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split() if block and attrs else ()
        hidden = bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or "") is not None)
        own = tag in UNWANTED or hidden or attrs.get("role") in ROLES
        self.skip = own and not block or parent is not None and parent.skip and not block
        self.own = own or tag not in ("body", "html") and any(map(_beside, tokens))
        self.header = tag == "header" or any(set(re.split("[_-]+", t)) <= {"header", *BESIDE} and "header" in t for t in tokens)
        self.article = (tag in ("article", "main") or attrs.get("role") in ("main", "article")) and not self.own
        self.sum = [f"<{tag} {' '.join(sorted((attrs.get('class') or '').split()))}>"]


def _beside(token: str) -> bool:
    """Whether a class token as a whole names a part beside the article: has-sidebar doesn't, sidebar-left does."""
    parts = [p for p in re.split("[_-]+", token) if p and not p.isdigit()]
    return any(p in NAMES for p in parts) and all(p in NAMES or p in BESIDE for p in parts)


def parse(page: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """Text blocks (element, raw text) in page order, and all elements, with the hashes of subtrees."""
    root = Element("html", None, {})
    stack, elements, blocks, text = [root], [root], [], []

    def flush():
        if text:
            words = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if words:
                blocks.append((stack[-1], words))
                stack[-1].sum.append(words)
                stack[-1].text += len(words)

    def read(raw):
        if stack[-1].skip:
            stack[-1].sum.append(raw)
        else:
            text.append(raw)

    def close(k):
        while len(stack) > k:
            e = stack.pop()
            e.hash = hashlib.blake2b("\x00".join(e.sum).encode("utf-8", "replace"), digest_size=8).digest()
            if e.parent is not None:
                e.parent.sum.append(e.hash.hex())
                e.parent.text += e.text
            e.sum = None

    at, raw = 0, None
    while at < len(page):
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = m.end() if m else len(page)
            raw = None
            continue
        m = _TAG.search(page, at)
        if not m:
            read(page[at:])
            break
        if m.start() > at:
            read(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                read(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if closing:
            if tag in BLOCKS:
                flush()
            k = len(stack) - 1
            while k > 0 and stack[k].tag != tag:
                k -= 1
            if k > 0:
                if tag not in BLOCKS and any(e.tag in BLOCKS for e in stack[k + 1 :]):
                    continue  # misnested inline end: the blocks stay open
                close(k)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            read("\n")
            continue
        if tag in BLOCKS:
            flush()
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        if tag in _FLOW:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in BLOCKS), 0)
            if stack[k].tag == "p":
                close(k)
        if tag in _CLOSES:
            shut, until = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in shut:
                    close(i)
        attrs = {a[0].lower(): html_lib.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3] or m[6] or "")} if (m[3] or m[6]) else {}
        if tag in RAW:
            raw = tag
            continue
        if tag in VOID or (m[3] or m[6] or "").endswith("/") and tag not in BLOCKS:
            continue
        e = Element(tag, stack[-1], attrs)
        stack.append(e)
        elements.append(e)
    flush()
    close(0)
    return blocks, elements


def judge(elements: list[Element]) -> tuple[set[Element], set[Element], set[Element]]:
    """What is unwanted, what lies in an article, and articles with all that holds them.

    Articles are the marked elements outside unwanted ones; if all marked ones lie in unwanted ones, the one with
    most text.
    """
    under, marked = set(), []  # ``elements`` has parents first
    for e in elements:
        if e.own or e.parent in under:
            under.add(e)
        if e.article:
            marked.append(e)
    articles = [e for e in marked if e not in under] or sorted(marked, key=lambda e: -e.text)[:1]
    holds = set(articles)
    for e in articles:
        while e.parent is not None and e.parent not in holds:
            e = e.parent
            holds.add(e)
    unwanted, inside, named = set(), set(), set(articles)
    for e in elements:
        within = e in named or e.parent in inside
        if within:
            inside.add(e)
        if e.parent in unwanted or e not in holds and (e.own or e.header and not within):
            unwanted.add(e)
    return unwanted, inside, holds


def subtree_keys(host: str, elements: list[Element], inside: set[Element], holds: set[Element]) -> tuple[list[Element], np.ndarray]:
    """The block elements that may be template, and 64-bit keys of host and subtree: all but those that hold, are or lie
    in an article."""
    some = [e for e in elements if e.text and e.tag in BLOCKS and e.tag not in ("html", "body") and e not in holds and e not in inside]
    salt = hashlib.blake2b(host.encode(), digest_size=8).digest()
    keys = b"".join(hashlib.blake2b(salt + e.hash, digest_size=8).digest() for e in some)
    return some, np.frombuffer(keys, np.int64)


def extract_text(page: str | None, host: str = "", template=None) -> str:
    """The main text; ``template`` tells which of an array of keys of subtree_keys are template."""
    if not page:
        return ""
    blocks, elements = parse(page)
    unwanted, inside, holds = judge(elements)
    gone = set()
    if template is not None:
        some, keys = subtree_keys(host, elements, inside, holds)
        gone = {some[i] for i in np.flatnonzero(template(keys))}
    wanted = [(e, words) for e, words in blocks if e not in unwanted and (not inside or e in inside)]
    if not gone:
        return "\n\n".join(words for _, words in wanted)
    by, left, groups = [], 0, {}
    for e, words in wanted:
        top = None
        while e is not None:
            top = e if e in gone else top
            e = e.parent
        by.append(top)
        if top is None:
            left += len(words)
        else:
            groups[top.parent] = groups.get(top.parent, 0) + len(words)
    kept = {None}
    if groups:
        most = max(groups, key=groups.get)
        if groups[most] > MIRROR * left:
            kept |= {top for top in by if top is not None and top.parent is most}
    return "\n\n".join(words for (_, words), top in zip(wanted, by) if top in kept)


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def page_keys(pages: DataFrame) -> DataFrame:
    """(host, page, key), once for each distinct page of a host: hashes of host, html and subtrees."""

    def keys(batches):
        for batch in batches:
            which, found = [], []
            for i, (host, page) in enumerate(zip(batch.column("name").to_pylist(), batch.column("html"))):
                elements = parse(page.as_py() or "")[1]
                mine = np.unique(subtree_keys(host, elements, *judge(elements)[1:])[1])
                which.append(np.full(len(mine), i))
                found.append(mine)
            which = np.concatenate(which) if which else np.zeros(0, np.int64)
            cols = [batch.column(c).take(pa.array(which)) for c in ("host", "page")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["host", "page", "key"])

    rows = pages.select(_host(F.col("url")).alias("name"), "html").select("name", F.xxhash64("name").alias("host"), F.xxhash64("html").alias("page"), "html")
    return arrow_map(rows, keys, "host long, page long, key long").distinct()


def template_keys(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(key) of the subtrees that recur on many distinct pages of their host."""
    return found.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("key").distinct()


def extract(pages: DataFrame, broadcast_hashes: int = BROADCAST_HASHES, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = Stash(page_keys(pages), "subtrees")
    recurring = Stash(template_keys(found.df, min_pages), "templates").df
    fields = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))
    sent = None
    if recurring.count() <= broadcast_hashes:
        found.drop()
        sent = pages.sparkSession.sparkContext.broadcast(np.sort(recurring.toPandas()["key"].to_numpy(np.int64)))
        fields = fields.drop("page")
    else:  # a page's own template keys, at most its block elements, go along with it
        mine = found.df.join(recurring, "key").groupBy("page").agg(F.collect_set("key").alias("keys"))
        fields = fields.hint("merge").join(mine, "page", "left").select("page_id", "url", "html", "host", "keys")

    def texts(batches):
        for batch in batches:
            out = []
            for i, host in enumerate(batch.column("host").to_pylist()):
                known = sent.value if sent is not None else np.sort(np.array(batch.column("keys")[i].as_py() or (), np.int64))

                def template(keys, known=known):
                    at = np.searchsorted(known, keys)
                    return known[np.minimum(at, len(known) - 1)] == keys

                out.append(extract_text(batch.column("html")[i].as_py(), host, template if len(known) else None))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(fields, texts, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
