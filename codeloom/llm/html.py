"""Main text of web pages, with the help of a suffix array over each host.

A page becomes blocks of text. Blocks inside the article (or main) element are its text, except for
what markup declares as something else and for template lines: suffixes that begin a block are grouped
to the block's end, and a group with half of the host's distinct articles (PAGES at least) is a line of
the template, unless it is a heading. Equal articles count once, so copies and quoted passages stay. All other visible blocks of a host's pages are concatenated,
page by page, into token streams, and their suffixes are sorted; only their first RUN tokens
matter, so suffixes that agree on them form a group, and a group with PAGES distinct pages is a
substring that the host repeats, if these are a SHARE of the host's pages, too. Pages of the same visible
text count once. Blocks that such substrings cover from end to end are boilerplate; a block of which
only a part is repeated stays whole. On a page without an article element, the blocks that are left and
not declared as boilerplate are the text; pages with one only add evidence of what their host repeats.
"""

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import STEP, mix, text_batches
from codeloom.session import materialise

RUN = 5  # tokens of the shortest repeated substring
PAGES = 3  # distinct pages of the host that make a substring boilerplate, at least
SHARE = 0.1  # of the host's distinct pages that make it so
HALF = 0.5  # of the host's distinct articles that make a whole block of them a template line

#: Fixed values of the markup language and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset(
    "head script style template noscript iframe object embed svg math canvas audio video map title textarea select option "
    "optgroup datalist noembed noframes xmp".split()
)
DECLARED = frozenset("nav header footer aside form button dialog menu search label legend fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription signup sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager toolbar footer header masthead comment comments disqus respond reply replies share sharing social related "
    "recommended recommendations widget login search skip".split()
)
#: Words that may stand beside such a name in a class ("site-footer", "ad-slot") without giving it another meaning.
BESIDE = frozenset(
    "site page global main primary secondary top bottom left right inner outer wrap wrapper container box block area section "
    "region panel slot unit zone bar strip row column list item items link links button buttons icon icons text title form "
    "widget widgets post posts article articles stories news topics reading module mobile desktop sticky fixed floating js".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def named(token):
    """What a class or id says its element is: "header", another name of NAMES, or None.

    A name counts alone or beside words that don't change it: "no-sidebar", "content-with-sidebar" or
    "related-work" declare nothing. A modifier after two hyphens is left out.
    """
    words = [w for w in re.split(r"[^a-z]+", token.partition("--")[0]) if w]
    own = [w for w in words if w in NAMES]
    if not own or any(w not in NAMES and w not in BESIDE for w in words):
        return None
    return "header" if own[-1] in ("header", "masthead") else own[-1]


def declared(tag, rest):
    """Whether an element's tag, role, name or style says that it isn't article text; "header" for a header."""
    if tag in DECLARED:
        return "header" if tag == "header" else True
    if not rest or rest.isspace() or "=" not in rest and "hidden" not in rest:
        return False
    found = False
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), html.unescape("".join(values)).lower()
        if name in ("class", "id"):
            if tag in ("body", "html"):
                continue
            names = set(value.split()) & NAMES if tag in ("article", "main") else set(map(named, value.split())) - {None}
            if names - {"header"}:
                return True
            found = found or ("header" if names else False)
        elif name == "role" and value.strip() in ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return found


class Open:
    """An open element: its tag, whether it is in an article, declared, unseen, in a heading; ended if only its end tag was met."""

    __slots__ = ("tag", "article", "mark", "unseen", "heading", "ended")

    def __init__(self, tag, article, mark, unseen, heading):
        self.tag, self.article, self.mark, self.unseen, self.heading, self.ended = tag, article, mark, unseen, heading, False


def parsed(page):
    """(text, in article, declared, heading) of the visible blocks of a page, in order.

    Linear in the page, whatever its tags: the places of open elements are kept by tag, so an end tag
    without its start costs nothing, and an element closed out of order only when it comes to the top.
    """
    found, text, stack, places, open_blocks = [], [], [], {}, []

    def flush():
        if text:
            value = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if value:
                top = stack[-1] if stack else None
                found.append((value, bool(top and top.article), top.mark if top else False, bool(top and top.heading)))

    def drop(count):
        """Takes elements off the stack, down to ``count``, and ended ones below."""
        while stack and (len(stack) > count or stack[-1].ended):
            top = stack.pop()
            if not top.ended:
                places[top.tag].pop()
                if top.tag in BLOCKS:
                    open_blocks.pop()

    def close(at):
        flush()
        drop(at)

    def start(tag, rest):
        if tag in BLOCKS:
            flush()
            if open_blocks and stack[open_blocks[-1]].tag == "p":
                drop(open_blocks[-1])
            if tag in CLOSED_BY:
                for at in reversed(open_blocks[-6:]):
                    if stack[at].tag in CLOSED_BY[tag]:
                        drop(at)
                        break
                    if stack[at].tag not in HEADINGS and stack[at].tag != "p":
                        break
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img", "input"):
                text.append("" if tag == "wbr" else " ")
            return
        top = stack[-1] if stack else Open("", False, False, False, False)
        article, mark = top.article, top.mark
        own = declared(tag, rest)
        if tag in HEADINGS and article and mark == "header":
            mark = False
        if own and not mark and tag in BLOCKS:
            mark = "header" if own == "header" and article else True
        if tag in ("article", "main") and not own and not mark or "role" in rest and re.search(r"role\s*=\s*[\"']?main", rest):
            article = True
        inside = bool(own) and tag not in BLOCKS  # goes without ending the block around it
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append(Open(tag, article, mark, top.unseen or inside or tag in UNSEEN, top.heading or tag in HEADINGS))

    at, page = 0, page or ""
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        seen = not (stack and stack[-1].unseen)
        if lt > at and seen:
            text.append(page[at:lt])
        if lt == len(page):
            break
        token = TOKEN.match(page, lt)
        if not token:
            if seen:
                text.append("<")
            at = lt + 1
            continue
        at = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", lt) and seen:
                text.append(html.escape(token[0][9:].removesuffix("]]>"), False))
            continue
        rest = token["rest"] or token["rest2"] or ""
        if token["end"] or token["end2"]:
            if places.get(tag):
                if tag in BLOCKS:
                    close(places[tag][-1])
                else:
                    stack[places[tag].pop()].ended = True  # blocks opened inside it go on
                    drop(len(stack))
            elif tag in BLOCKS:
                flush()
            continue
        start(tag, rest)
        if tag in RAW and not rest.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return found


def blocks(page):
    """(text, in article, declared) of the visible blocks of a page, in order."""
    return [block[:3] for block in parsed(page)]


def signed(text):
    """64-bit hash of a text as a signed number."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def token_hashes(other):
    return [xxhash.xxh3_64_intdigest(w) for text in other for w in text.split()]


def heads_of(host, tokens):
    """Hashes of the first RUN tokens of each suffix of a page's stream, told apart by host."""
    n = max(len(tokens) - RUN + 1, 0)
    own = np.array(tokens, np.uint64)
    head = np.full(n, xxhash.xxh3_64_intdigest(host), np.uint64)
    for i in range(RUN):
        head = mix((head ^ own[i : i + n]) * STEP)
    return head.view(np.int64)


def evidence(pages: DataFrame) -> DataFrame:
    """(t1, t2, id, url, site, content, heads, bare, other, marks, story, keys) of (t1, t2, id, url, host, html).

    ``site`` and ``content`` are hashes of the host and of the visible text, ``heads`` those of the text outside
    the article; the blocks themselves stay for pages without an article only. ``story`` is a hash of an
    article's text, null without one, and ``keys`` those of its blocks, told apart by host.
    """
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                own = batch.slice(first, 64)
                columns = [[] for _ in range(8)]
                for host, page in zip(own.column(4).to_pylist(), own.column(5).to_pylist()):
                    whole = parsed(page)
                    found = [block[:3] for block in whole]
                    bare = not any(a for _, a, _ in found)
                    rest = [(t, bool(d)) for t, a, d in found if not a or d]
                    columns[0].append(signed(host))
                    columns[1].append(signed("\n".join(t for t, _, _ in found)))
                    columns[2].append(heads_of(host, token_hashes([t for t, _ in rest])))
                    columns[3].append(bare)
                    columns[4].append([t for t, _ in rest] if bare else [])
                    columns[5].append([d for _, d in rest] if bare else [])
                    own_text = [(t, h) for t, a, d, h in whole if a and not d]
                    columns[6].append(signed("\n".join(t for t, _ in own_text)) if own_text else None)
                    columns[7].append([None if h else signed(f"{host}\0{t}") for t, h in own_text])  # headings stay
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.int64()]
                kinds.append(pa.list_(pa.int64()))
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                names = ["t1", "t2", "id", "url", "site", "content", "heads", "bare", "other", "marks", "story", "keys"]
                yield pa.RecordBatch.from_arrays([*own.columns[:4], *arrays], names)

    schema = f"t1 bigint, t2 bigint, id {kind}, url string, site bigint, content bigint, heads array<bigint>, bare boolean"
    return pages.mapInArrow(run, f"{schema}, other array<string>, marks array<boolean>, story bigint, keys array<bigint>")


def article_texts(pages: DataFrame) -> DataFrame:
    """(id, url, text, n_chars) of the pages (id, url, html, lines) that have an article, without template lines."""
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                own, rows, texts = batch.slice(first, 64), [], []
                for i, (page, lines) in enumerate(zip(own.column(2).to_pylist(), own.column(3).to_pylist())):
                    found = blocks(page)
                    if any(a for _, a, _ in found):
                        rows.append(i)
                        gone = set(lines or ())
                        texts.append("\n\n".join(t for k, t in enumerate(t for t, a, d in found if a and not d) if k not in gone))
                kept = own.take(pa.array(rows, pa.int64()))
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array(texts, pa.string()), sizes], ["id", "url", "text", "n_chars"]
                )

    return pages.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")


def often(known, content, values, share) -> DataFrame:
    """(value): elements of the array ``values`` that PAGES distinct contents of a host, and a share of them, hold."""
    pages = known.where(F.col(content).isNotNull()).select("site", content, values).dropDuplicates(["site", content])
    number = pages.groupBy("site").agg(F.count("*").alias("of"))
    each = pages.select("site", F.explode_outer(F.array_distinct(values)).alias("value")).where("value is not null")
    found = each.groupBy("site", "value").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES)
    return found.join(number, "site").where(F.col("pages") >= F.col("of") * share).select("value").distinct()


def uncovered(other, marks, places):
    """The blocks that aren't declared boilerplate and hold a token that no repeated substring covers."""
    kept, at = [], 0
    covered = {p + i for p in places or () for i in range(RUN)}
    for text, mark in zip(other, marks):
        size = len(text.split())
        if not mark and not covered.issuperset(range(at, at + size)):
            kept.append(text)
        at += size
    return "\n\n".join(kept)


def main_text(df: DataFrame, key="page_id", url="url", page="html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``df``.

    Null and empty pages have an empty text; a null url is a host of its own. Character references are
    decoded, each run of white space is one space, blocks are joined by two line ends. Unclosed
    elements end where their parent ends, a paragraph also where the next block begins; end tags without
    a start are passed over, in time linear in the page. Repeated rows
    are all returned; pages of one visible text count as one page of their host. A page is parsed twice, which
    costs less than storing its text.
    """
    text_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    rows = rows.select(
        F.xxhash64(F.col("id").cast("string"), "url").alias("t1"), F.xxhash64("html").alias("t2"), "id", "url", host.alias("host"), "html"
    )
    known = materialise(evidence(rows), "evidence")
    shared = materialise(often(known, "content", "heads", SHARE), "shared").withColumnRenamed("value", "head")
    bare = known.where("bare")
    heads = bare.select("t1", "t2", F.posexplode_outer("heads").alias("pos", "head"))
    places = heads.join(shared, "head").groupBy("t1", "t2").agg(F.collect_set("pos").alias("places"))
    joined = bare.join(places, ["t1", "t2"], "left").select("id", "url", "other", "marks", "places")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = batch.select(["other", "marks", "places"]).to_pylist()
            texts = [uncovered(r["other"], r["marks"], r["places"]) for r in rows]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "url", "text", "n_chars"])

    left = joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    lines = materialise(often(known, "story", "keys", HALF), "lines").withColumnRenamed("value", "key")
    keys = known.select("t1", "t2", F.posexplode_outer("keys").alias("pos", "key"))
    lines = materialise(keys.join(lines, "key").groupBy("t1", "t2").agg(F.collect_set("pos").alias("lines")), "lines")
    articles = rows.join(lines, ["t1", "t2"], "left").select("id", "url", "html", "lines")
    return article_texts(articles).unionByName(left)
