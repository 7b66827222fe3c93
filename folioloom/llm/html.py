"""Main text of web pages: structure first, then differencing of what is in doubt with the page of the nearest URL.

What the page tells goes first: menus, footers, forms, scripts and the like by element or role, adverts, sidebars, comments and notices by
classes and ids that are made of such words only. An article (or a main element) tells which blocks are the text; one inside a form or a notice
does so if the page has no other. What is left in
doubt is compared with the nearest page: pages of a host are ordered by URL path, a page is paired with the neighbour that shares the longer path
prefix, their lines are aligned by longest common subsequence, and shared lines in doubt are deleted. In doubt are, on a page
that tells no article, all its lines; in an article those under a class or id that has such a word among others ("related-work"), or one that texts use as well ("discussion").

Differencing alone cannot give the article: adverts and footers differ from page to page, and copies of an article on one
host share all their lines. So an article's other lines are never deleted, and a page that shares most of them tells nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm._common import by_column, written

# Elements by what becomes of them.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
DROPPED = RAW | set("head nav footer aside form menu dialog search fieldset".split())
#: Elements inside a line: what they hold goes, the line goes on.
INLINE_DROPPED = set("button select datalist svg canvas object audio video map applet".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status toolbar".split())
# Words of classes and ids that mark what is no article, and words that say no more than where such a thing is.
MARKS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs toc footer masthead comment comments commentlist respond disqus reply replies "
    "notice notices cookie cookies consent gdpr alert alerts popup popups modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget widgets toolbar pagination pager disclaimer copyright paywall search searchbox skip discussion".split()
)
PLACES = set(
    "site page main global top bottom left right upper lower inner outer primary secondary header head body content container wrapper wrap holder box block area zone region section "
    "slot unit bar panel pane row column col list item items links link button buttons btn icon icons form field text title heading label image img thread post posts article articles "
    "story stories entry entries user reader readers author web mobile desktop sticky fixed small large big first last js wp s a 1 2 3 4 5".split()
)
# Whole classes or ids of a page's head, and of what holds its text where no element says so.
HEADS = set("header site-header page-header top-header global-header main-header header-top".split())
CONTENT = set("content main-content page-content article article-body article-content article-text post post-body post-content entry entry-content story story-body main-text body-text body-content".split())
# Elements, roles, and words of classes and ids of things that some pages wrap around their whole article.
WRAPPERS = set("form fieldset dialog".split())
WRAPPER_MARKS = set("form alert alerts alertdialog notice notices modal overlay popup popups widget widgets dialog status paywall".split())
# Words that inside an article are as often its own as not; the second are so of paragraphs only.
WEAK, WEAK_LINES = set("discussion toc disclaimer promotion subscription consent".split()), set("reply replies comment".split())
#: Classes of these are not judged: they hold everything.
HOLDERS = {"html", "body", "main"}

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|([^>]*)(?:>|\Z))|</?\Z|</[^a-zA-Z][^>]*(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_URL = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)")

#: WRAPPED: structure that an article may still be in; RESCUED: such an article, which is one if the page has no other.
STRUCTURE, DOUBTFUL, MAIN, ARTICLE, WRAPPED, RESCUED = range(6)
#: Added to a kind: in doubt, though inside what holds the text.
SUSPECT = 8
#: Inside an inline element that is no part of the article: its text is left out and the block goes on.
HIDDEN = -1


def _named(name: str, inside: bool, line: bool = False) -> str | None:
    """What a class or id, of a paragraph if ``line``, says: 'structure', 'wrapper', 'content', 'suspect' or nothing."""
    parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if p]
    whole = "-".join(parts)
    if whole in HEADS and not inside:
        return "structure"
    marks = {p for p in parts if p in MARKS}
    if marks:
        if not all(p in MARKS or p in PLACES for p in parts) or inside and marks <= (WEAK | WEAK_LINES if line else WEAK):
            return "suspect"
        return "wrapper" if marks <= WRAPPER_MARKS else "structure"
    return "content" if whole in CONTENT else None


def _told(attributes: str, tag: str, inside: bool) -> int | None:
    """What role, class, id or style tell of an element: STRUCTURE or WRAPPED if it is no part of an article, MAIN or ARTICLE if it holds the text, SUSPECT if it may be either, or nothing."""
    if not attributes.strip():
        return None
    at: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        at.setdefault((m[1] or m[5]).lower(), unescape(m[2] or m[3] or m[4] or ""))
    role = at.get("role", "").lower().strip()
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "")):
        return STRUCTURE
    if role in ROLES:
        return WRAPPED if role in WRAPPER_MARKS else STRUCTURE
    if role in ("main", "article"):
        return MAIN if role == "main" else ARTICLE
    if tag in HOLDERS:
        return None
    # Ids of headings, and inside a text those of paragraphs and sections, are made of their words.
    ids = [] if tag in HEADINGS else at.get("id", "").split()
    said = {_named(n, inside, tag in ("p", "span", "blockquote")) for n in at.get("class", "").split()}
    slug = {_named(n, inside) for n in ids}
    if inside and tag in ("p", "section", "span", "a"):
        slug = {"suspect" if s in ("structure", "wrapper") else s for s in slug}
    said |= slug
    if tag == "article":
        return STRUCTURE if re.search(r"(?i)\b(?:comments?|reply)\b", at.get("class", "") + " " + at.get("id", "")) else None
    if "structure" in said:
        return STRUCTURE
    if "wrapper" in said:
        return WRAPPED
    if "suspect" in said and inside:
        return SUSPECT
    return MAIN if "content" in said and tag in ("div", "section", "td") else None


def blocks_of(html: str) -> list[tuple[str, int]]:
    """(text, kind) of each non-empty block in page order; structure is what is dropped whatever else the page has.

    A block is suspect (SUSPECT is added to its kind) if all of it is.
    """
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    # Open elements with the kind of what they hold, and how many there are of each tag. Inline elements outside structure
    # change nothing and are not held, so unclosed ones do not pile up.
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    kind = of = DOUBTFUL  # of: the kind of what is in the buffer
    at = 0

    def add(text: str) -> None:
        nonlocal of
        if kind != HIDDEN:
            of = kind if not buffer else of - SUSPECT if of >= SUSPECT > kind and text.strip() else of
            buffer.append(text)

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append((text, STRUCTURE if of == WRAPPED else of))
            buffer.clear()

    def pop_to(n: int) -> None:
        nonlocal kind
        if any(k != HIDDEN and (t in BLOCKS or t in DROPPED or k % SUSPECT != (stack[n - 1][1] if n else DOUBTFUL) % SUSPECT) for t, k in stack[n:]):
            flush()
        for t, _ in stack[n:]:
            opened[t] -= 1
        del stack[n:]
        kind = stack[-1][1] if stack else DOUBTFUL

    def close(tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        """What a start tag ends by itself."""
        if not any(opened.get(t) for t in tags):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return pop_to(i)
            if stack[i][0] in until:
                return None

    while True:
        m = _MARKUP.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            add(unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif tag == "p" and kind != HIDDEN:
                flush()
            continue
        attributes = m[3] if m[3] is not None else m[4] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = end.start() if end else len(html)
            if end:
                at = html.find(">", end.start()) + 1 or len(html)
            if tag != "noscript":
                add("" if tag in ("script", "style", "template") else " ")
            continue
        if tag in ("br", "wbr", "td", "th"):
            add("" if tag == "wbr" else " ")
        if tag in BLOCKS:
            close(("p",), ("table", "td", "th", "button", "object", "article", "section", "div", "li", "blockquote", "body"))
        if tag == "li":
            close(("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            close(("dt", "dd"), ("dl",))
        elif tag == "tr":
            close(("tr",), ("table",))
        if (tag in BLOCKS or tag in DROPPED) and kind != HIDDEN:
            flush()
        if tag in VOID:
            continue
        now = kind
        if kind not in (STRUCTURE, HIDDEN):
            inside = kind % SUSPECT in (ARTICLE, MAIN, RESCUED)
            told = STRUCTURE if tag in DROPPED or tag in INLINE_DROPPED or (tag == "header" and not inside) else _told(attributes, tag, inside)
            if told == STRUCTURE and tag in WRAPPERS:
                told = WRAPPED
            if told in (STRUCTURE, WRAPPED):
                now = told if tag in BLOCKS or tag in DROPPED else HIDDEN
            elif kind == WRAPPED:
                now = RESCUED if tag in ("article", "main") or told in (ARTICLE, MAIN) else WRAPPED
            elif tag == "article" or told == ARTICLE:
                now = RESCUED if kind % SUSPECT == RESCUED else ARTICLE
            elif (tag == "main" or told == MAIN) and kind % SUSPECT not in (ARTICLE, RESCUED):
                now = MAIN
            elif told == SUSPECT and kind < SUSPECT:
                now = kind + SUSPECT
        inline = tag not in BLOCKS and tag not in DROPPED
        if now != kind and now != HIDDEN and not (inline and now % SUSPECT == kind % SUSPECT):
            flush()
        if inline and (attributes.rstrip().endswith("/") or now == kind and kind not in (STRUCTURE, HIDDEN)):
            continue
        stack.append((tag, now))
        opened[tag] = opened.get(tag, 0) + 1
        kind = now
    flush()
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path, without the last slash; both empty where there is none."""
    m = _URL.match(url or "")
    return (m[1].lower(), m[2].rstrip("/")) if m else ("", (url or "").split("?")[0].split("#")[0])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, by bit vectors; halves of a where the vectors are too many."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = [*range(lo), *range(len(a) - hi, len(a))]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not x or not y or not set(x) & set(y):
        return ends

    def vectors(x: list[int], y: list[int], keep: bool) -> list[int]:
        mask: dict[int, int] = {}
        for j, v in enumerate(y):
            mask[v] = mask.get(v, 0) | 1 << j
        full = (1 << len(y)) - 1
        s, rows = full, []
        for v in x:
            u = s & mask.get(v, 0)
            s = ((s + u) | (s - u)) & full
            if keep:
                rows.append(s)
        return rows if keep else [s]

    if len(x) * len(y) <= 1 << 28:
        rows = vectors(x, y, True)
        found, i, j = [], len(x), len(y)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                found.append(lo + i)
        return sorted(ends + found)
    half = len(x) // 2
    up = vectors(x[:half], y, False)[0]
    down = vectors(x[half:][::-1], y[::-1], False)[0]
    best, cut, left = -1, 0, 0
    right = sum(1 for j in range(len(y)) if not down >> j & 1)
    for j in range(len(y) + 1):  # y is cut where both halves share most
        if left + right > best:
            best, cut = left + right, j
        if j < len(y):
            left += not up >> j & 1
            right -= not down >> (len(y) - 1 - j) & 1
    one, two = common_lines(x[:half], y[:cut]), common_lines(x[half:], y[cut:])
    return sorted(ends + [lo + i for i in one] + [lo + half + i for i in two])


EXTRACTED = "page_id long, url string, row_key long, host string, path string, text string, blocks array<string>, places array<int>, judged array<boolean>, lines array<long>"


def _extract(pages: DataFrame) -> DataFrame:
    """text of pages of which nothing is in doubt; else blocks, their places among the lines, which are in doubt, and hashes of all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, keys, htmls in by_column(batches, "page_id", "url", "row_key", "html"):
            out = []
            for url, html in zip(urls.to_pylist(), htmls.to_pylist()):
                found = blocks_of(html or "")
                kinds = {k % SUSPECT for _, k in found}
                best = next((k for k in (ARTICLE, RESCUED, MAIN) if k in kinds), DOUBTFUL)
                kept = [(i, t, best == DOUBTFUL or k >= SUSPECT) for i, (t, k) in enumerate(found) if k % SUSPECT == best]
                lines = [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in found]
                if any(doubt for _, _, doubt in kept):
                    out.append((*split_url(url), None, *([x[j] for x in kept] for j in (1, 0, 2)), lines))
                else:
                    out.append((*split_url(url), "\n\n".join(t for _, t, _ in kept), None, None, None, lines))
            kinds_ = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, urls, keys, *(pa.array(c, t) for c, t in zip(zip(*out), kinds_))], ["page_id", "url", "row_key", "host", "path", "text", "blocks", "places", "judged", "lines"])

    return pages.mapInArrow(run, EXTRACTED)


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _neighbours(light: DataFrame, parts: int) -> DataFrame:
    """host, line_key (a hash of the lines), shared: which lines a page has in common with that of its host, among those with other lines, whose URL path is nearest.

    Pages of a host with the same lines are one here, at the least of their paths: a copy would take all of a page's lines. If any of them is
    doubtful it stands for all, since the same lines have the same lines in common.

    Pages are range-partitioned by host and path, so a host with a third of all pages is spread. A partition also gets the last
    page before it and the first one after it: two rows a partition, whatever the number of pages.
    """
    order = ["host", "path", "page_id", "row_key"]
    same = light.withColumn("line_key", F.xxhash64("lines"))
    one = same.groupBy("host", "line_key").agg(F.min(F.struct("path", "page_id", "row_key")).alias("o"), F.max("doubtful").alias("doubtful"), F.first("lines").alias("lines"))
    light = one.select("host", "o.*", "lines", "doubtful", "line_key")
    dealt = written(light.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    row = F.struct(*order, "lines", "doubtful", "line_key")
    ends = dealt.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    w = Window.orderBy("part")  # one row a partition
    near = ends.select("part", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    ghosts = near.select("part", F.explode(F.array("before", "after")).alias("g")).where(F.col("g").isNotNull()).select("part", "g.*", F.lit(True).alias("ghost"))
    both = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition(parts, "part").sortWithinPartitions("part", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages in order; no more than three are held."""
        held: list[tuple] = []  # part, host, path, line_key, doubtful, ghost, lines

        def judged(i: int) -> tuple | None:
            part, host, path, key, doubtful, ghost, lines = held[i]
            beside = [x for j in (i - 1, i + 1) if 0 <= j < len(held) and (x := held[j])[:2] == (part, host)]
            if ghost or not doubtful or not beside:
                return None
            other = max(beside, key=lambda x: _shared_prefix(path, x[2]))  # the one before, of equals
            return host, key, common_lines(lines.as_py(), other[6].as_py())

        def told(rows: list[tuple]) -> pa.RecordBatch:
            hosts, keys, shared = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(shared, pa.list_(pa.int32()))], ["host", "line_key", "shared"])

        for parts_, *columns, lines in by_column(batches, "part", "host", "path", "line_key", "doubtful", "ghost", "lines"):
            rows = []
            for row_ in zip(parts_.to_pylist(), *(c.to_pylist() for c in columns), lines):
                held.append(row_)
                if len(held) > 1:
                    rows.append(judged(len(held) - 2))
                    held = held[-2:]
            if rows := [r for r in rows if r]:
                yield told(rows)
        if held and (last := judged(len(held) - 1)):
            yield told([last])

    return both.mapInArrow(run, "host string, line_key long, shared array<int>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each of pages; other columns of pages do not matter. Null html is empty; a null url is a host of its own.

    Repeated rows have one text. A page is compared with the nearest one of its host that has other lines; a page whose host has none, as
    that of copies only, keeps its lines in doubt. An empty table gives no rows. So does an article of whose other lines the nearest page has more than half. A page may be
    of any length: a task holds the pages of a batch, and three of the ordered ones.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = written(_extract(p.withColumn("row_key", F.xxhash64("page_id", "url", "html"))))
    light = found.select("host", "path", "page_id", "row_key", "lines", F.col("text").isNull().alias("doubtful")).dropDuplicates(["row_key"])
    shared = _neighbours(light, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    doubtful = found.where(F.col("text").isNull()).select("page_id", "url", "host", F.xxhash64("lines").alias("line_key"), "blocks", "places", "judged")
    left = doubtful.join(shared, ["host", "line_key"], "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    sure = F.filter(F.arrays_zip("places", "judged"), lambda x: ~x["judged"])
    met = F.size(F.filter(sure, lambda x: F.array_contains(F.col("shared"), x["places"])))
    left = left.withColumn("copy", (F.size(sure) > 0) & (2 * met > F.size(sure)))
    gone = lambda x: x["judged"] & ~F.col("copy") & F.array_contains(F.col("shared"), x["places"])
    kept = F.filter(F.arrays_zip("blocks", "places", "judged"), lambda x: ~gone(x))
    text = F.array_join(F.transform(kept, lambda x: x["blocks"]), "\n\n")
    out = found.where(F.col("text").isNotNull()).select("page_id", "url", "text").unionByName(left.select("page_id", "url", text.alias("text")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
