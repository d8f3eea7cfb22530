"""Main text of web pages by differencing with the page of the nearest URL, with markup as evidence.

A page is read as lines, one per block.  Markup says of a line that it is chrome
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader
comments: it goes), or that it belongs to a declared ``<article>`` or ``<main>`` (it
must not be deleted, since articles quote one another), or nothing.  Within each
host, pages are sorted by URL path, each is paired with the neighbour that shares
the longer start of its path, their lines are aligned by longest common
subsequence, and shared lines of which markup says nothing are deleted, beside a
declared article as well as without one.  What is left is the text.

Pages of a host whose lines agree but for chrome are one page to this: else a
mirrored article would be deleted by its mirror.  Only hashes of lines are sorted
and compared.  A hot host is split by path, and the rows at the ends of
partitions find their neighbours in a second step.

Defined results: null html is an empty page; a page alone in its host has no
neighbour and loses nothing by differencing; a null URL is a host of its own; an
unclosed element ends with the page; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace, shuffle_parts, table

OPEN, CHROME, ARTICLE = 0, 1, 2

#: Elements whose text is never part of an article.
CHROME_TAGS = frozenset("aside button dialog footer form head input label menu nav noscript option select".split())
#: Elements whose content is not markup.
RAW_TAGS = "iframe|math|noembed|noframes|object|script|style|svg|template|textarea|title|audio|video|canvas"
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of class, id and role attributes that mark such elements.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies "
    "disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination popup promo "
    "promoted related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets alert complementary "
    "contentinfo masthead-nav site-header site-footer skip-link".split()
)
TOKEN = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)")
ATTRIBUTE = re.compile(r"(?is)([a-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CHROME_TAGS or tag == "header" and not in_article:
        return True
    if not attributes.strip():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            if tag in ("html", "body", "article", "main") and name != "id" and "comment" not in value:
                continue
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if parts[0] not in ("has", "with", "no") and any(p in CHROME_WORDS and not (in_article and p == "header") for p in (word, *parts)):
                    return True
        elif name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return re.search(r"(?i)(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub("", attributes)) is not None


def page_lines(html: str) -> list[tuple[str, int]]:
    """The visible lines of a page, each with OPEN, CHROME or ARTICLE."""
    lines: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that aren't inline, and the kind of their lines
    kind = OPEN

    def end_line() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                lines.append((line, kind))
            text.clear()

    for m in TOKEN.finditer(html):
        if m[5] is not None:
            text.append(m[5])
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE_TAGS:
            chrome = not m[2] and m[4] and _is_chrome(tag, m[4], kind == ARTICLE)
            if not chrome and (tag, CHROME) not in stack[-1:]:
                continue
        end_line()
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                del stack[at:]
        elif tag not in VOID_TAGS and not m[4].endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            now = stack[-1][1] if stack else OPEN
            if now != CHROME and _is_chrome(tag, m[4], now == ARTICLE):
                now = CHROME
            elif now == OPEN and (tag in ("article", "main") or re.search(r"(?i)role\s*=\s*[\"']?main\b", m[4])):
                now = ARTICLE
            stack.append((tag, now))
        kind = stack[-1][1] if stack else OPEN
    end_line()
    return lines


def shared_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, bit-parallel over ``b``.

    A row of bits per line would take the product of both lengths; one row in
    each stretch of about the square root of ``a`` is kept, and the others of a
    stretch are made again on the way back.
    """
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1

    def below(row, x):
        """After one more line of a: a zero at bit j where the subsequence with b[:j + 1] is longer than with b[:j]."""
        u = row & at.get(x, 0)
        return (row + u | row - u) & full

    step = max(1, isqrt(len(a)))
    row, kept = full, []
    for i, x in enumerate(a):
        if i % step == 0:
            kept.append(row)
        row = below(row, x)
    found, i, j = [], len(a), len(b)
    while i and j:
        low = (i - 1) // step * step
        rows = [kept[low // step]]
        for x in a[low:i]:
            rows.append(below(rows[-1], x))
        while i > low and j:
            mask, last, now = (1 << j) - 1, rows[i - low - 1], rows[i - low]
            if (now & mask).bit_count() == (last & mask).bit_count():
                i -= 1
            elif now >> (j - 1) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append(i)
    return found[::-1]


def _common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _nearest(path: str, before, after):
    """Of two neighbours (path, hashes), the one whose path agrees longer; the first on a tie."""
    if before is None or after is None:
        return before or after
    return after if _common_start(path, after[0]) > _common_start(path, before[0]) else before


SORTED = "part int, at int, side string, key long, host string, path string, hashes array<long>, open array<int>, inner_path string, inner_hashes array<long>, gone array<int>"


def _gone(hashes, open_, near) -> list[int]:
    """Open lines that the nearest page shares."""
    if near is None or not open_:
        return []
    allowed = set(open_)
    return [i for i in shared_lines(hashes, near[1]) if i in allowed]


def _by_neighbours(batches: Iterator) -> Iterator:
    """Over pages sorted by host and path: settle each page that has both neighbours here."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0

    def row(x, side, inner=None, gone=None):
        nonlocal at
        at += 1
        ends = x if side != "inside" else dict.fromkeys(x)
        inner = inner if inner and inner["host"] == x["host"] else {}
        return {"part": part, "at": at, "side": side, "inner_path": inner.get("path"), "inner_hashes": inner.get("hashes"), "gone": gone} | {c: ends[c] for c in ("host", "path", "hashes", "open")} | {"key": x["key"]}

    def beside(x, y):
        return (y["path"], y["hashes"]) if x["host"] == y["host"] else None

    before = here = None
    for batch in batches:
        out = []
        for after in batch.to_pylist():
            if before:
                out.append(row(here, "inside", None, _gone(here["hashes"], here["open"], _nearest(here["path"], beside(here, before), beside(here, after)))))
            elif here:
                out.append(row(here, "first", after))
            before, here = here, after
        yield pa.RecordBatch.from_pylist(out, schema=_sorted_schema())
    if here:
        yield pa.RecordBatch.from_pylist([row(here, "last", before) if before else row(here, "only")], schema=_sorted_schema())


def _sorted_schema():
    import pyarrow as pa

    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    return pa.schema([("part", pa.int32()), ("at", pa.int32()), ("side", pa.string()), ("key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("hashes", longs), ("open", ints), ("inner_path", pa.string()), ("inner_hashes", longs), ("gone", ints)])


def _at_ends(batches: Iterator) -> Iterator:
    """The first and last pages of all partitions, in order: settle them with their outer neighbours."""
    import pyarrow as pa

    rows = [x for batch in batches for x in batch.to_pylist()]
    keys, gone = [], []
    for i, x in enumerate(rows):
        outer = lambda y: (y["path"], y["hashes"]) if y["host"] == x["host"] else None  # noqa: B023, E731
        inner = (x["inner_path"], x["inner_hashes"]) if x["inner_hashes"] is not None else None
        before = inner if x["side"] == "last" else outer(rows[i - 1]) if i else None
        after = inner if x["side"] == "first" else outer(rows[i + 1]) if i + 1 < len(rows) else None
        keys.append(x["key"])
        gone.append(_gone(x["hashes"], x["open"], _nearest(x["path"], before, after)))
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])


def _light(batches: Iterator) -> Iterator:
    """Of each page the hashes of its lines but for chrome, which of them markup leaves open, and one hash of them all."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        hashes, open_, bodies = [], [], []
        for html in batch.column(3).to_pylist():
            lines = [(x, kind) for x, kind in page_lines(html) if kind != CHROME]
            hashes.append([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63 for x, _ in lines])
            open_.append([i for i, (_, kind) in enumerate(lines) if kind == OPEN])
            bodies.append(xxhash.xxh64_intdigest(repr((hashes[-1], open_[-1])).encode()) - 2**63)
        columns = [pa.array(bodies, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(open_, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], ["page", "host", "path", "body", "hashes", "open"])


def _texts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = []
        for html, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            gone = set(gone or ())
            texts.append(" ".join(x for i, x in enumerate(x for x, kind in page_lines(html) if kind != CHROME) if i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, ws: Workspace) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    keyed = pages.select("page_id", "url", html.alias("html"), host.alias("host"), path.alias("path")).withColumn("page", F.xxhash64("host", "html"))

    light = keyed.select("page", "host", "path", "html").mapInArrow(_light, "page long, host string, path string, body long, hashes array<long>, open array<int>")
    light = ws.save(light.withColumn("key", F.xxhash64("host", "body")), "light")
    # Pages of one body are one, at their least path; where markup leaves nothing open the page only serves as a neighbour.
    one = light.groupBy("key").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("open").alias("open"))
    one = ws.save(one.where("size(hashes) > 0"), "one")
    order = ["host", "path", "key"]
    settled = one.repartitionByRange(shuffle_parts(pages.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_by_neighbours, SORTED)
    settled = ws.save(settled, "settled")
    # Two rows a partition: few, however many pages there are.
    ends = settled.where("side <> 'inside'").repartition(1).sortWithinPartitions("part", "at").mapInArrow(_at_ends, "key long, gone array<int>")
    gone = settled.where("side = 'inside'").select("key", "gone").unionByName(ends).where("size(gone) > 0")
    gone = ws.save(gone, "gone")
    by_page = ws.save(light.select("page", "key").distinct().join(gone, "key").select("page", "gone"), "by-page")
    rows = keyed.join(by_page, "page", "left").select("page_id", "url", "html", "gone")
    kinds = dict(pages.dtypes)
    return rows.mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), Workspace(spark, "html"))
