"""Main text of pages by nearest-URL page differencing.

Every page is paired with the page of its host whose path is nearest: of the ``SIDE``
pages before it and after it in the order of paths, the one that shares most leading path
parts, the nearer first, the one before first among equals.  A page that shares the longest
line is a copy of the article and tells nothing, so the next nearest is taken; where all
are copies, nothing is deleted.  A template's lines recur: a line counts as shared if
``CONFIRMED`` of the pages as near as the partner have it (all, where there are fewer).
These lines of both pages are aligned by a longest common subsequence, bit-parallel with
backtracking, long ones from rows kept in steps so that memory stays bounded, and the common ones
are deleted.

Differencing alone can't give right results where a template's lines change from page
to page, or where different articles share a line.  So the markup settles what is left:
lines in elements for menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments are never text, and lines within an article or main element are
never deleted as shared; where a page has such an element, its lines are the text.

Plan: only line hashes move.  Host and path order comes from a range partitioning (a
host with a third of all pages is spread over many tasks), neighbours across partition
borders from one row per partition.  Deleted line numbers are joined back to the pages.

Defined results: null and empty html give an empty text; null urls are a host of their
own, paired in page order; repeated page ids share one pairing; an empty table gives
an empty result; html that ends within a tag loses that tag only.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialize, partitions, shipped

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>|[^>]*+(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# HTML element names by their role here.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUT = {"nav", "footer", "aside", "form", "svg", "canvas", "button", "select", "menu", "dialog", "head", "object", "audio", "video", "datalist", "fieldset"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
FRAME = {"article", "aside", "blockquote", "body", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "html", "main", "menu", "nav", "ol", "section", "table", "ul", "svg", "canvas", "button", "select", "object", "audio", "video", "datalist"}
SPACED = {"br", "td", "th", "option", "img", "wbr"} - {"wbr", "img"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar", "note"}
NAMES = {"ad", "ads", "advert", "advertisement", "advertising", "adverts", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "reply", "replies", "disqus", "respond", "search", "searchbox", "widget", "widgets", "pagination", "pager", "skip", "hidden", "header"}
#: Of these, the ones that mark such parts within an article too.
INNER = {"ad", "ads", "advert", "advertisement", "advertising", "adverts", "adsense", "sponsored", "promo", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "comment", "comments", "replies", "disqus", "respond", "sidebar", "breadcrumbs", "pagination"}
CHROME, PLAIN, ARTICLE = 0, 1, 2
SIDE, CONFIRMED = 2, 3
TABLE_BITS = 1 << 28  # of the rows that backtracking keeps all of


def _excluded(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OUT or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "article", "main") or not attributes.strip("/ >\n"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name in ("class", "id"):
            if not (INNER if in_article else NAMES).isdisjoint(re.split(r"[^a-z0-9]+", value)):
                return True
        elif name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of all non-empty blocks, in order; raw elements such as scripts have none."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    frames: list[tuple[str, int]] = []  # open elements that frame others, with the zone inside
    opened: Counter[str] = Counter()  # their names: an end tag without a start is passed at once
    zone, at, end = PLAIN, 0, len(page)

    def flush():
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((text, zone))
            parts.clear()

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCK:
            flush()
        elif tag in SPACED:
            parts.append(" ")
        if closing:
            if opened[tag]:
                flush()
                while True:
                    name, _ = frames.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
                zone = frames[-1][1] if frames else PLAIN
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID or m[3].rstrip().endswith("/>") and tag in ("svg", "canvas"):
            continue
        gone = zone == CHROME or _excluded(tag, m[3], zone == ARTICLE)
        if tag in FRAME or gone and zone != CHROME and tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            flush()
            zone = CHROME if gone else ARTICLE if zone == ARTICLE or tag in ("article", "main") else PLAIN
            frames.append((tag, zone))
            opened[tag] += 1
        elif gone and zone != CHROME:  # an element whose end tag may be left out: until the next block
            flush()
            frames.append((tag, CHROME))
            opened[tag] += 1
            zone = CHROME
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = _common(a[lead : len(a) - tail], b[lead : len(b) - tail])
    return [*range(lead), *[lead + i for i in middle], *range(len(a) - tail, len(a))]


def _places(x: list[int], y: list[int]) -> dict[int, int]:
    """For each value of both, its places in ``y`` as bits."""
    out: dict[int, int] = {}
    some = set(x)
    for j, v in enumerate(y):
        if v in some:
            out[v] = out.get(v, 0) | (1 << j)
    return out


def _rows(x: list[int], places: dict[int, int], row: int, every: int):
    """After each entry of ``x``, a number whose zero bits mark where the common length with the first entries of the other list grows; ``row`` stands before the first."""
    for v in x:
        u = row & places.get(v, 0)
        row = ((row + u) | (row - u)) & every
        yield row


def _common(x: list[int], y: list[int]) -> list[int]:
    """Places in ``x`` of the longest common subsequence that backtracking finds.

    Rows that would take more than ``TABLE_BITS`` are kept in steps only, and made again from
    there, a step at a time; so the result is that of the whole table.
    """
    if not x or not y:
        return []
    places, every = _places(x, y), (1 << len(y)) - 1
    step = len(x) if len(x) * len(y) <= TABLE_BITS else math.isqrt(len(x)) + 1
    starts = [every]
    if step < len(x):
        for i, row in enumerate(_rows(x, places, every, every), 1):
            if i % step == 0:
                starts.append(row)
    held, rows = -1, []  # the step whose rows are at hand, the one before it first
    found, i, j = [], len(x), len(y)
    while i and j:
        part = (i - 1) // step
        if part != held:
            rows, held = [starts[part], *_rows(x[part * step : i], places, starts[part], every)], part
        k = i - part * step
        if rows[k] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if rows[k - 1] >> (j - 1) & 1:
                found.append(i)
                j -= 1
    return found[::-1]


def neighbours(pages: DataFrame, id_col: str, url_col: str, side: int = SIDE) -> DataFrame:
    """(id, others, depths): each page id, up to 2 * ``side`` pages of its host, the nearest path first, and how many leading parts of the path each shares."""
    url = F.coalesce(col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    rows = pages.select(col(id_col).alias("id"), host.alias("host"), path.alias("path")).where("id is not null").groupBy("id").agg(F.min(F.struct("host", "path")).alias("x"))
    rows = rows.select("id", "x.host", "x.path").repartitionByRange(partitions(pages.sparkSession), "host", "path", "id")
    rows = materialize(rows.withColumn("part", F.spark_partition_id()), "paths")
    key = F.struct("host", "path", "id")
    order = W.partitionBy("part").orderBy("host", "path", "id")
    last = lambda x: F.when(F.size(x) > side, F.slice(x, -side, side)).otherwise(x)
    rows = rows.withColumns({"n": F.row_number().over(order), "prev": F.collect_list(key).over(order.rowsBetween(-side, -1)), "next": F.collect_list(key).over(order.rowsBetween(1, side))})
    first = F.sort_array(F.collect_list(F.when(F.col("n") <= side, key)))
    final = F.sort_array(F.collect_list(F.when(F.size("next") < side, key)))
    by_part = W.orderBy("part")  # one row per partition
    ends = rows.groupBy("part").agg(first.alias("lo"), final.alias("hi"))
    ends = ends.select(F.col("part").alias("of"), F.flatten(F.collect_list("hi").over(by_part.rowsBetween(-side, -1))).alias("before"), F.flatten(F.collect_list("lo").over(by_part.rowsBetween(1, side))).alias("after"))
    rows = rows.join(ends, F.col("part") == F.col("of"))
    rows = rows.select("id", "host", "path", last(F.concat("before", "prev")).alias("prev"), F.slice(F.concat("next", "after"), 1, side).alias("next"))

    def ranked(others, sign):
        """Of the host's own: shared leading path parts (less is better here), distance, side and id."""
        place = lambda i: F.size(others) - i if sign < 0 else i + 1
        return F.filter(F.transform(others, lambda x, i: F.struct((-shared(x.path)).alias("far"), place(i).alias("steps"), F.lit(sign).alias("sign"), x.id.alias("id"), x.host.alias("host"))), lambda x: x.host == F.col("host"))

    def shared(path):
        same = F.zip_with(F.split("path", "/"), F.split(path, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
        first = F.array_position(same, False)
        return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")

    found = F.array_sort(F.concat(ranked(F.col("prev"), -1), ranked(F.col("next"), 1)))
    return rows.select("id", F.transform(found, lambda x: x.id).alias("others"), F.transform(found, lambda x: -x.far).alias("depths")).where(F.size("others") > 0)


def line_hashes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, lines (hash of each block), sizes (their characters) and zones."""

    def run(batches):
        for batch in batches:
            lines, zones = [], []
            for page in batch.column(1).to_pylist():
                found = blocks(page or "")
                lines.append([t for t, _ in found])
                zones.append([z for _, z in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.string())), pa.array(zones, pa.list_(pa.int32()))], names=["id", "lines", "zones"])

    rows = pages.select(col(id_col).alias("id"), col(html_col).cast("string").alias("html"))
    out = shipped(rows).mapInArrow(run, T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("zones", T.ArrayType(T.IntegerType()))]))
    return out.select("id", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines"), F.transform("lines", lambda x: F.length(x)).alias("sizes"), "zones")


def deleted(lines: list[int], sizes: list[int], zones: list[int], others: list[list[int]], depths: list[int]) -> list[int]:
    """Numbers of the lines outside articles that go: common with the first of ``others`` that is no copy, and in ``CONFIRMED`` of those as near.

    A copy shares the longest line that isn't chrome.
    """
    text = [k for k, z in enumerate(zones) if z != CHROME]
    longest = lines[max(text, key=lambda k: (sizes[k], -k))] if text else None
    pages = [(d, theirs, set(theirs)) for d, theirs in zip(depths, others, strict=True)]
    pages = [p for p in pages if longest not in p[2]]
    if not pages:
        return []
    near = [own for d, _, own in pages if d == pages[0][0]]
    often = Counter(v for own in near for v in own)
    places = [k for k, v in enumerate(lines) if v in pages[0][2] and often[v] >= min(CONFIRMED, len(near))]
    return [places[i] for i in common_lines([lines[k] for k in places], pages[0][1]) if zones[places[i]] != ARTICLE]


def shared_lines(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, gone): block numbers outside articles that a page shares with its nearest page that is no copy."""
    lines = materialize(line_hashes(pages, id_col, html_col), "lines")
    pairs = materialize(neighbours(pages, id_col, url_col), "neighbours")
    single = lines.where("id is not null").groupBy("id").agg(F.min(F.struct("lines", "sizes", "zones")).alias("x")).select("id", "x.*")
    single = materialize(single, "single")
    theirs = pairs.select("id", F.posexplode(F.arrays_zip("others", "depths")).alias("rank", "o")).select("id", "rank", F.col("o.others").alias("other"), F.col("o.depths").alias("depth")).join(single.select(F.col("id").alias("other"), F.col("lines").alias("theirs")), "other")
    theirs = theirs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "theirs", "depth"))).alias("s")).select("id", F.col("s.theirs").alias("theirs"), F.col("s.depth").alias("depths"))
    both = single.join(theirs, "id").select("id", "lines", "sizes", "zones", "theirs", "depths")

    def run(batches):
        for batch in batches:
            gone = []
            for r in range(batch.num_rows):
                gone.append(deleted(*[batch.column(k)[r].as_py() for k in range(1, 6)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["id", "gone"])

    out = both.mapInArrow(run, T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("gone", T.ArrayType(T.IntegerType()))]))
    return materialize(out.where(F.size("gone") > 0), "gone")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: id, url and text."""
    gone = shared_lines(pages, id_col, url_col, html_col).withColumnRenamed("id", "of")

    def run(batches):
        for batch in batches:
            texts = []
            for page, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found, drop = blocks(page or ""), set(drop or ())
                zone = ARTICLE if any(z == ARTICLE for _, z in found) else PLAIN
                texts.append("\n\n".join(t for k, (t, z) in enumerate(found) if z == zone and k not in drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), col(html_col).cast("string").alias("html")).join(gone, F.col("id") == F.col("of"), "left")
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType())])
    return rows.select("id", "url", "html", "gone").mapInArrow(run, schema)


def op9_page_difference(spark, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
