"""Main text of web pages by nearest-URL page differencing and markup regions.

A page is cut into lines (blocks of text); lines in menus, headers, footers, sidebars, notices, adverts, forms and comments
go by their markup.  Every page is aligned with the nearest pages of its host, before and after, by longest common
subsequence of lines.  The nearest page is the one with the longest common start of the URL path; where almost all of a
page's text, by lines, is in the other, it is a copy, the alignment says nothing, and the next nearest page counts.  Pages of a host
with the same lines are one page here, at the first of their paths, and have the same text.

What the alignment shares is deleted, and a check on the markup follows.  If a page has an <article> or <main>, its text is the
lines inside; there a shared line may also be a passage that two articles have in common, so it is deleted only if it is
shared with the nearest pages on both sides (on the one there is, at a host's ends), and is so on WIDE different pages of the host
at least and on more than half of those with an article; where such lines are half of an article's text or more, the pages are
versions of one article and it stays whole.  Of other pages, all lines shared with the nearest page go; two pages that are
equally near, before and after, both count.

Lines travel as hashes of 64 bits.  They are range-partitioned and sorted by host and URL path, so a hot host spreads over many
partitions.  Pages that find no nearest page before the end of their partition look on in the next one, until the host ends.

A null html is empty and gives an empty text; pages without a readable host form a host of their own.  Broken or cut
markup is read as far as it goes.  Very long pages are read in time that grows with their length, and aligned in memory that
does.  Repeated rows and ids are extracted one by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, release, small_batches

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_space = re.compile(r"\s+")
_attr = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_names = re.compile(r"[a-z]+")

# The HTML elements and naming habits that the regions are told by.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select option button canvas audio video head".split())
DROPPED = frozenset("nav footer aside form dialog menu".split())
CLASSES = frozenset(
    "ad ads advert advertisement adverts adsense alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar widget widgets".split()
)
#: Blocks of near copies have 2**LEAST_LEVEL rows at least.
LEAST_LEVEL = 3
#: Different pages of a host on which a line of an article must be shared before it counts as the host's, not the article's.
WIDE = 5
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def _unwanted(tag: str, attrs: str, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in _attr.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words = _names.findall(value)
            if not CLASSES.isdisjoint(words) or "header" in words and not inside:
                return True
        if name == "role" and not ROLES.isdisjoint(value.split()):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def page_lines(html: str) -> list[tuple[str, bool]]:
    """(line, whether it is inside an article) for each block of text outside unwanted regions, in page order."""
    lines: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, unwanted from here, inside an article from here
    unwanted = inside = False

    def end_block() -> None:
        if text:
            line = _space.sub(" ", unescape("".join(text))).strip()
            text.clear()
            if line:
                lines.append((line, inside))

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    at = 0
    search = _token.search
    while m := search(html, at):
        if not unwanted and m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if not unwanted:
                text.append(" ")
        elif m[1]:
            if tag in INLINE and not any(e[0] == tag for e in stack):
                continue
            if tag not in INLINE:
                end_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            unwanted, inside = state()
        elif tag in RAW and tag != "head":
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            end_block()
        elif tag in INLINE:
            if m[3] and not unwanted and _unwanted(tag, m[3], inside):
                stack.append((tag, True, inside))
                end_block()
                unwanted = True
        else:
            end_block()
            if tag in VOID:
                continue
            if stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                stack.pop()
                unwanted, inside = state()
            now_inside = inside or tag in ("article", "main")
            unwanted = unwanted or _unwanted(tag, m[3], now_inside) or tag == "head"
            if tag == "body" or tag == "article" and not any(e[0] != "head" and e[1] for e in stack):
                unwanted = False  # an unclosed head ends here
            inside = now_inside
            stack.append((tag, unwanted, inside))
    if not unwanted and at < len(html):
        text.append(html[at:])
    end_block()
    return lines


def _common_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of a longest common subsequence of x with every beginning of y."""
    row = np.zeros(len(y) + 1, np.int64)
    for s in x:
        row[1:] = np.maximum.accumulate(np.where(y == s, row[:-1] + 1, row[1:]))
    return row


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b, in memory that grows with their sum (by halves of a)."""
    number: dict[str, int] = {}
    in_a, in_b = set(a), set(b)
    at = np.array([i for i, s in enumerate(a) if s in in_b], np.int64)
    x = np.array([number.setdefault(a[i], len(number)) for i in at], np.int64)
    y = np.array([number.setdefault(s, len(number)) for s in b if s in in_a], np.int64)
    found: set[int] = set()
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and x[i] == y[k]:
            found.add(int(at[i]))
            i, k = i + 1, k + 1
        while i < j and k < m and x[j - 1] == y[m - 1]:
            found.add(int(at[j - 1]))
            j, m = j - 1, m - 1
        if j - i == 1 and m > k:
            if (y[k:m] == x[i]).any():
                found.add(int(at[i]))
        elif j > i and m > k:
            half = (i + j) // 2
            cut = k + int((_common_lengths(x[i:half], y[k:m]) + _common_lengths(x[half:j][::-1], y[k:m][::-1])[::-1]).argmax())
            todo += [(i, half, k, cut), (half, j, cut, m)]
    return found


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _content(found: list[tuple[str, bool]]) -> int:
    return _hash("\n".join(f"{inside:d}{line}" for line, inside in found))


def _read_lines(batches):
    """What the search needs of each page that has lines: hashes and sizes of the lines, and which are inside an article."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            found = page_lines(batch.column("html")[i].as_py() or "")
            if found:
                rows.append({
                    **{c: batch.column(c)[i].as_py() for c in ("host", "path", "page_id")}, "content": _content(found),
                    "lines": [_hash(s) for s, _ in found], "sizes": [len(s) for s, _ in found], "inside": [x for _, x in found],
                })
        yield pa.RecordBatch.from_pylist(rows, _PAGE)


def _read_texts(batches):
    """The lines of each page that its text is made of, joined: those inside an article, or all where none is."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("content", pa.int64()), ("text", pa.string())])
    for batch in batches:
        rows, size = [], 0
        for i in range(batch.num_rows):
            found = page_lines(batch.column("html")[i].as_py() or "")
            text = "\n\n".join([s for s, inside in found if inside] or [s for s, _ in found])
            rows.append({**{c: batch.column(c)[i].as_py() for c in ("page_id", "url", "host")}, "content": _content(found), "text": text})
            size += len(text)
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


_PAGE = pa.schema([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("content", pa.int64()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("inside", pa.list_(pa.bool_()))])
_PAGE_SQL = "host string, path string, page_id long, content long, lines array<long>, sizes array<int>, inside array<boolean>"
_LINE = pa.struct([("i", pa.int32()), ("line", pa.int64()), ("size", pa.int32())])
_NEAR = pa.struct([("near", pa.int32()), ("shared", pa.list_(_LINE))])
_NEAR_SQL = "struct<near:int,shared:array<struct<i:int,line:bigint,size:int>>>"


class _Rows:
    """Pages of one partition in the order of their places; lists are made when a row is looked at."""

    def __init__(self, table: pa.Table):
        self.host, self.path = table["host"].to_pylist(), table["path"].to_pylist()
        self.lists = {c: table[c].combine_chunks() for c in ("lines", "sizes", "inside")}
        self.sets: dict[int, dict[int, int]] = {}
        self.blocks: dict[tuple[int, int], tuple[dict[int, int], int]] = {}
        self.first: dict[str, int] = {}
        self.end: dict[str, int] = {}
        for i, host in enumerate(self.host):
            self.first.setdefault(host, i)
            self.end[host] = i + 1

    def get(self, name: str, i: int) -> list:
        return self.lists[name][i].as_py()

    def known(self, i: int) -> dict[int, int]:
        """The different lines of a row and their sizes; some rows are remembered."""
        if i not in self.sets:
            if len(self.sets) >= 4000:
                self.sets.clear()
            self.sets[i] = dict(zip(self.get("lines", i), self.get("sizes", i), strict=True))
        return self.sets[i]

    def block(self, level: int, start: int) -> tuple[dict[int, int], int]:
        """The lines that most of 2**level rows have, with their sizes, and the most characters of them that a row lacks."""
        if (level, start) not in self.blocks:
            count: Counter[int] = Counter()
            for i in range(start, start + (1 << level)):
                count.update(self.known(i).keys())
            lead = {x for x, n in count.items() if 2 * n > 1 << level}
            sizes = {x: n for i in range(start, start + (1 << level)) for x, n in self.known(i).items() if x in lead} if lead else {}
            self.blocks[level, start] = sizes, max(sum(sizes[x] for x in lead - self.known(i).keys()) for i in range(start, start + (1 << level)))
        return self.blocks[level, start]

    def look(self, i: int, step: int, host: str, path: str, lines: list[int], sizes: list[int], inside: list[bool]) -> tuple[dict | None, bool]:
        """The first page of the host from i on that is no copy, as (near and shared lines that the text is made of), and
        whether the rows ended before the host did.

        Blocks in which all rows must be copies are passed in one step: a row has those of the page's lines that most rows of the
        block have, but for what it lacks of these.  So runs of near copies are not compared pair by pair.
        """
        number = [k for k, x in enumerate(inside) if x] or range(len(lines))
        place = {k: n for n, k in enumerate(number)}
        chars = sum(sizes[k] for k in number)
        weight: dict[int, int] = {}
        for k in number:
            weight[lines[k]] = weight.get(lines[k], 0) + sizes[k]
        times = max(Counter(lines[k] for k in number).values())
        low, high = self.first.get(host, 0), self.end.get(host, 0)
        level = 0
        while low <= i < high:
            start = i if step > 0 else i + 1 - (1 << level)
            if level and (start < low or start + (1 << level) > high or start & ((1 << level) - 1)):
                level = level - 1 if level > LEAST_LEVEL else 0
                continue
            has, lacks = self.block(level, start) if level else (self.known(i), 0)
            same = sum(n for x, n in weight.items() if x in has) - times * lacks
            if 10 * same >= 8 * chars:
                i += step << level
                level = max(level + 1, LEAST_LEVEL)
            elif level:
                level = level - 1 if level > LEAST_LEVEL else 0
            else:
                other, shared = self.get("lines", i), []
                if not weight.keys().isdisjoint(other):
                    shared = [{"i": place[k], "line": lines[k], "size": sizes[k]} for k in sorted(common_lines(lines, other)) if k in place]
                return {"near": _prefix(path, self.path[i]), "shared": shared}, False
        return None, not 0 <= i < len(self.host)


def _search(batches):
    """Pages of a sorted partition with their nearest pages in it on both sides, or that these may be in the next partition."""
    table = pa.Table.from_batches(batches, _PAGE)
    rows, out = _Rows(table), {-1: [], 1: []}
    for i in range(table.num_rows):
        own = rows.host[i], rows.path[i], rows.get("lines", i), rows.get("sizes", i), rows.get("inside", i)
        for step in out:
            out[step].append(rows.look(i + step, step, *own))
    table = table.append_column("at", pa.array(range(table.num_rows), pa.int32()))
    for step, name in ((-1, "before"), (1, "after")):
        table = table.append_column(name, pa.array([near for near, _ in out[step]], _NEAR)).append_column(f"{name}_open", pa.array([x for _, x in out[step]], pa.bool_()))
    yield from table.to_batches(2000)


_SOUGHT = f"step int, part int, first int, last int, host string, path string, content long, lines array<long>, sizes array<int>, inside array<boolean>, found {_NEAR_SQL}"


def _search_on(seekers: pa.Table, pages: pa.Table) -> pa.Table:
    """Seekers with the first page of their host in this partition that is no copy; else with the next partition to look in."""
    rows, out = _Rows(pages.sort_by("at")), []
    for q in seekers.to_pylist():
        if q["host"] in rows.first:
            start = rows.end[q["host"]] - 1 if q["step"] < 0 else rows.first[q["host"]]
            q["found"], _ = rows.look(start, q["step"], q["host"], q["path"], q["lines"], q["sizes"], q["inside"])
        if q["found"] is None:
            q["part"] += q["step"]
        out.append(q)
    return pa.Table.from_pylist(out, seekers.schema)


def _aligned(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different pages of each host, and (host, content, found) for each side of a page that has a nearest page."""
    one = read.groupBy("host", "content").agg(F.min(F.struct("path", "page_id")).alias("place"), *[F.first(c).alias(c) for c in ("lines", "sizes", "inside")])
    pages = materialize(one.select("host", "place.path", "place.page_id", "content", "lines", "sizes", "inside"), "pages")
    order = ("host", "path", "page_id", "content")
    dealt = pages.repartitionByRange(*order).sortWithinPartitions(*order)
    sides = f"before {_NEAR_SQL}, before_open boolean, after {_NEAR_SQL}, after_open boolean"
    table = materialize(dealt.mapInArrow(_search, f"{_PAGE_SQL}, at int, {sides}").withColumn("part", F.spark_partition_id()), "aligned")
    release(pages)
    found = [table.select("host", "content", F.col(c).alias("found")).filter("found is not null") for c in ("before", "after")]
    hosts = table.groupBy("host").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    opened = [table.filter(f"{c}_open").select("*", F.lit(step).alias("step")) for c, step in (("before", -1), ("after", 1))]
    seekers = opened[0].union(opened[1]).join(hosts, "host").withColumns({"part": F.col("part") + F.col("step"), "found": F.lit(None).cast(_NEAR_SQL)})
    names = [c.split()[0] for c in _SOUGHT.split(", ")]
    seekers = materialize(seekers.filter("part between first and last").select(names), "seekers")
    while not seekers.isEmpty():
        met = table.select("part", "at", "host", "path", "lines", "sizes", "inside").join(seekers.select("part", "host").distinct(), ["part", "host"], "left_semi")
        went = materialize(seekers.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(_search_on, _SOUGHT), "sought")
        found.append(went.filter("found is not null").select("host", "content", "found"))
        seekers = went.filter("found is null and part between first and last")
    return table, reduce(DataFrame.union, found)


def _gone(read: DataFrame) -> DataFrame:
    """host, content and the numbers of the lines that go (gone), of pages that lose any."""
    table, found = _aligned(read)
    article = F.exists("inside", lambda x: x)
    chars = F.aggregate(F.zip_with("sizes", "inside", lambda n, x: F.when(x, n).otherwise(0)), F.lit(0), lambda a, b: a + b)
    # only the pages of which a line is shared move on; sides that share nothing decide with them
    sides = found.groupBy("host", "content").agg(F.collect_list("found").alias("found")).filter(F.exists("found", lambda x: F.size(x.shared) > 0))
    sides = materialize(sides.join(table.select("host", "content", article.alias("article"), chars.alias("chars")), ["host", "content"]), "sides")
    numbers = lambda x: F.transform(x.shared, lambda y: y.i)
    # other pages: what is shared with the nearest page, or with both where they are equally near
    nearest = F.filter("found", lambda x: x.near == F.array_max(F.transform("found", lambda y: y.near)))
    alone = sides.filter("not article").select("host", "content", F.array_distinct(F.flatten(F.transform(nearest, numbers))).alias("gone"))
    # pages with an article: what is shared on both sides, on most of the host's pages
    both = F.filter(F.element_at("found", 1).shared, lambda y: F.array_contains(numbers(F.element_at("found", -1)), y.i))
    lines = sides.filter("article").select("host", "content", "chars", F.explode(both).alias("x")).select("host", "content", "chars", "x.*")
    pages = table.filter(article).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    wide = lines.groupBy("host", "line").agg(F.count_distinct("content").alias("n")).filter(F.col("n") >= WIDE).join(pages, "host").filter("2 * n > pages")
    taken = lines.join(wide.select("host", "line"), ["host", "line"]).groupBy("host", "content", "chars").agg(F.collect_list("i").alias("gone"), F.sum("size").alias("size"))
    return materialize(alone.filter(F.size("gone") > 0).union(taken.filter("2 * size < chars").select("host", "content", "gone")), "gone")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    small_batches(pages.sparkSession)
    url = F.coalesce(F.col("url"), F.lit(""))
    placed = pages.select(
        "page_id", "url", "html",
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
    )
    gone = _gone(placed.select("host", "path", "page_id", "html").mapInArrow(_read_lines, _PAGE_SQL))
    whole = placed.select("page_id", "url", "host", "html").mapInArrow(_read_texts, "page_id long, url string, host string, content long, text string")
    left = F.filter(F.split("text", "\n\n"), lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n\n"))
    return whole.join(gone, ["host", "content"], "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(load(spark, sf_dir, "pages"))
