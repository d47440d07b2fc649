"""Main text of web pages: blocks by structure, less what the nearest page of the same host has as well.

Each page is paired with the pages next to it in the order of URL paths within its host. The lines of the
two are aligned by their longest common subsequence, and shared lines go: menus, notices and footers repeat
from page to page, articles do not. On a page that marks its article, lines outside go as well, and a
neighbour with more than half of the article is a copy, which takes no line away. Elements that are
never part of an article (menus, forms, scripts, comments) go by their tag, role, class or id.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm._shared import checkpoint, expand, partitions, ready, squeeze, table

#: Elements by their part in a page (fixed values of HTML).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = set("script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas menu dialog audio video".split())
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements within which an open element of the kinds above is another's.
SCOPES = set("table ul ol dl menu select object template button".split())
#: Words in a class, id, role or label that mark what is not the article, and what is.
_BOILER = re.compile(r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|related|recommended|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|tags|toolbar|widget|complementary|contentinfo|search|alert|legal|login|signup)$", re.I)
#: Words that may stand beside these in one name (site-footer, share-buttons); any other, as in has-sidebar, makes it another name.
_BESIDE = set("site page main global top bottom left right inner outer primary secondary list area box bar link links button buttons posts item items section container wrapper wrap block group".split())
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|entry-content|post-content|post-body|main-content|story-body|main|content|post|entry|story)(?:$|[\s_-])", re.I)
_SPACE = re.compile(r"\s+")
SPAN = 400


def _boiler(marks: str, inside: bool) -> bool:
    """Whether a name among marks stands for what is not the article; headers inside an article are part of it."""
    for name in marks.split():
        parts = [x for x in re.split("[-_]+", name.lower()) if x not in _BESIDE]
        if parts and all(_BOILER.match(x) and not (inside and x in ("header", "masthead")) for x in parts):
            return True
    return False


class Blocks(HTMLParser):
    """(zone, text) in page order; zone is 2 inside a marked article, 1 elsewhere, -1 in a form or what a name marks; what is never article is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag, zone
        self.count: Counter[str] = Counter()
        self.blocks: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.zone = 1

    def flush(self) -> None:
        s = _SPACE.sub(" ", "".join(self.text).replace("\x00", "\ufffd")).strip()
        if s and self.zone:
            self.blocks.append((self.zone, s))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        for open_tag, closers in CLOSED_BY.items():
            if tag in closers and self.count[open_tag]:
                self.close(open_tag)
        if tag in VOID:
            return
        zone = self.zone
        if zone:
            a = {k: v or "" for k, v in attrs}
            marks = " ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label"))
            hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I)
            if (tag in NEVER and tag != "form") or hidden or (tag == "header" and zone == 1):
                zone = 0
            elif tag not in ("article", "main", "body", "html") and (tag == "form" or _boiler(marks, zone == 2)):
                zone = -1
            elif zone < 0:
                # a wrapper of the article; articles after the first are comments and teasers
                zone = 2 if tag == "main" or (tag == "article" and not _boiler(marks, False) and not any(z == 2 for z, _ in self.blocks)) else zone
            elif tag in ("article", "main") or "articlebody" in a.get("itemprop", "").lower() or (tag in ("div", "section", "td") and marks.strip() and _MAIN.search(marks)):
                zone = 2
        if zone != self.zone:
            self.flush()
        self.stack.append((tag, self.zone))
        self.count[tag] += 1
        self.zone = zone

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.text.append(" ")

    def close(self, tag: str) -> None:
        """Ends the innermost open element of a tag, unless one that holds its like (a list, a table) is open within it."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.flush()
                self.leave(at)
                return
            if self.stack[at][0] in SCOPES:
                return

    def leave(self, at: int) -> None:
        self.zone = self.stack[at][1]
        self.count.subtract(t for t, _ in self.stack[at:])
        del self.stack[at:]

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag in BLOCK:
            self.flush()
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None) if self.count[tag] else None
        if at is None or (tag not in BLOCK and tag not in NEVER and any(t in BLOCK for t, _ in self.stack[at + 1 :])):
            return  # a stray end, or one of an inline element that a block was left open in
        if self.stack[at][1] != self.zone:
            self.flush()
        self.leave(at)

    def handle_data(self, data):
        if self.zone:
            self.text.append(data)


def blocks(html: str | None) -> list[tuple[int, str]]:
    """All visible blocks of a page, with their zones. Null and empty pages have none.

    What stands in forms or under names of other parts is left out, unless there is nothing else.
    """
    p = Blocks()
    p.feed(html or "")
    HTMLParser.close(p)  # what an unfinished tag holds counts as text
    p.flush()
    return [b for b in p.blocks if b[0] > 0] or [(1, t) for _, t in p.blocks]


def main_text(found: list[tuple[int, str]], others: list[bytes]) -> list[str]:
    """Lines of a page that neighbours do not share; of a page that marks its article, only lines inside.

    A neighbour with more than half of the marked article holds a copy of it, and takes nothing away.
    """
    own = np.array([xxhash.xxh64_intdigest(t) for _, t in found], np.uint64)
    inside = np.array([z == 2 for z, _ in found], bool)
    marked = inside.any()
    size = np.array([len(t) for _, t in found]) * inside
    common = np.zeros(len(found), bool)
    for o in others:
        c = shared(own, np.frombuffer(o, np.uint64))
        if not marked or 2 * size[c].sum() <= size.sum():
            common |= c
    kept = (inside | (not marked)) & ~common
    if not kept.any():
        kept = inside | (not marked)
    return [t for (_, t), k in zip(found, kept) if k]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of a are in a longest common subsequence of a and b (Hunt and Szymanski: only equal lines are visited)."""
    keep = np.zeros(len(a), bool)
    place: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        place.setdefault(x, []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    from bisect import bisect_left

    for i, x in enumerate(a.tolist()):
        for j in reversed(place.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            else:
                tails[k], ends[k] = j, link
    at = ends[-1] if ends else None
    while at:
        keep[at[0]] = True
        at = at[1]
    return keep


def _place(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").removeprefix("www."), u.path.rstrip("/")
    except ValueError:
        return "", url or ""


def placed(pages: DataFrame) -> DataFrame:
    """row, host, path, lines (hashes of the visible lines) of every page."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SPAN):
                some = batch.slice(lo, SPAN)
                out = []
                for url, html in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    lines = np.array([xxhash.xxh64_intdigest(t) for _, t in blocks(html)], np.uint64)
                    out.append((*_place(url), lines.tobytes()))
                made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([some.column(2), *made], ["row", "host", "path", "lines"])

    return pages.select("url", "html", "row").mapInArrow(run, "row long, host string, path string, lines binary")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, row, z (the blocks, compressed) of every page."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SPAN):
                some = batch.slice(lo, SPAN)
                z = [squeeze("\x00".join(f"{zone}{t}" for zone, t in blocks(html)).encode("utf-8", "replace")) for html in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(3), pa.array(z, pa.binary())], ["page_id", "url", "row", "z"])

    return pages.select("page_id", "url", "html", "row").mapInArrow(run, f"page_id {kind}, url string, row long, z binary")


def neighbours(places: DataFrame) -> DataFrame:
    """(row, other): the lines of the pages before and after each page, in the order of paths within its host.

    places is cut into ranges of (host, path), which may split a host; each range is scanned by itself,
    and its first and last page find theirs in the ranges beside it.
    """
    n = partitions(places.sparkSession)
    ranged = checkpoint(places.repartitionByRange(n, "host", "path", "row").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy("host", "path", "row")
    page = F.struct("host", "lines")
    inner = ranged.withColumns({"before": F.lag(page).over(w), "after": F.lead(page).over(w)})
    edge = ranged.groupBy("part").agg(F.min(F.struct("host", "path", "row", "lines")).alias("low"), F.max(F.struct("host", "path", "row", "lines")).alias("high")).collect()  # two pages' line hashes for each range
    edge.sort(key=lambda r: r["part"])
    rows = [(r["part"], *((edge[i - 1]["high"]["host"], bytes(edge[i - 1]["high"]["lines"])) if i else (None, None)), *((edge[i + 1]["low"]["host"], bytes(edge[i + 1]["low"]["lines"])) if i + 1 < len(edge) else (None, None))) for i, r in enumerate(edge)]
    beside = places.sparkSession.createDataFrame(rows, "part int, bh string, bl binary, ah string, al binary")
    joined = inner.join(F.broadcast(beside), "part")
    before = F.coalesce("before", F.struct(F.col("bh").alias("host"), F.col("bl").alias("lines")))
    after = F.coalesce("after", F.struct(F.col("ah").alias("host"), F.col("al").alias("lines")))
    same = lambda x: F.when(x["host"] == F.col("host"), x["lines"])
    return joined.select("row", F.array_compact(F.array(same(before), same(after))).alias("other"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null or empty html has an empty text. A page alone on its host, or without a URL, loses no line by
    differencing. If all lines of a page are shared, the page is a copy: it keeps them.
    Rows that agree in everything get the same result; extra columns are ignored.

    Pages are parsed twice, for the hashes of their lines and for their texts: texts that were kept on disk
    between the two would take more of it than parsing takes time.
    """
    ready(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("row"))
    kind = dict(pages.dtypes)["page_id"]
    places = checkpoint(placed(pages)).dropDuplicates(["row"])
    beside = checkpoint(neighbours(places))
    asked = beside.join(places.where(F.length("lines") > 0).select("row"), "row", "left_semi").where(F.size("other") > 0)
    read = parsed(pages).join(asked, "row", "left")

    def run(batches):
        for batch in batches:
            out = []
            for z, others in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = expand(z).tobytes().decode()
                found = [(int(s[0]), s[1:]) for s in raw.split("\x00")] if raw else []
                out.append("\n".join(main_text(found, others or [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return read.select("page_id", "url", "z", "other").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))
