"""Main text of web pages by nearest-URL page differencing.

Pages of a site share menus, notices and footers; two pages with
neighbouring URLs share the most.  Every page is paired with its nearest
neighbour by URL path within its host whose lines are not all the same (a copy
tells nothing about what is boilerplate), their text lines are aligned by
longest common subsequence, and shared lines are deleted.  Three rules bound that:

- Lines of elements that are never content (menus, forms, adverts, reader
  comments) go even if they differ; so do lines beside an article (or main)
  element that holds most of the page's text.
- A shared line inside an article goes only as a notice of the host: it stands
  at the same structural place (first or last block, or under the same named
  elements) in most of the host's different articles, and in five at least.
  Copied articles, and prose that recurs anywhere in the text, stay.
- Where a page marks no article, the differencing alone decides.

Only line hashes are sorted and paired.  The sort is global over (host,
path), so a host with a third of all pages spreads over many partitions; the
pages at partition edges get their neighbour from a table of edges, also where
a run of copies spans several partitions.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from urllib.parse import unquote

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm._base import row_key, run_window, sorted_runs, stage

CHROME, BODY, MAIN = 0, 1, 2
TITLE = "title"
#: A notice stands in so many different articles of its host at least.
LEAST_ARTICLES = 5

_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe"}
_CHROME_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "header", "head"}
_MAIN_TAGS = {"article", "main"}
#: Class, id and role names that mark boilerplate.
_CHROME_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "replies", "share",
    "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "widget",
}
#: ``site-ad`` is marked as ``ad`` is.
_NAME_PREFIXES = {"site", "global", "main", "primary", "secondary", "top", "bottom"}
#: Names that mark whatever follows them (``cookie-bar``), unless it tells of a state of the page (``nav-open``).
_NAME_STEMS = {
    "ad", "ads", "advert", "breadcrumb", "comment", "comments", "cookie", "footer", "menu", "nav", "navbar",
    "newsletter", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "subscribe",
}
_STATES = {"open", "closed", "free", "none", "off", "on", "enabled", "disabled", "hidden", "visible", "left", "right"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
}
_SPACE = {"br", "td", "th", "img"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<([/]?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^<>]*\Z""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _boilerplate(name: str) -> bool:
    words = re.split(r"[-_]+", name)
    if name in _CHROME_NAMES or len(words) == 2 and words[0] in _NAME_PREFIXES and words[1] in _CHROME_NAMES:
        return True
    return len(words) > 1 and words[0] in _NAME_STEMS and _STATES.isdisjoint(words[1:])


def _marked(attributes: str) -> bool:
    return any(_boilerplate(name) for groups in _NAMES.findall(attributes) for name in "".join(groups).lower().split())


def _names_of(attributes: str) -> str:
    """The class, id and role names of an element, numbers in them set aside."""
    names = sorted({n for groups in _NAMES.findall(attributes) for n in "".join(groups).lower().split()})
    return re.sub(r"[0-9]+", "#", ".".join(names))


def lines_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's non-empty text blocks, in page order."""
    return [(zone, text) for zone, text, _ in blocks_of(page)]


def blocks_of(page: str) -> list[tuple[int, str, str]]:
    """(zone, text, place) of the page's non-empty text blocks, in page order.

    Place: for blocks of an article the named elements around it, `TITLE` for
    its title; empty otherwise.

    Character references are decoded; white space inside a block becomes one
    space.  Raw-text elements (scripts, styles) and comments are no text.  A
    boilerplate element ends at its closing tag, or where an article begins.
    The names of ``html`` and ``body`` tell of the page, not of their text; the
    first h1 of an article is its title, even in an element named as a header.
    """
    out: list[tuple[int, str, str]] = []
    buffer: list[str] = []
    around: list[tuple[str, str]] = []  # open block elements inside the article, with their names
    chrome: tuple[str, int] | None = None  # open boilerplate element and its nesting
    main = 0
    named = titled = title = False  # the open boilerplate element is one by name; an h1 of the article came; is open

    def flush() -> None:
        nonlocal titled
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                zone = MAIN if title else CHROME if chrome else MAIN if main else BODY
                named_around = "/".join(f"{t}.{n}" for t, n in around if n) if zone == MAIN else ""
                out.append((zone, text, TITLE if title else named_around))
                titled = titled or title
            buffer.clear()

    at = 0
    while True:
        m = _TAG.search(page, at)
        buffer.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m.group(2):
            continue
        closing, tag, attributes = bool(m.group(1)), m.group(2).lower(), m.group(3)
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _SPACE:
            buffer.append(" ")
        elif tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if main and tag not in _INLINE and tag not in _SPACE and tag not in _MAIN_TAGS:
            if not closing:
                if tag == "p" and around and around[-1][0] == "p":  # left open
                    around.pop()
                around.append((tag, _names_of(attributes) if attributes else ""))
            elif any(t == tag for t, _ in around):
                while around.pop()[0] != tag:
                    pass
        if tag in _MAIN_TAGS and not (chrome and main):
            flush()
            if not closing:
                chrome = None
            main = max(0, main + (-1 if closing else 1))
            title = False
            titled = titled and main > 0
            if not main:
                around.clear()
        elif tag == "h1" and main and not (chrome and chrome[0] == "h1"):
            title = not closing and not titled and (not chrome or named)
        elif chrome:
            if tag == chrome[0]:
                title = False
                flush()
                depth = chrome[1] + (-1 if closing else 1)
                chrome = (tag, depth) if depth else None
        elif not closing and tag not in ("html", "body"):
            by_tag = tag in _CHROME_TAGS and not (main and tag == "header")
            if by_tag or _marked(attributes):
                flush()
                chrome, named, title = (tag, 1), not by_tag, False
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Equal heads and tails are aligned directly and lines without a partner
    are left out; the rest runs bit-parallel, one long integer per line.
    """
    n, m, head = len(a), len(b), 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    found = set(range(head)) | set(range(n - tail, n))
    theirs, ours = set(b[head:m - tail]), set(a[head:n - tail])
    rows = [i for i in range(head, n - tail) if a[i] in theirs]
    columns = [x for x in b[head:m - tail] if x in ours]
    where: dict[int, int] = {}
    for j, x in enumerate(columns):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(columns)) - 1
    states, state = [full], full
    for i in rows:  # a zero bit j: the common length grows at column j
        hits = state & where[a[i]]
        state = ((state + hits) | (state - hits)) & full
        states.append(state)
    j = len(columns)
    for k in range(len(rows), 0, -1):
        # Common length of k rows and j columns, with and without row k.
        with_row = j - (states[k] & ((1 << j) - 1)).bit_count()
        without = j - (states[k - 1] & ((1 << j) - 1)).bit_count()
        if with_row > without:
            found.add(rows[k - 1])
            while j and not states[k] >> (j - 1) & 1 == 0:
                j -= 1
            j -= 1
    return found


def places_of(blocks: list[tuple[int, str, str]]) -> list[tuple[int, str]]:
    """(line number, place) wherever a notice may stand in the article: its
    first and its last block (the title aside) and blocks in named elements."""
    own = [i for i, (zone, _, place) in enumerate(blocks) if zone == MAIN and place != TITLE]
    if not own:
        return []
    named = [(i, blocks[i][2]) for i in own if blocks[i][2]]
    return [(own[0], "first"), (own[-1], "last"), *named]


def kept_lines(zones: list[int], lines: list[str], shared: set[int], notices: set[int]) -> list[str]:
    """The page's content, given the shared lines and the notices of its article."""
    inside = sum(len(x) for zone, x in zip(zones, lines) if zone == MAIN)
    beside = sum(len(x) for zone, x in zip(zones, lines) if zone == BODY)
    marked = inside > 0 and inside >= beside

    def stays(i: int) -> bool:
        if zones[i] == MAIN:
            return i not in notices
        return zones[i] == BODY and not marked and i not in shared
    return [x for i, x in enumerate(lines) if stays(i)]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; empty where missing."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)), rest


def _nearness(path: str, other: str | None) -> int:
    if other is None:
        return -1
    n = 0
    for x, y in zip(unquote(path), unquote(other)):
        if x != y:
            break
        n += 1
    return n


def _signed_hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Thin rows: host, path, url, key, line hashes, and for the article the
    hash of its longest line (its identity; null without an article) and the
    line numbers and hashes of its places."""
    @F.pandas_udf("lines array<long>, article long, at array<int>, place array<long>")
    def hashes(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            blocks = blocks_of(text or "")
            lines = [_signed_hash(x) for _, x, _ in blocks]
            own = [x for zone, x, place in blocks if zone == MAIN and place != TITLE]
            places = places_of(blocks)
            rows.append((lines, _signed_hash(max(own, key=len)) if own else None, [i for i, _ in places],
                         [_signed_hash(place) for _, place in places]))
        out = pd.DataFrame(rows, columns=["lines", "article", "at", "place"], dtype=object)
        return out.astype({"article": "Int64"})

    host, path = url_parts(F.col(url_col))
    return pages.select(
        host.alias("host"), path.alias("path"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        row_key(F.col(id_col), F.concat_ws("\n", F.col(url_col), F.col(html_col))).alias("key"),
        hashes(F.col(html_col)).alias("page")).select("host", "path", "url", "key", "page.*")


def _edges(runs: DataFrame, rank: Column) -> DataFrame:
    """_pid, previous, next (struct host, path, lines): for every range
    partition the closest pages beside it that are no copies of its own first
    and last page.  One-task windows see only hashes, one row a partition; the
    lines of the pages they choose are fetched afterwards."""
    ref = runs.select("_pid", F.struct("host", F.xxhash64("lines").alias("s"), F.xxhash64(F.lit("lines"), "lines").alias("t"),
                                       "_pos").alias("page"), rank.alias("rank"))

    def differ(page: Column, copy: Column) -> Column:
        return (page["host"] != copy["host"]) | (page["s"] != copy["s"]) | (page["t"] != copy["t"])
    by_run = Window.orderBy("_pid")
    ends = ref.groupBy("_pid").agg(F.min_by("page", "rank").alias("first"), F.max_by("page", "rank").alias("last"))
    not_first, not_last = differ(F.col("page"), F.col("first")), differ(F.col("page"), F.col("last"))
    inner = (ref.join(ends, "_pid").groupBy("_pid")
             .agg(F.min_by(F.when(not_first, F.col("page")), F.when(not_first, F.col("rank"))).alias("second"),
                  F.max_by(F.when(not_last, F.col("page")), F.when(not_last, F.col("rank"))).alias("last_but")))

    def other(near: Column, farther: Column, page: Column) -> Column:
        """The closest page of the partition beside that is no copy of ``page``; null if there is none."""
        return F.when(differ(near, page), near).otherwise(farther)
    chosen = (ends.join(inner, "_pid")
              .select("_pid", other(F.lag("last").over(by_run), F.lag("last_but").over(by_run), F.col("first"))
                      .alias("previous"),
                      other(F.lead("first").over(by_run), F.lead("second").over(by_run), F.col("last")).alias("next"))
              # A partition of copies alone: what its own neighbour partition would see.
              .select("_pid", F.last("previous", True).over(by_run.rowsBetween(Window.unboundedPreceding, 0))
                      ["_pos"].alias("previous"),
                      F.last("next", True).over(Window.orderBy(F.desc("_pid"))
                                                .rowsBetween(Window.unboundedPreceding, 0))["_pos"].alias("next")))
    chosen = stage(chosen, "page-edges")
    wanted = chosen.select(F.explode(F.array("previous", "next")).alias("_pos")).filter("_pos is not null").distinct()
    pages = runs.join(wanted, "_pos", "left_semi").select("_pos", F.struct("host", "path", "lines").alias("page"))
    for side in ("previous", "next"):
        chosen = (chosen.join(pages.select(F.col("_pos").alias(side), F.col("page").alias(f"{side}_page")), side, "left")
                  .drop(side).withColumnRenamed(f"{side}_page", side))
    return chosen


def _notices(runs: DataFrame, salts: int) -> DataFrame:
    """spot, salt: the (host, line, place) that hold a notice of the host."""
    articles = runs.filter(F.col("article").isNotNull())
    spots = (articles.select("host", "article", F.explode(F.arrays_zip("at", "place")).alias("x"), "lines")
             .select("host", "article", _spot(F.get("lines", "x.at"), F.col("x.place")).alias("spot")).distinct()
             .groupBy("host", "spot").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ARTICLES))
    hosts = articles.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("all"))
    return (spots.join(hosts, "host").filter(2 * F.col("n") > F.col("all"))
            .select("spot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))


def _spot(line: Column, place: Column) -> Column:
    return F.xxhash64("host", line, place)


def shared_lines(pages: DataFrame, id_col: str, url_col: str, html_col: str, salts: int = 16) -> DataFrame:
    """(key, shared, notices): for every page the line numbers that its nearest
    neighbour has too, and those of them that are notices inside its article."""
    @F.pandas_udf("array<int>")
    def align(path: pd.Series, own: pd.Series, before_path: pd.Series, before: pd.Series, after_path: pd.Series,
              after: pd.Series) -> pd.Series:
        out = []
        for p, mine, bp, b, ap, a in zip(path, own, before_path, before, after_path, after):
            other = b if _nearness(p, bp) >= _nearness(p, ap) else a
            both = common_lines(mine.tolist(), other.tolist()) if other is not None else set()
            out.append(np.array(sorted(both), dtype=np.int32))
        return pd.Series(out, dtype=object)

    order = ["host", "path", "url", F.xxhash64("lines")]  # equal rows stand side by side
    runs = (sorted_runs(_parsed(pages, id_col, url_col, html_col), order, "pages")
            .withColumn("page", F.struct("host", "path", "lines")))
    w = run_window(order)
    back = Window.partitionBy("_pid").orderBy(*[F.desc(c) for c in order], F.desc(F.xxhash64("_pos")), F.desc("_pos"))

    def beside(rows: DataFrame, window: Window, name: str) -> DataFrame:
        """``name``: the last page in the window's order with other lines, the one before its run of copies."""
        turn = (F.col("beside")["host"] != F.col("host")) | (F.col("beside")["lines"] != F.col("lines"))
        rows = rows.withColumn("beside", F.lag("page").over(window)).withColumn("turn", turn)
        near = F.last(F.when(F.col("turn"), F.col("beside")), True).over(window.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(name, near).drop("beside", "turn")
    paired = (beside(beside(runs, w, "b"), back, "a")
              .join(_edges(runs, F.struct(*order, F.xxhash64("_pos"), "_pos")), "_pid")
              .withColumn("b", F.coalesce("b", "previous")).withColumn("a", F.coalesce("a", "next"))
              .withColumn("b", F.when(F.col("b.host") == F.col("host"), F.col("b")))
              .withColumn("a", F.when(F.col("a.host") == F.col("host"), F.col("a"))))
    both = paired.select("key", "host", "lines", "at", "place",
                         align("path", "lines", "b.path", "b.lines", "a.path", "a.lines").alias("shared"))
    # Shared article lines where a notice may stand.  A page without any
    # passes as one row, under a key that meets nothing and spreads.
    there = F.filter(F.arrays_zip("at", "place"), lambda x: F.array_contains("shared", x["at"]))
    asked = (both.select("key", "host", "lines", "shared", F.explode_outer(there).alias("x"))
             .select("key", "shared", "x.at", F.when(F.col("x").isNull(), F.xxhash64("key"))
                     .otherwise(_spot(F.get("lines", "x.at"), F.col("x.place"))).alias("spot"),
                     F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt")))
    notices = _notices(runs, salts).withColumn("found", F.lit(True))
    return (asked.join(notices, ["spot", "salt"], "left").groupBy("key")  # repeated rows: one answer
            .agg(F.min("shared").alias("shared"), F.collect_set(F.when(F.col("found"), F.col("at"))).alias("notices")))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars, n_shared: one row per page.

    Null html is an empty page (empty text); a null URL has the empty host
    and path; a page without another on its host but copies shares no lines.
    Repeated rows give the same text.  An empty table gives an empty result.
    """
    shared = shared_lines(pages, id_col, url_col, html_col)

    @F.pandas_udf("zones string, lines binary")
    def candidates(texts: pd.Series) -> pd.DataFrame:
        """A zone digit and a line for each block, compressed for the shuffle;
        lines of elements that are never content are blank."""
        out = []
        for text in texts:
            lines = lines_of(text or "")
            page = "\n".join(x if zone != CHROME else "" for zone, x in lines)
            out.append(("".join(str(zone) for zone, _ in lines),
                        zlib.compress(page.encode("utf-8", "surrogatepass"), 6)))
        return pd.DataFrame(out, columns=["zones", "lines"])

    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), candidates(F.col(html_col)).alias("c"),
                         row_key(F.col(id_col), F.concat_ws("\n", F.col(url_col), F.col(html_col))).alias("key"))

    @F.pandas_udf("string")
    def content(zones: pd.Series, lines: pd.Series, shared: pd.Series, notices: pd.Series) -> pd.Series:
        out = []
        for digits, packed, numbers, gone in zip(zones, lines, shared, notices):
            texts = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
            own = [set() if x is None else set(x.tolist()) for x in (numbers, gone)]
            out.append("\n".join(kept_lines([int(z) for z in digits], texts if digits else [], *own)))
        return pd.Series(out, dtype=object)

    return (keyed.select("id", "url", "c.zones", "c.lines", "key").join(shared, "key", "left")
            .select(F.col("id").alias(id_col), F.col("url").alias(url_col),
                    content("zones", "lines", "shared", "notices").alias("text"),
                    F.size("shared").cast("long").alias("n_shared"))
            .select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"), "n_shared"))
