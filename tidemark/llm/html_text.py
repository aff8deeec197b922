"""Main text of web pages: markup first, then nearest-URL page differencing for what markup leaves open.

Elements and class names that say what they are (nav, footer, adverts, forms, comments and so on) go, and lines
inside a declared article stay; where no article lies outside such class names and forms, one inside them stays too,
since a wrapper has a name as well. Every other line is open, on pages with a declared article too. For those, the page is
paired with the page nearest by URL path on its host, both are aligned by the longest common subsequence of lines, and
shared open lines are deleted: a template repeats from page to page, an article does not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: The end of a tag behind its name: quotes count as such only where a value begins, as in browsers.
TAG_END = re.compile(r"(?>[^>=]+|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+>")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
#: Elements whose content is raw text, that are dropped whole, that break lines, that never close.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "footer", "header", "aside", "form", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "title",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in a class name or id of an element that is not article text; those that are fit for parts of an
#: article, and elements that are; words before and behind which they name what a page has or has not; roles.
CHROME = set(
    """ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs
    footer footers header headers masthead sidebar sidebars side widget widgets cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay overlays newsletter newsletters subscribe
    subscription signup login comment comments commentlist replies reply disqus respond related recommended recommendations share sharing social toolbar pagination pager search skip complementary contentinfo toc
    tags outbrain taboola""".split()
)
OWN_WORDS, OWN_ELEMENTS = {"header", "headers"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
BEFORE = {"no", "has", "have", "with", "without", "non", "not", "hide", "is"}
BEHIND = {"enabled", "disabled", "free", "open", "closed", "on", "off", "less"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words that a label of an element that is not article text may have beside one of ``CHROME``.
LABEL_WORDS = {"main", "primary", "secondary", "site", "page", "post", "posts", "top", "bottom", "the", "this", "your", "area", "bar", "section", "links", "list", "form", "us", "media", "stories", "articles", "content", "article"}
WORD = re.compile(r"[a-z]+")
MAIN = {"article", "main"}
RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}

#: Rows of the staged table: a page with its text, a page that waits for what lies across a cut, and for each partition
#: its first and last group of copies (one row if there is only one), with the neighbour that is known.
DONE, WAITS, GROUP = range(3)
FIRST, LAST, BOTH = range(3)
LINES = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("last_path", pa.string()), ("text", pa.string()), ("lines", pa.list_(pa.string())), ("open", pa.list_(pa.bool_())), ("near_path", pa.string()), ("near_lines", pa.list_(pa.string()))])
LINES_SQL = "kind int, part int, side int, page_id long, url string, host string, path string, last_path string, text string, lines array<string>, open array<boolean>, near_path string, near_lines array<string>"
SIDES = pa.schema([("at_part", pa.int32()), ("at_side", pa.int32()), ("before_path", pa.string()), ("before_lines", pa.list_(pa.string())), ("after_path", pa.string()), ("after_lines", pa.list_(pa.string()))])
SIDES_SQL = "at_part int, at_side int, before_path string, before_lines array<string>, after_path string, after_lines array<string>"


def is_chrome(attributes: str, own: bool = False) -> bool:
    """Whether an element's attributes say that it is not article text. ``own``: inside an article."""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ROLES:
            return True
        if name == "aria-label" and (words := WORD.findall(value)) and not CHROME.isdisjoint(words) and CHROME.union(LABEL_WORDS).issuperset(words):
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = WORD.findall(one)
                found = CHROME.intersection(words)
                if found and not (own and found <= OWN_WORDS) and words[0] not in BEFORE and words[-1] not in BEHIND:
                    return True
    return False


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", ""), ("<", name, attributes) and (">", name, "") of a page, in one pass whatever it holds.

    A tag that no > closes outside quotes ends at the next >; where none comes, < is text. A comment that does not
    close is the rest of the page.
    """
    at, size, last = 0, len(source), source.rfind(">")
    text = 0
    while at <= last and (begin := source.find("<", at, last)) >= 0:
        if source.startswith("<!--", begin):
            ends = [x + n for x, n in ((source.find("-->", begin + 2), 3), (source.find("--!>", begin + 4), 4)) if x >= 0] if begin + 4 <= size else []
            if begin > text:
                yield source[text:begin], "", ""
            at = text = min(ends, default=size)
            continue
        name = NAME.match(source, begin + 1)
        if name is None and source[begin + 1] not in "!?/":
            at = begin + 1
            continue
        if begin > text:
            yield source[text:begin], "", ""
        found = TAG_END.match(source, name.end()) if name else None
        at = text = found.end() if found else source.find(">", begin) + 1
        if name:
            tag = name[2].lower()
            yield (">", tag, "") if name[1] else ("<", tag, source[name.end() : at - 1])
            if tag in RAW and not name[1]:
                end = RAW_END[tag].search(source, at)
                at = text = size if end is None else source.find(">", end.start()) + 1 or size
    end = source.find("<!--", max(text, last))
    if text < (size if end < 0 else end):
        yield source[text : size if end < 0 else end], "", ""


def page_lines(source: str | None) -> tuple[list[str], list[bool]]:
    """The lines that markup leaves, and for each whether it is open (outside a declared article)."""
    lines: list[tuple[str, bool, int]] = []  # line, whether in an article, named elements and forms around that
    stack: list[tuple[str, str]] = []  # element, what it is: hard or soft chrome, soft inside an article, main part
    places: dict[str, list[int]] = {}  # where in the stack an element is open
    depth = {"": 0, "hard": 0, "soft": 0, "inner": 0, "main": 0}
    mains: list[int] = []
    held: list[str] = []

    def gone() -> bool:
        return bool(depth["hard"] or depth["inner"] or depth["soft"] and not depth["main"])

    def flush() -> None:
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if line:
                lines.append((line, depth["main"] > 0, depth["soft"]))

    def close(level: int) -> None:
        while len(stack) > level:
            name, what = stack.pop()
            places[name].pop()
            depth[what] -= 1
            if what == "main":
                mains.pop()

    for text, name, attributes in tokens(source or ""):
        if not name:
            if not gone():
                held.append(text)
            continue
        if name in BLOCK and not gone():
            flush()
        if text == ">":
            # what is no block does not close an article from inside
            if places.get(name) and (name in BLOCK or not mains or mains[-1] < places[name][-1]):
                close(places[name][-1])
            continue
        if name in RAW or name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        inside = depth["main"] > 0
        what = ""
        if name in MAIN or 'role="main"' in attributes:
            what = "main"
        elif name in DROPPED and name != "form":
            what = "hard"
        elif name == "form" or name not in ("html", "body") and not (inside and name in OWN_ELEMENTS) and attributes and is_chrome(attributes, inside):
            what = "inner" if inside else "soft"
        if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends at the next block
            close(len(stack) - 1)
        if name in BLOCK or what:
            if not gone():
                flush()
            if what == "main":
                mains.append(len(stack))
            places.setdefault(name, []).append(len(stack))
            stack.append((name, what))
            depth[what] += 1
    if not gone():
        flush()
    # an article inside a named element or a form is the page's own only if none lies further outside
    around = min((n for _, inside, n in lines if inside), default=0)
    kept = [(x, not inside) for x, inside, n in lines if n == (around if inside else 0)]
    return [x for x, _ in kept], [x for _, x in kept]


def common_subsequence(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of lines. Bit-parallel: a row of the table is one integer."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    where: dict[str, int] = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for line in x:
        u = row & where.get(line, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, i, j = [], len(x), len(y)
    while i and j:
        # a zero bit j-1 in a row marks where the best length grows at column j
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return [*range(lead), *(lead + k for k in reversed(out)), *range(len(a) - tail, len(a))]


def nearness(a: str, b: str) -> int:
    """Leading path segments in common."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def without_shared(lines: list[str], is_open: list[bool], near: list[list[str]], copy_share: float) -> str:
    """The page's text. ``near``: lines of other pages that are no exact copies, the nearest first.

    The first of them with at most ``copy_share`` of the page's lines in common decides, or else the one with the
    fewest; its shared open lines are deleted. A page of nothing but shared open lines keeps them.
    """
    if near and any(is_open):
        shares = [common_subsequence(lines, x) for x in near]
        shared = next((x for x in shares if len(x) <= copy_share * len(lines)), min(shares, key=len))
        gone = {k for k in shared if is_open[k]}
        if len(gone) < len(lines):
            return " ".join(x for k, x in enumerate(lines) if k not in gone)
    return " ".join(lines)


def _near(path: str, *pages: tuple | None) -> list[list[str]]:
    """Lines of those (path, lines) that are known, the nearest first; in the order given on a tie."""
    return [x[1] for x in sorted((x for x in pages if x is not None), key=lambda x: -nearness(path, x[0]))]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages go through the exchange compressed by more than Spark's own block compression gives."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        html_packed = pa.array([pack.compress((x or "").encode()) for x in batch.column("html").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), html_packed], names=["page_id", "url", "host", "path", "packed"])


def _extract(copy_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by host and path. Exact copies in a row form a group, compared with the pages around it;
        of a group the lines are held once. The first and the last group of a partition wait for their other
        neighbour; empty pages stand in no way."""
        unpack = zstandard.ZstdDecompressor()
        part = TaskContext.get().partitionId()
        none = dict.fromkeys(LINES.names)
        group: list[tuple] = []  # id, url, path, open (one list for all that are equal)
        host, lines, before, first = "", [], None, True

        def settle(after: tuple | None, last: bool) -> Iterator[dict]:
            side = BOTH if first and last else FIRST if first else LAST
            for key, url, path, is_open in group:
                row = none | {"page_id": key, "url": url}
                if not (first or last) or not any(is_open):
                    yield row | {"kind": DONE, "text": without_shared(lines, is_open, _near(path, before, after), copy_share)}
                else:
                    yield row | {"kind": WAITS, "part": part, "side": side, "path": path, "lines": lines, "open": is_open}
            if first or last:
                near = (None, None) if side == BOTH else ((before if last else after) or (None, None))
                yield none | {"kind": GROUP, "part": part, "side": side, "host": host, "path": group[0][2], "last_path": group[-1][2], "lines": lines, "near_path": near[0], "near_lines": near[1]}

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(rows, schema=LINES)
            rows.clear()
            return made

        out: list[dict] = []
        for batch in batches:
            for key, url, page_host, path, packed in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "host", "path", "packed"))):
                page, page_open = page_lines(unpack.decompress(packed).decode())
                if not page:
                    out.append(none | {"kind": DONE, "page_id": key, "url": url, "text": ""})
                    continue
                if group and (page_host != host or page != lines):
                    for row in settle((path, page) if page_host == host else None, False):
                        out.append(row)
                        if len(out) >= common.ARROW_ROWS:
                            yield batch_of(out)
                    before = (group[-1][2], lines) if page_host == host else None
                    group, first = [], False
                host, lines = page_host, page
                group.append((key, url, path, group[-1][3] if group and group[-1][3] == page_open else page_open))
            yield batch_of(out)
        for row in settle(None, True) if group else ():
            out.append(row)
            if len(out) >= common.ARROW_ROWS:
                yield batch_of(out)
        yield batch_of(out)

    return common.lean(run)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the groups at the edges of partitions, in order, the neighbours on both sides. Groups with the same lines on
    either side of a cut are one; only those not yet settled are held, at most two a partition."""
    chain: list[dict] = []
    before: tuple | None = None  # host, path and lines of the last page before the chain

    def settled(after: dict | None) -> Iterator[dict]:
        head, tail = chain[0], chain[-1]
        if head["side"] == LAST:
            first = head["near_path"] is not None and (head["near_path"], head["near_lines"])
        else:
            first = before is not None and before[0] == head["host"] and before[1:]
        if tail["side"] == FIRST:
            last = tail["near_path"] is not None and (tail["near_path"], tail["near_lines"])
        else:
            last = after is not None and after["host"] == tail["host"] and (after["path"], after["lines"])
        for r in chain:
            yield dict(zip(SIDES.names, (r["part"], r["side"], *(first or (None, None)), *(last or (None, None)))))

    for batch in batches:
        out: list[dict] = []
        for r in batch.to_pylist():
            if chain:
                same = r["side"] != LAST and (r["host"], r["lines"]) == (chain[0]["host"], chain[0]["lines"])
                if not same:
                    out += settled(r)
                    before = (chain[-1]["host"], chain[-1]["last_path"], chain[-1]["lines"])
                    chain = []
                else:
                    r["lines"] = chain[0]["lines"]
            chain.append(r)
        yield pa.RecordBatch.from_pylist(out, schema=SIDES)
    if chain:
        yield pa.RecordBatch.from_pylist(list(settled(None)), schema=SIDES)


def _waiting(copy_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r in batch.to_pylist():
                near = [None if r[f"{x}_path"] is None else (r[f"{x}_path"], r[f"{x}_lines"]) for x in ("before", "after")]
                texts.append(without_shared(r["lines"], r["open"], _near(r["path"], *near), copy_share))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return common.lean(run)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy_share: float = 0.8) -> DataFrame:
    """(id, url, ``text``) of every row. Null and empty pages give an empty text; a null URL is a host of its own
    with an empty path. Rows that share an id or a URL are each extracted; copies of a page do not delete each
    other's lines. Empty tables give no rows. Other columns are ignored, whatever their names.

    A host that has a third of all pages spreads over partitions by path, and a page with a third of all copies by id.
    One row for the first and the last group of copies of each partition goes through one task afterwards, to find
    their neighbours across the cut; their pages are settled where they are.
    """
    spark = common.tuned(pages.sparkSession)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.col(html_col).cast("string").alias("html"),
    )
    keys = ["host", "path", "page_id"]
    packed = rows.mapInArrow(_packed, "page_id long, url string, host string, path string, packed binary")
    ordered = packed.repartitionByRange(common.partitions(spark), *keys).sortWithinPartitions(*keys)
    found, _ = common.staged(ordered.mapInArrow(_extract(copy_share), LINES_SQL), "page-lines")
    groups = found.where(F.col("kind") == GROUP).select("part", "side", "host", "path", "last_path", "lines", "near_path", "near_lines")
    sides = groups.repartition(1).sortWithinPartitions("part", "side").mapInArrow(common.lean(_sides), SIDES_SQL)
    late = found.where(F.col("kind") == WAITS).select("part", "side", "page_id", "url", "path", "lines", "open").join(sides, (F.col("part") == F.col("at_part")) & (F.col("side") == F.col("at_side")))
    late = late.mapInArrow(_waiting(copy_share), "page_id long, url string, text string")
    return found.where(F.col("kind") == DONE).select("page_id", "url", "text").unionByName(late).withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
