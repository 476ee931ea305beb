"""HTML extraction: page differencing against the nearest URL of the same host, over parsed blocks."""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relpredict.llm.common import stored
from relpredict.llm.url_rules import split_url

#: Two pages that share at least this part of their text are copies, not pages of one template.
COPY_SHARE = 0.5

#: Elements that never hold main text, those whose content isn't markup, and void ones.
SKIPPED = set(
    "head title nav header footer aside form menu dialog button select option textarea input label "
    "svg math iframe object embed canvas video audio template noscript map".split()
)
RAW = "script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a line; all others end it.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Words of a class, id or role that mark what surrounds an article.
SURROUNDINGS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar "
    "cookie cookies consent notice popup modal overlay newsletter subscribe subscription signup share "
    "sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation footer header "
    "masthead comment comments respond replies disqus toolbar widget login search contentinfo "
    "complementary form dialog alert alertdialog pagination pager".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+|[^<>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_MARKED = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    main: bool


def _surrounds(name: str, rest: str) -> bool:
    if name in SKIPPED:
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for found in _MARKED.finditer(rest):
        key, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if key == "hidden" or key == "style" and _HIDDEN.search(value):
            return True
        if key in ("class", "id", "role") and not SURROUNDINGS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def blocks(page: str | None) -> list[Block]:
    """Lines of text outside menus, forms, adverts and the like; of the article alone if one is marked up."""
    out: list[Block] = []
    pending: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, main
    skipped = main = 0

    def close() -> None:
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                out.append(Block(text, main > 0))

    def pop() -> str:
        nonlocal skipped, main
        name, was_skipped, was_main = stack.pop()
        if was_skipped or was_main:
            close()
        skipped -= was_skipped
        main -= was_main
        return name

    at, page = 0, page or ""
    for token in _TOKEN.finditer(page):
        if not skipped and token.start() > at:
            pending.append(page[at : token.start()])
        at = token.end()
        if token["name"] is None:
            continue
        name = token["name"].lower()
        if name not in INLINE:
            close()
        if token["end"]:
            if any(n == name for n, _, _ in stack):
                while pop() != name:
                    pass
            continue
        if name in VOID or token["rest"].endswith("/") and name in SKIPPED:
            continue
        if name in ("article", "main") and skipped and stack[-1][0] in ("nav", "header", "form", "head", "ul", "li", "a", "p"):
            while skipped:  # an unclosed menu must not swallow the article
                pop()
        if name == "body":
            while stack and stack[-1][0] != "html":
                pop()
        if name == "p" and stack and stack[-1][0] == "p":
            pop()
        surrounds, is_main = _surrounds(name, token["rest"]), name in ("article", "main")
        if surrounds:
            close()
        stack.append((name, surrounds, is_main))
        skipped += surrounds
        main += is_main
    if not skipped:
        pending.append(page[at:])
    close()
    return [b for b in out if b.main] if any(b.main for b in out) else out


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` that a longest common subsequence of ``a`` and ``b`` aligns (Hunt and Szymanski)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def _dropped(own: dict, others: list[dict]) -> list[int]:
    """Lines of a page to delete, ``others`` being its neighbours on the host, the nearest first.

    Outside a marked-up article what the nearest shares goes; of a page that shares half its text
    only what both neighbours share, for a template goes on where a copy ends. Inside an article a
    line goes that both neighbours share, neither of them being a copy. No page loses everything.
    """
    words, marks = own["words"], own["marks"]
    aligned = [shared_lines(own["hashes"], other["hashes"]) for other in others]
    alike = [sum(words[i] for i in places) >= COPY_SHARE * max(sum(words), 1) for places in aligned]
    several = len(others) == 2 and others[0]["hashes"] != others[1]["hashes"]
    both = set(aligned[0]).intersection(aligned[1]) if several else set()
    gone = both if alike[0] else set(aligned[0])
    gone = [i for i in sorted(gone | both) if not marks[i] or i in both and not any(alike)]
    return gone if len(gone) < len(words) else []


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _hash(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parsed = [blocks(h.as_py()) for h in batch.column(3)]
        columns = [
            pa.array([[_hash(b.text) for b in p] for p in parsed], pa.list_(pa.int64())),
            pa.array([[len(b.text.split()) for b in p] for p in parsed], pa.list_(pa.int32())),
            pa.array([[b.main for b in p] for p in parsed], pa.list_(pa.bool_())),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["key", "host", "path", "hashes", "words", "marks"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, found = [], []
        for row in batch.to_pylist():
            sides = [row[p] for p in ("before", "after") if row[p] is not None]
            if sides:
                sides.sort(key=lambda s: -_common(row["path"], s["path"]))  # the first of equals stays first
                if gone := _dropped(row, sides):
                    keys.append(row["key"])
                    found.append(gone)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["key", "gone"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, gone in zip(batch.column(2), batch.column(3), strict=True):
            drop = set(gone.as_py() or ())
            out.append(" ".join(b.text for i, b in enumerate(blocks(page.as_py())) if i not in drop))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    A page is parsed into lines of text; what elements, classes or roles mark as surroundings is left
    out, and only the article counts where one is marked up. Each page is then paired with its
    neighbour in URL path order within its host (the one with the longer common path start, ties to
    the one before), their lines are aligned by longest common subsequence, and shared lines go. Inside
    a marked-up article, and on pages that share half of their text, a line goes only if the
    neighbour on the other side shares it too: copies keep their text, templates don't.

    Only line hashes are put in order, by a range over host and path, so a crowded host spreads over
    many tasks; neighbours meet through their rank, one row each. The pages themselves are joined
    with the lines to delete. A null or empty ``html`` gives an empty text; pages without a host (null
    or odd URLs) share the empty one. Repeated rows are compared once and all returned. Other columns
    are not read.
    """
    key = F.xxhash64("page_id", "url", "html").alias("key")
    located = split_url(pages.select("url", "html", key), "key", "html").select("key", "host", "path", "html")
    parsed = located.mapInArrow(_lines, "key bigint, host string, path string, hashes array<bigint>, words array<int>, marks array<boolean>")
    gone = _deletions(stored(parsed.dropDuplicates(["key"]), "lines"))
    joined = pages.select("page_id", "url", "html", key).join(gone, "key", "left").select("page_id", "url", "html", "gone")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema)
    return joined.mapInArrow(_texts, f"{kinds}, text string")


def _deletions(lines: DataFrame) -> DataFrame:
    """``key`` and ``gone`` (line numbers) of the pages that lose lines."""
    ordered = lines.select("key", "host", "path").orderBy("host", "path", "key")
    placed = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "order")
    task, place = F.shiftright("at", 33).alias("task"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")
    ahead = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(task).agg(F.count("*").alias("n")).select("task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    ranked = placed.select("key", task, place).join(offsets, "task").select("key", (F.col("offset") + F.col("place")).alias("rank"))
    rows = stored(lines.join(ranked, "key"), "ranked")
    page = F.struct("host", "path", "hashes", "words", "marks").alias("page")
    before = rows.select((F.col("rank") + 1).alias("rank"), page.alias("before"))
    after = rows.select((F.col("rank") - 1).alias("rank"), page.alias("after"))
    same = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), F.col(side)).alias(side)
    pairs = rows.join(before, "rank", "left").join(after, "rank", "left")
    pairs = pairs.select("key", "path", "hashes", "words", "marks", same("before"), same("after"))
    return stored(pairs.mapInArrow(_compared, "key bigint, gone array<int>"), "gone")
