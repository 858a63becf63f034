"""Main text of web pages: structure gives the token streams, a host's repeated runs are cut out.

A page becomes blocks of text, each of the main region (article, main), of the page's
furniture (menus, headers, footers, adverts, forms, comments), or open. The blocks of the
main region, or of a page without one the open ones, are its token stream. All suffixes of
the streams of a host form its *host suffix array*, which is dealt over tasks by the first
``RUN`` tokens of the suffixes: suffixes that begin alike are neighbours there, and their
common prefix has at least that length. Where neighbours come from ``PAGES`` distinct pages
the prefix is boilerplate and what it covers is removed; runs that overlap add up to longer
ones. Only suffixes near an anchor that two pages share are dealt at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm import spans
from evigrid.llm.arrays import blocks, covered, mix, rolling, word_hashes
from evigrid.plans.lineage import written

U = np.uint64
#: Tokens of a run that counts as long, distinct pages of a host that make it boilerplate, and
#: tokens of an anchor: every run has one, that with the least hash.
RUN, PAGES, ANCHOR = 8, 3, 4

# HTML element names and the words sites use for page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg canvas audio video select textarea button option datalist".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
#: Of these, what may stand around a whole page; likewise the roles.
AROUND, AROUND_ROLES = frozenset("form dialog menu".split()), frozenset("dialog form".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar side-bar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies "
    "newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay toolbar pagination pager widget skip-link".split()
)
#: An open element that ends where one of these starts.
CLOSES = {"li": {"li"}, "p": BLOCK, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Parts of a class name that say nothing by themselves: ``comment-list`` and ``site-footer`` are furniture, ``with-sidebar`` is not.
NEUTRAL = frozenset(
    "area bar block box container content global inner item items left list outer page panel right section site slot sticky the top unit wrap wrapper".split()
)
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
OPEN, MAIN, CHROME, NESTED = 0, 1, 2, 3


def _by_name(attrs: dict[str, str | None]) -> bool:
    """Whether a class or the id names page furniture, by the whole name."""
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = [x.lower() for x in PARTS.split(name) if x]
        if name.lower() in WORDS or (not WORDS.isdisjoint(parts) and all(x in WORDS or x in NEUTRAL for x in parts)):
            return True
    return False


def _furniture(tag: str, attrs: dict[str, str | None], in_main: bool) -> int:
    """1: furniture whatever it holds; 2: furniture but for an article inside; 0: none."""
    role = (attrs.get("role") or "").lower()
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (attrs.get("style") or "").lower()):
        return 1
    if (tag in FURNITURE and tag not in AROUND) or (tag == "header" and not in_main) or (role in ROLES and role not in AROUND_ROLES):
        return 1
    if tag in AROUND or role in AROUND_ROLES:
        return 2
    return 2 if tag not in ("html", "body", "main") and _by_name(attrs) else 0


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, silent, furniture, region (MAIN, NESTED: inside furniture)
        self.out: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.kind = OPEN
        self.titles: set[int] = set()  # the kinds of text that have a heading of the first rank

    def _state(self) -> tuple[bool, int, int]:
        return self.stack[-1][1:] if self.stack else (False, 0, OPEN)

    def _end(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.out.append((self.kind, line))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.stack and tag in CLOSES.get(self.stack[-1][0], ()):
            self.stack.pop()
        if tag in BLOCK:
            # A block that starts inside inline elements of an open paragraph ends that paragraph.
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name == "p":
                    del self.stack[k:]
                if name in BLOCK:
                    break
            self._end()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        silent, chrome, region = self._state()
        found = dict(attrs)
        is_main = tag in ("article", "main") or (found.get("role") or "").lower() in ("main", "article")
        own = _furniture(tag, found, region != OPEN)
        if is_main and region == OPEN and 1 not in (chrome, own):
            # An article that is, or is inside, what only may be furniture counts where the page has no other.
            region, chrome = NESTED if chrome or own else MAIN, 0
        elif chrome != 1 and own:
            chrome = min(chrome or own, own)
        self.stack.append((tag, silent or tag in SILENT, chrome, region))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        silent, chrome, region = self._state()
        if silent:
            return
        kind = CHROME if chrome else region
        if kind != self.kind:
            self._end()
            self.kind = kind
        if data.strip() and any(x[0] == "h1" for x in self.stack):
            self.titles.add(kind)
        self.text.append(data)


def page_blocks(html: str | None) -> tuple[list[tuple[int, str]], set[int]]:
    """``(kind, text)`` of the blocks of a page, in page order; and the kinds that have its title."""
    p, html = _Blocks(), html or ""
    last = html.rfind("<")
    if last >= 0 and ">" not in html[last:] and re.match(r"<[A-Za-z/!]", html[last:]):
        html = html[:last]  # a tag that the page's end cuts off
    try:
        p.feed(html)
        p.close()
    except AssertionError:  # a broken declaration; what was read stands
        pass
    p._end()
    return p.out, p.titles


def stream(html: str | None) -> str:
    """The blocks of a page that may be its main text, a line each: those of its articles, of a page
    without one the open ones. Where the title stands outside the articles the open blocks count too."""
    found, titles = page_blocks(html)
    size = {k: sum(len(t) for x, t in found if x == k) for k in (MAIN, NESTED, OPEN)}
    kinds = {MAIN} if size[MAIN] else {NESTED} if size[NESTED] > size[OPEN] else {OPEN}
    if OPEN in titles and not titles & kinds:
        kinds.add(OPEN)
    return "\n".join(t for k, t in found if k in kinds)


def _suffixes(data: np.ndarray, offs: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """``(text, place, anchor, first half, second half)`` of every suffix with ``run`` tokens. The first
    token of each text is its host, which is in no suffix and in all hashes."""
    a, b, text, place = word_hashes(data, offs)
    n = len(a) - run + 1
    if n <= 0:
        return text[:0], place[:0], a[:0], a[:0], a[:0]
    host = a[np.flatnonzero(place == 0)][np.cumsum(place == 0) - 1]
    size = min(ANCHOR, run)
    short = mix(rolling(a, size) ^ host[: len(a) - size + 1])
    anchor = short[:n].copy()
    for k in range(1, run - size + 1):
        np.minimum(anchor, short[k : k + n], out=anchor)
    good = np.flatnonzero((text[:n] == text[run - 1 :]) & (place[:n] > 0))
    # Least hashes crowd at the low end; scrambled again they spread over the buckets.
    return text[good], place[good] - 1, mix(anchor[good] ^ U(0x5851F42D4C957F2D)), mix(rolling(a, run) ^ host[:n])[good], mix(rolling(b, run) ^ host[:n])[good]


def main_texts(pages: DataFrame, run: int = RUN, least_pages: int = PAGES, bits: int = spans.FILTER_BITS) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row.

    White space inside a block is one space, blocks are joined by a line feed, character
    references are decoded. Runs of ``run`` tokens or more that ``least_pages`` distinct pages
    of the host have are removed. They may cross blocks, but take less than ``run`` tokens from
    a block only if they cover all of it, so that a story keeps its first words. A page that would lose four fifths of its
    tokens or more is itself a near copy of others, not boilerplate, and stays whole. Pages with equal text count
    once.

    A null or empty page has an empty text; broken markup is read as far as it goes; very long
    pages are read whole. Repeated rows give repeated results; an empty table gives none; null
    ids and urls pass through (pages without a host are one host); other columns are not looked
    at. Runs and pages are told apart by 128 bits of hash.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([stream(x.as_py()) for x in b.column(3)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], text], names=["page_id", "url", "host", "text"])

    spark = pages.sparkSession
    n = spans.buckets_of(spark)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    host = F.concat(F.lit("//"), F.regexp_replace(host, r"[\x20\x09-\x0D]+", "-"))
    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    read = pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(parse, f"page_id {kind['page_id']}, url {kind['url']}, host string, text string")
    read = written(read.select("*", F.xxhash64("host", "text").alias("doc_id"), F.xxhash64(F.lit(1), "host", "text").alias("tag")), "pages")
    streams = read.where("text <> ''").select("doc_id", "tag", F.concat_ws("\n", "host", "text").alias("text"))

    def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, _, anchor, *_ = _suffixes(data, offs, run)
        return anchor, text

    shared = spans.shared_filter(streams, anchors, bits, least_pages)

    def settle_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            found = [np.concatenate([x[k] for x in held]) for k in range(5)]
            many, few = _common(*found[:4], least_pages)
            rows = [(k, 1, blob) for k, blob in spans.flag_blobs(*(x[many] for x in found[2:]), n)]
            # Of a run that is common here as many pages go on as show it: others may have it too.
            left = [x[~many | few] for x in found]
            rows += [(k, 0, spans.packed_windows(*(x[at] for x in left))) for k, at in spans.split_by(spans.bucket(left[0], n), n)]
            return spans.rows_batch(rows)

        for b in batches:
            ids, tags = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, j, data, offs in blocks(b.column(2), 1 << 20):
                text, place, anchor, x, y = _suffixes(data, offs, run)
                keep = shared.marked(anchor)
                t = text[keep]
                held.append((x[keep], y[keep], ids[i:j][t], tags[i:j][t], place[keep]))
                if sum(len(h[0]) for h in held) >= spans.FLUSH:
                    yield out()
                    held = []
        if held:
            yield out()

    def judge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, doc, tag, start = (np.concatenate(v) for v in zip(*map(spans.unpacked_windows, blobs)))
        many, _ = _common(x, y, doc, tag, least_pages)
        return doc[many], tag[many], start[many]

    hits = written(spans.settle(streams.mapInArrow(settle_own, spans.ROWS_DDL), judge), "runs")
    touched = spans.bitmap(hits.select(F.col("doc_id").alias("slot")), bits)

    def split(wanted: bool):
        def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                marks = touched.marked(b.column(0).to_numpy(zero_copy_only=False).view(U))
                yield b.filter(pa.array(marks == wanted))

        return run_

    def unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut(text, spans.starts_of(blob), run) for text, blob in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    # Pages that no run touches stay where they are; only the others meet their runs.
    rows, ddl = read.select("doc_id", "tag", "page_id", "url", "text"), f"doc_id long, tag long, page_id {kind['page_id']}, url {kind['url']}, text string"
    whole = rows.mapInArrow(split(False), ddl).select("page_id", "url", "text")
    both = rows.mapInArrow(split(True), ddl).join(hits, ["doc_id", "tag"], "left").select("page_id", "url", "text", "starts")
    done = whole.union(both.mapInArrow(unique_runs, f"page_id {kind['page_id']}, url {kind['url']}, text string"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def _common(x: np.ndarray, y: np.ndarray, doc: np.ndarray, tag: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry whether its run (``x``, ``y``) is on ``least`` distinct pages, and whether it is the
    first entry of one of that many pages."""
    if not len(x):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((tag, doc, y, x))
    x, y, doc, tag = x[order], y[order], doc[order], tag[order]
    new_run = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    new_page = new_run | np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    first = np.flatnonzero(new_run)
    size = np.diff(np.append(first, len(x)))
    page = np.cumsum(new_page)
    page -= np.repeat(page[first], size)  # the page's number in its run
    many, few = np.empty(len(x), bool), np.empty(len(x), bool)
    many[order] = np.repeat(np.maximum.reduceat(page, first) + 1 >= least, size)
    few[order] = new_page & (page < least)
    return many, few


def cut(text: str, places: np.ndarray, run: int) -> str:
    """``text`` without the tokens that runs at ``places`` cover, unless that is four fifths of it."""
    if not len(places):
        return text
    lines = [line.split(" ") for line in text.split("\n")]
    n = sum(map(len, lines))
    mask = covered(places, run, n)
    if 5 * int(mask.sum()) >= 4 * n:
        return text
    at, kept = 0, []
    for line in lines:
        gone = mask[at : at + len(line)]
        at += len(line)
        if not gone.all():
            edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            for i, j in zip(edges[::2], edges[1::2]):
                if j - i < run:  # the end of a run from the block before, or the start of one into the next
                    gone[i:j] = False
            kept.append(" ".join(w for w, m in zip(line, gone.tolist()) if not m))
    return "\n".join(kept)
