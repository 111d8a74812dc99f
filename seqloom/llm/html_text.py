"""Main text of web pages: structural zones, and a host suffix array for the blocks that they leave open.

A page with an article (or main) element gives its blocks without the menus,
notices and forms within. Open are its blocks inside elements whose class or id
only hints at a notice or teaser, and all blocks of a page without an article:
there, the suffixes of the open token streams of a host are grouped by their
first tokens, as in a suffix array of that depth; the tokens of substrings
repeated across distinct pages are boilerplate and the unique runs stay. (In
the other blocks of an article the suffix array would delete passages that
several articles share, which must be kept.)
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import words as W
from seqloom.llm._spark import attach, materialize

#: Elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("nav header footer aside form menu dialog head title script style noscript template iframe object svg canvas audio video button select textarea".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("body html option caption legend tbody td tfoot th thead tr title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: What may stand in a head; other elements and text end it.
HEAD = frozenset("head title meta link base script style noscript template basefont bgsound noframes".split())
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|discussion|disqus|respond|replies)(?:$|[\s_-])", re.I)
#: Whole class names or ids of notices and adverts, wherever they stand.
NOTICES = re.compile(r"(?:^|(?<=\s))(?:ads?|advert|advertisement|adsbygoogle|sponsored|cookie-(?:notice|banner|consent)|newsletter(?:-signup)?|(?:share|social)-(?:buttons|links)|related-(?:posts|articles|links))(?=\s|$)", re.I)
#: An article element of these classes is another article's preview.
TEASER = re.compile(r"(?:^|[\s_-])(?:teaser|card|preview|excerpt|summary|related|promo|sponsored)(?:$|[\s_-])", re.I)
#: Words of notices and teasers; an article inside counts if the page has none elsewhere, and inside an article the host decides.
CHROME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|share|social|related|pagination|widget)(?:$|[\s_-])", re.I)
#: Classes that tell what a page has or lacks, not what the element is.
STATES = re.compile(r"(?:^|(?<=\s))(?:(?:no|has|with|without)[_-]\S*|comments?[_-](?:open|closed|enabled|disabled|off|on))(?=\s|$)", re.I)
#: Words that may also name the layout around an article: an article or main element inside undoes them.
LAYOUT = re.compile(r"(?:^|[\s_-])(?:banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead)(?:$|[\s_-])", re.I)
#: Elements that end an open one of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: A quote that is never closed ends at the next >.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:[\"'][^>]*)?>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
WHITE = re.compile(r"\s+")
TOKENS, PAGES = 8, 3
#: Pages whose tokens are hashed at a time.
SLICE = 256


def _chrome(name: str, attributes: str) -> int:
    """3: not part of the text; 2: not, unless the page's only article or main element is inside; 1: not, unless any is inside; 0: may be."""
    if name in DROPPED and name != "form":
        return 3
    if not attributes or name in ("html", "body", "main"):
        return int(name == "form")
    found = int(name == "form")
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            value = STATES.sub(" ", value) if "-" in value or "_" in value else value
            if name == "article":
                found = max(found, 3 if COMMENTS.search(value) else 2 if TEASER.search(value) else 0)
            else:
                found = max(found, 3 if COMMENTS.search(value) else 2 if CHROME.search(value) else 1 if LAYOUT.search(value) else 0)
        elif key == "role" and value.lower() in ROLES or key == "aria-hidden" and value == "true":
            return 3
        elif key == "role" and value.lower() == "form":
            found = max(found, 1)
    return 3 if re.search(r"(?:^|\s)hidden(?:\s|$|=)", ATTRIBUTE.sub(" ", attributes)) else found


def _dropped_inside(name: str, attributes: str) -> bool:
    """Whether an element within an article is surely not its text: forms, and what is named a notice or advert."""
    return name == "form" or any(m[1].lower() in ("class", "id") and bool(NOTICES.search(m[2] or m[3] or m[4] or "")) or m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() == "form" for m in ATTRIBUTE.finditer(attributes))


def blocks(page: str) -> tuple[list[str], bool]:
    """(texts of the page's blocks, whether they are of an article or main element; else of the whole page, undecided)."""
    found, decided = zones(page)
    return [t for t, _ in found], decided


def zones(page: str) -> tuple[list[tuple[str, bool]], bool]:
    """((text, open) of the page's blocks, whether they are of an article or main element); open: the host decides.

    Both are taken where chrome is least: articles outside notices and teasers
    before those inside; without any text in an article, the text outside
    layout and forms, then that inside, then that of notices and teasers, all
    open. Menus, footers, comment lists and hidden elements never; nor forms,
    notices and articles that are comments or teasers within an article. The
    time is linear in the page, however deep it is nested.
    """
    inside: list[tuple[str, int, int]] = []  # open elements: name, chrome (within the article, if in one), of the article (-1: in none)
    opened: Counter[str] = Counter()
    main: list[list[tuple[str, bool]]] = [[], [], []]
    rest: list[list[tuple[str, bool]]] = [[], [], []]
    text: list[str] = []
    chrome, article = 0, -1

    def flush() -> None:
        if text:
            joined = WHITE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if joined and chrome < 3:
                (rest[chrome] if article < 0 else main[article]).append((joined, article < 0 or chrome > 0))

    def leave(k: int) -> None:
        nonlocal chrome, article
        flush()
        opened.subtract(x[0] for x in inside[k:])
        del inside[k:]
        chrome, article = inside[-1][1:] if inside else (0, -1)

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        part = page[at : m.start() if m else size]
        if inside and inside[-1][0] == "head" and part.strip():
            leave(len(inside) - 1)
        if chrome < 3:
            text.append(part)
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if opened[name] > 0:
                leave(next(k for k in range(len(inside) - 1, -1, -1) if inside[k][0] == name))
            elif name in BLOCKS:
                flush()
            continue
        if name not in HEAD and opened["head"] > 0:
            if name == "body":
                leave(next(k for k in range(len(inside)) if inside[k][0] == "head"))
            elif inside[-1][0] == "head":
                leave(len(inside) - 1)
        if name == "br":
            text.append(" ")
            continue
        attributes = m[3] or ""
        block, own = name in BLOCKS, _chrome(name, attributes)
        if article >= 0 and (own and _dropped_inside(name, attributes) or name == "article" and own == 2):
            own = 3
        if not (block or own or name in RAW):
            continue  # inline: no block, no zone
        if block:
            flush()
        ends = SIBLINGS.get(name, {"p"} if name in CLOSES_P else set())
        for k in range(len(inside) - 1, -1, -1):
            if inside[k][0] in ends:
                leave(k)
                break
            if inside[k][0] not in ("p", "li", "dt", "dd", "td", "th", "option") or name in ("ul", "ol", "dl", "table") and inside[k][0] != "p":
                break
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name in VOID:
            continue
        flush()
        chrome = max(chrome, own)
        if name in ("article", "main") and chrome < 3:
            chrome, article = 0, max(article, chrome if chrome == 2 else 0)
        inside.append((name, chrome, article))
        opened[name] += 1
    flush()
    decided = next((x for x in main if x), None)
    return (decided, True) if decided else (next((x for x in rest if x), []), False)


def repeated(pages: list[list[str]], tokens: int = TOKENS, least: int = PAGES) -> list[np.ndarray]:
    """For each page, which of its tokens lie in a run of `tokens` tokens (a power of two) found on at least `least` pages.

    The ranks of all suffixes by their first 1, 2, 4, ... tokens are those of a
    suffix array under construction by prefix doubling; at `tokens` equal ranks
    are equal runs. No run leaves its page. This is the one-host, in-memory
    form of what main_text() does by shuffles.
    """
    sizes = np.array([len(p) for p in pages], dtype=np.int64)
    if not sizes.sum():
        return [np.zeros(0, dtype=bool) for _ in pages]
    rank = np.unique(np.array([t for p in pages for t in p], dtype=object), return_inverse=True)[1].astype(np.int64)
    page = np.repeat(np.arange(len(pages)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(rank))  # tokens from here to the page's end
    length = 1
    while length < tokens:
        after = np.full(len(rank), -1, dtype=np.int64)
        after[:-length] = rank[length:]
        after[left <= length] = -1
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        length *= 2
    whole = np.flatnonzero(left >= length)
    pairs = np.unique(rank[whole] * len(pages) + page[whole])
    n_pages = np.bincount(pairs // len(pages), minlength=int(rank.max()) + 1)
    begins = whole[n_pages[rank[whole]] >= least]
    edge = np.zeros(len(rank) + 1, dtype=np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + length, -1)
    return np.split(np.cumsum(edge[:-1]) > 0, np.cumsum(sizes)[:-1])


def _runs(pages: list[list[list[str]]], hosts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the host and the first TOKENS tokens of every suffix that has so many, joined; their number for each page)."""
    known: dict[str, int] = {}

    def code(x: str) -> int:
        got = known.get(x)
        if got is None:
            got = known[x] = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return got

    tokens = [[code(t) for b in p for t in b] for p in pages]
    counts = np.array([len(t) for t in tokens], dtype=np.int64)
    runs, n = W.windows(np.array([t for p in tokens for t in p], dtype=np.uint64), counts, TOKENS, short=False)
    return W.mix(runs ^ np.repeat(np.array([code(h) for h in hosts], dtype=np.uint64), n)), n


def _tokens(batch: pa.RecordBatch) -> list[list[list[str]]]:
    """The tokens of each page's open blocks; others have none."""
    return [[b.split(" ") if o else [] for b, o in zip(x, os, strict=True)] for x, os in zip(batch.column("blocks").to_pylist(), batch.column("open").to_pylist(), strict=True)]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run, page, row: each run of a page once."""
    for batch in _sliced(batches):
        runs, n = _runs(_tokens(batch), batch.column("host").to_pylist())
        own = [np.unique(r) for r in np.split(runs, np.cumsum(n)[:-1])]
        per = [len(r) for r in own]
        page, row = (np.repeat(batch.column(c).to_numpy(), per) for c in ("page", "row"))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(page), pa.array(row)], names=["run", "page", "row"])


def _keep_unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, text without the tokens, in open blocks, of the runs listed for each page."""
    for batch in _sliced(batches):
        pages, texts = _tokens(batch), []
        runs, n = _runs(pages, batch.column("host").to_pylist())
        for page, whole, own, gone in zip(pages, batch.column("blocks").to_pylist(), np.split(runs, np.cumsum(n)[:-1]), batch.column("runs").to_pylist(), strict=True):
            begins = np.flatnonzero(np.isin(own.view(np.int64), np.array(gone or [], dtype=np.int64)))
            edge = np.zeros(sum(map(len, page)) + 1, dtype=np.int64)
            np.add.at(edge, begins, 1)
            np.add.at(edge, begins + TOKENS, -1)
            mark, at, kept = np.cumsum(edge[:-1]) > 0, 0, []
            for b, full in zip(page, whole, strict=True):
                kept.append(full if not b else " ".join(t for t, drop in zip(b, mark[at : at + len(b)], strict=True) if not drop))
                at += len(b)
            texts.append("\n".join(b for b in kept if b))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _without_repeats(pages: DataFrame) -> DataFrame:
    """page_id, url, text of pages(row, page_id, url, host, blocks, open) without the runs of open blocks that PAGES different pages of the host have.

    Suffixes are shuffled, not pages: those that begin with the same TOKENS
    tokens on one host meet wherever their pages are, and are counted with
    partial sums, so neither a host nor a run is one task's. Pages of a host
    with equal blocks count as one.
    """
    keyed = pages.withColumn("page", F.xxhash64("host", F.array_join("blocks", "\n")))
    pairs = materialize(keyed.select("row", "page", "host", "blocks", "open").mapInArrow(_suffixes, "run long, page long, row long"), "page-runs")
    per = pairs.groupBy("run", "page").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(per.groupBy("run").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n")).filter(F.col("pages") >= PAGES).select("run", "n"), "page-repeats")
    found = attach(pairs.select("run", "row"), counts, "run", pairs.count())
    gone = found.groupBy("row").agg(F.collect_list("run").alias("runs"))
    return keyed.join(gone, "row", "left").select("page_id", "url", "host", "blocks", "open", "runs").mapInArrow(_keep_unique, "page_id long, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html).

    Pages whose blocks are all certain are decided row by row. From the open
    blocks of the others, runs of TOKENS tokens that PAGES different pages of
    the whole host have there are taken out. Null html: empty text; a null url is a host; repeated
    rows stay (and are one page of the host); pages of any length and depth are
    read whole, in linear time; other columns are ignored; an empty table gives
    no rows.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [zones(x or "")[0] for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("page_id"), batch.column("url"), pa.array([[t for t, _ in b] for b in got], pa.list_(pa.string())), pa.array([[o for _, o in b] for b in got], pa.list_(pa.bool_()))], names=["row", "page_id", "url", "blocks", "open"])

    numbered = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html")
    cut = materialize(numbered.mapInArrow(kernel, "row long, page_id long, url string, blocks array<string>, open array<boolean>"), "page-blocks")
    decided = cut.filter("not exists(open, x -> x)").select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    open_pages = cut.filter("exists(open, x -> x)").withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)), F.lit("")))
    return decided.unionByName(_without_repeats(open_pages)).withColumn("n_chars", F.length("text").cast("long"))
