"""Main text of web pages, with a suffix array over each host's token streams.

A page is cut into blocks at block-level tags, and the tags give each block a prior:
furniture (menus, headers, footers, sidebars, forms, scripts, adverts, notices and
comment sections, by element or by class, id and role words), text (in an ``article``,
or else in ``main``) or open. The token streams of the text and open blocks of all
pages of a host are concatenated and sorted as suffixes; each interval of suffixes that
share their first ``REPEAT`` tokens is a long substring with the distinct pages that
hold it (pages of equal streams are one). A substring on a large share of a host's
pages is boilerplate; a block that such substrings cover is removed, and unique runs
are kept. Tags and array meet in the shares: in a page without text blocks open blocks
go from ``OPEN_SHARE`` on, text blocks only from ``TEXT_SHARE`` on.

Large hosts are dealt to several arrays by content; each sends the counts of its common
substrings only, which are summed by host. What leaves the arrays is the table of each
host's boilerplate, a few windows; pages are then read once more and decided in place.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut
from .shingles import U, mix, word_hashes

#: Tokens that make a repeat long (a power of two), or the whole of a shorter block; share of a block that must be covered.
REPEAT, COVERED = 8, 0.5
#: Least number and share of a host's distinct pages that make a repeat boilerplate: for open blocks, and for blocks that tags call text.
OPEN_PAGES, OPEN_SHARE = 3, 0.5
TEXT_PAGES, TEXT_SHARE = 5, 0.8
#: Pages of one suffix array, and pages from which an array leaves out counts below a quarter of OPEN_SHARE (it holds pages at random).
PAGES, FEW_PAGES = 512, 128
#: Windows (of 8 bytes) of all hosts that every task may hold; pages of a host that meet one copy of its windows beyond that.
BROADCAST_LONGS, HOST_PAGES = 4_000_000, 4096
FURNITURE, OPEN, TEXT = 0, 1, 2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
# Element names and attribute words.
DROPPED = frozenset(
    "nav header footer aside form script style noscript template iframe button select textarea svg canvas object head title dialog menu".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
FLAGGED = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner banners promo promotion sponsor sponsored cookie cookies consent notice notices "
    "comment comments disqus reply replies sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing "
    "social related newsletter subscribe signup popup modal overlay widget toolbar complementary contentinfo search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)

#: Words that make a class name tell of a page's layout or state, such as has-sidebar or comments-open.
STATES = frozenset("has no not with without layout open closed enabled disabled".split())
#: Start tags that end an open element of another list's names, up to an element that holds its own.
_CELLS, _ROWS = frozenset(("td", "th")), frozenset("td th tr caption".split())
ENDS = {
    **dict.fromkeys(("td", "th"), _CELLS), "tr": _ROWS, **dict.fromkeys(("tbody", "thead", "tfoot"), _ROWS | {"tbody", "thead", "tfoot"}),
    "li": frozenset(("li",)), **dict.fromkeys(("dt", "dd"), frozenset(("dt", "dd"))),
}
_HOLDERS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}


def _flagged(rest: str) -> int:
    """2 for a class, id or role that is a furniture word (or one with a number), 1 for one that holds such a word, 0 for others."""
    most = 0
    for _, value in _ATTRIBUTE.findall(rest):
        for token in value.strip("\"'").lower().split():
            words = [w for w in re.split(r"[_-]+", token) if w and not w.isdigit()]
            if not FLAGGED.isdisjoint(words) and STATES.isdisjoint(words):
                most = max(most, 2 if len(words) == 1 else 1)
    return most


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order, each with its prior ``FURNITURE``, ``OPEN`` or ``TEXT``.

    Text is the first of these that there is: articles outside furniture; ``main``,
    which no class name around it makes furniture; articles in elements whose class
    name only holds a furniture word (``sidebar-page``).
    """
    found: list[tuple[str, frozenset[str], bool]] = []  # text, the sets it may belong to, whether it is furniture
    if not page:
        return []
    parts: list[str] = []
    # open elements that matter: their name, and how they drop what they hold (3 by name, 2 by a furniture word, 1 by a compound of one)
    stack: list[tuple[str, int]] = []

    def flush() -> None:
        if not parts:
            return
        text = " ".join(references.unescape("".join(parts)).split())
        parts.clear()
        if not text:
            return
        # drops within the innermost main count, or else all; class names around a main do not
        names = [n for n, _ in stack]
        main = len(names) - 1 - names[::-1].index("main") if "main" in names else None
        drops = [d for k, (_, d) in enumerate(stack) if d == 3 or (d and (main is None or k > main))]
        first = names.index("article") if "article" in names else None
        sets = frozenset()
        if not drops and (first is not None or main is not None):
            sets = frozenset(n for n, at in (("article", first), ("main", main)) if at is not None)
        elif first is not None and not any(d > 1 or (d and k >= first) for k, (_, d) in enumerate(stack) if d == 3 or main is None or k > main):
            sets = frozenset(("wrapped",))
        found.append((text, sets, bool(drops)))

    def end(at: int) -> None:
        del stack[at:]

    def implied(name: str) -> None:
        """Ends the elements whose end tag may be left out before this start tag."""
        if name in BLOCKS and name not in ("body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    end(k)
                    break
                if stack[k][0] in ("table", "td", "th", "caption", "button", "object", "template", "html"):
                    break
        if name in ENDS:
            holders = _HOLDERS.get(name, frozenset(("table",)))
            lowest = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ENDS[name]:
                    lowest = k
                    if name in _HOLDERS:
                        break
                elif stack[k][0] in holders or stack[k][0] in ("article", "main") or (name in _CELLS and stack[k][0] == "tr"):
                    break
            if lowest is not None:
                end(lowest)

    at, until = 0, len(page)
    while at < until:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name in BLOCKS or name in DROPPED
        if block:
            flush()
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if not block and any(d for _, d in stack[k:]):
                        flush()
                    end(k)
                    break
                if stack[k][0] in ("article", "main") and name not in ("article", "main", "body", "html"):
                    break  # a stray end tag does not end the text
            continue
        if block:
            implied(name)
        if name in VOID or m["rest"].endswith("/"):
            continue
        drops = 3 if name in DROPPED else 0 if name in ("html", "body", "main") else _flagged(m["rest"])
        if name == "article" and drops == 1:
            drops = 0  # an article is furniture only by a whole word
        if block or drops or any(o[0] == name for o in stack):
            if drops:
                flush()
            stack.append((name, drops))
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = close.start() if close else until
    flush()
    chosen = next((n for n in ("article", "main", "wrapped") if any(n in sets for _, sets, _ in found)), None)
    return [(text, TEXT if chosen in sets else FURNITURE if dropped else OPEN) for text, sets, dropped in found]


def suffix_ranks(tokens: np.ndarray, depth: int = REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by prefix doubling up to ``depth`` tokens, and the rank of each place: equal where these tokens are."""
    n = len(tokens)
    order, rank = np.empty(0, np.int64), np.unique(tokens, return_inverse=True)[1].astype(np.int64).ravel()
    step = 1
    while step <= depth // 2:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(both[order]) != 0)))[:n]
        step *= 2
    return order, rank


def _window_hash(tokens: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    out = mix(tokens[places].astype(np.uint64) + U(width))
    for i in range(1, width):
        out = mix(out * U(3) + tokens[places + i].astype(np.uint64))
    return out.astype(np.int64)


def _short_hash(tokens: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of whole blocks of fewer than ``REPEAT`` tokens."""
    out = np.zeros(len(start), np.int64)
    for width in range(1, REPEAT):
        of = np.flatnonzero(size == width)
        out[of] = _window_hash(tokens, start[of], width)
    return out


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the blocks, one stream, as 32-bit hashes, and the number of each block's tokens."""
    sizes = np.array([t.count(" ") + 1 for t in texts], np.int64)
    return (word_hashes(" ".join(texts)) >> U(32)).astype(np.uint32), sizes


def repeats(tokens: np.ndarray, sizes: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``REPEAT`` tokens within a block, and of whole shorter blocks, with the number of distinct pages.

    ``page`` is the page number of each block, not falling.
    """
    if not len(tokens):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(page, sizes)
    left = np.repeat(start + sizes, sizes) - np.arange(len(tokens))
    order, rank = suffix_ranks(tokens)
    order = order[left[order] >= REPEAT]  # windows stay within their block
    kinds, pages = rank[order], owner[order]
    # suffixes of one rank are in order of their places, so those of a page lie together
    fresh = np.ones(len(order), bool)
    fresh[1:] = (kinds[1:] != kinds[:-1]) | (pages[1:] != pages[:-1])
    head = np.ones(len(order), bool)
    head[1:] = kinds[1:] != kinds[:-1]
    heads = np.flatnonzero(head)
    counts = np.add.reduceat(fresh.astype(np.int64), heads) if len(heads) else np.empty(0, np.int64)
    short = np.flatnonzero(sizes < REPEAT)
    whole = np.unique(np.stack((_short_hash(tokens, start[short], sizes[short]), page[short].astype(np.int64))), axis=1)
    names, n = np.unique(whole[0], return_counts=True)
    return np.concatenate((_window_hash(tokens, order[heads], REPEAT), names)), np.concatenate((counts, n))


def covered(tokens: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Per block, whether windows in the sorted ``known`` cover more than ``COVERED`` of it."""
    start = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), bool)
    if not len(known) or not len(tokens):
        return out
    short = np.flatnonzero(sizes < REPEAT)
    out[short] = np.isin(_short_hash(tokens, start[short], sizes[short]), known)
    left = np.repeat(start + sizes, sizes) - np.arange(len(tokens))
    places = np.flatnonzero(left >= REPEAT)
    hit = places[np.isin(_window_hash(tokens, places, REPEAT), known)]
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + REPEAT, -1)
    share = np.add.reduceat((np.cumsum(edge)[:-1] > 0).astype(np.int64), start) / sizes
    return out | ((sizes >= REPEAT) & (share > COVERED))


def boilerplate(pages: DataFrame) -> DataFrame:
    """``(host, w, strong)``: the windows that are boilerplate on a host of ``pages(host, html)``.

    ``strong`` ones are on ``TEXT_SHARE`` of the host's distinct pages. A host's windows
    are no more than its tokens per page over ``OPEN_SHARE``.
    """
    large = cut(pages.groupBy("host").count().where(F.col("count") > PAGES).select("host", F.ceil(F.col("count") / PAGES).cast("int").alias("arrays")), "hosts")
    dealt = pages.join(bounded_broadcast(large), "host", "left").select("host", F.coalesce("arrays", F.lit(1)).alias("arrays"), "html")

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()  # equal streams of one task are sent once
        for batch in batches:
            rows = []
            for host, arrays, page in zip(batch["host"], batch["arrays"], batch["html"], strict=True):
                texts = [t for t, prior in blocks(page) if prior != FURNITURE]
                if not texts:
                    continue
                tokens, sizes = _tokens(texts)
                code = hashlib.blake2b(tokens.tobytes() + sizes.tobytes(), digest_size=16).digest()
                if (host, code) not in seen:
                    seen.add((host, code))
                    rows.append((host, int.from_bytes(code[:6], "little") % arrays, arrays, code, tokens.tobytes(), sizes.astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["host", "array", "arrays", "code", "tokens", "sizes"])

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("code")
        sizes = [np.frombuffer(b, np.uint32) for b in rows["sizes"]]
        page = np.repeat(np.arange(len(rows)), [len(x) for x in sizes])
        w, n = repeats(np.frombuffer(b"".join(rows["tokens"]), np.uint32), np.concatenate(sizes).astype(np.int64), page)
        if rows["arrays"].iloc[0] == 1:
            common = n >= max(OPEN_PAGES, OPEN_SHARE * len(rows))
        else:
            common = n >= (OPEN_SHARE / 4 * len(rows) if len(rows) >= FEW_PAGES else 1)
        return pd.DataFrame({"host": key[0], "w": np.append(w[common], 0), "n": np.append(n[common], 0), "pages": np.append(np.zeros(common.sum(), np.int64), len(rows))})

    counts = dealt.mapInPandas(streams, "host string, array int, arrays int, code binary, tokens binary, sizes binary").groupBy("host", "array")
    counts = cut(counts.applyInPandas(count, "host string, w long, n long, pages long").groupBy("host", "w").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")), "windows")
    total = counts.groupBy("host").agg(F.sum("pages").alias("total"))
    found = counts.where(F.col("n") >= OPEN_PAGES).select("host", "w", "n").join(total, "host")
    strong = (F.col("n") >= TEXT_PAGES) & (F.col("n") >= TEXT_SHARE * F.col("total"))
    return found.where(F.col("n") >= OPEN_SHARE * F.col("total")).select("host", "w", strong.alias("strong"))


def _chosen(page: str | None, weak: np.ndarray | None, strong: np.ndarray | None) -> str:
    """The page's text, given its host's boilerplate."""
    found = blocks(page)
    prior = max((p for _, p in found), default=FURNITURE)
    texts = [t for t, p in found if p == prior != FURNITURE]
    known = strong if prior == TEXT else weak
    if texts and known is not None and len(known):
        dropped = covered(*_tokens(texts), np.sort(known))
        if prior == OPEN or not dropped.all():
            texts = [t for t, d in zip(texts, dropped, strict=True) if not d]
    return "\n\n".join(texts)


def _beside(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``pages`` with the windows ``known(host, weak, strong)`` of their host.

    Up to ``BROADCAST_LONGS`` windows in all go to every task. Beyond that both sides meet
    by host, a host of more than ``HOST_PAGES`` pages in so many parts, each with a copy of
    its windows.
    """
    held = cut(known.withColumn("_longs", F.size("weak") + F.size("strong")), "boilerplate")
    size = held.agg(F.coalesce(F.sum("_longs"), F.lit(0)).alias("longs")).first()["longs"]
    held = held.drop("_longs")
    if size <= BROADCAST_LONGS:  # a host has a window at least, so hosts are bounded with them
        return pages.join(F.broadcast(held), "host", "left")
    large = cut(pages.groupBy("host").count().where(F.col("count") > HOST_PAGES).select("host", F.ceil(F.col("count") / HOST_PAGES).cast("int").alias("_parts")), "hosts")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = pages.join(bounded_broadcast(large), "host", "left").withColumn("_part", F.floor(F.rand(5) * parts).cast("int"))
    copies = held.join(bounded_broadcast(large), "host", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_parts").join(copies.drop("_parts"), ["host", "_part"], "left").drop("_part")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html)``.

    Character references are decoded, white space inside a block is one space, and
    blocks are joined in page order by a blank line. A null or empty page has the
    empty text; pages with a null url share one nameless host; equal rows get equal
    texts; an empty table gives none. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    pages = pages.select("page_id", "url", host.alias("host"), "html")
    known = boilerplate(pages.select("host", "html")).groupBy("host").agg(F.collect_list("w").alias("weak"), F.collect_list(F.when(F.col("strong"), F.col("w"))).alias("strong"))

    @F.pandas_udf("string")
    def text_of(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, weak, strong in columns:
            yield pd.Series([_chosen(*row) for row in zip(html, weak, strong, strict=True)], dtype=object)

    read = _beside(pages, known).select("page_id", "url", text_of("html", "weak", "strong").alias("text"))
    return read.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
