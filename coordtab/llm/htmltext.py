"""Main text of web pages.

A page is cut into blocks, each with what the markup says of it: part of the article, part of a menu, advert, form, ..., or
nothing. The token streams of all pages of a host, whole and with a token at each block's end, are indexed by their
suffixes. Runs of whole blocks of LENGTH tokens or more, and other strings of PASSAGE tokens or more, that stand on two
distinct pages are boilerplate; the tokens they cover are removed, and the runs that are unique to a page are kept. A
shorter phrase in a block that is unique stays, wherever else it stands.

Markup protects and vetoes. Blocks of an article that the markup names stay, as an article may be quoted or mirrored on
another page; what it calls a menu, an advert, ... goes even if it is unique; and where it names an article, so does what
stands outside. Names count whole: "site-footer" is a footer, a "related-work" isn't what is related. Inside a named article
an id alone, or the class of a heading, a quotation, a table, ..., is no veto, but leaves the block to the index. The index
decides about all other blocks too, with the blocks of all pages as evidence.

Whole runs are indexed by a hash of the fewest blocks that make up LENGTH tokens, at both ends of each block. Of each
PASSAGE tokens, the suffix is indexed that begins at the window's anchor, its part of PASSAGE // 4 tokens with the
smallest hash: equal windows have equal anchors at equal places, and one token in twenty is one. Where an anchor stands on
two pages, the windows around it are compared. No task sees a whole host: the index is dealt out by the hash of host and
first tokens, an entry's pages are reduced to the smallest and the largest before the shuffle, and covered places are
joined back to their pages. Strings are told apart by 64-bit hashes keyed by the host.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html as html_module
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestream, store
from .suffixdedup import leftmost_minima

#: Tokens of repeated whole blocks; the ends of blocks count.
LENGTH = 6
#: Tokens of another repeated string.
PASSAGE = 50

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside form button select option input fieldset dialog menu noscript template iframe object embed svg math canvas audio video map script style textarea title".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Words of class, id and role that mark what isn't the article.
OTHER = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar tabs skip "
    "footer footnav colophon contentinfo sidebar sidenav aside complementary widget widgets rail "
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner promo promotion sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices alert alertdialog dialog popup modal overlay paywall "
    "newsletter subscribe subscription signup login signin register search share sharing social follow "
    "related recommended recommendations trending popular teaser "
    "comment comments commentlist respond reply replies disqus discussion hidden".split()
)
#: Words that mark the page's header; an article's own header stays.
HEADER = frozenset("header masthead topbar banner".split())
#: Words that may stand beside those in a name of several words. With another word beside it, as in "search-history", the
#: name means something else.
BESIDE = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer mobile desktop sticky fixed "
    "list lists box block item items wrap wrapper container section area bar row column group panel module region slot unit "
    "link links button buttons btn icon icons form field input results label title heading body content text count counter "
    "post posts article articles story stories entry entries author recent latest more media network networks thread user users".split()
)
#: Elements of an article; with a class of OTHER in a named article, the index decides about them.
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table caption tbody thead tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Ids that veto in a named article too: readers' comments are unique, so the index never finds them.
READERS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: Marks of the article, from the surest.
BODY_WORDS = frozenset("article-body articlebody article-content post-content post-body entry-content story-body story content main main-content maincontent article post entry body-content page-content".split())

#: A comment, the begin of a tag with its attributes up to the next "<" or broken quote, or another thing in brackets. No
#: part is tried twice, so a search takes time in proportion to what it passes.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>"']++|"[^<"]*+"|'[^<']*+')*+)(?P<shut>>?)"""
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
EVENT = re.compile("[>\"']")
PLAIN = re.compile("[^<>]*+")
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html_module.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(source)} if source.strip(" /\n\t") else {}


@functools.lru_cache(10_000)
def names_one_of(words: frozenset[str], name: str) -> bool:
    """Whether a class, id or role is made of these words, and of such as may stand beside them. Up to two letters, or a
    number, say nothing."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    return any(x in words for x in parts) and all(x in OTHER or x in HEADER or x in BESIDE or len(x) < 3 or x.isdigit() for x in parts)


def marks(name: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool, bool, int]:
    """(isn't the article, may not be, is a header, how surely the article: 0 for no sign, 4 for the best), for an element
    that stands inside a named article or not."""
    classes = [x.lower() for k in ("class", "role") for x in attrs.get(k, "").split()]
    ids = [x.lower() for x in attrs.get("id", "").split()]
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(NO_DISPLAY.search(attrs.get("style", "")))
    drop, doubt = name in DROPPED or hidden, False
    if not drop:
        by_class = any(names_one_of(OTHER, x) for x in classes)
        by_id = name not in HEADINGS and any(names_one_of(OTHER, x) for x in ids)
        readers = by_id and any(names_one_of(READERS, x) for x in ids)
        if inside:
            drop = by_class and name not in CONTENT or readers
            doubt = (by_class or by_id) and not drop and name not in INLINE
        else:
            drop = by_class or by_id
    header = name == "header" or any(names_one_of(HEADER, x) for x in classes + ids * (name not in HEADINGS))
    if name in ("body", "html"):
        drop = doubt = header = False
    sure = 0
    if name == "article" or attrs.get("itemprop", "").lower() == "articlebody":
        sure = 4
    elif name == "main" or attrs.get("role", "").lower() == "main":
        sure = 3
    elif name in ("div", "section", "td") and set(classes + ids) & BODY_WORDS:
        sure = 2
    return drop, doubt, header, sure


class Quotes:
    """Ends of tags with "<" in quotes, or with broken quotes. A quote that has led to no end once leads to none again, so
    all calls together take time in proportion to the page, but for a search among the quotes."""

    def __init__(self, source: str):
        self.source = source
        self.at: list[int] | None = None
        self.failed: set[int] = set()

    def end(self, at: int) -> int | None:
        """Where the tag ends whose attributes start at a place; quotes reach to the next of their kind."""
        if self.at is None:
            self.at = [m.start() for m in EVENT.finditer(self.source)]
        tried: list[int] = []
        while True:
            k = bisect.bisect_left(self.at, at)
            if k == len(self.at) or self.at[k] in self.failed:
                break
            at = self.at[k]
            if self.source[at] == ">":
                return at
            tried.append(at)
            close = self.source.find(self.source[at], at + 1)
            if close < 0:
                break
            at = close + 1
        self.failed.update(tried)
        return None


class Page:
    """Blocks of a page in order: (text, surest mark above it, whether the markup calls it something else, or may)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self.stack: list[tuple[str, bool, bool, int]] = []  # name, dropped, in doubt, surest mark so far
        self.open: Counter[str] = Counter()
        self.dropped = self.doubts = 0
        self.sure = 0
        self.text: list[str] = []
        self.off: list[str] = []
        at = search = 0
        quotes = Quotes(source)
        while m := TOKEN.search(source, search):
            start, stop, name, attrs = m.start(), m.end(), m["name"], m["attrs"]
            if name and not m["shut"]:
                stop = quotes.end(m.start("attrs"))
                if stop is None:
                    stop = PLAIN.match(source, m.start("attrs")).end()
                if m["end"] and source[stop : stop + 1] != ">":  # an end tag that breaks off
                    name, stop = None, source.find(">", stop)
                    stop = len(source) if stop < 0 else stop
                elif source[stop : stop + 1] == "<":  # no tag
                    search = start + 1
                    continue
                attrs = source[m.start("attrs") : stop]
                if stop == len(source):
                    name = None  # the page breaks off in it
                stop = min(stop + 1, len(source))
            if start > at:
                self.data(source[at:start])
            if name and not m["end"] and name.lower() in RAW:
                close = RAW_END[name.lower()].search(source, stop)
                stop = close.end() if close else len(source)
            elif name:
                self.tag(name.lower(), bool(m["end"]), attrs)
            at = search = stop
        if at < len(source):
            self.data(source[at:])
        self.flush()

    def data(self, raw: str) -> None:
        text = html_module.unescape(raw) if "&" in raw else raw
        (self.off if self.dropped else self.text).append(text)

    def flush(self) -> None:
        for parts, off in ((self.text, False), (self.off, True)):
            text = " ".join("".join(parts).split())
            if text:
                self.blocks.append((text, self.sure, off, self.doubts > 0))
            parts.clear()

    def pop(self, to: int) -> None:
        for name, dropped, doubt, _ in self.stack[to:]:
            self.open[name] -= 1
            self.dropped -= dropped
            self.doubts -= doubt
        del self.stack[to:]
        self.sure = self.stack[-1][-1] if self.stack else 0

    def tag(self, name: str, end: bool, source: str) -> None:
        if name == "br":
            (self.off if self.dropped else self.text).append(" ")
            return
        block = name not in INLINE
        if block:
            self.flush()
        if end:
            if not self.open[name]:
                return
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    self.pop(k)
                    break
                if not block and self.stack[k][0] not in INLINE:
                    break  # an inline end tag doesn't close blocks
            return
        if name in VOID:
            return
        if block:  # blocks end an open paragraph, items end the item before
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p" or self.stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    self.pop(k)
                    break
                if self.stack[k][0] not in INLINE:
                    break
        drop, doubt, header, sure = marks(name, attributes(source), self.sure >= 2)
        if self.sure >= 3 and not drop:
            header = False
        drop = drop or header
        if source.rstrip().endswith("/") and name not in INLINE and name in ("svg", "path", "iframe"):
            return
        self.sure = max(self.sure, sure)
        self.stack.append((name, drop, doubt, self.sure))
        self.open[name] += 1
        self.dropped += drop
        self.doubts += doubt


#: What a block is: no text, text whatever the index says, text but for what the index covers.
OFF, TEXT, OPEN = 0, 1, 2


def kinds_of_blocks(source: str | None) -> tuple[bool, list[str], list[int]]:
    """Whether the markup settles all; all blocks of the page; what each is. Where the markup names the article, its blocks
    are text, but those in doubt are open; else all that the markup doesn't call something else are open."""
    if not source:
        return True, [], []
    found = Page(source).blocks
    best = max((sure for _, sure, off, _ in found if not off), default=0)
    named = best >= 2
    kinds = [OFF if off or named and sure < best else OPEN if doubt or not named else TEXT for _, sure, off, doubt in found]
    return OPEN not in kinds, [t for t, *_ in found], kinds


def judged_blocks(source: str | None) -> tuple[bool, list[str], list[bool]]:
    """Whether the markup settles all; all blocks of the page; which of them are text or open."""
    clear, blocks, kinds = kinds_of_blocks(source)
    return clear, blocks, [x != OFF for x in kinds]


def blocks_of(source: str | None) -> tuple[bool, list[str]]:
    """Whether the markup settles all, and the blocks that are text or open."""
    clear, blocks, text = judged_blocks(source)
    return clear, [b for b, x in zip(blocks, text) if x]


PARSED_DDL = "clear boolean, text string"
PARSED = pa.struct([("clear", pa.bool_()), ("text", pa.string())])


def parsed(html: pa.Array) -> pa.Array:
    """Of each page whether its article is clear, and the text if the index covers nothing."""
    rows = [blocks_of(h) for h in html.to_pylist()]
    return pa.array([{"clear": c, "text": " ".join(b)} for c, b in rows], PARSED)


OPEN_DDL = "_key long, _host string, _blocks array<string>, _kinds array<tinyint>"


def open_pages(batches):
    """The pages with blocks that the markup leaves to the index."""
    schema = pa.schema([("_key", pa.int64()), ("_host", pa.string()), ("_blocks", pa.list_(pa.string())), ("_kinds", pa.list_(pa.int8()))])
    for batch in bytestream.slices(batches, 100):
        out = [(key, host, *rest) for key, host, (clear, *rest) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(kinds_of_blocks, batch.column(2).to_pylist())) if not clear]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(4)], schema=schema)


def token_stream(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all blocks with one for each end, and the number of the block."""
    hashes = bytestream.word_hashes([b.encode("utf-8", "surrogatepass") for b in blocks])
    out = [np.append(h, np.uint64(1)) for h in hashes]
    return np.concatenate(out), np.repeat(np.arange(len(blocks)), [len(x) for x in out])


def block_windows(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """(from, to): for each block the fewest blocks of length tokens that start with it, and that end with it."""
    found, total, i = set(), 0, 0
    for j, size in enumerate(sizes):  # the fewest that end with j
        total += size
        while total - sizes[i] >= length:
            total -= sizes[i]
            i += 1
        if total >= length:
            found.add((i, j + 1))
    total, j = 0, len(sizes)
    for i in range(len(sizes) - 1, -1, -1):  # the fewest that start with i
        total += sizes[i]
        while total - sizes[j - 1] >= length:
            j -= 1
            total -= sizes[j]
        if total >= length:
            found.add((i, j))
    return sorted(found)


def salted(h: np.ndarray, salt: bytes) -> np.ndarray:
    return bytestream.mix(h + np.uint64(int.from_bytes(salt, "little"))).view(np.int64)


def salt_of(host: str) -> bytes:
    return hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def whole_runs(host: str, blocks: list[str], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, tokens) of the shortest runs of whole blocks that may be boilerplate."""
    salt = salt_of(host)
    sizes = np.bincount(owner, minlength=len(blocks))
    starts = np.append(0, np.cumsum(sizes))
    windows = block_windows(sizes.tolist(), length)
    h = [int.from_bytes(hashlib.blake2b("\n".join(blocks[i:j]).encode("utf-8", "surrogatepass"), digest_size=8, key=salt).digest(), "little", signed=True) for i, j in windows]
    return np.array(h, np.int64), np.array([starts[i] for i, _ in windows], np.int64), np.array([starts[j] - starts[i] for i, j in windows], np.int64)


def anchored(host: str, stream: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchors of all strings of `passage` tokens."""
    part = max(1, passage // 4)
    if len(stream) < passage:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = bytestream.gram_hashes(stream, part)
    at = leftmost_minima(h, np.arange(len(stream) - passage + 1), passage - part + 1)
    return salted(h[at], salt_of(host)), at


def suffixes(length: int, passage: int):
    """_h, _key, _open: the index entries of all pages."""

    def work(batches):
        for batch in bytestream.slices(batches, 100):
            out = []
            for key, host, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                clear, blocks, _ = judged_blocks(html)
                if blocks:
                    stream, owner = token_stream(blocks)
                    h = np.append(whole_runs(host, blocks, owner, length)[0], anchored(host, stream, passage)[0])
                    h = np.unique(h)
                    out.append((h, np.full(len(h), key), np.full(len(h), not clear)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["_h", "_key", "_open"])

    return work


def run_places(length: int):
    """_h, _key, _at, _n of the runs of whole blocks of open pages."""

    def work(batches):
        for batch in bytestream.slices(batches, 100):
            out = []
            for key, host, blocks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if blocks:
                    h, at, n = whole_runs(host, blocks, token_stream(blocks)[1], length)
                    out.append((h, np.full(len(h), key), at.astype(np.int32), n.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["_h", "_key", "_at", "_n"])

    return work


def anchor_windows(passage: int):
    """_h, _key, _open, _at, _windows: each anchor with the hashes of the strings of `passage` tokens that hold it, from
    the place _at on."""
    schema = pa.schema([("_h", pa.int64()), ("_key", pa.int64()), ("_open", pa.bool_()), ("_at", pa.int32()), ("_windows", pa.list_(pa.int64()))])

    def work(batches):
        for batch in bytestream.slices(batches, 100):
            out = []
            for key, host, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                clear, blocks, _ = judged_blocks(html)
                stream = token_stream(blocks)[0] if blocks else np.empty(0, np.uint64)
                h, at = anchored(host, stream, passage)
                whole = salted(bytestream.gram_hashes(stream, passage), salt_of(host))
                for x, place in zip(h.tolist(), at.tolist()):
                    low = max(0, place - passage + max(1, passage // 4))
                    out.append((x, key, not clear, low, whole[low : place + 1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(5)], schema=schema)

    return work


def unique_runs(batches):
    """_key, _cut: the words of text, and those of open blocks that no place covers."""
    for batch in bytestream.slices(batches, 100):
        out = []
        for key, blocks, kinds, places in zip(*(batch.column(k).to_pylist() for k in range(4))):
            stream, owner = token_stream(blocks) if blocks else (np.empty(0), np.empty(0, int))
            cover = np.zeros(len(stream) + 1, int)
            for p in places or ():
                cover[p["_at"]] += 1
                cover[p["_at"] + p["_n"]] -= 1
            covered = np.cumsum(cover)[:-1] > 0
            kept, first = [], 0
            for b, size, kind in zip(blocks, np.bincount(owner, minlength=len(blocks)).tolist(), kinds):
                ws = b.split()
                if kind == TEXT:
                    kept += ws
                elif kind == OPEN:  # white space that the hashing of words doesn't know counts as one token with what it joins
                    kept += [w for w, c in zip(ws, covered[first : first + size - 1]) if not c] if size - 1 == len(ws) else [] if covered[first : first + size].all() else ws
                first += size
            out.append((key, " ".join(kept)))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["_key", "_cut"])


@store.keeps_columns
def extracted(pages: DataFrame, length: int = LENGTH, ident: str = "page_id", url: str = "url", html: str = "html", passage: int = PASSAGE) -> DataFrame:
    """pages with _text, the main text: character references decoded, white space in a block made one space, blocks in
    page order joined by one space; nothing else is dropped or cut off.

    A null or empty page has an empty text. A page that breaks off counts up to there. A null address is a host of its
    own. Rows that are equal in id, address and page are one page and get equal texts. An empty table stays empty; other
    columns pass through."""
    store.ship(pages.sparkSession)
    key = F.xxhash64(F.col(ident), F.col(url), F.col(html))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    cut_up = pages.withColumn("_p", F.arrow_udf(parsed, PARSED_DDL)(F.col(html)))
    source = pages.select(key.alias("_key"), host.alias("_host"), F.col(html).alias("_html"))
    several = lambda index: index.agg(F.min("_key").alias("_a"), F.max("_key").alias("_b"), F.max("_open").alias("_open")).where((F.col("_a") != F.col("_b")) & F.col("_open"))
    index = source.mapInArrow(suffixes(length, passage), "_h long, _key long, _open boolean")
    twice = store.written(several(index.groupBy("_h")).select("_h"), "twice")
    if twice.isEmpty():  # nothing repeats in what the markup leaves open
        return cut_up.withColumn("_text", F.col("_p.text")).drop("_p")
    open_ = store.written(source.mapInArrow(open_pages, OPEN_DDL), "open")
    whole = open_.select("_key", "_host", "_blocks").mapInArrow(run_places(length), "_h long, _key long, _at int, _n int")
    places = whole.join(twice, "_h", "left_semi").select("_key", "_at", "_n")
    near = source.mapInArrow(anchor_windows(passage), "_h long, _key long, _open boolean, _at int, _windows array<long>")
    near = store.marked(near, F.col("_h"), twice).join(twice, "_h", "left_semi")
    each = store.written(near.select("_key", "_open", "_at", F.posexplode("_windows").alias("_k", "_w")), "windows")
    again = several(each.groupBy("_w")).select("_w")
    places = places.unionByName(each.where("_open").join(again, "_w", "left_semi").select("_key", (F.col("_at") + F.col("_k")).alias("_at"), F.lit(passage).alias("_n")))
    listed = places.groupBy("_key").agg(F.collect_set(F.struct("_at", "_n")).alias("_places"))
    runs = open_.dropDuplicates(["_key"]).join(listed, "_key").select("_key", "_blocks", "_kinds", "_places")
    cut = store.written(runs.mapInArrow(unique_runs, "_key long, _cut string"), "runs")
    clear = cut_up.where("_p.clear").withColumn("_text", F.col("_p.text")).drop("_p")
    rest = cut_up.where(~F.col("_p.clear")).withColumn("_key", key).join(cut, "_key", "left").withColumn("_text", F.coalesce("_cut", "_p.text")).drop("_key", "_cut", "_p")
    return clear.unionByName(rest)
