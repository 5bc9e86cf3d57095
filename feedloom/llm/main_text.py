"""The main text of web pages: markup first, then what pages of a host repeat.

A page becomes blocks of text. Markup decides most of them: elements that are menus,
headers, footers, sidebars, notices, adverts, forms or comments by their name, role or
class go, and where a page marks its article, plain text in it stays and text outside
goes. The other blocks, which are those of pages that mark no article and those with a
class of their own within one, are open.

Open blocks are decided by suffix arrays of the hosts. The token streams of a host's
pages, of all their text but plain text of articles, are dealt to volumes of bounded
size and concatenated there; the suffixes of a volume are sorted by their first LENGTH
tokens, the ends of blocks being tokens as well. Runs of equal suffixes give each
window of LENGTH tokens with the number of distinct pages in the volume, Spark adds
these up over a host's volumes, and windows on PAGES distinct pages come back to the
volumes that hold them. An open block whose words lie in such windows to COVERED is
boilerplate, and what is left of the page is its unique runs. Since every substring of
LENGTH tokens or more that repeats is made of such windows, and pages are dealt whole
and by address, this finds what one array of the whole host would.

Defined results: null html and pages without text give the empty text; null addresses
have no host and are decided by markup alone; rows with one address count as one page;
rows and ids may repeat; a page whose open blocks all repeat keeps them if nothing else
is left; an empty table gives no rows. Columns other than page_id, url and html are
never read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize, sliced

#: Tokens of a window; distinct pages on which it must lie; words of a block that must be covered, in percent.
LENGTH, PAGES, COVERED = 8, 3, 75
#: Tokens of a volume, about.
VOLUME_TOKENS = 1_000_000

# Elements whose text is never read, those that begin a block, those that are no part of an article.
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_UNREAD = frozenset("template svg math select datalist button object canvas audio video map head label".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_AROUND = frozenset("nav footer aside form dialog menu".split())
_AROUND_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_AROUND_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot adbox sponsor sponsored promo promotion promoted banner sidebar side rail nav navbar navigation menu"
    " breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup"
    " share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus pagination pager search login toolbar"
    " widget widgets skip teaser hidden".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z|[\"'].*\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>]+)))?+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
#: What becomes of a block.
OUT, KEPT, OPEN = 0, 1, 2


class _Element:
    """An open element: how many articles it lies in, whether in a main region, and what its name and attributes say."""

    __slots__ = ("name", "parent", "around", "unread", "depth", "main", "classed", "frame")

    def __init__(self, name: str, parent: _Element | None, attributes: str):
        given = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
        role = given.get("role", "").lower()
        article = name == "article" or role == "article"
        main = name == "main" or role == "main" or "articlebody" in given.get("itemprop", "").lower()
        within = parent is not None and (parent.depth > 0 or parent.main)
        self.name, self.parent, self.frame = name, parent, False
        self.depth = (parent.depth if parent else 0) + article
        self.main = main or (parent is not None and parent.main)
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        self.unread = name in _UNREAD or hidden or (parent is not None and parent.unread)
        named = name not in ("html", "body") and any(_is_around(c) for key in ("class", "id") for c in given.get(key, "").split())
        self.around = name in _AROUND or role in _AROUND_ROLES or named or (name == "header" and not within)
        own = any(given.get(key, "").strip() for key in ("class", "id", "role"))
        self.classed = within and not (article or main) and (own or parent.classed)
        if (article or main) and not (self.around or self.unread):
            while parent is not None and not parent.frame:
                parent.frame = True
                parent = parent.parent


def _is_around(name: str) -> bool:
    parts = re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name)
    return parts[0].lower() in _AROUND_NAMES or parts[-1].lower() in _AROUND_NAMES


def page_blocks(html: str) -> list[tuple[str, int]]:
    """The blocks of a page in their order, white space made one, each with OUT, KEPT or OPEN."""
    root = _Element("", None, "")
    stack, open_names = [root], Counter()
    blocks: list[tuple[str, _Element]] = []
    pieces: list[str] = []

    def end_block() -> None:
        if pieces:
            if words := unescape("".join(pieces)).split():
                blocks.append((" ".join(words), stack[-1]))
            pieces.clear()

    def close(name: str) -> None:
        while stack[-1].name != name:
            open_names[stack.pop().name] -= 1
        open_names[stack.pop().name] -= 1

    at, size = 0, len(html)
    while at < size:
        found = _MARKUP.search(html, at)
        if (until := found.start() if found else size) > at and not stack[-1].unread:
            pieces.append(html[at:until])
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in _RAW and not found[1]:
            end = _RAW_END[name].search(html, at)
            at = end.start() if end else size
            continue
        if name in _BLOCK:
            end_block()
        if found[1]:
            if open_names[name]:
                close(name)
            continue
        if name in _EMPTY:
            continue
        if name in _BLOCK and open_names["p"]:
            # a block ends an open paragraph, if nothing but inline elements lies between
            p_at = [i for i in range(len(stack) - 1, max(-1, len(stack) - 64), -1) if stack[i].name == "p" or stack[i].name in _BLOCK][:1]
            if p_at and stack[p_at[0]].name == "p":
                close("p")
        if found[3].endswith("/") and name not in _BLOCK:
            continue
        stack.append(_Element(name, stack[-1], found[3]))
        open_names[name] += 1
    end_block()
    return _decided(blocks)


def _is_boilerplate(element: _Element) -> bool:
    """Whether the element or one round it is no part of an article. What frames an article is not, whatever it is called."""
    heading = element.name in _HEADINGS
    up: _Element | None = element
    while up is not None:
        if not up.frame and (up.around or (up.name == "header" and not heading)):
            return True
        up = up.parent
    return False


def _decided(blocks: list[tuple[str, _Element]]) -> list[tuple[str, int]]:
    own = [(text, element, _is_boilerplate(element)) for text, element in blocks]
    # articles within articles are comments, unless the outer one has no text of its own
    depths = {e.depth for _, e, gone in own if not gone}
    article = min(depths - {0}, default=0)
    main = not article and any(e.main for _, e, gone in own if not gone)
    out = []
    for text, element, gone in own:
        inside = element.depth == article if article else element.main or not main
        if gone or not inside:
            out.append((text, OUT))
        else:
            out.append((text, OPEN if element.classed or not (article or main) else KEPT))
    return out


_STREAM = pa.schema([("blocks", pa.list_(pa.string())), ("states", pa.list_(pa.int8()))])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, page, host, html -> key, page, host, the blocks that aren't plain text of an article, and their states."""
    for batch in sliced(batches):
        kept = [[b for b in page_blocks(html) if b[1] != KEPT] for html in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([[t for t, _ in p] for p in kept], _STREAM.field(0).type), pa.array([[s for _, s in p] for p in kept], _STREAM.field(1).type)],
            names=["key", "page", "host", "blocks", "states"],
        )


def _suffix_groups(streams: list[list[str]], length: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of concatenated token streams: the start of every suffix with `length` tokens of its stream, the number of the group
    of equal ones it is in, sorted; the tokens; and the starts of the streams."""
    sizes = np.array([len(s) for s in streams])
    tokens = [t for s in streams for t in s]
    numbers: dict[str, int] = {}
    rank = np.array([numbers.setdefault(t, len(numbers)) for t in tokens], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    left = np.repeat(starts[1:], sizes) - np.arange(len(tokens))
    depth = 1
    # each round sorts suffixes by twice as many tokens, from the ranks of the round before
    while depth < length:
        step = min(depth, length - depth)
        behind = np.zeros(len(rank), np.int64)
        behind[: len(rank) - step] = rank[step:] + 1
        behind[left <= step] = 0
        rank = np.unique(rank * (len(rank) + len(numbers) + 2) + behind, return_inverse=True)[1]
        depth += step
    places = np.flatnonzero(left >= length)
    order = places[np.argsort(rank[places], kind="stable")]
    return order, rank[order], tokens, starts


def _digest(host: str, window: list[str]) -> bytes:
    return blake2b("\n".join([host, *window]).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _token_stream(blocks: list[str]) -> list[str]:
    """Words, and a line feed at either end of each block."""
    out = ["\n"]
    for b in blocks:
        out += b.split(" ")
        out.append("\n")
    return out


def _of_volume(table: pa.Table, length: int):
    """By host in a volume: the rows' numbers with order, groups, tokens and starts of their suffixes."""
    by_host: dict[str, list[int]] = {}
    for i, host in enumerate(table.column("host").to_pylist()):
        by_host.setdefault(host, []).append(i)
    blocks = table.column("blocks").to_pylist()
    for host, rows in by_host.items():
        streams = [_token_stream(blocks[i]) for i in rows]
        yield host, rows, *_suffix_groups(streams, length)


def _windows(length: int):
    def run(table: pa.Table) -> pa.Table:
        """The distinct windows of a volume with the pages they lie on."""
        pages, volume = table.column("page").to_numpy(), table.column("volume")[0].as_py()
        keys, counts = [], []
        for host, rows, order, groups, tokens, starts in _of_volume(table, length):
            if not len(order):
                continue
            of_page = pages[rows][np.searchsorted(starts, order, side="right") - 1]
            first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            group = np.cumsum(np.r_[True, groups[1:] != groups[:-1]]) - 1
            pairs = np.lexsort((of_page, group))
            new = np.r_[True, (group[pairs][1:] != group[pairs][:-1]) | (of_page[pairs][1:] != of_page[pairs][:-1])]
            counts.append(np.bincount(group[pairs][new], minlength=len(first)))
            keys += [_digest(host, tokens[p : p + length]) for p in order[first].tolist()]
        total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return pa.table({"window": pa.array(keys, pa.binary()), "volume": pa.array([volume] * len(keys), pa.int64()), "pages": pa.array(total, pa.int64())})

    return run


def _covered(length: int, share: int):
    def run(table: pa.Table, often: pa.Table) -> pa.Table:
        """key, drop: the numbers of open blocks of each page that lie in often repeated windows."""
        wanted = set(often.column("window").to_pylist())
        keys, states, blocks = (table.column(c).to_pylist() for c in ("key", "states", "blocks"))
        out: list[tuple[bytes, list[int]]] = []
        for host, rows, order, groups, tokens, starts in _of_volume(table, length) if wanted else ():
            if not len(order):
                continue
            first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            hit = np.array([_digest(host, tokens[p : p + length]) in wanted for p in order[first].tolist()])
            at = order[np.repeat(hit, np.diff(np.r_[first, len(order)]))]
            edge = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            cover = np.cumsum(edge)[:-1] > 0
            for i, begin in zip(rows, starts.tolist(), strict=False):
                drop, begin = [], begin + 1
                for k, (block, state) in enumerate(zip(blocks[i], states[i], strict=True)):
                    n = block.count(" ") + 1
                    if state == OPEN and 100 * int(cover[begin : begin + n].sum()) >= share * n:
                        drop.append(k)
                    begin += n + 1
                if drop:
                    out.append((keys[i], drop))
        return pa.table({"key": pa.array([k for k, _ in out], pa.binary()), "drop": pa.array([d for _, d in out], pa.list_(pa.int32()))})

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html, drop -> page_id, url, text, n_chars."""
    for batch in sliced(batches):
        texts = []
        for html, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            blocks, gone = page_blocks(html), set(drop or ())
            kept, left, number = [], [], 0
            for text, state in blocks:
                if state != OUT:
                    left.append(text)
                    if state == KEPT or number not in gone:
                        kept.append(text)
                number += state != KEPT
            texts.append(" ".join(kept or left))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def repeated_blocks(pages: DataFrame, length: int = LENGTH, least_pages: int = PAGES, share: int = COVERED, volume_tokens: int = VOLUME_TOKENS) -> DataFrame:
    """key, drop: the open blocks that pages of a host repeat, by their numbers among the page's blocks that aren't plain text of an article.

    pages: key, page (a number of its address), host, html."""
    streams = materialize(
        pages.filter("host <> ''").mapInArrow(_streams, "key binary, page long, host string, blocks array<string>, states array<byte>").filter(F.size("blocks") > 0),
        "page-streams",
    )
    tokens = F.aggregate("blocks", F.lit(1).cast("long"), lambda n, b: n + F.length(b) - F.length(F.replace(b, F.lit(" "), F.lit(""))) + 2)
    # hosts without an open block have nothing to decide; those with too few rows can't repeat anything
    hosts = (
        streams.groupBy("host")
        .agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("rows"), F.max(F.array_contains("states", F.lit(OPEN).cast("byte"))).alias("open"))
        .filter((F.col("rows") >= least_pages) & F.col("open"))
        .select("host", F.ceil(F.col("tokens") / volume_tokens).cast("long").alias("volumes"))
    )
    hosts = materialize(hosts, "page-hosts")
    volume = F.xxhash64("host", F.pmod(F.xxhash64("page"), "volumes"))
    dealt = join_small(streams, hosts, ["host"], hosts.count()).withColumn("volume", volume).drop("volumes")
    windows = dealt.groupBy("volume").applyInArrow(_windows(length), "window binary, volume long, pages long")
    windows = materialize(windows, "page-windows")
    often = windows.groupBy("window").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= least_pages).select("window")
    back = windows.select("window", "volume").join(often, "window", "left_semi")
    drops = dealt.groupBy("volume").cogroup(back.groupBy("volume")).applyInArrow(_covered(length, share), "key binary, drop array<int>")
    return materialize(drops.dropDuplicates(["key"]), "page-drops")


def main_texts(pages: DataFrame, **how) -> DataFrame:
    """page_id, url, text, n_chars of every row; how: parameters of repeated_blocks()."""
    html = F.coalesce(F.col("html"), F.lit(""))
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    key = F.unhex(F.md5(F.concat_ws("\x1f", F.col("page_id").cast("string"), "url", html)))
    keyed = pages.select("page_id", "url", key.alias("key"), F.xxhash64("url").alias("page"), host.alias("host"), html.alias("html"))
    drops = repeated_blocks(keyed.select("key", "page", "host", "html"), **how)
    joined = join_small(keyed.select("key", "page_id", "url", "html"), drops, ["key"], drops.count(), "left")
    id_type = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", F.col("url").cast("string").alias("url"), "html", "drop").mapInArrow(
        _texts, f"page_id {id_type}, url string, text string, n_chars long"
    )
