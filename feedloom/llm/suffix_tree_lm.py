"""Language-model scoring by a probabilistic suffix tree over words.

Tokens are words in ASCII lower case and one end per text. The tree predicts
symbols: a word seen SYMBOL_COUNT times in training is one, the others share a symbol
by their last two characters where those are seen as often, and the rest, with every
word that training lacks, share one. A symbol's probability is that of its words, so
a text's score is its unigram score plus, for each token, the logarithm of what the
context changes for the token's symbol.

Contexts grow from the newest symbol backwards. One of length k+1 is counted where
its newest k symbols are in the tree and it is seen CONTEXT_COUNT times; it is
retained if its next symbols diverge enough from those after its suffix. Next symbols
seen ENTRY_COUNT times have a probability of their own, drawn towards the suffix's,
and what is left goes to the others in the suffix's proportions. A token is scored in
the longest retained context that is a suffix of what precedes it. The counts are
absolute, so the tree grows with the text; in small tables, where a share of all
tokens comes to less than a count, the share takes its place.

Texts become blocks first, in each of which words, and later symbols and contexts,
are numbered. The counts of all words are exact: each block sends its words with
their counts, Spark adds them up by word, and every block gets the totals and symbols
of its words back. In the same way each level sends a block's contexts and what
follows them, packed and dealt to buckets by key, and hears which contexts are
retained, with their counts, and the counts of what follows. The tokens are written
once: what a block has heard is kept beside them in the order in which it sent, and
contexts and chances of the levels before are made from both again when needed.
Symbols, contexts and next symbols are tables in the shared folder; nothing of them
reaches the driver or is broadcast for its own sake.

Defined results: null counts as the empty text, whose one token is the end; without
training tokens every probability is 1; rows and ids may repeat.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, forget, join_small, materialize, release, sliced

#: Tokens of a block; tokens for which a bucket is made, whose keys are added up in one task.
BLOCK_TOKENS, BUCKET_TOKENS = 1_000_000, 3_000_000
SYMBOL_SHARE, CONTEXT_SHARE, ENTRY_SHARE = 5e-5, 5e-5, 2e-6
SYMBOL_COUNT, CONTEXT_COUNT, ENTRY_COUNT = 256, 256, 8
DEPTH, DRAW, DIVERGENCE = 3, 30.0, 0.01
ADD = 0.1
#: Symbols: what stands before a text, the rest, the end; others follow. A text's end is the empty word.
BEFORE, REST, END, FIRST_SYMBOL = 0, 1, 2, 3
#: The context of length 0.
ROOT = -1


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = value = len(self)
        return value


def _written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, without the shuffles that made it: those of all levels would be several times the input."""
    out = materialize(df, tag)
    forget(df.sparkSession)
    return out


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<i4").tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i4").astype(np.int64)


def _blocks(id_type: pa.DataType):
    """doc_id, held_out, text -> block rows. Number 0 of a block's words is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, parts, words, size = [], [], [], _Numbers({b"": 0}), 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            lengths = np.array([len(p) for p in parts], np.int64)
            train = np.bincount(ids[np.repeat(~np.array(held, bool), lengths)], minlength=len(words))
            arrays = [
                pa.array([docs], pa.list_(id_type)),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([lengths.tolist()], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array([w.decode() for w in words])),
                pa.ListArray.from_arrays(pa.array([0, len(train)], pa.int32()), pa.array(train.astype(np.int64))),
                pa.array([_packed(ids)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["docs", "held", "lengths", "words", "train", "ids"])

        for batch in sliced(batches):
            for doc, out, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = text.encode().lower().split() if text else []
                found.append(b"")
                docs.append(doc)
                held.append(out)
                parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                size += len(found)
                if size >= BLOCK_TOKENS:
                    yield block()
                    docs, held, parts, words, size = [], [], [], _Numbers({b"": 0}), 0
        if docs:
            yield block()

    return run


@dataclass
class Level:
    """The retained contexts of one length: packed keys, sorted; shares left for unlisted symbols; listed next symbols."""

    keys: np.ndarray
    left: np.ndarray
    entries: np.ndarray
    chances: np.ndarray


@dataclass
class SuffixTree:
    """A whole tree in memory, with symbols and contexts numbered densely; root: each symbol's probability."""

    words: dict[str, int]
    endings: dict[str, int]
    root: np.ndarray
    levels: list[Level] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.root)

    def symbol(self, word: str) -> int:
        own = self.words.get(word)
        return own if own is not None else self.endings.get(word[-2:], REST)


def locate(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in the sorted keys, -1 where they are not there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, by pairs of bytes, the last pairs first: the others hardly differ."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c).view("<u2").reshape(-1, 4).T.tobytes() for c in columns), 1)


def _unpack(data: bytes, columns: int) -> np.ndarray:
    """The columns, as longs."""
    raw = np.frombuffer(zstandard.decompress(data), "<u2").reshape(columns, 4, -1)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<i8")[:, :, 0]


def _numbered(keys: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys among the valid ones, rising, and each one's place among them, -1 where it isn't valid."""
    at = np.full(len(keys), -1, np.int64)
    where = np.flatnonzero(valid)
    own = keys[where]
    order = np.argsort(own)
    own = own[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    at[where[order]] = np.cumsum(new) - 1
    return own[new], at


class _Dealt:
    """Keys (a, b) dealt to so many buckets: their order by bucket, the buckets that have some, and where each begins."""

    def __init__(self, parts: int, a: np.ndarray, b: np.ndarray):
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)) * np.uint64(0xC4CEB9FE1A85EC53)
        bucket = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        self.order = np.argsort(bucket, kind="stable")
        bucket = bucket[self.order].astype(np.int64)
        self.first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[: len(bucket)]
        self.buckets = bucket[self.first]

    def sent(self, block: int, kind: int, *columns: np.ndarray) -> pa.Table:
        """SENT: one row of packed columns for each bucket; buckets of the two kinds are different ones."""
        ends = np.append(self.first[1:], len(self.order))
        columns = [c[self.order] for c in columns]
        x = [_pack(*(c[low:high] for c in columns)) for low, high in zip(self.first.tolist(), ends.tolist())]
        return pa.Table.from_arrays([pa.array(2 * self.buckets + kind), pa.array(np.full(len(x), block, np.int64)), pa.array(x, pa.binary())], ["bucket", "block", "x"])

    def begins(self, bucket: np.ndarray) -> np.ndarray:
        return self.first[np.searchsorted(self.buckets, bucket)]


PAIRS, CONTEXTS = 0, 1
SENT = "bucket long, block long, x binary"
#: What a block has heard from a bucket: which of the contexts that it sent are candidates (at, ctx, c, log10 of left; NaN where not retained), or n of the pairs that it sent.
HEARD = "level long, bucket long, block long, contexts binary, n binary"
TOKENS = ["block", "held", "lengths", "symbols", "m", "q", "ids"]


class _Block:
    """A block's tokens and, of each, the context on the last level that was heard of, and count and chance of its symbol on the last retained one (0: not listed).

    going: of the level after those heard in whole, the candidates are known."""

    def __init__(self, row: pa.Table, parts: int, listed: float, going: bool = False):
        self.parts, self.listed, self.k, self.going = parts, listed, 0, going
        self.block = row.column("block")[0].as_py()
        self.symbols, m, q = (row.column(c)[0].values.to_numpy() for c in ("symbols", "m", "q"))
        self.ids = _unpacked(row.column("ids")[0].as_py())
        lengths = row.column("lengths")[0].values.to_numpy()
        self.train = np.repeat(~np.array(row.column("held")[0].as_py(), bool), lengths)
        self.starts = np.cumsum(lengths) - lengths
        self.since = np.arange(len(self.ids)) - np.repeat(self.starts, lengths)
        self.size = len(self.symbols)
        # the last level's candidates, each token's one, and whether it is retained
        self.ctx, self.place, self.on = np.array([ROOT], np.int64), np.zeros(len(self.ids), np.int64), np.ones(len(self.ids), bool)
        self.m, self.q, self.gain = m[self.ids], q[self.ids], np.zeros(len(self.ids))

    def seen(self) -> pa.Table:
        """SENT of every context (parent, older) of the next level, with how often training has it; parents are the candidates of this one."""
        found, at, dealt = self._extended()
        n = np.bincount(at[(at >= 0) & self.train], minlength=len(found))
        return dealt.sent(self.block, CONTEXTS, self.ctx[found // self.size], self.symbols[found % self.size], n)

    def after(self) -> pa.Table:
        """SENT of every (candidate, symbol), with how often training has it, and count and chance after the candidate's suffix."""
        codes, pair, dealt = self._pairs()
        on = np.flatnonzero(pair >= 0)
        one = np.empty(len(codes), np.int64)
        one[pair[on]] = on
        n = np.bincount(pair[on[self.train[on]]], minlength=len(codes))
        return dealt.sent(self.block, PAIRS, self.ctx[codes // self.size], self.symbols[codes % self.size], n, self.m[one], self.q[one].view("<i8"))

    def both(self) -> pa.Table:
        return pa.concat_tables([self.after(), self.seen()])

    def hear(self, heard: pa.Table | None, levels: int) -> _Block:
        """Goes up so many levels by what was heard of them; of the next one candidates may be known."""
        rows = [] if heard is None else heard.sort_by([("level", "ascending"), ("bucket", "ascending")]).select(["level", "bucket", "contexts", "n"]).to_pylist()
        for k in range(1, levels + 2):
            own = [r for r in rows if r["level"] == k]
            contexts = [(r["bucket"], r["contexts"]) for r in own if r["contexts"] is not None]
            if k <= levels or self.going:
                self._candidates(contexts)
            if k <= levels:
                self._next(np.concatenate([np.zeros(0, np.int64), *(_unpack(r["n"], 1)[0] for r in own if r["n"] is not None)]))
        return self

    def _extended(self) -> tuple[np.ndarray, np.ndarray, _Dealt]:
        k = self.k + 1
        older = np.zeros(len(self.ids), np.int64)
        older[k:] = self.ids[:-k]
        older[self.since < k] = 0  # a block's symbol 0 is BEFORE
        found, at = _numbered(self.place * self.size + older, (self.since >= k - 1) & (self.place >= 0))
        return found, at, _Dealt(self.parts, self.ctx[found // self.size], self.symbols[found % self.size])

    def _candidates(self, rows: list[tuple[int, bytes]]) -> None:
        """The next level's; those whose suffix wasn't retained have no tokens."""
        found, at, dealt = self._extended()
        columns = [_unpack(x, 4) for _, x in rows]
        number, self.ctx, self.c, x = np.concatenate([np.zeros((4, 0), np.int64), *columns], axis=1)
        self.left = np.ascontiguousarray(x).view("<f8")
        which = np.full(len(found) + 1, -1, np.int64)  # the last is for tokens without a context
        begins = dealt.begins(np.repeat(np.array([b for b, _ in rows], np.int64), [c.shape[1] for c in columns]))
        which[dealt.order[begins + number]] = np.arange(len(number))
        self.place = np.where(self.on, which[at], -1)
        self.k += 1

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, _Dealt]:
        codes, pair = _numbered(self.place * self.size + self.ids, self.place >= 0)
        return codes, pair, _Dealt(self.parts, self.ctx[codes // self.size], self.symbols[codes % self.size])

    def _next(self, totals: np.ndarray) -> None:
        codes, pair, dealt = self._pairs()
        n = np.empty(len(codes), np.int64)
        n[dealt.order] = totals
        self.on = np.append(~np.isnan(self.left), False)[self.place]
        on = np.flatnonzero(self.on)
        place, m, q = self.place[on], n[pair[on]], self.q[on]
        listed = m >= self.listed
        chance = np.where(listed, (m + DRAW * q) / (self.c[place] + DRAW), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.gain[on] += np.where(listed, np.log10(chance / q), self.left[place])
        self.m[on], self.q[on] = m, chance


def _each(run):
    """run, which takes a table of one row and what the row has heard, over the rows of batches: nothing was heard yet."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from run(pa.Table.from_batches([batch.slice(row, 1)]), None).to_batches()

    return rows


def _sends(what: str, levels: int, parts: int, listed: float):
    """A block's row and HEARD of so many levels -> what it sends."""

    def run(row: pa.Table, heard: pa.Table | None) -> pa.Table:
        release()
        return getattr(_Block(row, parts, listed, what != "seen").hear(heard, levels), what)()

    return run


SCORED = ["docs", "held", "lengths", "known", "base", "gain"]


def _scored(levels: int, parts: int, listed: float):
    """A block's row and HEARD of so many levels -> the row with the gain of its texts."""

    def run(row: pa.Table, heard: pa.Table | None) -> pa.Table:
        release()
        b = _Block(row, parts, listed).hear(heard, levels)
        return pa.Table.from_arrays([pa.array([np.add.reduceat(b.gain, b.starts)]) if n == "gain" else row.column(n) for n in SCORED], SCORED)

    return run


def _with_symbols(total: int, whole: float, distinct: int, rest: float):
    """A block and of_block, x (number, c, symbol, m, k) of its words -> its tokens by symbols, with count and chance of each symbol."""

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        number, *columns = np.concatenate([_unpack(x, 5) for x in words.column("x").to_pylist()], axis=1)
        c, symbol, m, k = (np.empty(len(number), np.int64) for _ in columns)
        for of_word, own in zip((c, symbol, m, k), columns):
            of_word[number] = own
        symbols, first, own = np.unique(symbol, return_index=True, return_inverse=True)
        ids = _unpacked(block.column("ids")[0].as_py())
        lengths = block.column("lengths")[0].values.to_numpy()
        starts = np.cumsum(lengths) - lengths
        base = np.log10((c + ADD) / (total + ADD * (distinct + 1))) if total else np.zeros(len(c))
        row = {
            "known": np.add.reduceat((c[ids] > 0).astype(np.int64), starts),
            "base": np.add.reduceat(base[ids], starts),
            "symbols": np.concatenate([[BEFORE], symbols]),
            "m": np.concatenate([[0], m[first]]),
            "q": np.concatenate([[0.0], np.where(symbols == REST, rest, (m[first] + ADD * k[first]) / whole)]),
            "ids": _packed(own[ids] + 1),
        }
        names = ["block", "docs", "held", "lengths", "known", "base", "symbols", "m", "q", "ids"]
        out = pa.Table.from_arrays([pa.array([row[n]]) if n in row else block.column(n) for n in names], names)
        release()
        return out

    return run


WORDS = "bucket long, block long, words binary, n binary, number binary"


def _sent_words(parts: int):
    """block, words, train -> WORDS: a block's words, without white space and so packed by it, dealt to buckets by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = [w.encode() for w in batch.column("words")[row].as_py()]
                n = batch.column("train")[row].values.to_numpy()
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
                order = np.argsort(bucket, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
                cut = np.split(order, first[1:])
                arrays = [
                    pa.array(bucket[order][first]),
                    pa.array(np.full(len(first), batch.column("block")[row].as_py(), np.int64)),
                    pa.array([zstandard.compress(b"\n".join(words[i] for i in own.tolist()), 1) for own in cut], pa.binary()),
                    pa.array([_long(n[own]) for own in cut], pa.binary()),
                    pa.array([_long(own) for own in cut], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "block", "words", "n", "number"])
        release()

    return run


def _bucket_words(sent: pa.Table) -> list[list[bytes]]:
    return [zstandard.decompress(x).split(b"\n") for x in sent.column("words").to_pylist()]


def _word_totals(sent: pa.Table) -> pa.Table:
    """A bucket's WORDS -> bucket, word, c of the words that training has."""
    at, words = pd.factorize(np.array([w for own in _bucket_words(sent) for w in own], object))
    n = np.concatenate([_longs(x) for x in sent.column("n").to_pylist()])
    c = np.bincount(at, weights=n, minlength=len(words)).astype(np.int64)
    some = np.flatnonzero(c)
    out = {"bucket": np.full(len(some), sent.column("bucket")[0].as_py(), np.int64), "word": [words[i].decode() for i in some.tolist()], "c": c[some]}
    return pa.table(out, pa.schema([("bucket", pa.int64()), ("word", pa.string()), ("c", pa.int64())]))


def _given_words(rest: int):
    """A bucket's WORDS and word, c, symbol, m, k of known ones -> of_block, x of its blocks' words: number, c, symbol, and the symbol's m and k, packed."""

    def run(sent: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        number = {w.encode(): i for i, w in enumerate(known.column("word").to_pylist())}
        columns = [np.append(known.column(c).to_numpy(), missing) for c, missing in (("c", 0), ("symbol", REST), ("m", rest), ("k", 0))]
        for block, own, places in zip(sent.column("block").to_pylist(), _bucket_words(sent) if sent.num_rows else [], sent.column("number").to_pylist()):
            at = np.fromiter((number.get(w, -1) for w in own), np.int64, len(own))
            rows.append((block, _pack(_longs(places), *(c[at] for c in columns))))
        release()
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["of_block", "x"])

    return run


def _long(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers, "<i8").tobytes(), 1)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i8")


def _keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Which distinct pair each place has, a place of each pair, and the number of pairs."""
    own, _ = pd.factorize(a)
    other, others = pd.factorize(b)
    at, found = pd.factorize(own * len(others) + other)
    first = np.empty(len(found), np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    return at, first, len(found)


def _received(sent: pa.Table, columns: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A bucket's SENT, unpacked, and block, low and high of the part of each."""
    parts = [_unpack(x, columns) for x in sent.column("x").to_pylist()]
    ends = np.cumsum([p.shape[1] for p in parts]).tolist()
    return np.concatenate(parts, axis=1), list(zip(sent.column("block").to_pylist(), [0, *ends[:-1]], ends))


def _table(kinds: str, rows: list[dict]) -> pa.Table:
    """Rows of a bucket; a column that a row lacks is null."""
    arrow = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    columns = [c.split() for c in kinds.split(", ")]
    return pa.Table.from_arrays([pa.array([r.get(n) for r in rows], arrow[k]) for n, k in columns], [n for n, _ in columns])


#: Of each block that sent some contexts its candidates, as HEARD has them before any is retained, or n of the pairs that it sent. Rows without a block
#: hold all candidates (ctx, parent, older); what counts for each candidate's test (ctx, c, k, gain, many, listed); the listed symbols (of, symbol, count, q).
BACK = (
    "bucket long, block long, contexts binary, n binary, ctx array<long>, parent array<long>, older array<long>, c array<long>, k array<long>, gain array<double>, "
    "many array<long>, listed array<double>, of array<long>, symbol array<long>, count array<long>, q array<double>"
)


def _back(least: float, listed: float):
    """A bucket's SENT -> BACK."""

    def run(sent: pa.Table) -> pa.Table:
        release()
        bucket, kind = divmod(sent.column("bucket")[0].as_py(), 2)
        return _table(BACK, _counted(sent, bucket, least) if kind == CONTEXTS else _added(sent, bucket, listed))

    return run


def _counted(sent: pa.Table, bucket: int, least: float) -> list[dict]:
    """Contexts that all blocks together see so often."""
    (parent, older, n), blocks = _received(sent, 3)
    at, first, found = _keys(parent, older)
    many = np.flatnonzero(np.bincount(at, weights=n, minlength=found) >= least)
    ctx = np.full(found, -1, np.int64)
    ctx[many] = (bucket << 40) + np.arange(len(many))
    rows = [{"bucket": bucket, "ctx": ctx[many], "parent": parent[first[many]], "older": older[first[many]]}] if len(many) else []
    for block, low, high in blocks:
        own = ctx[at[low:high]]
        some = np.flatnonzero(own >= 0)
        if len(some):
            rows.append({"bucket": bucket, "block": block, "contexts": _pack(some, own[some], np.zeros(len(some), np.int64), np.full(len(some), np.nan))})
    return rows


def _added(sent: pa.Table, bucket: int, least: float) -> list[dict]:
    """Pairs of all blocks together."""
    (a, b, n, m, q), blocks = _received(sent, 5)
    at, first, found = _keys(a, b)
    n = np.bincount(at, weights=n, minlength=found).astype(np.int64)
    rows = [{"bucket": bucket, "block": block, "n": _pack(n[at[low:high]])} for block, low, high in blocks]
    some = np.flatnonzero(n)  # the others are in held-out texts alone
    if len(some):
        n, first = n[some], first[some]
        m, q = m[first], np.ascontiguousarray(q[first]).view("<f8")
        own, ctx = pd.factorize(a[first])
        listed = n >= least
        add = lambda x: np.bincount(own, weights=x, minlength=len(ctx))
        counts = {"c": add(n).astype(np.int64), "k": np.bincount(own), "many": add(n * listed).astype(np.int64)}
        rows.append({"bucket": bucket, "ctx": ctx, "gain": add(n * np.log(n / m)), "listed": add(q * listed)} | counts)
        rows.append({"bucket": bucket, "of": a[first][listed], "symbol": b[first][listed], "count": n[listed], "q": q[listed]})
    return rows


def _heard(level: int):
    """A bucket's candidates of blocks and its retained contexts -> HEARD of contexts."""

    def run(candidates: pa.Table, kept: pa.Table) -> pa.Table:
        ids = kept.column("ctx").to_numpy()
        order = np.argsort(ids)
        c, left = np.append(kept.column("c").to_numpy()[order], 0), np.append(np.log10(kept.column("left").to_numpy()[order]), np.nan)
        rows = []
        for block, bucket, x in zip(*(candidates.column(n).to_pylist() for n in ("block", "bucket", "contexts"))):
            at, ctx, _, _ = _unpack(x, 4)
            place = locate(ids[order], ctx)
            rows.append({"level": level, "bucket": bucket, "block": block, "contexts": _pack(at, ctx, c[place], left[place].view("<i8"))})
        return _table(HEARD, rows)

    return run


class SuffixTreeModel:
    """Learns from the rows of docs that `held_out` does not mark; score() scores all rows."""

    def __init__(self, docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text"):
        rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
        id_kind = rows.schema["doc_id"].dataType.simpleString()
        from pyspark.sql.pandas.types import to_arrow_type

        blocks = rows.mapInArrow(
            _blocks(to_arrow_type(rows.schema["doc_id"].dataType)),
            f"docs array<{id_kind}>, held array<boolean>, lengths array<long>, words array<string>, train array<long>, ids binary",
        )
        self.blocks = _written(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "lm-blocks")
        self.kinds = (
            f"block long, docs array<{id_kind}>, held array<boolean>, lengths array<long>, known array<long>, base array<double>, "
            "symbols array<long>, m array<long>, q array<double>, ids binary"
        )
        self.scored = f"docs array<{id_kind}>, held array<boolean>, lengths array<long>, known array<long>, base array<double>, gain array<double>"
        tokens = F.aggregate("train", F.lit(0).cast("long"), lambda a, b: a + b)
        self.total = self.blocks.agg(F.coalesce(F.sum(tokens), F.lit(0))).first()[0]
        lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
        self.tokens = self.blocks.agg(F.coalesce(F.sum(lengths), F.lit(0))).first()[0]
        self.parts = -(-self.tokens // BUCKET_TOKENS) or 1
        self.listed = max(self._least(ENTRY_COUNT, ENTRY_SHARE), 1)
        self.levels: list[tuple[DataFrame, DataFrame]] = []
        self.heard: list[DataFrame] = []
        self.coded = self._symbols()
        discard(self.blocks)
        if self.total:
            for _ in range(DEPTH):
                if not self._grow():
                    break

    def _least(self, count: int, share: float) -> float:
        return min(count, share * self.total)

    def _symbols(self) -> DataFrame:
        """The tokens by symbols; self.words, endings and symbols (symbol, q: its probability)."""
        least = F.greatest(F.lit(self._least(SYMBOL_COUNT, SYMBOL_SHARE)), F.lit(1))
        sent = self.blocks.select("block", "words", "train").mapInArrow(_sent_words(self.parts), WORDS)
        sent = _written(sent, "lm-sent-words")
        counted = sent.groupBy("bucket").applyInArrow(_word_totals, "bucket long, word string, c long")
        rare = (F.col("word") != "") & (F.col("c") < least)
        counted = counted.withColumn("ending", F.when(rare, F.substring("word", -2, 2)))
        known = _written(counted.withColumn("id", F.monotonically_increasing_id() + FIRST_SYMBOL), "lm-words")
        self.words = known.filter((F.col("c") >= least) & (F.col("word") != ""))
        self.endings = _written(
            known.filter("ending is not null")
            .groupBy("ending")
            .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k"), F.min("id").alias("shared"))
            .filter(F.col("c") >= least),
            "lm-endings",
        )
        distinct = known.count()
        whole = self.total + ADD * (distinct + 1)
        own = self.words.select(F.col("id").alias("symbol"), F.col("c").alias("m"), (F.col("c") + ADD).alias("mass"))
        own = own.unionByName(self.endings.select(F.col("shared").alias("symbol"), F.col("c").alias("m"), (F.col("c") + ADD * F.col("k")).alias("mass")))
        end = known.filter("word = ''").first()
        ends = end.c if end else 0
        m, mass = own.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("mass"), F.lit(0.0))).first()
        rest = max(ADD / whole, 1.0 - (mass + ends + ADD) / whole)
        two = self.blocks.sparkSession.createDataFrame([(REST, rest), (END, (ends + ADD) / whole)], "symbol long, q double")
        self.symbols = own.select("symbol", (F.col("mass") / whole).alias("q")).unionByName(two)
        shared = self.endings.select("ending", "shared", F.col("c").alias("of_all"), F.col("k").alias("words"))
        named = join_small(known, shared, ["ending"], shared.count(), "left")
        alone = (F.col("word") == "") | (F.col("c") >= least)
        symbol = F.when(F.col("word") == "", END).when(F.col("c") >= least, F.col("id")).otherwise(F.coalesce("shared", F.lit(REST)))
        of_symbol = F.when(alone, F.col("c")).otherwise(F.coalesce("of_all", F.lit(self.total - m - ends)))
        named = named.select("bucket", "word", "c", symbol.alias("symbol"), of_symbol.alias("m"), F.when(alone, 1).otherwise(F.coalesce("words", F.lit(0))).cast("long").alias("k"))
        words = sent.groupBy("bucket").cogroup(named.groupBy("bucket")).applyInArrow(_given_words(self.total - m - ends), "of_block long, x binary")
        words = _written(words, "lm-given-words")
        discard(sent)
        own = self.blocks.select("block", "docs", "held", "lengths", "ids").groupBy("block")
        coded = own.cogroup(words.groupBy("of_block")).applyInArrow(_with_symbols(self.total, whole, distinct, rest), self.kinds)
        coded = _written(coded, "lm-tokens")
        discard(words)
        return coded

    def _blockwise(self, run, schema: str, columns: list[str], heard: list[DataFrame]) -> DataFrame:
        """What `run` makes of each block and of what it has heard."""
        rows = self.coded.select(*columns)
        if not heard:
            return rows.mapInArrow(_each(run), schema)
        return rows.groupBy("block").cogroup(reduce(DataFrame.unionByName, heard).groupBy("block")).applyInArrow(run, schema)

    def _sent(self, what: str, heard: list[DataFrame]) -> DataFrame:
        least = max(self._least(CONTEXT_COUNT, CONTEXT_SHARE), 1)
        sent = self._blockwise(_sends(what, len(self.levels), self.parts, self.listed), SENT, TOKENS, heard)
        return _written(sent.groupBy("bucket").applyInArrow(_back(least, self.listed), BACK), "lm-back")

    def _grow(self) -> bool:
        """Adds a level; False if it has no contexts.

        What blocks see goes to buckets by key, packed, is added up there, and what counts of it goes back to the blocks by
        the same way. A common key comes once from each block and is one of many in its bucket."""
        k = len(self.levels) + 1
        if k == 1:
            self.candidates = self._sent("seen", self.heard)
        candidates = self.candidates
        own = candidates.filter("contexts is not null").select("bucket", "block", "contexts")
        level, no = F.lit(k).cast("long").alias("level"), F.lit(None).cast("binary")
        known = own.select(level, "bucket", "block", "contexts", no.alias("n"))
        added = self.candidates = self._sent("both" if k < DEPTH else "after", [*self.heard, known])
        # how the next symbols of a context diverge from those of its suffix, over all of them
        x = F.explode(F.arrays_zip("ctx", "c", "k", "gain", "many", "listed")).alias("x")
        tested = added.filter("gain is not null").select(x).select("x.*").groupBy("ctx").agg(*(F.sum(c).alias(c) for c in ("c", "k", "gain", "many", "listed")))
        x = F.explode(F.arrays_zip("ctx", "parent", "older")).alias("x")
        tested = tested.join(candidates.filter("parent is not null").select("bucket", x).select("bucket", "x.*"), "ctx")
        if self.levels:
            tested = tested.join(self.levels[-1][0].select(F.col("ctx").alias("parent"), F.col("c").alias("of_suffix")), "parent")
        else:
            tested = tested.withColumn("of_suffix", F.lit(self.total))
        gain = F.col("gain") + F.col("c") * F.log(F.col("of_suffix") / F.col("c"))
        unlisted = lambda x: F.greatest(1.0 - x, F.lit(1e-12))
        left = unlisted((F.col("many") + DRAW * F.col("listed")) / (F.col("c") + DRAW)) / unlisted(F.col("listed"))
        contexts = tested.filter(gain - (F.col("k") - 1) >= DIVERGENCE * F.col("c")).select("bucket", "ctx", "parent", "older", "c", left.alias("left"))
        contexts = _written(contexts, "lm-contexts")
        if contexts.isEmpty():
            discard(added, contexts)
            return False
        heard = _written(own.groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(_heard(k), HEARD), "lm-heard")
        totals = added.filter("n is not null").select(level, "bucket", "block", no.alias("contexts"), "n")
        self.heard += [heard, totals]
        x = F.explode(F.arrays_zip("of", "symbol", "count", "q")).alias("x")
        listed = added.filter("of is not null").select(x).select(F.col("x.of").alias("ctx"), "x.symbol", "x.count", "x.q")
        chance = (F.col("count") + DRAW * F.col("q")) / (F.col("c") + DRAW)
        self.levels.append((contexts, listed.join(contexts, "ctx").select("ctx", "symbol", chance.alias("chance"))))
        return True

    @property
    def tree(self) -> SuffixTree:
        """The whole tree, collected: for small tables."""
        words, endings = self.words.select("id", "word").collect(), self.endings.select("shared", "ending").collect()
        q = {r.symbol: r.q for r in self.symbols.collect()}
        number = {BEFORE: BEFORE, REST: REST, END: END} | {r[0]: i for i, r in enumerate(words + endings, FIRST_SYMBOL)}
        root = np.zeros(len(number))
        for symbol, p in q.items():
            root[number[symbol]] = p
        tree = SuffixTree({r.word: number[r.id] for r in words}, {r.ending: number[r.shared] for r in endings}, root)
        places = {ROOT: 0}
        for contexts, level in self.levels:
            rows = contexts.select("ctx", "parent", "older", "left").distinct().collect()
            rows = sorted((places[r.parent] * tree.size + number[r.older], r.ctx, r.left) for r in rows)
            places = {ctx: i for i, (_, ctx, _) in enumerate(rows)}
            entries = sorted((places[r.ctx] * tree.size + number[r.symbol], r.chance) for r in level.collect())
            tree.levels.append(Level(*map(np.array, ([r[0] for r in rows], [r[2] for r in rows], [e[0] for e in entries], [e[1] for e in entries]))))
        return tree

    def score(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; scores are log10."""
        x = F.explode(F.arrays_zip("docs", "held", "lengths", "known", "base", "gain")).alias("x")
        scored = self._blockwise(_scored(len(self.levels), self.parts, self.listed), self.scored, [*TOKENS, "docs", "known", "base"], self.heard)
        return scored.select(x).select(
            F.col("x.docs").alias("doc_id"),
            F.col("x.held").alias("held_out"),
            F.col("x.lengths").alias("n_tokens"),
            F.col("x.known").alias("n_known"),
            F.lit(self.total).cast("long").alias("train_tokens"),
            F.col("x.base").alias("base_score"),
            (F.col("x.base") + F.col("x.gain")).alias("score"),
        )


def perplexity(log10_probability: float, tokens: int) -> float:
    """Per token, from a text's score."""
    return math.pow(10.0, -log10_probability / max(1, tokens))
