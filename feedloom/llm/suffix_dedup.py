"""Removal of repeated byte strings by suffix arrays over shards.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a
document with a smaller id, or before in the same one. Every such string has an
anchor, the short string in it whose hash is least (the first of equals), and the
core, the anchor with the bytes on its longer side up to CORE. Neighbouring strings
with one anchor and one side are a run, held by a piece of text. Equal strings have
equal cores, so pieces come together by their cores' hashes.

Pieces whose core occurs once go. Of equal pieces the first stays, and all strings of
the others repeat. The pieces left are dealt to shards by core; a shard's are laid end
to end, their suffixes are sorted by induction in external memory (see induced), and
runs of suffixes with LENGTH bytes in common leave all but their earliest start to
remove. The filter loses no repeat, and it leaves to the sort what it alone can tell.

A core with more than HOT different pieces is dealt to several shards. What is first
in a shard need not be first of all then, so of every string in such a piece each
shard gives a 128-bit hash and the first place, and an aggregate finds the others.

Equal pieces are told by 128 bits of hashes: 64 of the core, 64 of the whole.

Defined results: null counts as the empty text; rows that share an id, or have none,
are told apart in the order of id, null last, and text, and rows with the same id and
text count as separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, forget, materialize, release, sliced
from .induced import MEMORY, STEP, Scratch, blocks, sorted_suffixes

LENGTH, ANCHOR = 100, 16
WINDOW, SIDE = LENGTH - ANCHOR + 1, (LENGTH - ANCHOR) // 2
CORE = ANCHOR + SIDE
#: Bytes of text that are looked at together; pieces of a task that are counted or compared before they leave it.
SEGMENT, FLUSH = 1 << 17, 400_000
#: Different pieces of one core that stay in one shard.
HOT = 4_096
#: Text of a shard that tables beyond `spark.sql.shuffle.partitions` of them are dealt for.
SHARD_BYTES = 32 << 20
PRIME = 0x100000001B3
INVERSE = pow(PRIME, -1, 1 << 64)
SHIFTED = bytes((i + 2) % 256 for i in range(256))  # UTF-8 has no byte above 0xF4, so 0 and 1 stay free
TOP = 0xF4 + 2
LOW_BITS = np.uint64(0xFFFFFFFF)
_POWERS: list[np.ndarray] = []
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (PRIME, INVERSE):
            p = np.full(max(n, 2 * SEGMENT + 8 * LENGTH), base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (text, first place of its own, place where the part begins, part): parts of texts, about SEGMENT bytes together.

    A part goes far enough round the strings that start at places of its own to show their runs as a whole."""
    held, size = [], 0
    for i, data in enumerate(texts):
        if len(data) < LENGTH:
            continue
        for start in range(0, len(data) - LENGTH + 1, SEGMENT):
            low = max(0, start - 1)
            part = data[low : start + SEGMENT + WINDOW + LENGTH]
            held.append((i, start, low, part))
            size += len(part)
            if size >= SEGMENT:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """core, whole (hashes), text, low, high: each run of strings that share an anchor and a side, by its first and last start."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for held in _segments(texts):
        text, start, low = (np.array([h[k] for h in held], np.int64) for k in range(3))
        size = np.array([len(h[3]) for h in held], np.int64)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
        n = len(data)
        up, down = _powers(n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        count = n - ANCHOR + 1
        x = _mixed((sums[ANCHOR:] - sums[:count]) * down[:count])
        # a string's anchor is the first place in it with the least hash
        anchor = (_least(x & ~LOW_BITS | np.arange(count, dtype=np.uint64), WINDOW) & LOW_BITS).astype(np.int64)
        starts = np.arange(len(anchor))
        left = anchor - starts >= SIDE
        inside = np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(begin + size - LENGTH + 1, minlength=n + 1))[: len(anchor)] > 0
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (inside[1:] != inside[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor)) - 1
        part = np.searchsorted(begin, first, side="right") - 1
        place = first - begin[part] + low[part]
        own = inside[first] & (place >= start[part]) & (place < start[part] + SEGMENT)
        first, last, part, place = first[own], last[own], part[own], place[own]
        anchor, left = anchor[first], left[first]
        at = anchor - np.where(left, SIDE, 0)
        core = _mixed((sums[at + CORE] - sums[at]) * down[at] ^ left.astype(np.uint64))
        whole = _mixed((sums[last + LENGTH] - sums[first]) * down[first])
        whole ^= _mixed(((anchor - first) * LENGTH + last - first).astype(np.uint64))
        found.append((core, whole, text[part], place, place + last - first))
    return tuple(np.concatenate(c) for c in zip(*found))


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> core, n: cores with the number of their pieces, some hundred thousand pieces at a time."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        cores, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cores.view(np.int64)), pa.array(n)], ["core", "n"])

    for batch in sliced(batches):
        held.append(runs([t.encode() for t in batch.column(0).to_pylist()])[0])
        size += len(held[-1])
        if size > FLUSH:
            yield counted()
            held, size = [], 0
    yield counted()


def _copies(core: np.ndarray, whole: np.ndarray, key: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which pieces have an equal one among these that comes first."""
    out = np.zeros(len(core), bool)
    both = core ^ _mixed(whole)
    order = np.argsort(both)
    both = both[order]
    same = both[1:] == both[:-1]
    some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    some = some[np.lexsort((low[some], key[some], whole[some], core[some]))]
    out[some[1:]] = (core[some[1:]] == core[some[:-1]]) & (whole[some[1:]] == whole[some[:-1]])
    return out


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> core, whole, key, low, high, copy: copy marks pieces that repeat one of the same task, so that those
    of a common passage need not meet."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        core, whole, key, low, high = (np.concatenate(c) for c in zip(*held))
        arrays = [core.view(np.int64), whole.view(np.int64), key, low.astype(np.int32), high.astype(np.int32), _copies(core, whole, key, low)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["core", "whole", "key", "low", "high", "copy"])

    for batch in sliced(batches):
        core, whole, text, low, high = runs([t.encode() for t in batch.column(1).to_pylist()])
        held.append((core, whole, batch.column(0).to_numpy()[text], low, high))
        size += len(core)
        if size > FLUSH:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, wanted (low, high, shard, hot), text -> shard, hot, key, start, bytes: the pieces with their text."""
    names = ["shard", "hot", "key", "start", "bytes"]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names)

    for batch in sliced(batches):
        out: list[tuple] = []
        for key, wanted, text in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode()
            out.extend((w["shard"], w["hot"], key, w["low"], data[w["low"] : w["high"] + LENGTH]) for w in wanted)
            if len(out) > 20_000:
                yield made(out)
                out = []
        yield made(out)


class Shard:
    """Pieces (key, start, bytes, hot) laid end to end, and what sorting their suffixes says of their strings.

    The text and all arrays of the sort go to scratch files beyond `memory` bytes; 21 bytes a piece stay in memory."""

    def __init__(self, pieces: Iterator[pa.RecordBatch], memory: int = MEMORY):
        scratch = Scratch(memory)
        keys, starts, hots, sizes = ([np.zeros(0, k)] for k in (np.int64, np.int32, bool, np.int64))
        with tempfile.TemporaryFile() as file:
            for batch in pieces:
                texts = batch.column("bytes").to_pylist()
                file.write(b"".join(x.translate(SHIFTED) + b"\x01" for x in texts))
                sizes.append(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
                for column, name in ((keys, "key"), (starts, "start"), (hots, "hot")):
                    column.append(batch.column(name).to_numpy(zero_copy_only=False))
            self.n = file.tell() + 1
            self.text = scratch.array(self.n + STEP, np.uint8)
            file.seek(0)
            for a, b in blocks(0, self.n - 1):
                self.text[a:b] = np.frombuffer(file.read(b - a), np.uint8)
        self.keys, self.starts, self.hots = map(np.concatenate, (keys, starts, hots))
        self.ends = np.cumsum(np.concatenate(sizes))
        self.gone = scratch.array(self.n, bool)
        self.scratch = scratch

    def _places(self, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of suffixes, and the documents' keys and places where they start."""
        piece = np.minimum(np.searchsorted(self.ends, suffix, side="right"), len(self.ends) - 1)
        begin = np.where(piece > 0, self.ends[piece - 1], 0)
        return piece, self.keys[piece], self.starts[piece] + (suffix - begin)

    def sort(self) -> Iterator[tuple[bytes, int, int]]:
        """Marks every string that repeats an earlier one of the shard; yields (hash, key, start) of each string of hot
        pieces, at its first place here."""
        held = np.zeros(0, np.int64)  # the first place of the run that goes on in the next block
        for suffix, shared in sorted_suffixes(self.text, self.n, TOP, LENGTH, self.scratch):
            begins = shared < LENGTH
            runs_before = np.cumsum(begins)
            most = int(runs_before[-1])
            whole = suffix + LENGTH < self.ends[np.minimum(np.searchsorted(self.ends, suffix, side="right"), len(self.ends) - 1)]
            run = np.concatenate([np.zeros(len(held), np.int64), runs_before[whole]])
            suffix = np.concatenate([held, suffix[whole]])
            held = suffix[:0]
            if not len(suffix):
                continue
            piece, key, start = self._places(suffix)
            order = np.lexsort((start, key, run))
            run, suffix = run[order], suffix[order]
            first = np.concatenate([[True], run[1:] != run[:-1]])
            self.gone[suffix[~first]] = True
            if run[-1] == most:
                held = suffix[first][-1:]
            edge = np.flatnonzero(first)
            hot = np.logical_or.reduceat(self.hots[piece[order]], edge)
            if len(held):
                hot[-1] = False
            yield from self._hashed(suffix[edge[hot]])
        if len(held):
            yield from self._hashed(held[self.hots[self._places(held)[0]]])

    def _hashed(self, suffix: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        _, key, start = self._places(suffix)
        for s, k, at in zip(suffix.tolist(), key.tolist(), start.tolist()):
            yield xxhash.xxh3_128_digest(self.text[s : s + LENGTH]), k, at

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """key, begin, end of neighbouring strings that are marked."""
        for a, b in blocks(0, self.n):
            at = a + np.flatnonzero(self.gone[a:b])
            if len(at):
                piece, key, start = self._places(at)
                first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])]))
                last = np.append(first[1:], len(at)) - 1
                yield key[first], start[first], start[last] + LENGTH


def _sorted_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hot, key, start, bytes of a shard -> key, begin, end of what repeats, and key, begin, hash of hot strings' first places."""
    names, kinds = ["key", "begin", "end", "hash"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def made(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    release()
    shard = Shard(batches)
    if len(shard.keys):
        given = shard.sort()
        while rows := list(islice(given, 50_000)):
            hashes, keys, starts = zip(*rows)
            yield made(keys, starts, [None] * len(rows), hashes)
        for key, begin, end in shard.spans():
            yield made(key, begin, end, [None] * len(key))
    del shard
    release()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, gone (begin, end) -> what goes and what is left."""
    for batch in sliced(batches):
        out: tuple[list, ...] = ([], [], [], [], [])
        gone_of = batch.column(2)
        for i, text in enumerate(batch.column(1).to_pylist()):
            data = (text or "").encode()
            n = len(data)
            edges, kept = np.zeros(0, np.int64), data
            if gone_of[i].is_valid:
                pairs = gone_of[i].values
                steps = np.bincount(pairs.field("begin").to_numpy(), minlength=n + 1)
                steps -= np.bincount(np.minimum(pairs.field("end").to_numpy(), n), minlength=n + 1)
                gone = np.cumsum(steps[:n]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = [{"begin": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
            for column, value in zip(out, (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, text: the key is the id where that is a number of one row each, else a number in the order of id and text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if isinstance(rows.schema["doc_id"].dataType, (T.LongType, T.IntegerType)):
        twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
        if twice.isEmpty():
            return rows.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text")
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.coalesce("text", F.lit("")))
    return materialize(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "repeats-docs")


def _span(begin: Column | str, end: Column | str) -> Column:
    return F.struct(F.col(begin).cast("long").alias("begin"), end.cast("long").alias("end")).alias("span")


def _pieces(texts: DataFrame) -> DataFrame:
    """key, low, high, core, copy of the pieces whose core occurs again; copy: an equal piece comes first."""
    cores = texts.select("text").mapInArrow(_cores, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))
    cores = materialize(cores.filter("n > 1").select("core"), "repeats-cores")
    forget(texts.sparkSession)
    rows = texts.mapInArrow(_piece_rows, "core long, whole long, key long, low int, high int, copy boolean")
    rows = materialize(rows.join(cores, "core", "left_semi"), "repeats-pieces")
    discard(cores)
    forget(texts.sparkSession)
    open_ = rows.filter("NOT copy")
    first = open_.groupBy("core", "whole").agg(F.min(F.struct("key", "low")).alias("first"))
    copy = F.struct("key", "low") != F.col("first")
    pieces = open_.join(first, ["core", "whole"]).select("key", "low", "high", "core", copy.alias("copy"))
    pieces = materialize(pieces.unionByName(rows.filter("copy").select("key", "low", "high", "core", "copy")), "repeats-pieces")
    discard(rows)
    forget(texts.sparkSession)
    return pieces


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end in bytes) of every row."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    texts = rows.select("key", "text").filter(F.octet_length("text") >= LENGTH)
    pieces = _pieces(texts)
    kinds = pieces.filter("NOT copy").groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shards = F.ceil(F.col("k") / F.lit(hot))
    shard = F.xxhash64("core", F.pmod(F.xxhash64("key", "low"), shards))
    wanted = pieces.filter("NOT copy").join(kinds, "core").select("key", F.struct("low", "high", shard.alias("shard"), (shards > 1).alias("hot")).alias("x"))
    wanted = materialize(wanted.groupBy("key").agg(F.collect_list("x").alias("wanted")), "repeats-wanted")
    size = wanted.select(F.explode("wanted").alias("x")).agg(F.coalesce(F.sum(F.col("x.high") - F.col("x.low") + LENGTH + 1), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    fetched = texts.join(wanted, "key").select("key", "wanted", "text")
    fetched = fetched.mapInArrow(_fetched, "shard long, hot boolean, key long, start int, bytes binary")
    found = fetched.repartition(parts, "shard").mapInArrow(_sorted_shard, "key long, begin long, end long, hash binary")
    found = materialize(found, "repeats-found")
    discard(wanted)
    forget(spark)
    hashed = found.filter("hash is not null")
    gone = pieces.filter("copy").select("key", _span("low", F.col("high") + LENGTH)).unionByName(
        found.filter("hash is null").select("key", _span("begin", F.col("end")))
    )
    if not hashed.isEmpty():
        first = hashed.groupBy("hash").agg(F.min(F.struct("key", "begin")).alias("first"))
        again = hashed.join(first, "hash").filter(F.struct("key", "begin") != F.col("first"))
        gone = gone.unionByName(again.select("key", _span("begin", F.col("begin") + LENGTH)))
    gone = gone.groupBy("key").agg(F.collect_list("span").alias("gone"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (
        rows.join(gone, "key", "left")
        .select("doc_id", "text", "gone")
        .mapInArrow(
            _removed,
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>",
        )
    )
