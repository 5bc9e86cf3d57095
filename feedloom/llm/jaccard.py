"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles. Shingles have one order: those that
repeat most come last, the rest by hash. If two sets reach the similarity, their
prefixes in this order share a shingle, and their sizes and the shingle's places
bound how much they can share. Documents with the same prefix and size form one
group; groups meet in the buckets of their prefix shingles, pairs of groups that
pass the bounds expand into their distinct sets, and every such pair is verified on
whole sets. Copies never become pairs: equal sets are one class from the start.

Where every link counts, all entries of a bucket meet, those of large ones in salted
blocks. For components alone there is a quick path. Every class goes to two of its
buckets, those whose shingles have the least of two hashes: near copies mostly choose
alike. There classes are dealt to blocks, whose prefixes are compared at once, and so
are the whole sets of those that may have a partner in their block, a part of the blocks after another. After the components of these links, a bucket in one component needs
nothing more; in others the members outside the bucket's largest component first meet a few
other members each, which joins most of what links to a large component. Then those that are still
outside meet all other members, in salted blocks, and pairs in one component drop out. No pair that
could join two components is left out. The pairs that remain are checked first on
prefixes, whose common shingles bound those of the sets, and then on whole sets.

The order is a matter of speed alone, so it may rest on counts that leave out what
repeats in no task. Shingles are held as 64-bit hashes and sets are told apart by
128 bits.

Defined results: texts without words, and null, have an empty set and link with
nothing; a text of fewer words than a shingle has one shingle, its whole sequence;
rows may repeat, also with one id; a null id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_ROWS, discard, forget, fresh, materialize, sliced

#: Groups in a bucket that are paired outright.
BUCKET = 64
#: Buckets that a class chooses; classes and shingles of about so many make a block there.
CHOICES, CLASSES, SHINGLES = 2, 64, 500_000
#: Entries of a large bucket that meet in one task when all of them meet.
BLOCK = 256
#: Entries of a bucket of several components that those outside the largest meet in one task.
REST_BLOCK = 4_096
#: Entries of a larger bucket of several components that those outside the largest meet first, and in how many buckets.
TRIED, TRIES = 128, 4
#: Counts below this don't move a shingle to the end; at most so many shingles are moved.
REPEATS, MOVED = 8, 250_000
#: Sets are fetched by a broadcast list of the places that want them up to this length (about 60 bytes each), beyond it by a shuffle.
FETCH_BROADCAST = 500_000
PARTNERS = 256
#: Shingles of a block that are looked at together.
COLUMNS = 4_096
#: Whole sets go to the blocks in so many rounds, each with its part of the blocks, if there are more than BROADCAST_ROWS of them.
ROUNDS = 4
#: Pairs of one class that its set goes to from one row.
HOMES = 1_024
FLUSH_SHINGLES = 2_000_000
#: Bytes of texts whose shingles are made together (about forty times as much on the way), and of a word that is hashed by its places.
TEXT_BYTES, PLACED = 512 << 10, 64

SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: A number for each byte, one for both cases of a letter, and what a place multiplies it by.
BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
STEP = 0xD1342543DE82EF95


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """STEP to the power of each place, and its inverse to it, modulo 2 ** 64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(TEXT_BYTES + PLACED, x, np.uint64))) for x in (STEP, pow(STEP, -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def _hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another in data, and the number of words before each of the bounds.

    A word is its bytes' numbers times the powers of their places, so a running sum gives all words at once. Such sums
    are weak for very long words that are made for it; those beyond PLACED bytes are hashed one by one."""
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = SPACES[data[:-1]]
    cut[bounds] = True  # no word goes on into the next text
    word = ~SPACES[data]
    starts, ends = np.flatnonzero(word & cut[:-1]), np.flatnonzero(word & np.append(cut[1:-1] | SPACES[data[1:]], True)) + 1
    hashes, (powers, inverse) = np.empty(len(starts), np.uint64), _powers()
    for low in range(0, len(data), TEXT_BYTES):
        part = data[low : low + TEXT_BYTES + PLACED]
        own = slice(*np.searchsorted(starts, [low, low + TEXT_BYTES]))
        at, to = starts[own] - low, np.minimum(ends[own] - low, len(part))
        sums = np.append(np.uint64(0), np.cumsum(BYTES[part] * powers[: len(part)]))
        hashes[own] = _mixed((sums[to] - sums[at]) * inverse[at] + (to - at).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > PLACED).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    held = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    if not len(held) or bounds[0] == bounds[-1]:
        return [np.zeros(0, np.uint64)] * len(held)
    data = np.frombuffer(held.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    hashes, upto = _hashed_words(data, bounds - bounds[0])
    count = np.diff(upto)
    rolled = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
    for j in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(rolled)]
    rolled = _mixed(rolled)
    out = []
    for low, n in zip(upto[:-1].tolist(), count.tolist()):
        own = np.sort(rolled[low : low + n - width + 1]) if n >= width else _whole(hashes[low : low + n])
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own)
    return out


def _whole(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of a text that has fewer words than a shingle, or none."""
    value = len(hashes)
    for x in hashes.tolist():
        value = (value * 0x9E3779B97F4A7C15 + x) % (1 << 64)
    return _mixed(np.full(min(1, len(hashes)), value, np.uint64))


def _prefix_length(percent: int, n):
    return n - -(-percent * n // 100) + 1


def _repeats(width: int):
    """text -> token, n: shingles that several distinct sets of a task share, with how many."""

    def flush(held: dict) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate([*held.values(), np.zeros(0, np.uint64)]), return_counts=True)
        many = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[many].view(np.int64)), pa.array(counts[many])], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in sliced(batches, TEXT_BYTES):
            for s in shingle_sets(batch.column(0), width):
                key = xxhash.xxh3_128_digest(s)
                if key not in held:
                    held[key] = s
                    size += len(s)
            if size > FLUSH_SHINGLES:
                yield flush(held)
                held, size = {}, 0
        yield flush(held)

    return run


def _prefixes(width: int, percent: int, moved: np.ndarray, counts: np.ndarray):
    """row, doc_id, text, text_hash -> row, doc_id, n, sid, gid, prefix, text_hash; a task gives a group's prefix once while it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for batch in sliced(batches, TEXT_BYTES):
            ns, sids, gids, prefixes = [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                n = len(s)
                length = _prefix_length(percent, n) if n else 0
                prefix = s[:length]
                if len(moved) and n:
                    at = np.minimum(np.searchsorted(moved, s), len(moved) - 1)
                    prefix = s[np.argsort(np.where(moved[at] == s, counts[at], 0), kind="stable")[:length]]
                gid = xxhash.xxh3_128_digest(prefix.tobytes() + n.to_bytes(8, "little"))
                if len(given) > 100_000:
                    given.clear()
                prefixes.append(prefix.view(np.int64) if gid not in given else prefix[:0].view(np.int64))
                given.add(gid)
                ns.append(n)
                sids.append(xxhash.xxh3_128_digest(s))
                gids.append(gid)
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))
            arrays = [batch.column(0), batch.column(1), pa.array(ns, pa.int32()), pa.array(sids, pa.binary()), pa.array(gids, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(3)], ["row", "doc_id", "n", "sid", "gid", "prefix", "text_hash"])

    return run


def _sets(width: int):
    """cls, chunk, sid, homes, text -> homes, cls, n, shingles, where the text has that set; a task gives a class's chunk of homes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for batch in sliced(batches, TEXT_BYTES):
            rows, sets, sizes = [], [], []
            keys = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)))
            for i, ((cls, chunk, sid), s) in enumerate(zip(keys, shingle_sets(batch.column(4), width))):
                if (cls, chunk) not in given:
                    if xxhash.xxh3_128_digest(s) == sid:
                        given.add((cls, chunk))
                        rows.append(i)
                        sizes.append(len(s))
                        sets.append(s.tobytes())
            at = pa.array(rows, pa.int64())
            arrays = [batch.column(3).take(at), batch.column(0).take(at), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["homes", "cls", "n", "shingles"])

    return run


def _prefix_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """homes, cls, n, shared -> homes, cls, n, shingles."""
    for batch in batches:
        sets = [x.values.to_numpy().tobytes() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["homes", "cls", "n", "shingles"])


def _verifier(percent: int, whole: bool = True):
    """a, part, partner, cls, n, shingles in order -> a, b: the set of a comes first, and its partners after it.

    n: the shingles of the whole set; without whole=True those at hand are what its prefix can share. The prefix that ends earlier in
    the order of all shingles holds all that both sets share up to there, so beside what prefixes share the rest of one set can be equal."""

    def rest(n: int) -> int:
        return 0 if whole else n - _prefix_length(percent, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, own, size = None, np.zeros(0, np.uint64), 0
        for batch in sliced(batches):
            found: list[tuple[int, int]] = []
            for a, part, partner, cls, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                other = np.frombuffer(data, np.uint64)
                if not partner:
                    home, own, size = (a, part), other, n
                    continue
                if home != (a, part):
                    raise ValueError(f"class {a} has no set")
                both = len(np.intersect1d(own, other, assume_unique=True)) + max(rest(size), rest(n))
                if 100 * both >= percent * (size + n - both):
                    found.append((a, cls))
            arrays = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, but for the diagonal."""
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    same = tokens[1:] == tokens[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    place = np.cumsum(np.concatenate([[True], ~same]))[shared]
    owner = owner[shared]
    both = np.zeros((len(sets), len(sets)), np.int64)
    if not len(owner):
        return both
    place = np.unique(place, return_inverse=True)[1]
    for low in range(0, int(place[-1]) + 1, COLUMNS):  # place is sorted
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[a:b], place[a:b] - low] = 1
        both += (has @ has.T).astype(np.int64)
    np.fill_diagonal(both, 0)
    return both


def _likely(sizes: list[int], prefixes: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets have another one here that is similar enough, as far as what their prefixes can share tells."""
    size = np.array(sizes)
    both, rest = _overlaps(prefixes), size - _prefix_length(percent, size)
    most = both + np.maximum(rest[:, None], rest[None, :])
    return ((both > 0) & (100 * most >= percent * (size[:, None] + size[None, :] - most))).any(axis=1)


def _joined(classes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links, enough of them to connect what all links between these sets connect."""
    size, both = np.array([len(x) for x in sets]), _overlaps(sets)
    linked = (both > 0) & (100 * both >= percent * (size[:, None] + size[None, :] - both))
    out, left = [], set(range(len(sets)))
    while left:
        todo = [left.pop()]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(linked[i]).tolist():
                if j in left:
                    left.remove(j)
                    todo.append(j)
                    out.append((classes[i], classes[j]))
    return out


def _of_blocks(close, names: list[str]):
    """a, part, cls, n, shingles in order of (a, part) -> what close gives of each block: rows of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held = None, ([], [], [])
        for batch in sliced(batches):
            found: list[tuple] = []
            for a, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if home != (a, part):
                    found += close(home, *held) if len(held[0]) > 1 else []
                    home, held = (a, part), ([], [], [])
                for column, x in zip(held, (row[0], row[1], np.frombuffer(row[2], np.uint64))):
                    column.append(x)
            yield made(found)
        yield made(close(home, *held) if len(held[0]) > 1 else [])

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))], names)

    return run


def _block_likely(percent: int):
    """-> a, part, cls of the classes that may have a partner in their block."""

    def close(home, classes, sizes, prefixes):
        return [(*home, classes[i]) for i in np.flatnonzero(_likely(sizes, prefixes, percent)).tolist()]

    return _of_blocks(close, ["a", "part", "cls"])


def _block_links(percent: int):
    """-> a, b: links within blocks of whole sets."""
    return _of_blocks(lambda _, classes, sizes, sets: [(min(x), max(x)) for x in _joined(classes, sets, percent)], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of edges a, b, two longs; loops may be absent.

    Large-star and small-star steps take turns until nothing moves. Every step is
    an aggregate and a join; nothing but counts reaches the driver."""

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    was = state(edges)
    while was[0]:
        around = both(edges)
        least = around.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        last, edges = edges, materialize(small.filter("a <> b").distinct(), "cc")
        discard(last)
        now = state(edges)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root after further edges a, b: only the roots that these join are connected anew."""
    one, two = (labels.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")) for end in "ab")
    ends = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = connected_components(ends.filter("a <> b").distinct())
    moved = moved.select(F.col("node").alias("was"), F.col("root").alias("now"))
    known = labels.join(moved, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    new = moved.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return known.unionByName(new)


def _can_reach(percent: int, n: Column, m: Column, i: Column, j: Column) -> Column:
    """Whether sets of n and m shingles, the first they share at places i and j, can be similar enough."""
    most = F.lit(1) + F.least(n - i - 1, m - j - 1)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * most >= percent * (n + m - most))


class JaccardJoin:
    """The join of one table; links() gives all linked pairs of classes, link_counts() and components() a row per document."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, bucket: int = BUCKET):
        self.width, self.percent, self.bucket = width, percent, bucket
        self.texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        self.spark = docs.sparkSession
        self.wanted: list[DataFrame] = []
        moved, counts = self._moved()
        kind = self.texts.schema["doc_id"].dataType.simpleString()
        rows = self.texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
        rows = rows.mapInArrow(
            _prefixes(width, percent, moved, counts),
            f"row long, doc_id {kind}, n int, sid binary, gid binary, prefix array<long>, text_hash long",
        )
        self.rows = materialize(rows, "jaccard-rows")
        full = self.rows.filter("n > 0")
        #: cls stands for all rows with one set; g for all with one prefix and size
        classes = full.groupBy("sid").agg(F.min(F.struct("row", "doc_id", "gid", "n")).alias("x"))
        classes = classes.select("sid", F.col("x.row").alias("cls"), F.col("x.doc_id").alias("its_id"), "x.gid", "x.n")
        groups = full.filter(F.size("prefix") > 0).groupBy("gid").agg(F.min("row").alias("g"))
        self.classes = materialize(classes.join(groups, "gid").drop("gid"), "jaccard-classes")
        forget(self.spark)
        per_token = W.partitionBy("token")
        at = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")  # in one number: most rows move only to be found alone
        entries = full.select("row", "n", F.posexplode("prefix").alias("pos", "token"))
        entries = (
            entries.select("token", "row", at.alias("at"))
            .withColumn("seen", F.count(F.lit(1)).over(per_token))
            .filter("seen > 1")
        )
        # other rows of a group have the prefix of the first again
        entries = entries.join(groups.select(F.col("g").alias("row")), "row").select(
            "token", F.col("row").alias("g"), F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos")
        )
        entries = entries.withColumn("groups", F.count(F.lit(1)).over(per_token)).filter("groups > 1")
        self.entries = materialize(entries, "jaccard-entries")
        with_prefixes, self.rows = self.rows, materialize(self.rows.drop("gid", "prefix"), "jaccard-rows")
        discard(with_prefixes)
        self.shared = materialize(self._shared(), "jaccard-shared")
        forget(self.spark)

    def _shared(self) -> DataFrame:
        """g, shared: what a group's prefix can share with others. Shingles of this group alone are left out, but if it has several classes numbers stand for them."""
        groups = self.classes.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
        tokens = self.entries.groupBy("g").agg(F.collect_list("token").alias("tokens"))
        groups = groups.join(tokens, "g", "left").filter("k > 1 OR tokens IS NOT NULL").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<long>")))
        length, own = f"n - ({self.percent} * cast(n AS long) + 99) DIV 100 + 1", "size(tokens)"
        alone = f"IF(k > 1 AND {length} > {own}, transform(sequence({own} + 1L, {length}), i -> xxhash64(g, i)), cast(array() AS array<bigint>))"
        return groups.select("g", F.concat("tokens", F.expr(alone)).alias("shared"))

    def _moved(self) -> tuple[np.ndarray, np.ndarray]:
        """The most repeated shingles, sorted, and their counts; at most MOVED of them, 16 bytes each."""
        counts = self.texts.select("text").mapInArrow(_repeats(self.width), "token long, n long")
        counts = materialize(counts.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= REPEATS), "jaccard-counts")
        level = F.floor(F.log2("n") * 8).cast("int")
        levels = sorted(((r.level, r.tokens) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("tokens")).collect()), reverse=True)
        least, total = 1 << 30, 0
        for at, tokens in levels:
            if (total := total + tokens) > MOVED:
                break
            least = at
        frame = counts.filter(level >= least).toPandas()
        tokens, n = frame["token"].to_numpy(np.int64).view(np.uint64), frame["n"].to_numpy(np.int64)
        order = np.argsort(tokens)
        discard(counts)
        return tokens[order], n[order]

    def _expanded(self, pairs: DataFrame) -> DataFrame:
        """Pairs of groups g, h as pairs of their classes."""
        members = self.classes.select("g", F.col("cls").alias("a"))
        others = self.classes.select(F.col("g").alias("h"), F.col("cls").alias("b"))
        return pairs.join(members, "g").join(others, "h").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def _members(self, least: int, *more: Column) -> DataFrame:
        """key, cls, n, pos: entries of the buckets of more than `least` groups, and of groups with several classes as buckets of their own.

        more: further columns of the entries, null in those buckets."""
        names = ["key", "cls", "n", "pos", *(f"more{i}" for i in range(len(more)))]
        classes = self.classes.select("g", "cls", "n")
        tokens = self.entries.filter(F.col("groups") > least).select(F.struct(F.lit(0), "token").alias("key"), "g", "pos", *(c.alias(x) for c, x in zip(more, names[4:])))
        own = self.classes.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        groups = own.select(F.struct(F.lit(1), F.col("g").alias("token")).alias("key"), "g", F.lit(0).alias("pos"))
        return tokens.join(classes, "g").select(names).unionByName(groups.join(classes, "g").select(names[:4]), allowMissingColumns=True)

    def _small(self) -> DataFrame:
        """a, b: pairs of classes from small buckets."""
        small = self.entries.filter(F.col("groups") <= self.bucket)
        x = small.select("token", "g", "n", "pos")
        y = small.select("token", F.col("g").alias("h"), F.col("n").alias("m"), F.col("pos").alias("at"))
        fits = _can_reach(self.percent, F.col("n"), F.col("m"), F.col("pos"), F.col("at"))
        met = x.join(y, (x["token"] == y["token"]) & (F.col("g") < F.col("h")) & fits).select("g", "h").distinct()
        return self._expanded(met)

    def _all(self) -> DataFrame:
        """a, b: every pair of classes that a bucket, small or large, lets through.

        A large bucket is dealt into parts of about BLOCK entries, and each two parts meet in a block of their own."""
        large = self._members(self.bucket)
        parts = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        large = materialize(large.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")), "jaccard-large")
        x = large.withColumn("other", F.explode(F.expr("sequence(part, parts - 1)")))
        x = x.select("key", F.col("part").alias("i"), F.col("other").alias("j"), "cls", "n", "pos")
        y = large.withColumn("other", F.explode(F.expr("sequence(0, part)")))
        y = y.select("key", F.col("other").alias("i"), F.col("part").alias("j"), F.col("cls").alias("its"), F.col("n").alias("m"), F.col("pos").alias("at"))
        once = (F.col("i") < F.col("j")) | (F.col("cls") < F.col("its"))
        fits = _can_reach(self.percent, F.col("n"), F.col("m"), F.col("pos"), F.col("at"))
        met = x.join(y, ["key", "i", "j"]).filter(once & fits)
        return self._small().unionByName(met.select(F.least("cls", "its").alias("a"), F.greatest("cls", "its").alias("b"))).distinct()

    def _split(self, labels: DataFrame, last: DataFrame | None = None) -> DataFrame:
        """key, cls, n, pos, before, root, most (the bucket's largest component), entries: the buckets of several components.

        before: the group's bucket before this one, in the order of places. last: what it was with fewer links, which has all of these buckets."""
        roots = labels.select(F.col("node").alias("cls"), "root")
        if last is None:
            last = self._members(1, F.lag("token").over(W.partitionBy("g").orderBy("pos"))).withColumnRenamed("more0", "before")
        large = last.select("key", "cls", "n", "pos", "before").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        shares = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
        largest = shares.groupBy("key").agg(
            F.max(F.struct("k", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("k").alias("entries")
        )
        return materialize(large.join(largest.filter("roots > 1"), "key"), "jaccard-split")

    def _met(self, few: DataFrame, split: DataFrame, block: int, everywhere: bool = False) -> DataFrame:
        """a, b: few (key, part, cls, n, pos, root) with the members of other components in their part of the bucket, of about `block` entries.

        everywhere: few are in all of their buckets. Then two that come from one bucket have met there, where the bounds let through
        whatever they do here, and don't meet again: else near copies would in each of their many common buckets."""
        all_ = split.select(
            F.col("key").alias("key2"),
            F.pmod(F.xxhash64("cls"), F.ceil(F.col("entries") / block).cast("int")).cast("int").alias("part2"),
            F.col("cls").alias("other"),
            F.col("n").alias("m"),
            F.col("pos").alias("at"),
            F.col("root").alias("root2"),
            F.col("before").alias("before2"),
        )
        fits = _can_reach(self.percent, F.col("n"), F.col("m"), F.col("pos"), F.col("at"))
        if everywhere:
            fits &= F.coalesce(F.col("before") != F.col("before2"), F.lit(True))
        met = few.join(all_, (few["key"] == all_["key2"]) & (few["part"] == all_["part2"]) & (F.col("root") != F.col("root2")) & fits)
        return met.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()

    def _tries(self, split: DataFrame) -> DataFrame:
        """a, b: for each class outside its buckets' largest components a few others of buckets that are too large to meet it whole.

        What links is found by few of a large component's members, and then needs no pair with the others."""
        large = split.filter(F.col("entries") > TRIED)
        # the earlier the place, the more partners the bounds let through; a class has as many entries as its prefix
        entry = F.struct("pos", F.xxhash64("key", "cls").alias("h"), "key", "n", "root", "entries")
        outside = large.filter("root <> most").groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, TRIES).alias("all"))
        outside = outside.select("cls", F.explode("all").alias("x"))
        part = F.pmod(F.col("x.h"), F.ceil(F.col("x.entries") / TRIED).cast("int")).cast("int")
        return self._met(outside.select("x.key", part.alias("part"), "cls", "x.n", "x.pos", "x.root"), large, TRIED)

    def _rest(self, labels: DataFrame, split: DataFrame | None = None) -> DataFrame:
        """a, b: pairs of different components in a bucket, one side outside the bucket's largest component."""
        split = self._split(labels) if split is None else split
        parts = F.ceil(F.col("entries") / REST_BLOCK).cast("int")
        few = split.filter("root <> most").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "cls", "n", "pos", "before", "root")
        return self._met(few, split, REST_BLOCK, everywhere=True)

    def _sent(self, homes: DataFrame) -> DataFrame:
        """home, cls, n, shingles: the whole sets of homes' classes, at their homes, from cls, home."""
        chunks = homes.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / HOMES).alias("chunks"))
        homes = homes.join(chunks, "cls").groupBy("cls", F.pmod(F.xxhash64("home"), F.col("chunks")).alias("chunk"))
        homes = homes.agg(F.collect_list("home").alias("homes"))
        wanted = materialize(self.classes.join(homes, "cls").select("cls", "chunk", "sid", "homes", "its_id"), "jaccard-wanted")
        self.wanted.append(wanted)
        kind = wanted.schema["homes"].dataType.simpleString()
        if wanted.agg(F.coalesce(F.sum(F.size("homes")), F.lit(0))).first()[0] <= FETCH_BROADCAST:
            wanted = F.broadcast(wanted)
        texts = self.texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("its_id"))).select("cls", "chunk", "sid", "homes", "text")
        sets = texts.mapInArrow(_sets(self.width), f"homes {kind}, cls long, n int, shingles binary")
        return sets.select(F.explode("homes").alias("home"), "cls", "n", "shingles")

    def _prefixes_sent(self, homes: DataFrame) -> DataFrame:
        """The same with what prefixes can share, which is at hand, in the place of sets."""
        placed = homes.groupBy("cls").agg(F.collect_list("home").alias("homes"))
        kind = placed.schema["homes"].dataType.simpleString()
        rows = self.classes.join(placed, "cls").join(self.shared, "g").select("homes", "cls", "n", "shared")
        sets = rows.mapInArrow(_prefix_sets, f"homes {kind}, cls long, n int, shingles binary")
        return sets.select(F.explode("homes").alias("home"), "cls", "n", "shingles")

    def verified(self, pairs: DataFrame, whole: bool = True) -> DataFrame:
        """Those of the pairs of classes whose whole sets are similar enough; with whole=False those whose prefixes allow it.

        A set goes to the pairs' first classes, cut into parts of about PARTNERS
        partners, and there once, whatever the number of pairs."""
        pairs = materialize(pairs, "jaccard-pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
        placed = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
        home = F.struct("a", "part", F.lit(False).alias("partner"))
        own = placed.select(F.col("a").alias("cls"), home.alias("home")).distinct()
        partners = placed.select(F.col("b").alias("cls"), F.struct("a", "part", F.lit(True).alias("partner")).alias("home"))
        homes = own.unionByName(partners)
        sent = (self._sent(homes) if whole else self._prefixes_sent(homes)).select("home.*", "cls", "n", "shingles")
        checked = (
            sent.repartition("a", "part")
            .sortWithinPartitions("a", "part", "partner")
            .mapInArrow(_verifier(self.percent, whole), "a long, b long")
            .distinct()
        )
        return self._checked(checked, pairs)

    def _checked(self, links: DataFrame, *used: DataFrame) -> DataFrame:
        """links, written; what they came from is dropped."""
        links = materialize(links, "jaccard-links")
        discard(*used, *self.wanted)
        self.wanted = []
        forget(self.spark)
        return links

    def chosen(self) -> DataFrame:
        """a, b: links between classes that choose the same bucket, and there fall into the same block."""
        members = self._members(1).select("key", "cls", "n")
        least = [F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), "key", "n")).alias(f"x{k}") for k in range(CHOICES)]
        choices = F.array_distinct(F.array(*[F.struct(f"x{k}.key", f"x{k}.n") for k in range(CHOICES)]))
        choices = members.groupBy("cls").agg(*least).select("cls", F.explode(choices).alias("x")).select("cls", "x.key", "x.n")
        choices = materialize(choices, "jaccard-choices")
        parts = F.ceil(F.greatest(F.count(F.lit(1)) / CLASSES, F.sum("n") / SHINGLES)).alias("parts")
        sizes = choices.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), parts).filter("classes > 1")
        home = F.struct(F.xxhash64("key").alias("a"), F.pmod(F.xxhash64("cls", "key"), F.col("parts")).alias("part"))
        sent = self._prefixes_sent(choices.join(sizes, "key").select("cls", home.alias("home")))

        def in_blocks(sent: DataFrame) -> DataFrame:
            return sent.select("home.*", "cls", "n", "shingles").repartition("a", "part").sortWithinPartitions("a", "part")

        likely = self._checked(in_blocks(sent).mapInArrow(_block_likely(self.percent), "a long, part long, cls long"), choices)
        rounds, links = ROUNDS if likely.count() > BROADCAST_ROWS else 1, []
        for nth in range(rounds):
            own = likely.filter(F.pmod(F.xxhash64("a", "part"), F.lit(rounds)) == nth)
            sent = self._sent(own.select("cls", F.struct("a", "part").alias("home")))
            links.append(self._checked(in_blocks(sent).mapInArrow(_block_links(self.percent), "a long, b long")))
        return self._checked(reduce(DataFrame.unionByName, links).distinct(), likely, *links)

    def links(self) -> DataFrame:
        """a, b: all pairs of classes that are similar enough, whatever the size of their buckets."""
        return self.verified(self._all())

    def link_counts(self) -> DataFrame:
        """doc_id, n_shingles, class_id (the least id with its set; an empty set is its own), n_links (classes it links with) of every document."""
        links = self.links()
        ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls")))
        counts = ends.groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
        least = self.rows.select("sid", "n", "doc_id").filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
        own = self.classes.select("sid", "cls").join(least, "sid").join(counts, "cls", "left").select("sid", "least", "n_links")
        return self.rows.join(own, "sid", "left").select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )

    def _near(self, pairs: DataFrame) -> DataFrame | None:
        """The links among pairs, checked on prefixes first; null where there are none."""
        pairs = materialize(pairs, "jaccard-rest")
        near = None if pairs.isEmpty() else self.verified(pairs, whole=False)
        discard(pairs)
        links = None if near is None or near.isEmpty() else self.verified(near)
        return None if links is None or links.isEmpty() else links

    def _connected(self) -> tuple[DataFrame, DataFrame]:
        """a, b: verified pairs of classes, enough of them to connect every component; and node, root of what they connect."""
        links = self.chosen()
        labels = materialize(connected_components(links), "jaccard-labels")
        split = self._split(labels)
        if (found := self._near(self._tries(split))) is not None:
            links, labels = links.unionByName(found), materialize(relabelled(labels, found), "jaccard-labels")
            last, split = split, self._split(labels, split)
            discard(last)
        if (found := self._near(self._rest(labels, split))) is not None:
            links, labels = links.unionByName(found), materialize(relabelled(labels, found), "jaccard-labels")
        discard(split)
        return links, labels

    def connecting(self) -> DataFrame:
        """a, b: verified pairs of classes, enough of them to connect every component."""
        return self._connected()[0]

    def _rooted(self) -> DataFrame:
        """row, doc_id, n, text_hash, root (a number of its component), cls of every document."""
        _, labels = self._connected()
        roots = self.classes.join(labels, F.col("cls") == F.col("node"), "left").select("sid", "cls", F.coalesce("root", "cls").alias("root"))
        return self.rows.join(roots, "sid", "left").select(
            "row", "doc_id", "n", "text_hash", F.coalesce("root", "row").alias("root"), F.coalesce("cls", "row").alias("cls")
        )

    def stay(self) -> DataFrame:
        """doc_id, text_hash, several: the document of each component that has the least id, null last; several: all of its kind stay, having no words."""
        rooted = self._rooted()
        least = rooted.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash", "n")).alias("x"))
        return least.select("x.doc_id", "x.text_hash", (F.col("x.n") == 0).alias("several")).distinct()

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id (the least id that links reach), class_id of every document."""
        named = self._rooted()
        least = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return named.join(least, "root", "left").select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.col("cls").alias("class_id"),
        )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, that with the least id, null last, with all its columns; rows without words all stay.

    Of rows that share this id and the text any one stays."""
    its_id, its_hash, hashed, several, nth = (fresh(docs, x) for x in ("kept_id", "kept_hash", "text_hash", "several", "nth"))
    stay = JaccardJoin(docs, id_col, text_col, **how).stay().toDF(its_id, its_hash, several)
    same = F.col(id_col).eqNullSafe(F.col(its_id)) & (F.col(hashed) == F.col(its_hash))
    found = docs.withColumn(hashed, F.xxhash64(text_col)).join(stay, same)
    equal = W.partitionBy(hashed, id_col).orderBy(F.lit(1))
    found = found.withColumn(nth, F.row_number().over(equal)).filter((F.col(nth) == 1) | F.col(several))
    return found.select(*docs.columns)
