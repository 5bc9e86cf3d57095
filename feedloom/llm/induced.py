"""Sorting suffixes by induction, block by block, with queues that go to disk.

Suffixes that start a rise are sorted first: the pieces between them get names in
their order, and the string of names is sorted in the same way, until it fits in
memory, where doubling sorts it. They induce the order of all others in two passes:
whenever a suffix leaves the queue, the one that starts a symbol earlier enters it.
A queue holds tuples (suffix, common prefix with the one before it) and hands out the
least symbol first, in the second pass the largest. How many suffixes a symbol has is
known beforehand, so a queue is one array with a row for each symbol, filled from its
start; arrays beyond the memory that a sort may use are files without a name that
end with the task. The common prefix of two induced suffixes is one more than the
least on the way between the two that induced them.

Blocks of suffixes, of one symbol or of neighbouring symbols that don't feed each
other, go through both passes as arrays. Suffixes are told apart by their first `cap`
symbols; the order of those that agree in so many is left open.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Suffixes of a block; names that are sorted in memory; bytes of arrays that a sort holds in memory.
BLOCK, NAMES, MEMORY = 1 << 18, 1 << 22, 96 << 20
#: Symbols that are compared at once; a string has so many zeros after its end.
STEP = 8


class Scratch:
    """Arrays of zeros, in memory until `left` bytes are given out, then in scratch files."""

    def __init__(self, left: int = MEMORY):
        self.left = left

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.left:
            self.left -= size
            return np.zeros(n, dtype)
        with tempfile.TemporaryFile() as file:
            file.truncate(size)
            return np.asarray(np.memmap(file, dtype, "r+", shape=(n,)))


def _small(cap: int) -> type:
    return np.uint8 if cap < 255 else np.int32


def blocks(low: int, high: int) -> Iterator[tuple[int, int]]:
    for a in range(low, high, BLOCK):
        yield a, min(high, a + BLOCK)


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """How many symbols suffixes a and b have in common, `cap` at most, of which `known` have been compared."""
    out = np.minimum(known, cap).astype(np.int64)
    near = np.lib.stride_tricks.sliding_window_view(t, STEP)
    on = np.flatnonzero(out < cap)
    while len(on):
        same = near[a[on] + out[on]] == near[b[on] + out[on]]
        whole = same.all(axis=1)
        out[on] += np.where(whole, STEP, same.argmin(axis=1))
        on = on[whole]
        on = on[out[on] < cap]
    return np.minimum(out, cap)


def _refined(rank: np.ndarray, on: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Tells items `on` of equal rank apart by key, of so many bits, in place; returns those still tied.

    A rank is the number of lesser items."""
    both = rank[on] << bits | key
    order = np.argsort(both)
    both = both[order]
    at = np.arange(len(both))
    new = np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]
    old = both >> bits
    first_old = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]])[: len(old)], at, 0))
    first_new = np.maximum.accumulate(np.where(new, at, 0))
    rank[on[order]] = old + first_new - first_old
    tied = ~(new & np.concatenate([new[1:], [True]]))
    return on[order[tied]]


def _ranked_pieces(t: np.ndarray, low: np.ndarray, high: np.ndarray, top: int, cap: int) -> np.ndarray:
    """Ranks of the pieces t[low..high]; where one begins another, the shorter is the greater."""
    small = t.dtype == np.uint8
    bits, past = 8 if small else (top + 1).bit_length(), len(t) - 1
    rank, on, at = np.zeros(len(low), np.int64), np.arange(len(low)), 0
    near = np.lib.stride_tricks.sliding_window_view(t, STEP)
    while len(on) and at < cap:
        width = min(STEP, max(1, (63 - (len(low).bit_length() if at else 0)) // bits))
        left = high[on] + 1 - low[on] - at  # so many symbols are left, and then one above all others
        if small:
            x = near[np.minimum(low[on] + at, len(near) - 1)]
            places = np.arange(STEP)
            x = np.where(places < left[:, None], x, np.where(places == left[:, None], np.uint8(top + 1), np.uint8(0)))
            key = (x.view(">u8")[:, 0].astype(np.uint64) >> np.uint64(64 - 8 * width)).astype(np.int64)
        else:
            key = np.zeros(len(on), np.int64)
            for j in range(width):
                symbol = np.where(j < left, t[np.minimum(low[on] + at + j, past)], np.where(j == left, top + 1, 0))
                key = key << bits | symbol
        on = _refined(rank, on, key, bits * width)
        at += width
        on = on[low[on] + at <= high[on] + 1]
    return rank


def _name(t: np.ndarray, starts: np.ndarray, top: int, cap: int, names: np.ndarray) -> int:
    """Fills names with the dense ranks, from 1, of the pieces between starts; returns the largest.

    Pieces with the same first symbols come together, as many at once as fit in memory."""
    m, pairs = len(starts), top < 1 << 12

    def lead(a: int, b: int) -> np.ndarray:
        s = starts[a:b]
        return t[s].astype(np.int64) * (top + 1) + t[s + 1] if pairs else t[s]

    counts = np.zeros((top + 1) ** 2 if pairs else top + 1, np.int64)
    for a, b in blocks(0, m):
        counts += np.bincount(lead(a, b), minlength=len(counts))
    last, done, low = 0, 0, 0
    upto = np.cumsum(counts)
    while low < len(counts) and last < m:
        high = max(low + 1, int(np.searchsorted(upto, last + NAMES, side="right")))
        which = []
        for a, b in blocks(0, m):
            x = lead(a, b)
            which.append(a + np.flatnonzero((x >= low) & (x < high)))
        which = np.concatenate(which)
        s, e = starts[which], starts[np.minimum(which + 1, m - 1)]
        rank = _ranked_pieces(t, s, e, top, cap)
        dense = np.cumsum(np.bincount(rank, minlength=len(rank)) > 0)
        names[which] = done + dense[rank]
        done += int(dense[-1]) if len(dense) else 0
        last, low = int(upto[high - 1]), high
    return done


def _doubled(names: np.ndarray, most: int, cap: int) -> np.ndarray:
    """The order of the suffixes of names, by doubling, in memory; each name stands for two symbols at least."""
    m = len(names)
    counts = np.bincount(names, minlength=most + 1)
    rank = (np.cumsum(counts) - counts)[names]
    on, width, bits = np.flatnonzero(counts[names] > 1), 1, (m + 1).bit_length()
    while len(on) and 2 * width < cap:
        ahead = on + width
        key = np.where(ahead < m, rank[np.minimum(ahead, m - 1)] + 1, 0)
        on = _refined(rank, on, key, bits)
        width *= 2
    return np.argsort(rank, kind="stable")


def _kinds(t: np.ndarray, n: int, rising: np.ndarray) -> None:
    """Marks the suffixes that rise: those that are less than the next one."""
    rising[n - 1] = True
    for a, b in reversed(list(blocks(0, n - 1))):
        here, after = t[a:b], t[a + 1 : b + 1]
        at = np.where(here != after, np.arange(b - a), b - a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        rising[a:b] = np.append(here < after, rising[b])[at]


class _Queue:
    """Rows of (suffix, common prefix) by symbol. enter() takes what a block of suffixes induces."""

    def __init__(self, scratch: Scratch, sizes: np.ndarray, n: int, cap: int):
        self.cap, self.begin = cap, np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        self.suffix = scratch.array(total, np.int32 if n < 1 << 31 else np.int64)
        self.common = scratch.array(total, _small(cap))
        self.fill = self.begin.copy()
        self.least = np.zeros(len(sizes), self.common.dtype)

    def enter(self, t: np.ndarray, which: np.ndarray, suffix: np.ndarray, shared: np.ndarray) -> None:
        """Induces from suffixes that leave in this order, shared being what each has in common with the one before it.

        Suffixes `which` of the block are those whose predecessor belongs in this queue."""
        least = np.minimum.accumulate(shared)
        since, self.least = self.least, np.minimum(self.least, least[-1])
        if not len(which):
            return
        target = suffix[which] - 1
        symbol = t[target]
        order = np.argsort(symbol, kind="stable")
        which, target, symbol = which[order], target[order], symbol[order]
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        at = np.flatnonzero(first)
        counts = np.diff(np.append(at, len(symbol)))
        there = symbol[at]
        # between neighbours of one symbol: the least since the one before
        value = np.empty(len(which), np.int64)
        later = np.flatnonzero(~first)
        value[later] = _least(shared, which[later - 1] + 1, which[later])
        value[at] = np.where(self.fill[there] > self.begin[there], np.minimum(since[there], least[which[at]]).astype(np.int64), -1)
        slot = np.repeat(self.fill[there] - at, counts) + np.arange(len(symbol))
        self.suffix[slot] = target
        self.common[slot] = np.minimum(self.cap, value + 1)
        self.fill[there] += counts
        after = np.append(np.minimum.accumulate(shared[::-1])[::-1], shared.dtype.type(self.cap))
        self.least[there] = after[which[at + counts - 1] + 1]


def _least(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x[low..high] for each pair, from a table of the least of 1, 2, 4, ... neighbours."""
    if not len(low):
        return np.zeros(0, x.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = np.empty((int(level.max()) + 1, len(x)), x.dtype)
    table[0] = x
    for k in range(1, len(table)):
        half = 1 << (k - 1)
        table[k] = table[k - 1]
        np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, :-half])
    return np.minimum(table[level, low], table[level, high - (1 << level) + 1])


def _spans(sizes: np.ndarray, feeds: np.ndarray) -> list[tuple[int, int]]:
    """Symbols in spans [low, high) that can leave together: none takes from a symbol of its span, unless it is alone.

    feeds: the nearest symbol below from which a symbol takes, itself included."""
    out, low, held = [], 0, 0
    for c, (size, feed) in enumerate(zip(sizes.tolist(), feeds.tolist())):
        if c > low and (feed >= low or held + size > BLOCK):
            out.append((low, c))
            low, held = c, 0
        held += size
        if feed == c:
            out.append((c, c + 1))
            low, held = c + 1, 0
    if low < len(sizes):
        out.append((low, len(sizes)))
    return out


def _sorted_starts(t: np.ndarray, starts: np.ndarray, top: int, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of starts in order, and what each has in common with the one before it."""
    m = len(starts)
    names = scratch.array(m + STEP, np.int32 if m < 1 << 31 else np.int64)
    most = _name(t, starts, top, cap, names[:m])
    order, shared = scratch.array(m, starts.dtype), scratch.array(m, _small(cap))
    if m <= NAMES:
        order[:] = starts[_doubled(names[:m], most, cap)]
    else:
        end = m
        after = None
        names[:m] -= 1  # the last one, of the end, is the least and the only one
        for suffix, equal in sorted_suffixes(names, m, most - 1, cap, Scratch(scratch.left)):
            places = starts[suffix]
            order[end - len(suffix) : end] = places[::-1]
            # what a suffix shares with the next larger one stands with the larger
            larger = np.concatenate([[suffix[0] if after is None else after], suffix[:-1]])
            skip = starts[np.minimum(larger + equal, m - 1)] - starts[larger]
            at = end - np.arange(len(suffix))
            inside = at < m
            shared[at[inside]] = np.minimum(skip, cap)[inside]
            after = suffix[-1]
            end -= len(suffix)
    for a, b in blocks(1, m):
        shared[a:b] = common(t, order[a - 1 : b - 1], order[a:b], shared[a:b], cap)
    return order, shared


def sorted_suffixes(t: np.ndarray, n: int, top: int, cap: int, scratch: Scratch | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of suffixes, the largest first, and what each has in common with the one before it.

    t holds n symbols up to `top`, the last a 0 that is the only one, and STEP zeros more."""
    scratch = scratch or Scratch()
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    rising = scratch.array(n, bool)
    _kinds(t, n, rising)
    falls, climbs, seeds = (np.zeros(top + 1, np.int64) for _ in range(3))
    below, above = np.full(top + 1, -1, np.int64), np.full(top + 1, top + 1, np.int64)
    pairs = np.zeros((2, (top + 1) ** 2), np.int64) if top < 1 << 8 else None
    m = 0
    for a, b in blocks(0, n):
        up, x, after = rising[a:b], t[a:b], t[a + 1 : b + 1]
        falls += np.bincount(x[~up], minlength=top + 1)
        climbs += np.bincount(x[up], minlength=top + 1)
        if pairs is not None:
            codes = x.astype(np.int64) * (top + 1) + after
            pairs[0] += np.bincount(codes[~up], minlength=len(pairs[0]))
            pairs[1] += np.bincount(codes[up], minlength=len(pairs[1]))
        else:
            np.maximum.at(below, x[~up], after[~up])
            np.minimum.at(above, x[up], after[up])
        m += np.count_nonzero(up[1:] & ~up[:-1]) + int(a > 0 and rising[a] and not rising[a - 1])
    if pairs is not None:
        for symbol, after in zip(*np.nonzero(pairs[0].reshape(top + 1, -1))):
            below[symbol] = after
        for symbol, after in zip(*(c[::-1] for c in np.nonzero(pairs[1].reshape(top + 1, -1)))):
            above[symbol] = after
    above[0] = top + 1  # of the end, nothing comes after
    starts, m = scratch.array(m, np.int32 if n < 1 << 31 else np.int64), 0
    for a, b in blocks(1, n):
        found = a + np.flatnonzero(rising[a:b] & ~rising[a - 1 : b - 1])
        starts[m : m + len(found)] = found
        m += len(found)
    order, shared = _sorted_starts(t, starts, top, cap, scratch)
    for a, b in blocks(0, m):
        seeds += np.bincount(t[order[a:b]], minlength=top + 1)

    first = _Queue(scratch, falls + seeds, n, cap)
    ends = first.begin + falls
    for a, b in blocks(0, m):
        symbol = t[order[a:b]]
        slot = np.arange(a, b) - (np.cumsum(seeds) - seeds)[symbol] + ends[symbol]
        first.suffix[slot], first.common[slot] = order[a:b], shared[a:b]
    del order, shared
    rows = falls + seeds

    def leave_up(a: int, b: int) -> None:
        for a, b in blocks(a, b):
            s = first.suffix[a:b].astype(np.int64)
            before = np.maximum(s - 1, 0)
            first.enter(t, np.flatnonzero((s > 0) & ~rising[before]), s, first.common[a:b].copy())

    def join_seeds(low: int, high: int) -> None:
        """Compares the first seed of each symbol with the induced suffix before it."""
        with_seeds = low + np.flatnonzero(seeds[low:high] > 0)
        both = with_seeds[falls[with_seeds] > 0]
        first.common[ends[with_seeds]] = 0
        a, b = first.suffix[ends[both] - 1].astype(np.int64), first.suffix[ends[both]].astype(np.int64)
        first.common[ends[both]] = common(t, a, b, np.zeros(len(both), np.int64), cap)

    for low, high in _spans(rows, below):
        if high == low + 1:
            at = int(first.begin[low])
            while at < first.fill[low]:
                upto = int(first.fill[low])
                leave_up(at, upto)
                at = upto
            join_seeds(low, high)
            leave_up(at, int(first.begin[low] + rows[low]))
        else:
            join_seeds(low, high)
            leave_up(int(first.begin[low]), int(first.begin[high - 1] + rows[high - 1]))

    second = _Queue(scratch, climbs, n, cap)
    second.suffix[0] = n - 1
    second.fill[0] = 1

    def leave_down(s: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = np.maximum(s - 1, 0)
        second.enter(t, np.flatnonzero((s > 0) & rising[before]), s, shared)
        return s, shared

    def fallen(c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The row of c in the first queue, backwards."""
        low, high = int(first.begin[c]), int(ends[c])
        for a, b in blocks(0, high - low):
            s = first.suffix[high - b : high - a][::-1].astype(np.int64)
            shared = first.common[high - b + 1 : high - a + 1][::-1].copy() if a else np.append(0, first.common[high - b + 1 : high][::-1])
            if not a and climbs[c]:
                last = second.suffix[second.begin[c] + climbs[c] - 1 :][:1].astype(np.int64)
                shared[:1] = common(t, last, s[:1], np.zeros(1, np.int64), cap)
            yield s, shared.astype(first.common.dtype)

    feeds = top - above[::-1]
    for a, b in _spans((climbs + falls)[::-1], feeds):
        low, high = top + 1 - b, top + 1 - a
        if high == low + 1:
            at = int(second.begin[low])
            while at < second.fill[low]:
                upto = int(second.fill[low])
                for x, y in blocks(at, upto):
                    yield leave_down(second.suffix[x:y].astype(np.int64), second.common[x:y].copy())
                at = upto
            for s, shared in fallen(low):
                yield leave_down(s, shared)
        else:
            parts = []
            for c in range(high - 1, low - 1, -1):
                if climbs[c]:
                    x, y = int(second.begin[c]), int(second.begin[c] + climbs[c])
                    parts.append((second.suffix[x:y].astype(np.int64), second.common[x:y]))
                if falls[c]:
                    parts.extend(fallen(c))
            if parts:
                yield leave_down(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
