"""A suffix array with common-prefix values by external, recursive induced sorting.

A suffix is S-type if it is less than the one after it, else L-type; S-type ones after an L-type one
are turns. Turns are named by the order of the substrings between them, the string of names is
sorted by the same procedure, and from the turns all others are induced: in a first pass the L-type
suffixes in ascending order, in a second the S-type ones in descending order. Both passes draw on a
priority queue of (symbol, suffix, common prefix) tuples, first in first out among equal symbols.
Common prefixes come along: two suffixes induced from two others share one symbol more than the
least common prefix between these.

Arrays as long as the text and the queue's sorted runs lie in memory up to a bound, and beyond it in
a scratch file; what is worked on at a time is a block of bounded length. So a shard may be far
larger than memory. The scratch file lies where Spark spills (`SPARK_LOCAL_DIRS`), has no name and
ends with its task, which a retry repeats as a whole.

Values are exact up to `cap`; suffixes alike in their first `cap` symbols may lie in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Symbols, or tuples, that are worked on at a time; runs of a queue that are merged into one.
BLOCK, RUNS = 1 << 16, 8
#: Names beyond which a string of them is sorted by recursion; a shorter one is sorted in memory.
SHORT = 1 << 18
#: Bytes that a sort keeps in memory before it moves arrays and runs to disk.
MEMORY = 16 << 20


class Shelf:
    """Arrays in memory up to a bound, and in a scratch file of this task alone beyond it."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.file, self.end = memory, 0, None, 0

    def _mapped(self, n: int, dtype) -> np.ndarray:
        if self.file is None:
            at = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self.file = tempfile.TemporaryFile(dir=at if os.path.isdir(at) else None)
        out = np.memmap(self.file, dtype, "r+", self.end, (n,))
        self.end += -(-out.nbytes // 4096) * 4096
        return out

    def array(self, n: int, dtype) -> np.ndarray:
        """A new array of zeros."""
        size = n * np.dtype(dtype).itemsize
        if not n or self.held + size <= self.memory:
            self.held += size
            return np.zeros(n, dtype)
        return self._mapped(n, dtype)

    def keep(self, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same arrays, or copies of them on disk."""
        out = []
        for a in arrays:
            if not isinstance(a, np.memmap) and len(a) and self.held + a.nbytes > self.memory:
                b = self._mapped(len(a), a.dtype)
                b[:] = a
                out.append(b)
            else:
                self.held += 0 if isinstance(a, np.memmap) else a.nbytes
                out.append(a)
        return tuple(out)

    def drop(self, *arrays: np.ndarray) -> None:
        """Gives back the memory that arrays of `array` or `keep` had; disk is kept to the end."""
        self.held -= sum(a.nbytes for a in arrays if not isinstance(a, np.memmap))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Queue:
    """A priority queue of (key, suffix, common prefix): least keys first, and first in, first out
    among equal keys. Pushes become sorted runs; so many runs of one rank are merged into one of
    the next, so that few are ever open, and runs that outgrow the shelf's memory lie on disk."""

    def __init__(self, shelf: Shelf):
        self.shelf = shelf
        self.ranks: list[list[tuple[np.ndarray, ...]]] = []  # runs by rank, older ones first

    def push(self, key: np.ndarray, at: np.ndarray, lcp: np.ndarray, rank: int = 0) -> None:
        """Tuples in ascending order of key; those of one key in the order that they shall leave."""
        if not len(key):
            return
        while len(self.ranks) <= rank:
            self.ranks.append([])
        own = self.ranks[rank]
        own.append(self.shelf.keep(key, at, lcp))
        if len(own) >= RUNS:
            self.ranks[rank] = []
            columns = [np.concatenate(c) for c in zip(*own)]
            for run in own:
                self.shelf.drop(*run)
            order = np.argsort(columns[0], kind="stable")
            self.push(*(c[order] for c in columns), rank=rank + 1)

    def pull(self, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes all tuples whose key is less than `below`."""
        parts = []
        for runs in reversed(self.ranks):
            for i, run in enumerate(runs):
                n = int(np.searchsorted(run[0], below))
                if n:
                    parts.append([np.array(c[:n]) for c in run])
                    self.shelf.drop(*(c[:n] for c in run))
                    runs[i] = tuple(c[n:] for c in run)
            runs[:] = [run for run in runs if len(run[0])]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16)
        if len(parts) == 1:
            return tuple(parts[0])
        return in_order(*(np.concatenate(c) for c in zip(*parts)))


def in_order(key: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    return key[order], *(x[order] for x in others)


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi + 1]) of each range, by tables of doubling width."""
    out = np.empty(len(lo), values.dtype)
    span = hi - lo + 1
    width, longest, table = 1, int(span.max(initial=1)), values
    while True:
        now = (span >= width) & (span < 2 * width)
        if now.any():
            out[now] = np.minimum(table[lo[now]], table[hi[now] - width + 1])
        if 2 * width > longest:
            return out
        table = np.minimum(table[:-width], table[width:])
        width *= 2


class _Text:
    """A string that ends in a 0 that is nowhere else, the type of each suffix and the turns."""

    def __init__(self, symbols: np.ndarray, sigma: int, cap: int, shelf: Shelf):
        self.symbols, self.sigma, self.cap, self.shelf = symbols, sigma, cap, shelf
        n = len(symbols)
        self.rising = shelf.array(n, np.bool_)  # S-type
        self.rising[n - 1] = after = True
        for hi in range(n - 1, 0, -BLOCK):
            lo = max(0, hi - BLOCK)
            part = symbols[lo : hi + 1].astype(np.int64)
            step = np.diff(part)
            where = np.where(step != 0, np.arange(len(step)), len(step))
            next_step = np.minimum.accumulate(where[::-1])[::-1]  # where the symbol changes next
            up = np.append(step > 0, after)[next_step]
            self.rising[lo:hi] = up
            after = bool(up[0])
        turns = []
        for lo in range(1, n, BLOCK):
            own = self.rising[lo - 1 : min(n, lo + BLOCK)]
            turns.append((np.nonzero(own[1:] & ~own[:-1])[0] + lo).astype(np.int32))
        turns = np.concatenate(turns) if turns else np.zeros(0, np.int32)
        if not len(turns) or turns[-1] != n - 1:
            turns = np.append(turns, np.int32(n - 1))
        (self.turns,) = shelf.keep(turns)

    def run(self, at: np.ndarray) -> np.ndarray:
        """How often the symbol at each place follows on itself there, up to the cap."""
        out, live, first = np.ones(len(at), np.int64), np.arange(len(at)), self.symbols[at]
        while len(live):
            live = live[self.symbols[np.minimum(at[live] + out[live], len(self.symbols) - 1)] == first[live]]
            out[live] += 1
            live = live[out[live] < self.cap]
        return np.minimum(out, self.cap)


def _names(text: _Text) -> tuple[np.ndarray, int]:
    """A number for each turn, in the order of the substrings from each to the next, equal ones
    alike; and how many numbers there are. Turns are sorted in groups by their first symbols."""
    symbols, turns, m, n = text.symbols, text.turns, len(text.turns), len(text.symbols)
    bits = (2 * text.sigma + 1).bit_length()
    per = 62 // bits
    names = text.shelf.array(m, np.int32)
    first = np.empty(m, symbols.dtype)
    for lo in range(0, m, BLOCK):
        first[lo : lo + BLOCK] = symbols[turns[lo : lo + BLOCK]]
    (by_first,) = text.shelf.keep(np.argsort(first, kind="stable").astype(np.int32))
    steps = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=text.sigma))])
    del first
    lo = count = 0
    while lo < m:
        # whole first symbols: at least one, and no more than a block's worth of turns beyond it
        hi = int(max(steps[np.searchsorted(steps, lo, side="right")], steps[np.searchsorted(steps, lo + BLOCK, side="right") - 1]))
        own = np.array(by_first[lo:hi])
        start = turns[own].astype(np.int64)
        size = np.minimum(np.where(own + 1 < m, turns[np.minimum(own + 1, m - 1)], n - 1) - start + 1, text.cap + 2)
        rank, ties, done = np.zeros(len(own), np.int64), np.arange(len(own)), 0
        while len(ties):
            word = np.zeros(len(ties), np.int64)
            for j in range(done, done + per):
                at = np.minimum(start[ties] + j, n - 1)
                word = word << bits | np.where(j < size[ties], symbols[at].astype(np.int64) * 2 + text.rising[at], 0)
            order = np.lexsort((word, rank[ties]))
            entry, was, now = ties[order], rank[ties][order], word[order]
            group = np.concatenate([[True], was[1:] != was[:-1]])
            piece = group | np.concatenate([[True], now[1:] != now[:-1]])
            place = np.arange(len(entry))
            rank[entry] = was + np.maximum.accumulate(np.where(piece, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
            done += per
            entry = entry[~(piece & np.append(piece[1:], True))]
            ties = entry[size[entry] > done]
        different, dense = np.unique(rank, return_inverse=True)
        names[own] = dense + count
        count += len(different)
        lo = hi
    return names, count


def _within_memory(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a short string of names in ascending order, and the common prefix of each with
    the one before, up to the cap: the recursion's base, by doubling what ranks tell apart."""
    m = len(names)

    def split(rank: np.ndarray, ties: np.ndarray, second: np.ndarray) -> np.ndarray:
        order = np.lexsort((second, rank[ties]))
        entry, was, now = ties[order], rank[ties][order], second[order]
        group = np.concatenate([[True], was[1:] != was[:-1]])
        piece = group | np.concatenate([[True], now[1:] != now[:-1]])
        place = np.arange(len(entry), dtype=np.int32)
        rank[entry] = was + np.maximum.accumulate(np.where(piece, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        return entry[~(piece & np.append(piece[1:], True))]

    rank, width = np.zeros(m, np.int32), 1
    ties = split(rank, np.arange(m, dtype=np.int32), names)
    ranks = [rank.copy()]
    while len(ties) and width < cap:
        ties = split(rank, ties, np.where(ties + width < m, ranks[-1][np.minimum(ties + width, m - 1)], -1))
        ranks.append(rank.copy())
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b, shared = order[:-1], order[1:], np.zeros(m - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + shared, b + shared
        fits = (x < m) & (y < m)
        shared[fits & (ranks[level][np.minimum(x, m - 1)] == ranks[level][np.minimum(y, m - 1)])] += 1 << level
    return order, np.append(0, np.minimum(shared, cap))


def _sorted_turns(text: _Text) -> tuple[np.ndarray, np.ndarray]:
    """Turns in ascending order of their suffixes, and the common prefix of each with the one
    before: by recursion on the string of their names, unless each has a name of its own."""
    symbols, turns, shelf, m, n = text.symbols, text.turns, text.shelf, len(text.turns), len(text.symbols)
    names, count = _names(text)
    order, alike = shelf.array(m, np.int32), shelf.array(m, np.int16)
    least = text.cap // 2 + 1  # a name covers two symbols at least
    if count == m:
        order[names] = np.arange(m, dtype=np.int32)
    elif m <= SHORT or least < 2:
        order[:], alike[:] = _within_memory(np.array(names), least)
    else:
        end = m
        for at, lcp in _descending(_Text(names, count, least, shelf)):
            order[end - len(at) : end] = at[::-1]
            alike[end - len(at) + 1 : end + 1] = lcp[::-1][: len(at) if end < m else len(at) - 1]
            end -= len(at)
    out, shared_out = shelf.array(m, np.int32), shelf.array(m, np.int16)
    for lo in range(0, m, BLOCK):
        b = order[lo : lo + BLOCK].astype(np.int64)
        a = np.append(order[max(0, lo - 1) : lo], b[:-1]).astype(np.int64) if lo else np.append(b[:1], b[:-1])
        x, y = turns[a].astype(np.int64), turns[b].astype(np.int64)
        shared = turns[np.minimum(a + alike[lo : lo + BLOCK], m - 1)] - x
        live = np.nonzero(shared < text.cap)[0]
        while len(live):
            p, q = x[live] + shared[live], y[live] + shared[live]
            same = (p < n) & (q < n)
            live = live[same & (symbols[np.minimum(p, n - 1)] == symbols[np.minimum(q, n - 1)])]
            shared[live] += 1
            live = live[shared[live] < text.cap]
        out[lo : lo + BLOCK] = y
        shared_out[lo : lo + BLOCK] = np.minimum(shared, text.cap)
    if m:
        shared_out[0] = 0
    shelf.drop(names, order, alike)
    return out, shared_out


def _unrolled(text: _Text, at: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes (with common prefixes) that begin with one symbol, and after them those that the
    symbol's repetition before them brings in, round by round, as many rounds as a block holds;
    and where a further round may follow."""
    reach = max(1, BLOCK // len(at))
    back = at[:, None].astype(np.int64) - 1 - np.arange(reach)
    other = (back < 0) | (text.symbols[np.maximum(back, 0)] != text.symbols[at[0]])
    times = np.where(other.any(1), other.argmax(1), reach)
    who = np.repeat(np.arange(len(at)), times + 1)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(times + 1) - times - 1, times + 1)
    order = np.argsort(nth, kind="stable")
    who, nth = who[order], nth[order]
    before = np.append(-1, who[:-1])
    new = np.append(True, nth[1:] != nth[:-1])
    least = _range_least(lcp.astype(np.int64), np.where(new, who, before + 1), who) + nth
    least[new] = text.run(at[:1])[0] + nth[new] - 1  # of a round with the one before: the shorter repetition
    least[0] = lcp[0]
    return (at[who] - nth).astype(np.int32), np.minimum(least, text.cap).astype(np.int16), nth == reach


def _induced(text: _Text, seeds: tuple, falling: bool, first: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(suffixes, common prefix of each with the one before, True for seeds) in order: seeds
    (suffixes in order, common prefixes, key ends) and, before the seeds of equal symbol, the
    suffixes induced from all that came earlier. With `falling` the order is descending and S-type
    suffixes are induced, else ascending and L-type ones. `first` enters the queue unasked."""
    symbols, wanted, cap, sigma = text.symbols, text.rising, text.cap, text.sigma
    top = sigma - 1
    own_type = falling

    def key_of(at: np.ndarray) -> np.ndarray:
        s = symbols[at].astype(np.int32)
        return top - s if falling else s

    queue = Queue(text.shelf)
    for at in first:
        where = np.array([at], np.int32)
        queue.push(key_of(where), where, np.zeros(1, np.int16))
    since = np.full(sigma, cap, np.int16)  # least common prefix since a key's last
    seed_at, seed_lcp, seed_key = seeds
    width = max(1, int(sigma / max(1.0, 2 * len(symbols) ** 0.5)))
    last_key, last_at, last_seed, taken = -1, -1, False, 0

    def preceding(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.nonzero((at > 0) & (wanted[at - 1] == own_type))[0]
        return ok, key_of(at[ok] - 1)

    for low in range(0, sigma, width):
        high = min(sigma, low + width)
        upto = int(np.searchsorted(seed_key, high))
        key, at, lcp = queue.pull(high)
        while len(key) or taken < upto:
            # all sources up to the first that one of them may still bring in; the queue's come before seeds of equal key
            end = min(upto, taken + BLOCK)
            s_at, s_lcp, s_key = np.array(seed_at[taken:end]), np.array(seed_lcp[taken:end]), np.array(seed_key[taken:end])
            q = min(len(key), BLOCK)
            k = np.concatenate([key[:q], s_key])
            order = np.argsort(2 * k + np.repeat([0, 1], [q, len(s_key)]), kind="stable")
            k, source = k[order], np.concatenate([at[:q], s_at])[order]
            seeded, own = order >= q, np.concatenate([lcp[:q], s_lcp])[order]
            stop = len(k)
            for whole, cut in ((q == len(key), key[q - 1] if q else -1), (end == upto, s_key[-1] if len(s_key) else -1)):
                if not whole:  # beyond the last known key of a side others of that side may follow
                    stop = min(stop, int(np.searchsorted(k, cut)))
            ok, to = preceding(source)
            inside = to < high
            if inside.any():
                stop = min(stop, int(np.searchsorted(k, to[inside].min())))
            gone = 0  # how many the queue loses, if not one for each of its sources
            if not stop:
                # one key alone: its queue first, then its seeds once nothing more can enter the queue
                head = int(k[0])
                stop = int(np.count_nonzero((k == head) & ~seeded)) or int(np.searchsorted(k, head, side="right"))
                ends = text.run(source[[0, stop - 1]])  # alike: all are of one round
                if not seeded[0] and (q == len(key) or key[q] != head) and ends[0] == ends[1]:
                    gone = stop
                    source, own, more = _unrolled(text, source[:gone], own[:gone])
                    stop = len(source)
                    k, seeded = np.full(stop, head, np.int32), np.zeros(stop, bool)
                    ok, to = preceding(source)
                    ok, to = ok[keep := (to != head) | more[ok]], to[keep]
            k, source, own, seeded = k[:stop], source[:stop], own[:stop], seeded[:stop]
            before_key, before_at, before_seed = np.append(last_key, k[:-1]), np.append(last_at, source[:-1]), np.append(last_seed, seeded[:-1])
            shown = np.where(before_key == k, own, 0).astype(np.int16)
            seam = np.nonzero((before_key == k) & seeded & ~before_seed)[0]
            if len(seam):
                shown[seam] = np.minimum(text.run(before_at[seam]), text.run(source[seam]))
            last_key, last_at, last_seed = int(k[-1]), int(source[-1]), bool(seeded[-1])
            yield source, shown, seeded
            # what they induce
            here = ok < stop
            ok, to = ok[here], to[here]
            whole = shown.min()
            if len(ok):
                by = np.argsort(to, kind="stable")
                of, to = ok[by], to[by]
                new = np.concatenate([[True], to[1:] != to[:-1]])
                least = _range_least(shown, np.where(new, 0, np.append(0, of[:-1] + 1)), of)
                starts = np.nonzero(new)[0]
                least[starts] = np.minimum(least[starts], since[to[starts]])
                np.minimum(since, whole, out=since)
                final = of[np.append(starts[1:], len(to)) - 1]
                tail = np.full(len(final), cap, np.int16)
                some = final + 1 < len(shown)
                if some.any():
                    tail[some] = _range_least(shown, final[some] + 1, np.full(int(some.sum()), len(shown) - 1))
                since[to[starts]] = tail
                new_at, new_lcp = (source[of] - 1).astype(np.int32), np.minimum(least.astype(np.int64) + 1, cap).astype(np.int16)
                if gone and head in to:  # its repetitions in between have not passed the queue
                    new_lcp[np.searchsorted(to, head)] = text.run(source[-1:])[0]
                far = int(np.searchsorted(to, high))
                queue.push(to[far:], new_at[far:], new_lcp[far:])
            else:
                np.minimum(since, whole, out=since)
                far = 0
            n_seeds = int(seeded.sum())
            taken += n_seeds
            gone = gone or stop - n_seeds
            key, at, lcp = key[gone:], at[gone:], lcp[gone:]
            if far:
                key, at, lcp = in_order(np.concatenate([key, to[:far]]), np.concatenate([at, new_at[:far]]), np.concatenate([lcp, new_lcp[:far]]))


def _descending(text: _Text) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    shelf, n = text.shelf, len(text.symbols)
    turns, lcps = _sorted_turns(text)
    keys = shelf.array(len(turns), np.int32)
    for lo in range(0, len(turns), BLOCK):
        keys[lo : lo + BLOCK] = text.symbols[turns[lo : lo + BLOCK]]
    falls = n - int(sum(np.count_nonzero(text.rising[lo : lo + BLOCK]) for lo in range(0, n, BLOCK)))
    down, down_lcp = shelf.array(falls, np.int32), shelf.array(falls, np.int16)
    end = falls  # from the back, so that they stand in descending order
    for at, lcp, seeded in _induced(text, (turns, lcps, keys), False, []):
        new = np.nonzero(~seeded)[0]
        down[end - len(new) : end] = at[new][::-1]
        down_lcp[end - len(new) : end] = lcp[new][::-1]
        end -= len(new)
    shelf.drop(turns, lcps, keys)
    # of each with the one before it in descending order: what the one before had in ascending order
    for hi in range(falls, 1, -BLOCK):
        lo = max(1, hi - BLOCK)
        down_lcp[lo:hi] = np.array(down_lcp[lo - 1 : hi - 1])
    keys = shelf.array(falls, np.int32)
    for lo in range(0, falls, BLOCK):
        keys[lo : lo + BLOCK] = text.sigma - 1 - text.symbols[down[lo : lo + BLOCK]].astype(np.int32)
    for at, lcp, _ in _induced(text, (down, down_lcp, keys), True, [n - 1]):
        yield at, lcp
    shelf.drop(down, down_lcp, keys)


def suffix_array(text: np.ndarray, cap: int, memory: int = MEMORY, shelf: Shelf | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the suffix array with common prefixes, in descending order of the suffixes: each
    yields suffixes (descending) and the common prefix of each with the one yielded before it.

    `text` holds non-negative symbols and ends in a 0 that is nowhere else. Up to `memory` bytes of
    what the sort keeps lie in memory; a shelf of the caller's is not closed here.
    """
    own = shelf or Shelf(memory)
    try:
        yield from _descending(_Text(text, int(text.max(initial=0)) + 1, cap, own))
    finally:
        if shelf is None:
            own.close()
