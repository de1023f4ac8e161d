"""Suffixes of a text in order, with their common prefixes, by recursive induction in external memory.

The text lies on disk. Each suffix is or isn't less than the one after it (it rises or falls); a valley is a rising suffix after a
falling one. From the valleys in order all falling suffixes follow upwards, and from these all rising ones downwards: whoever
is taken from the queue puts the suffix one place before it in. The queue is a priority queue by first symbol in which
equals keep their order; what is put in never comes before what is being taken out, so it needs no more than lists by ranges of
symbols, which are dealt to single symbols when the range is reached (a radix heap). Lists are runs of tuples: position, the four symbols
before it, and the common prefix with the suffix in front of it in the order. Runs beyond the memory limit lie on the task's disk.

A tuple's common prefix is one more than the least of the common prefixes that were taken since its symbol was last put in. The
valleys themselves are sorted in the same way: a first induction, from valleys in order of their first symbol only, puts the stretches
from valley to valley in order, and tells which are equal; equal stretches get equal names; the text of names, each written as
two digits, is sorted by recursion, and its common prefixes, in names, become those of the valleys. The recursion ends where all names differ, or
where a text fits in the memory given and is sorted there.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Common prefixes are told up to so many symbols.
CAP = 4096
#: Names up to so many are one digit.
ONE_DIGIT = 2048
ITEM = np.dtype([("pos", "<i8"), ("prev", "<u8"), ("sym", "<u2"), ("left", "<u2"), ("v", "<u2")])
_NAMED = np.dtype([("pos", "<i8"), ("name", "<i8")])
_RANKED = np.dtype([("pos", "<i8"), ("v", "<u2")])
_MASK = np.uint64(0xFFFF)


class Pool:
    """Runs of records, in memory up to limit bytes altogether; beyond it they go to a file of the task."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.spilled = limit, 0, 0
        self._file = None
        self._live: dict[int, list] = {}

    def put(self, x: np.ndarray) -> list:
        run = [x, 0, len(x), x.dtype]
        self._live[id(run)] = run
        self.held += x.nbytes
        if self.held > self.limit:
            self._spill()
        return run

    def _spill(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        self._file.seek(0, os.SEEK_END)
        for run in self._live.values():
            run[1] = self._file.tell()
            self._file.write(run[0].tobytes())
            run[0] = None
        self.spilled += self.held
        self.held = 0
        self._live.clear()

    def get(self, run: list) -> np.ndarray:
        x, at, n, kind = run
        if x is not None:
            del self._live[id(run)]
            self.held -= x.nbytes
            return x
        self._file.seek(at)
        return np.frombuffer(self._file.read(n * kind.itemsize), kind)

    def close(self) -> None:
        self._live.clear()
        if self._file is not None:
            self._file.close()


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The records of several arrays of one kind in one."""
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([np.ascontiguousarray(x).view(np.uint8) for x in parts]).view(parts[0].dtype)


class Queue:
    """Tuples by symbol; those of one symbol in the order in which they came. Symbols are taken upwards only, or downwards only.

    Symbols are in ranges. What comes for the range that is being taken out is dealt to its symbols when one is asked for;
    the rest is gathered, and dealt to ranges a block at a time.
    """

    def __init__(self, pool: Pool, sigma: int, block: int) -> None:
        self.pool, self.block, self.step = pool, block, max(16, math.isqrt(sigma))
        self.ranges: list[list] = [[] for _ in range(sigma // self.step + 1)]
        self.own: list[list] = [[] for _ in range(self.step)]
        self.near: list[np.ndarray] = []
        self.far: list[np.ndarray] = []
        self.n_far, self.open = 0, -1

    def push(self, x: np.ndarray) -> None:
        """x is in order of symbols."""
        low, high = np.searchsorted(x["sym"], (max(0, self.open * self.step), max(0, (self.open + 1) * self.step))).tolist()
        if high > low:
            self.near.append(x[low:high])
        for rest in (x[:low], x[high:]):
            if len(rest):
                self.far.append(rest)
                self.n_far += len(rest)
        if self.n_far > self.block:
            self._deal_far()

    def _cut(self, parts: list[np.ndarray], step: int, lists: list[list], first: int) -> None:
        x = _joined(parts)
        place = x["sym"].astype(np.int64) // step - first
        if len(parts) > 1:
            order = np.argsort(place.astype(np.uint16), kind="stable")
            x, place = x[order], place[order]
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        ends = [0, *cut.tolist(), len(x)]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            lists[place[a]].append(self.pool.put(x[a:b].copy() if len(ends) > 2 else x))

    def _deal_far(self) -> None:
        if self.far:
            far, self.far, self.n_far = self.far, [], 0
            self._cut(far, self.step, self.ranges, 0)

    def pop(self, c: int) -> np.ndarray | None:
        """The next tuples of symbol c, about a block of them; None if there are none now."""
        if c // self.step != self.open:
            self._deal_far()
            self.open = c // self.step
            runs, self.ranges[self.open] = self.ranges[self.open], []
            parts: list[np.ndarray] = []
            for i, run in enumerate(runs):
                parts.append(self.pool.get(run))
                if sum(map(len, parts)) > self.block or i == len(runs) - 1:
                    self._cut([*parts, parts[0][:0]], 1, self.own, self.open * self.step)
                    parts = []
        if self.near:
            near, self.near = self.near, []
            self._cut(near, 1, self.own, self.open * self.step)
        runs = self.own[c % self.step]
        if not runs:
            return None
        n = k = 0
        while k < len(runs) and n < self.block:
            n += runs[k][2]
            k += 1
        self.own[c % self.step] = runs[k:]
        return _joined([self.pool.get(r) for r in runs[:k]])


class Spread:
    """Records dealt by position into spans of the text, given back in order of position, a span at a time."""

    def __init__(self, pool: Pool, n: int, span: int) -> None:
        self.pool, self.span = pool, span
        self.runs: list[list] = [[] for _ in range(n // span + 1)]

    def put(self, x: np.ndarray, pos: np.ndarray) -> None:
        place = pos // self.span
        order = np.argsort(place, kind="stable")
        x, place = x[order], place[order]
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), place[1:] != place[:-1]))).tolist()
        for a, b in zip(cut, [*cut[1:], len(x)], strict=False):
            self.runs[place[a]].append(self.pool.put(x[a:b].copy()))

    def spans(self) -> Iterator[np.ndarray]:
        for i, runs in enumerate(self.runs):
            if runs:
                self.runs[i] = []
                yield _joined([self.pool.get(r) for r in runs])


class Skim:
    """Of items with values relative to the one before, those kept, with values relative to the one kept before."""

    def __init__(self) -> None:
        self.carry = 0

    def __call__(self, v: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(kept)
        if not len(at):
            if len(v):
                self.carry = min(self.carry, int(v.min()))
            return at, v[:0]
        least = np.minimum.reduceat(v[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
        least[0] = min(int(least[0]), self.carry)
        rest = v[at[-1] + 1 :]
        self.carry = int(rest.min()) if len(rest) else CAP
        return at, least


class Text:
    """A file of symbols of two bytes, all at least 1 but for the end symbol 0, which is the last."""

    def __init__(self, path: str) -> None:
        self.s = np.memmap(path, np.uint16, "r").view(np.ndarray)
        self.n = len(self.s) - 1

    def items(self, pos: np.ndarray, v: np.ndarray | int) -> np.ndarray:
        x = np.zeros(len(pos), ITEM)
        x["pos"], x["sym"], x["v"] = pos, self.s[pos], v
        self.refill(x)
        return x

    def refill(self, x: np.ndarray) -> None:
        """Gives the tuples that have none left the (up to) four symbols before them."""
        on = np.flatnonzero((x["left"] == 0) & (x["pos"] > 0))
        if len(on):
            pos = x["pos"][on]
            prev = np.zeros(len(on), np.uint64)
            for k in range(4):
                prev |= self.s[np.maximum(pos - 1 - k, 0)].astype(np.uint64) << np.uint64(16 * k)
            x["prev"][on], x["left"][on] = prev, np.minimum(pos, 4)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are equal, up to CAP; a and b differ."""
        out, on, width = np.zeros(len(a), np.int64), np.arange(len(a)), 8
        while len(on):
            steps = np.arange(width)
            differ = self.s[np.minimum((a[on] + out[on])[:, None] + steps, self.n)] != self.s[np.minimum((b[on] + out[on])[:, None] + steps, self.n)]
            some = differ.any(1)
            out[on] += np.where(some, differ.argmax(1), width)
            on = on[~some & (out[on] < CAP)]
        return np.minimum(out, CAP)

    def valleys(self, block: int) -> Iterator[np.ndarray]:
        """Positions of valleys, ascending within a block, blocks from the end of the text to its beginning."""
        rises_next, high = True, self.n
        while high > 0:
            low = max(0, high - block)
            s = self.s[low : high + 1].astype(np.int64)
            step = s[1:] - s[:-1]
            nearest = np.where(step != 0, np.arange(len(step)), len(step))
            nearest = np.minimum.accumulate(nearest[::-1])[::-1]
            rises = np.where(nearest < len(step), np.append(step > 0, rises_next)[nearest], rises_next)
            before = np.concatenate((self.s[max(low - 1, 0) : low].astype(np.int64) if low else s[:1], s[:-2]))
            yield low + np.flatnonzero(rises & (before > s[:-1]))
            rises_next, high = bool(rises[0]), low


def _least(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of v[low..high] for each pair, by a table of least values of stretches of 2^k."""
    k = np.frexp((high - low + 1).astype(float))[1] - 1
    table = np.empty((int(k.max()) + 1, len(v)), v.dtype)
    table[0] = v
    for i in range(1, len(table)):
        half = 1 << (i - 1)
        table[i] = table[i - 1]
        np.minimum(table[i - 1][: len(v) - half], table[i - 1][half:], out=table[i][: len(v) - half])
    return np.minimum(table[k, low], table[k, high - (1 << k) + 1])


class _Inducer:
    """Puts in what the tuples that are taken out induce, with its common prefix (or whether it equals the one before)."""

    def __init__(self, text: Text, queue: Queue, sigma: int, prefixes: bool) -> None:
        self.text, self.queue, self.prefixes = text, queue, prefixes
        self.since = np.full(sigma, -1, np.int64)  # the least value since each symbol was last put in; -1: it never was

    def take(self, x: np.ndarray, v: np.ndarray, chosen: np.ndarray) -> None:
        at = np.flatnonzero(chosen)
        if not len(at):
            np.minimum(self.since, int(v.min()), out=self.since)
            return
        sym = (x["prev"][at] & _MASK).astype(np.uint16)
        order = np.argsort(sym, kind="stable")
        sym, at = sym[order], at[order]
        new = np.concatenate(([True], sym[1:] != sym[:-1]))
        low = np.concatenate(([0], at[:-1] + 1))
        low[new] = 0
        value = _least(v, low, at).astype(np.int64)
        first = np.flatnonzero(new)
        value[first] = np.minimum(value[first], self.since[sym[first]])
        value = np.where(value < 0, 0, np.minimum(value + 1, CAP) if self.prefixes else value)
        np.minimum(self.since, int(v.min()), out=self.since)
        later = np.append(np.minimum.accumulate(v[::-1])[::-1], CAP)
        last = np.append(first[1:], len(at)) - 1
        self.since[sym[last]] = later[at[last] + 1]
        y = x[at]
        y["pos"] -= 1
        y["prev"] >>= np.uint64(16)
        y["left"] -= 1
        y["sym"], y["v"] = sym, value
        self.text.refill(y)
        self.queue.push(y)


def _induced(text: Text, sigma: int, seeds: Queue, pool: Pool, prefixes: bool, block: int) -> Iterator[tuple[np.ndarray, int, bool]]:
    """All suffixes downwards, from the valleys (seeds, the end among them): tuples, their first symbol, whether they rise.

    Without prefixes, values are 1 for equal stretches and 0 for others, and only rising suffixes are given.
    """

    def meeting(falling: int | None, rising: int | None) -> int:  # where the falling suffixes of a symbol meet the rising ones
        if falling is None or rising is None or not prefixes:
            return 0
        return int(text.common(np.array([falling]), np.array([rising]))[0])

    up = Queue(pool, sigma, block)
    inducer = _Inducer(text, up, sigma, prefixes)
    log: list[tuple[int, list]] = []
    skim = Skim()
    for c in range(sigma):
        last = None
        while (x := up.pop(c)) is not None:
            before = x["prev"] & _MASK
            inducer.take(x, x["v"], (x["pos"] > 0) & (before >= c))
            last = int(x["pos"][-1])
            if not prefixes:  # those that induce nothing downwards aren't asked for
                at, value = skim(x["v"], (x["pos"] > 0) & (before < c))
                x = x[at]
                x["v"] = value
            if len(x):
                log.append((c, pool.put(x)))
        first = True
        while (x := seeds.pop(c)) is not None:
            v = x["v"].copy()
            if first:
                v[0], first = meeting(last, int(x["pos"][0])), False
            inducer.take(x, v, x["pos"] > 0)
    down = Queue(pool, sigma, block)
    inducer = _Inducer(text, down, sigma, prefixes)
    for c in range(sigma - 1, 0, -1):
        last = None
        while (x := down.pop(c)) is not None:
            last = int(x["pos"][-1])
            yield x, c, True
            inducer.take(x, x["v"], (x["pos"] > 0) & ((x["prev"] & _MASK) <= c))
        value = None
        while log and log[-1][0] == c:
            x = pool.get(log.pop()[1])[::-1].copy()
            value, own = int(x["v"][-1]), np.concatenate(([meeting(int(x["pos"][0]), last) if value is None else value], x["v"][:-1]))
            x["v"] = own
            if prefixes:
                yield x, c, False
            inducer.take(x, x["v"], (x["pos"] > 0) & ((x["prev"] & _MASK) < c))


#: Bytes that sorting a symbol in memory takes.
_IN_MEMORY = 64


def _doubled(s: np.ndarray) -> np.ndarray:
    """The suffixes of a text of at most a block in order: ranks of one stretch give those of two, and so on until they differ."""
    rank, width = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        second = np.zeros(len(rank), np.int64)
        second[:-width] = rank[width:]
        both = rank * (len(rank) + 2) + second
        order = np.argsort(both, kind="stable")
        rank = np.empty(len(both), np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], both[order][1:] != both[order][:-1])))
        width *= 2
        if width >= len(rank) or rank[order[-1]] == len(rank):
            return order


def suffixes(path: str, sigma: int, memory: int, folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of the text in path, greatest first: positions, and common prefixes (up to CAP) with the suffix given before.

    memory bounds what runs hold; besides there are some blocks of tuples and, for each symbol, a number.
    """
    text, block = Text(path), max(64, memory // 1024)
    if 0 < text.n <= max(2, memory // _IN_MEMORY):
        pos = _doubled(text.s[: text.n])[::-1]
        yield pos, np.concatenate(([0], text.common(pos[1:], pos[:-1])))
    elif text.n:
        seeds, kept = _sorted_valleys(text, sigma, memory, block, folder)
        pool = Pool(memory)
        for x, _, _ in _induced(text, sigma, seeds, pool, True, block):
            yield x["pos"], x["v"]
        pool.close()
        kept.close()


def _sorted_valleys(text: Text, sigma: int, memory: int, block: int, folder: str) -> tuple[Queue, Pool]:
    """A queue of the valleys in order with their common prefixes, behind the end; and the pool it lies in."""
    pool = Pool(memory)
    seeds = Queue(pool, sigma, block)
    seeds.push(text.items(np.array([text.n]), 0))
    for pos in text.valleys(block):
        x = text.items(pos, 1)
        seeds.push(x[np.argsort(x["sym"], kind="stable")])
    # stretches in order, downwards; equal ones are told by 1
    spread, runs, n_names, n_valleys, skim = Spread(pool, text.n, 16 * block), [], 0, 0, Skim()
    for x, c, rises in _induced(text, sigma, seeds, pool, False, block):
        at, equal = skim(x["v"], ((x["pos"] > 0) & ((x["prev"] & _MASK) > c)) if rises else np.zeros(len(x), bool))
        if len(at):
            named = np.zeros(len(at), _NAMED)
            named["pos"], named["name"] = x["pos"][at], n_names + np.cumsum(equal == 0) - 1
            n_names, n_valleys = int(named["name"][-1]) + 1, n_valleys + len(at)
            spread.put(named, named["pos"])
            runs.append(pool.put(named["pos"].copy()))
    kept = Pool(memory)
    ranked: list[list] = []
    last = None

    def rank(pos: np.ndarray, skip: np.ndarray | int, before: np.ndarray) -> None:
        v = np.zeros(len(pos), np.int64)
        some = np.flatnonzero(before >= 0)
        skip = skip[some] if isinstance(skip, np.ndarray) else skip
        v[some] = np.minimum(skip + text.common(pos[some] + skip, before[some] + skip), CAP)
        x = np.zeros(len(pos), _RANKED)
        x["pos"], x["v"] = pos, v
        ranked.append(kept.put(x))

    if n_names == n_valleys:
        for run in runs:
            pos = pool.get(run)
            rank(pos, 0, np.concatenate(([-1 if last is None else last], pos[:-1])))
            last = int(pos[-1])
        pool.close()
    else:
        digits = 1 if n_names <= ONE_DIGIT else 2
        base = n_names if digits == 1 else math.isqrt(n_names - 1) + 1
        with tempfile.TemporaryDirectory(dir=folder) as below:
            small: list[np.ndarray] = []
            with open(f"{below}/text", "wb") as names, open(f"{below}/places", "wb") as places:
                for x in spread.spans():
                    x = x[np.argsort(x["pos"])]
                    name = n_names - 1 - x["name"]
                    both = name[:, None] if digits == 1 else np.stack((name // base, name % base), 1)
                    names.write((both + 1).astype(np.uint16).tobytes())
                    places.write(x["pos"].tobytes())
                    if n_valleys * _IN_MEMORY <= memory:
                        small.append(name)
                names.write(np.zeros(1, np.uint16).tobytes())
                places.write(np.array([text.n], np.int64).tobytes())
            pool.close()
            place = np.memmap(f"{below}/places", np.int64, "r").view(np.ndarray)
            skim = Skim()
            if n_valleys * _IN_MEMORY <= memory:
                one = Text(f"{below}/text")
                r = _doubled(np.concatenate(small))[::-1]
                found = [(r * digits, np.concatenate(([0], one.common(r[1:] * digits, r[:-1] * digits))))]
            else:
                found = suffixes(f"{below}/text", base + 1, memory, below)
            for pos, v in found:
                at, common = skim(v, pos % digits == 0)
                if len(at):
                    r = pos[at] // digits
                    before = np.concatenate(([-1 if last is None else last], r[:-1]))
                    skip = place[np.minimum(r + common // digits, n_valleys)] - place[r]
                    rank(place[r], np.minimum(skip, CAP), np.where(before >= 0, place[before], -1))
                    last = int(r[-1])
            del place
    seeds = Queue(kept, sigma, block)
    seeds.push(text.items(np.array([text.n]), 0))
    value = 0
    while ranked:  # upwards: a valley's common prefix is now that with the one below it
        x = kept.get(ranked.pop())[::-1]
        own = np.concatenate(([value], x["v"][:-1]))
        value = int(x["v"][-1])
        seeds.push(text.items(x["pos"].copy(), own))
    return seeds, kept
