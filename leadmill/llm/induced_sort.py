"""Suffix sorting of one shard by external induced sorting, with common prefixes carried along.

Suffixes of type S (smaller than the next suffix) whose left neighbour is of type L are the seeds.
Their substrings are sorted and named, bucket by bucket in memory, or by a first induction where the text is
larger than ``memory``; where names repeat, the string of names is sorted by the same procedure, one level of
recursion down. The induction starts from the sorted seeds: scanning the suffixes in rising order, each one's left neighbour, if of type L, goes to the queue
of its first symbol; scanning in falling order does the same for type S. A queue holds tuples (position,
common prefix with the tuple before it); the common prefix of two induced suffixes is one more than the
smallest between those that induced them. Queues are served by symbol, the smallest (or largest)
first, so they are one monotone priority queue.

What a shard needs lies on disk once it is larger than ``memory``: queues write their tuples to files, and
the text, the types, the names and the result are arrays mapped from files in a temporary folder of the
task, which is deleted afterwards. They are worked on in slices of a share of ``memory``. Large alphabets,
those of names, are served some symbols at a time.

Only the first ``depth`` symbols of suffixes matter to the caller: common prefixes stop there, and
suffixes that agree that far may come in any order. Symbols are compared themselves, never hashes.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np


AHEAD = 64


class Disk:
    """Arrays and queues of one shard: in memory while small, else in files of a folder."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.files = folder, memory, 0
        self.slice = min(1 << 16, max(256, memory // 128))  # rows that are worked on at a time
        self.group = min(1 << 15, self.slice)  # suffixes of a bucket of several symbols

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory // 8:
            return np.zeros(n, dtype=dtype)
        path = self.path()
        out = np.memmap(path, dtype=dtype, mode="w+", shape=(n,)).view(np.ndarray)
        os.remove(path)  # its space is freed with the array
        return out

    def slices(self, n: int) -> Iterator[tuple[int, int]]:
        for low in range(0, n, self.slice):
            yield low, min(n, low + self.slice)


class BucketQueue:
    """A monotone priority queue: arrays of (position, common prefix) tuples, kept by bucket."""

    def __init__(self, disk: Disk):
        self.disk, self.held, self.file, self.end = disk, 0, None, 0
        self.rows: dict[int, list[np.ndarray]] = defaultdict(list)
        self.stored: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first row in the file, rows)

    def push(self, bucket: int, tuples: np.ndarray) -> None:
        self.rows[bucket].append(tuples)
        self.held += len(tuples)
        if 8 * self.held > self.disk.memory // 4:
            if self.file is None:
                path = self.disk.path()
                self.file = open(path, "w+b")  # noqa: SIM115
                os.remove(path)  # its space is freed when it is closed
            self.file.seek(8 * self.end)
            for key, parts in self.rows.items():
                size = sum(map(len, parts))
                self.file.write(np.concatenate(parts).tobytes())
                self.stored[key].append((self.end, size))
                self.end += size
            self.rows.clear()
            self.held = 0

    def pop(self, bucket: int, back: bool = False) -> Iterator[np.ndarray]:
        """All tuples of a bucket in slices, in the order in which they came, or from the last to the first."""
        own = self.rows.pop(bucket, [])
        self.held -= sum(map(len, own))
        parts = [*self.stored.pop(bucket, []), *own]
        most, held, size = self.disk.slice, [], 0
        for part in reversed(parts) if back else parts:
            rows = part[1] if isinstance(part, tuple) else len(part)
            for low in range(0, rows, most):
                high = min(rows, low + most)
                if back:
                    low, high = rows - high, rows - low
                if isinstance(part, tuple):
                    self.file.seek(8 * (part[0] + low))
                    one = np.frombuffer(self.file.read(8 * (high - low)), dtype=np.int32).reshape(-1, 2)
                else:
                    one = part[low:high]
                held.append(one[::-1] if back else one)
                size += len(one)
                if size >= most:
                    yield np.concatenate(held)
                    held, size = [], 0
        if held:
            yield np.concatenate(held)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _padded(disk: Disk, n: int, dtype) -> np.ndarray:
    """An array of n symbols with room behind it for reading ``AHEAD`` bytes at once."""
    return disk.array(n + AHEAD, dtype)


def common_prefix(text: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal symbols of pairs of suffixes of a padded text, up to ``most``, compared eight bytes at a time, later ``AHEAD``."""
    size = text.itemsize
    words = np.ndarray((n,), dtype="<u8", buffer=text.data, strides=(size,))
    rows = np.ndarray((n,), dtype=f"V{AHEAD}", buffer=text.data, strides=(size,))
    a, b = a.astype(np.int64), b.astype(np.int64)
    out = np.zeros(len(a), dtype=np.int64)
    most = np.minimum(most, n - np.maximum(a, b))
    live = np.flatnonzero(most > 0)
    at, by, left = a[live], b[live] - a[live], most[live]
    done = rounds = 0
    while len(live):
        wide = rounds >= 2
        if wide:
            differ = (rows[at].view("<u8") ^ rows[at + by].view("<u8")).reshape(-1, AHEAD // 8)
            word = (differ != 0).argmax(axis=1)
            differ = differ[np.arange(len(at)), word]
        else:
            differ = words[at] ^ words[at + by]
        on = differ == 0
        # The lowest bit that differs tells how many whole symbols agree.
        off = np.flatnonzero(~on)
        x = differ[off]
        same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // (8 * size) + done
        if wide:
            same += word[off] * (8 // size)
        out[live[off]] = np.minimum(same, left[off])
        step = (AHEAD if wide else 8) // size
        done += step
        rounds += 1
        end = on & (left <= done)
        out[live[end]] = left[end]
        on &= ~end
        live, at, by, left = live[on], at[on] + step, by[on], left[on]
    return out


class _Level:
    """A text of one level of the recursion: symbols, types, seeds, and its buckets of symbols."""

    def __init__(self, text: np.ndarray, n: int, symbols: int, disk: Disk):
        self.text, self.n, self.symbols, self.disk = text, n, symbols, disk
        self.small = disk.array(n, bool)
        later = True  # the last symbol is the smallest and stands once
        for low, high in reversed(list(disk.slices(n))):
            here = text[low:high]
            after = text[low + 1 : high + 1]
            known = np.where(here < after, 1, np.where(here > after, 0, -1)).astype(np.int8)
            if high == n:
                known[-1] = 1
            at = np.where(known >= 0, np.arange(high - low), high - low)
            at = np.minimum.accumulate(at[::-1])[::-1]
            self.small[low:high] = np.append(known == 1, later)[at]
            later = bool(self.small[low])
        count = sum(len(part) for part in self._seed_slices())
        self.seeds = disk.array(count, np.int32)
        at = 0
        for part in self._seed_slices():
            self.seeds[at : at + len(part)] = part
            at += len(part)
        self._deal()

    def _seed_slices(self) -> Iterator[np.ndarray]:
        for low, high in self.disk.slices(self.n):
            left = np.append(True if low == 0 else self.small[low - 1], self.small[low : high - 1])
            yield np.flatnonzero(self.small[low:high] & ~left) + low

    def _deal(self) -> None:
        """Symbols to buckets: one for each of a small alphabet; else some at a time, frequent ones alone."""
        self.plain = self.symbols <= 512  # each symbol is its own bucket
        if self.plain:
            self.bucket, self.alone = np.arange(self.symbols, dtype=np.uint16), np.ones(self.symbols, dtype=bool)
            return
        counts = np.zeros(self.symbols, dtype=np.int64)
        for low, high in self.disk.slices(self.n):
            part = self.text[low:high]
            first = int(part.min())
            own = np.bincount(part - first)
            counts[first : first + len(own)] += own
        often = counts > self.disk.group // 16
        often[0] = True  # the last symbol's suffix is induced by none
        share = np.cumsum(np.where(often, 0, counts)) // self.disk.group
        new = np.ones(self.symbols, dtype=bool)
        new[1:] = (share[1:] != share[:-1]) | often[1:] | often[:-1]
        self.bucket = np.cumsum(new) - 1
        self.alone = np.zeros(int(self.bucket[-1]) + 1, dtype=bool)
        self.alone[self.bucket[often]] = True
        self.alone |= np.bincount(self.bucket) == 1
        if len(self.alone) <= 1 << 16:  # short keys are sorted by radix
            self.bucket = self.bucket.astype(np.uint16)

    def queue(self, parts: Iterator[np.ndarray]) -> BucketQueue:
        """A queue of tuples that are dealt by first symbol."""
        out = BucketQueue(self.disk)
        for part in parts:
            bucket = self.bucket[self.text[part[:, 0]]]
            order = np.argsort(bucket, kind="stable")
            part, bucket = part[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(part) else []
            for low, high in zip(cuts, [*cuts[1:], len(part)]):
                out.push(int(bucket[low]), part[low:high])
        return out


class _Spread:
    """Sends tuples' left neighbours of one type to their queues, with common prefixes if they are wanted."""

    def __init__(self, level: _Level, small: bool, queue: BucketQueue, depth: int):
        self.level, self.small, self.queue, self.depth = level, small, queue, depth
        # Smallest common prefix since a symbol's last tuple; -1: it has none yet.
        self.since = np.full(level.symbols if depth else 0, -1, dtype=np.int32)

    def left(self, at: np.ndarray) -> np.ndarray:
        """Rows whose left neighbour is induced."""
        own = self.level.small[at - 1]
        if not self.small:
            own = ~own
        if not at.all():
            own &= at > 0
        return np.flatnonzero(own)

    def __call__(self, tuples: np.ndarray, own: int = -1) -> np.ndarray:
        """Returns the induced tuples that belong to the very bucket being served, ``own``."""
        at, prefix = tuples[:, 0], tuples[:, 1]
        rows = self.left(at)
        left = at[rows] - 1
        target = self.level.text[left]
        bucket = target if self.level.plain else self.level.bucket[target]
        order = np.argsort(bucket, kind="stable")
        rows, target, bucket = rows[order], target[order], bucket[order]
        out = np.zeros((len(rows), 2), dtype=np.int32)
        out[:, 0] = left[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(rows) else np.zeros(0, dtype=np.int64)
        ends = np.append(cuts[1:], len(rows))
        if self.depth and len(tuples):  # buckets are single symbols then
            before = self.since.copy()
            np.minimum(self.since, prefix.min(), out=self.since)
            for low, high in zip(cuts, ends):
                symbol, own_rows = int(target[low]), rows[low:high]
                between = np.minimum.reduceat(prefix, np.concatenate([[0], own_rows + 1])[: len(own_rows) + (own_rows[-1] + 1 < len(prefix))])
                found = between[: len(own_rows)]
                found[0] = min(found[0], before[symbol])
                out[low:high, 1] = np.minimum(found + 1, self.depth)
                self.since[symbol] = between[-1] if len(between) > len(own_rows) else self.depth
        same = out[:0]
        for low, high in zip(cuts, ends):
            if bucket[low] == own:
                same = out[low:high]
            else:
                self.queue.push(int(bucket[low]), out[low:high])
        return same


def _runs_on(level: _Level, tuples: np.ndarray, depth: int) -> np.ndarray:
    """All that tuples of one symbol induce in their own bucket, where they start with ``depth`` of it or more."""
    at = tuples[:, 0].astype(np.int64)
    out = []
    while len(at):
        at = at[at > 0] - 1
        at = at[(level.text[at] == level.text[at + 1])]
        out.append(at)
    at = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return np.column_stack([at, np.full(len(at), depth)]).astype(np.int32)


def _served(level: _Level, spread: _Spread, queue: BucketQueue, bucket: int, depth: int, far: int) -> Iterator[np.ndarray]:
    """The tuples of a bucket of one symbol, in order, while they induce; those that they induce in it follow."""
    waves = BucketQueue(level.disk)
    source, generation = queue.pop(bucket), 0
    while True:
        some = False
        for part in source:
            some = True
            yield part
            if generation < far:
                waves.push(generation + 1, spread(part, bucket))
            else:  # a run of more than ``far`` equal symbols: its further suffixes agree as far as anyone asks
                rest = _runs_on(level, part, depth)
                spread(part, bucket)
                for low in range(0, len(rest), level.disk.slice):
                    yield rest[low : low + level.disk.slice]
                    spread(rest[low : low + level.disk.slice], bucket)
        if not some or generation >= far:
            waves.close()
            return
        generation += 1
        source = waves.pop(generation)


def _group(level: _Level, spread: _Spread, arrived: np.ndarray, fixed: np.ndarray, falling: bool) -> np.ndarray:
    """All tuples of a bucket of several symbols in order of service. ``arrived`` were induced from
    outside; ``fixed`` (seeds, or type L when falling) stand behind the induced ones of their symbol."""
    at = np.concatenate([arrived, fixed])[:, 0].astype(np.int64)
    if not len(at):
        return np.zeros((0, 2), dtype=np.int32)
    bucket = level.bucket[level.text[at[0]]]
    first, last = np.searchsorted(level.bucket, bucket), np.searchsorted(level.bucket, bucket, side="right")

    def key(at: np.ndarray, kind: int) -> np.ndarray:
        symbol = level.text[at].astype(np.int64)
        return ((last - symbol if falling else symbol - first) << 41) | (kind << 40)

    begun = len(at)
    keys = [key(at[: len(arrived)], 0), key(at[len(arrived) :], 1)]
    found, by, new, base = [at], [], at, 0
    while len(new):  # all that the bucket induces in itself
        rows = spread.left(new)
        left = new[rows] - 1
        inside = level.bucket[level.text[left]] == bucket
        by.append(rows[inside] + base)
        base, new = base + len(new), left[inside]
        found.append(new)
        keys.append(key(new, 0))
    at, by, keys = np.concatenate(found), np.concatenate(by), np.concatenate(keys)
    place = np.arange(len(at)) + np.where(np.arange(len(at)) < begun, 0, 1 << 38)
    order = np.argsort(keys | place)
    rank = np.empty(len(at), dtype=np.int64)
    while len(by):
        # What is induced from within follows what is from outside, in the order of what induced it.
        rank[order] = np.arange(len(at))
        place[begun:] = (1 << 38) + rank[by]
        again = order[np.argsort((keys | place)[order], kind="stable")]
        if (again == order).all():
            break
        order = again
    return np.column_stack([at[order], np.zeros(len(at))]).astype(np.int32)


def _all(queue: BucketQueue, bucket: int, back: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros((0, 2), dtype=np.int32), *queue.pop(bucket, back)])


def _induce(level: _Level, seeds: BucketQueue, depth: int, far: int) -> Iterator[np.ndarray]:
    """All suffixes from the last to the first, with the common prefix of each with the one before it in
    rising order, from seeds that lie in the queue in order. Without ``depth``, no prefixes."""
    disk = level.disk
    first = lambda a, b: int(common_prefix(level.text, level.n, np.array([a], dtype=np.int64), np.array([b], dtype=np.int64), np.array([depth]))[0]) if depth else 0
    rising, falling, larges = BucketQueue(disk), BucketQueue(disk), BucketQueue(disk)
    spread = _Spread(level, False, rising, depth)
    buckets = len(level.alone)
    for g in range(buckets):
        if not level.alone[g]:
            own = _all(seeds, g)
            done = _group(level, spread, _all(rising, g), own, False)
            large = done[~level.small[done[:, 0]]]
            if len(large):
                larges.push(g, large)
            spread(done, g)
            continue
        last = None
        for part in _served(level, spread, rising, g, depth, far):
            larges.push(g, part)
            last = int(part[-1, 0])
        for part in seeds.pop(g):
            if last is not None:
                part[0, 1] = first(last, int(part[0, 0]))
                last = None
            spread(part)
    spread = _Spread(level, True, falling, depth)
    for g in range(buckets - 1, -1, -1):
        if not level.alone[g]:
            done = _group(level, spread, _all(falling, g), _all(larges, g, True), True)
            if len(done):
                spread(done, g)
                yield done
            continue
        # Falling tuples hold the prefix with the one before them in service, the next greater suffix;
        # the result wants the one with the next smaller, so each waits for the tuple that follows.
        held = None

        def turned(part: np.ndarray) -> np.ndarray:
            nonlocal held
            rows = part if held is None else np.concatenate([held, part])
            out = rows[:-1].copy()
            out[:, 1] = rows[1:, 1]
            held = rows[-1:].copy()
            return out

        if g == 0:  # the last symbol, which no suffix induces
            held = np.array([[level.n - 1, 0]], dtype=np.int32)
        for part in _served(level, spread, falling, g, depth, far):
            yield turned(part)
        after = None
        for part in larges.pop(g, True):
            # From the prefix with the smaller neighbour to that with the greater one.
            back = part.copy()
            back[1:, 1] = part[:-1, 1]
            back[0, 1] = after if after is not None else first(int(part[0, 0]), int(held[0, 0])) if held is not None else 0
            after = int(part[-1, 1])
            spread(back)
            yield turned(back)
        if held is not None:
            held[:, 1] = 0
            yield held
    for queue in (rising, falling, larges, seeds):
        queue.close()


def _by_substring(text: np.ndarray, n: int, symbols: int, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of substrings, and where in it a new one begins. As many symbols as fit 63 bits are sorted at a time, then
    the next ones of those that agree and go on. If one substring begins another, the longer is smaller: where the
    shorter ends, its suffix is of type S and the other's of type L."""
    bits = max(1, int(symbols - 1).bit_length())
    few = 62 // bits
    while few * bits + (few + 1).bit_length() > 63:
        few -= 1

    def key(rows: np.ndarray, done: int) -> np.ndarray:
        first, rest = at[rows] + done, size[rows] - done
        out = np.zeros(len(rows), dtype=np.int64)
        for i in range(few):
            out = out << bits | np.where(i < rest, text[np.minimum(first + i, n - 1)], (1 << bits) - 1)
        return out << (few + 1).bit_length() | (few + 1 - np.minimum(rest, few + 1))

    keys = key(np.arange(len(at)), 0)
    order = np.argsort(keys)
    keys = keys[order]
    new, done = np.append(True, keys[1:] != keys[:-1]), few
    while True:
        live = np.flatnonzero((~new | ~np.append(new[1:], True)) & (size[order] > done))
        if not len(live):
            return order, new
        group = np.cumsum(new)[live]
        keys = key(order[live], done)
        within = np.lexsort((keys, group))
        keys = keys[within]
        order[live] = order[live][within]
        new[live] |= np.append(True, (keys[1:] != keys[:-1]) | (group[1:] != group[:-1]))
        done += few


def _sorted_names(level: _Level, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The seeds in order of their substrings' first ``depth`` symbols, sorted bucket by bucket in memory; the string of
    names, padded; and how many names there are."""
    disk, seeds, count = level.disk, level.seeds, len(level.seeds)
    numbered = (np.column_stack([seeds[low:high], np.arange(low, high)]).astype(np.int32) for low, high in disk.slices(count))
    order, reduced, name, done = disk.array(count, np.int32), _padded(disk, count, np.int32), 0, 0
    queue = level.queue(numbered)
    for g in range(len(level.alone)):
        own = _all(queue, g)
        if not len(own):
            continue
        at, index = own[:, 0].astype(np.int64), own[:, 1]
        end = np.where(index + 1 < count, seeds[np.minimum(index + 1, count - 1)], level.n - 1)  # the next seed's first symbol
        by, new = _by_substring(level.text, level.n, level.symbols, at, np.minimum(end - at + 1, depth))
        order[done : done + len(by)] = at[by]
        reduced[index[by]] = np.cumsum(new) + (name - 1)
        name += int(new.sum())
        done += len(by)
    queue.close()
    return order, reduced, name


def _induced_names(level: _Level, far: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What ``_sorted_names`` gives, by an induction that holds slices only."""
    disk, n, text, seeds = level.disk, level.n, level.text, level.seeds
    count = len(seeds)
    as_tuples = lambda low, high: np.column_stack([seeds[low:high], np.zeros(high - low)]).astype(np.int32)
    is_seed = disk.array(n, bool)
    size = disk.array(n, np.int32)  # of a seed's substring, which ends with the next seed's first symbol
    for low, high in disk.slices(count):
        is_seed[seeds[low:high]] = True
        size[seeds[low:high]] = np.diff(np.append(seeds[low:high], seeds[high] if high < count else n - 1)) + 1
    order, end = disk.array(count, np.int32), count
    for part in _induce(level, level.queue(as_tuples(*s) for s in disk.slices(count)), 0, far):
        own = part[is_seed[part[:, 0]], 0]
        order[end - len(own) : end] = own[::-1]
        end -= len(own)
    names, last, name = disk.array(n, np.int32), None, -1
    for low, high in disk.slices(count):
        here = order[low:high].astype(np.int64)
        before = np.append(here[0] if last is None else last, here[:-1])
        long = size[here]
        same = (size[before] == long) & (common_prefix(text, n, before, here, long) >= long)
        if last is None:
            same[0] = False
        name_of = np.cumsum(~same) + name
        names[here] = name_of
        last, name = int(here[-1]), int(name_of[-1])
    reduced = _padded(disk, count, np.int32)
    for low, high in disk.slices(count):
        reduced[low:high] = names[seeds[low:high]]
    return order, reduced, name + 1


def _sorted_seeds(level: _Level, depth: int, far: int) -> np.ndarray:
    """The level's seeds in order of their suffixes: names of their substrings, then the order of the names."""
    disk, seeds = level.disk, level.seeds
    count = len(seeds)
    if count <= 1:
        return seeds
    order, reduced, names = _sorted_names(level, depth) if level.n <= disk.memory else _induced_names(level, far)
    deeper = (depth + 1) // 2  # seeds are at least two symbols apart
    if names == count or deeper <= 1:
        return order
    del order
    below = _Level(reduced, count, names, disk)
    ranked, end = disk.array(count, np.int32), count
    for part in _induce(below, below.queue(np.column_stack([s, np.zeros(len(s))]).astype(np.int32) for s in _in_slices(disk, _sorted_seeds(below, deeper, deeper))), 0, deeper):
        ranked[end - len(part) : end] = seeds[part[::-1, 0]]
        end -= len(part)
    return ranked


def _in_slices(disk: Disk, x: np.ndarray) -> Iterator[np.ndarray]:
    for low, high in disk.slices(len(x)):
        yield x[low:high]


def suffixes(text: np.ndarray, n: int, symbols: int, depth: int, disk: Disk) -> Iterator[np.ndarray]:
    """Suffixes of a padded ``text`` of n symbols, from the last to the first in order of their first
    ``depth`` symbols, as slices of (position, common prefix, at most ``depth``, with the one before in
    rising order). The text must end in a single 0; there are at most 512 symbols. Between slices, and
    between symbols, prefixes are 0 or more as they are: nothing is cut."""
    level = _Level(text, n, symbols, disk)
    ranked = _sorted_seeds(level, depth, depth)

    def seeded() -> Iterator[np.ndarray]:
        last = None
        for part in _in_slices(disk, ranked):
            here = part.astype(np.int64)
            before = np.append(here[0] if last is None else last, here[:-1])
            prefix = common_prefix(text, n, before, here, np.full(len(here), depth))
            if last is None:
                prefix[0] = 0
            last = int(here[-1])
            yield np.column_stack([here, prefix]).astype(np.int32)

    yield from _induce(level, level.queue(seeded()), depth, depth)


def suffix_order(text: np.ndarray, symbols: int, depth: int, memory: int = 256 << 20) -> tuple[np.ndarray, np.ndarray, int]:
    """All of ``suffixes`` in rising order: positions, common prefixes, and how many files were used."""
    with tempfile.TemporaryDirectory(prefix="induced") as folder:
        disk = Disk(folder, memory)
        own = _padded(disk, len(text), text.dtype)
        own[: len(text)] = text
        found = np.concatenate([part[::-1] for part in suffixes(own, len(text), symbols, depth, disk)][::-1])
        return found[:, 0].copy(), found[:, 1].copy(), disk.files
