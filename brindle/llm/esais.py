"""External induced suffix and LCP sorting for many strings at once, in numpy, for shards larger than memory.

The text is a sequence of symbols in which 0 ends a string; zeros differ from each other, in order of place, so no match
crosses them. Suffixes are sorted as in SA-IS / eSAIS: substrings between left-most-S (S*) places are named in order, the
string of names is sorted by recursion, and from the sorted S* suffixes all L suffixes and then all S suffixes are induced.
The recursion ends where no name comes twice, or where SMALL symbols or fewer are left.

Induction scans the suffixes in order and pushes those before them into a priority queue. The symbol before never lies before
the one being scanned, so the queue is a row of FIFO buckets that spill to a scratch file and are read back in pieces:

* over bytes (the first level) a bucket is a symbol, and tuples carry the common prefix with the tuple before them: one more than
  the least common prefix scanned between their sources (range minima over a piece, a running minimum for each bucket between pieces);
* over names a bucket is a range of symbols with at most a piece of suffixes, as a name may have few places. Tuples carry the rank
  of their source; suffixes whose source lies in the same range are ranked by pointer jumping along the sources. A name with
  more places than a piece is a range of its own, which is scanned in pieces like a byte's.

Common prefixes of S* suffixes come out of the names: equal names first, then the symbols of the first unlike ones.

Texts, types, places, names and results lie in scratch files without names when they exceed the memory, and all steps work
on pieces of PIECE_SHARE of it. A task's scratch files end with it; a task that is lost is run again from its input.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Common prefixes are counted up to this.
MOST = 65535
#: Symbols that are sorted directly; items of a piece for each byte of memory, and at least.
SMALL, PIECE_SHARE, LEAST_PIECE = 1 << 16, 1 / 128, 1 << 10


def places(n: int) -> type:
    """The type of places in a text of n symbols."""
    return np.int32 if n < 1 << 30 else np.int64


def piece_of(memory: int) -> int:
    return max(LEAST_PIECE, int(memory * PIECE_SHARE))


def scratch(n: int, kind: type, memory: int) -> np.ndarray:
    """An array of zeros, in a scratch file without a name if it takes more than an eighth of the memory."""
    if n * np.dtype(kind).itemsize <= memory // 8:
        return np.zeros(n, kind)
    f = tempfile.TemporaryFile()
    f.truncate(n * np.dtype(kind).itemsize)
    return np.memmap(f, kind, "r+", shape=(n,))


def _spans(n: int, step: int) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + step)) for a in range(0, n, step))


class DiskQueues:
    """FIFO buckets of rows of a few columns. Beyond `memory` bytes what is held goes to a scratch file."""

    def __init__(self, memory: int, *kinds: type):
        self.kinds, self.memory, self.held, self.file, self.spilled = [np.dtype(k) for k in kinds], memory, 0, None, 0
        self.buckets: dict = defaultdict(list)  # of (columns) or (offset, rows, begun)
        self.size: dict = defaultdict(int)

    def push(self, key, *columns: np.ndarray) -> None:
        self.buckets[key].append(tuple(np.ascontiguousarray(c, k) for c, k in zip(columns, self.kinds, strict=True)))
        self.size[key] += len(columns[0])
        self.held += sum(k.itemsize for k in self.kinds) * len(columns[0])
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for key, parts in self.buckets.items():
            kept = [p for p in parts if isinstance(p[0], int)]
            if new := [p for p in parts if not isinstance(p[0], int)]:
                columns = [np.concatenate(c) for c in zip(*new, strict=True)]
                kept.append((self.file.tell(), len(columns[0]), 0))
                for c in columns:
                    self.file.write(c.tobytes())
                self.spilled += len(columns[0])
            self.buckets[key] = kept
        self.held = 0

    def _read(self, part: tuple, a: int, b: int) -> tuple[np.ndarray, ...]:
        if not isinstance(part[0], int):
            return tuple(c[a:b] for c in part)
        offset, rows, _ = part
        out = []
        for k in self.kinds:
            self.file.seek(offset + a * k.itemsize)
            out.append(np.frombuffer(self.file.read((b - a) * k.itemsize), k))
            offset += rows * k.itemsize
        return tuple(out)

    def take(self, key, most: int) -> tuple[np.ndarray, ...] | None:
        """The first rows of a bucket, `most` at most, which leave it; None if it is empty."""
        got, n, parts = [], 0, self.buckets.get(key)
        while parts and n < most:
            part = parts[0]
            begun, rows = (part[2], part[1]) if isinstance(part[0], int) else (0, len(part[0]))
            end = min(rows, begun + most - n)
            got.append(self._read(part, begun, end))
            n += end - begun
            if not isinstance(part[0], int):
                self.held -= sum(k.itemsize for k in self.kinds) * (end - begun)
            if end == rows:
                parts.pop(0)
            else:
                parts[0] = (*part[:2], end) if isinstance(part[0], int) else tuple(c[end:] for c in part)
        if not got:
            self.buckets.pop(key, None)
            return None
        self.size[key] -= n
        return got[0] if len(got) == 1 else tuple(np.concatenate(c) for c in zip(*got, strict=True))

    def pieces(self, key, most: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """All rows of a bucket, a piece after another, which stay in it; backwards, the last piece comes first (its rows in order)."""
        parts = self.buckets.get(key, [])
        for part in reversed(parts) if backwards else parts:
            rows = part[1] if isinstance(part[0], int) else len(part[0])
            spans = list(_spans(rows, most))
            for a, b in reversed(spans) if backwards else spans:
                yield self._read(part, a, b)

    def drop(self, key) -> None:
        for part in self.buckets.pop(key, []):
            if not isinstance(part[0], int):
                self.held -= sum(k.itemsize for k in self.kinds) * len(part[0])
        self.size.pop(key, None)

    def close(self) -> None:
        if self.file:
            self.file.close()


class RangeMinima:
    """Least values of ranges of an array (sparse table, its levels one after another)."""

    def __init__(self, values: np.ndarray):
        levels, step = [values], 1
        while 2 * step <= len(values):
            last = levels[-1]
            levels.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2
        self.start = np.cumsum([0, *map(len, levels[:-1])])
        self.table = np.concatenate(levels) if len(levels) > 1 else values

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """first <= last, both inclusive."""
        level = np.frexp(last - first + 1)[1] - 1
        start = self.start[level]
        return np.minimum(self.table[start + first], self.table[start + last - (1 << level.astype(np.int64)) + 1])


def refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray, bound: int = 0) -> np.ndarray:
    """rank: for each item, how many are in smaller groups. Splits the groups of the active items (whole groups) by key, which lies
    below bound if that is given; gives those active items that still share a group."""
    group = rank[active]
    if len(active) == len(rank) and not group.any():
        order = np.argsort(key)
    elif bound and len(rank) * bound < 1 << 62:
        order = np.argsort(group.astype(np.int64) * bound + key)
    else:
        order = np.lexsort((key, group))
    items, group, key = active[order], group[order], key[order]
    del order
    at = np.arange(len(items), dtype=rank.dtype)
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    new = new_group | np.concatenate(([True], key[1:] != key[:-1]))
    del key
    first = np.maximum.accumulate(np.where(new, at, 0))
    first -= np.maximum.accumulate(np.where(new_group, at, 0))
    rank[items] = group + first
    return items[~(new & np.concatenate((new[1:], [True])))]


def direct(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling."""
    n, kind = len(text), places(len(text))
    key = text.astype(np.int64)
    zeros = np.flatnonzero(key == 0)
    key += len(zeros)
    key[zeros] = np.arange(len(zeros))
    rank = np.zeros(n, kind)
    active, h = refine(rank, np.arange(n, dtype=kind), key), 1
    del key
    while len(active):
        active = refine(rank, active, rank[np.minimum(active + h, n - 1)], n)
        h *= 2
    order = np.empty(n, kind)
    order[rank] = np.arange(n, dtype=kind)
    return order


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the suffixes at the places a and b, pair by pair."""
    out, active, h = np.zeros(len(a), np.uint16), np.arange(len(a)), 0
    while len(active) and h < MOST:
        x = text[a[active] + h]
        active = active[(x == text[b[active] + h]) & (x != 0)]
        h += 1
        out[active] = h
    return out


def _run(text: np.ndarray, place: int) -> int:
    """How often the symbol at a place repeats, up to MOST."""
    n, step = 1, 64
    while n < MOST:
        other = np.flatnonzero(text[place + n : place + n + step] != text[place])
        if len(other) or place + n + step >= len(text):
            return min(MOST, n + (int(other[0]) if len(other) else len(text) - place - n))
        n, step = n + step, 2 * step
    return MOST


def _types(text: np.ndarray, memory: int) -> np.ndarray:
    """Whether each suffix is S (smaller than the next); zeros are."""
    n, step = len(text), piece_of(memory)
    is_s = scratch(n, bool, memory)
    is_s[n - 1] = True
    for a, b in reversed(list(_spans(n - 1, step))):
        x = np.asarray(text[a : b + 1])
        at = np.where(x[:-1] != x[1:], np.arange(b - a), b - a)
        at = np.minimum.accumulate(at[::-1])[::-1]  # where a row of equal symbols stops
        smaller = np.concatenate((x[:-1] < x[1:], [is_s[b]]))
        is_s[a:b] = smaller[at] | (x[:-1] == 0)
    return is_s


def _stars(text: np.ndarray, is_s: np.ndarray, memory: int) -> np.ndarray:
    """Places of S suffixes with an L suffix or a string's end before them, and of all zeros."""

    def found() -> Iterator[np.ndarray]:
        for a, b in _spans(len(text), piece_of(memory)):
            star = np.array(is_s[a:b])
            star[1:] &= ~is_s[a : b - 1] | (text[a + 1 : b] == 0)
            star[0] &= text[a] == 0 or (a > 0 and not is_s[a - 1])
            yield np.flatnonzero(star) + a

    out, at = scratch(sum(map(len, found())), places(len(text)), memory), 0
    for x in found():
        out[at : at + len(x)] = x
        at += len(x)
    return out


def _top(text: np.ndarray, memory: int) -> int:
    return max((int(text[a:b].max()) for a, b in _spans(len(text), piece_of(memory))), default=0)


def _names(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, memory: int) -> tuple[np.ndarray, int]:
    """The rank of each S* substring, zeros and all else in order, 0 for a zero; and how many there are. An S symbol counts as larger
    than an equal L one, so no substring is the beginning of another. Where there are too many to sort them at once, they are
    dealt into ranges of their first symbols, and a hot range of equal ones by the symbols after those."""
    n, bits, most = len(text), _top(text, memory).bit_length() + 1, piece_of(memory)
    per_word = max(1, 63 // bits)
    names = scratch(len(stars), places(len(stars) + 1), memory)
    bags = DiskQueues(memory // 8, names.dtype)
    count, keys = 0, 1

    def sizes(idx: np.ndarray) -> np.ndarray:
        first = stars[idx]
        size = stars[np.minimum(idx + 1, len(stars) - 1)] - first + 1
        size[text[first] == 0] = 1
        return size

    def words(idx: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        first, word = stars[idx].astype(np.int64), np.zeros(len(idx), np.int64)
        for j in range(k, k + per_word):
            at = np.minimum(first + j, n - 1)
            word = word << bits | np.where(j < size, (text[at].astype(np.int64) << 1) | is_s[at], 0)
        return word

    def at_once(idx: np.ndarray, k: int) -> None:
        nonlocal count
        size = sizes(idx)
        rank, active = np.zeros(len(idx), np.int64), np.arange(len(idx))
        while len(active):
            active = refine(rank, active, words(idx[active], size[active], k))
            k += per_word
            active = active[size[active] > k]
        taken = np.zeros(len(idx) + 1, bool)
        taken[rank] = True
        names[idx] = count + np.cumsum(taken)[rank] - 1
        count += int(taken.sum())

    def deal(pieces: list | None, key, total: int, k: int) -> None:
        """Names the places of a bag (or of the pieces) by their symbols from k on."""
        nonlocal count, keys
        of = (lambda: bags.pieces(key, most)) if pieces is None else (lambda: iter(pieces))
        if total <= most:
            idx = np.concatenate([x for (x,) in of()])
            bags.drop(key)
            at_once(idx, k)
            return
        sample = np.concatenate([words(x[:: max(1, total // 4096)], sizes(x[:: max(1, total // 4096)]), k) for (x,) in of()])
        cuts = np.unique(np.quantile(sample, np.linspace(0, 1, 2 + 2 * total // most), method="nearest"))
        base, keys = keys, keys + 2 * len(cuts) + 1
        for (x,) in of():
            word = words(x, sizes(x), k)
            to = 2 * np.searchsorted(cuts, word, "left") + 0
            to += np.isin(word, cuts)  # places of a cut's own word are a bag of their own
            order = np.argsort(to, kind="stable")
            x, to = x[order], to[order]
            first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(to)], strict=True):
                bags.push(base + int(to[a]), x[a:b])
        bags.drop(key)
        for j in range(2 * len(cuts) + 1):
            if not (m := bags.size.get(base + j, 0)):
                continue
            if j % 2 and m > most and all((sizes(x) <= k + per_word).all() for (x,) in bags.pieces(base + j, most)):
                for (x,) in bags.pieces(base + j, most):  # all of them are equal
                    names[x] = count
                count += 1
                bags.drop(base + j)
            else:
                deal(None, base + j, m, k + per_word if j % 2 and m > most else k)

    class Range:
        def __iter__(self):
            return ((np.arange(a, b, dtype=names.dtype),) for a, b in _spans(len(stars), most))

    deal(Range(), 0, len(stars), 0)
    bags.close()
    return names, count


def order_of(text: np.ndarray, memory: int, small: int = SMALL, levels: list[int] | None = None) -> np.ndarray:
    """All suffixes of a text of many symbols in order. The lengths of the texts of each level are put into levels."""
    if levels is not None:
        levels.append(len(text))
    if len(text) <= max(1, small):
        return direct(np.asarray(text))
    is_s = _types(text, memory)
    stars = _stars(text, is_s, memory)
    return _induce_ranges(text, is_s, _sorted_stars(text, is_s, stars, memory, small, levels)[0], memory)


def _sorted_stars(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, memory: int, small: int, levels: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The S* suffixes in order, the string of their names and its suffixes in order."""
    names, count = _names(text, is_s, stars, memory)
    step, zeros = piece_of(memory), 0
    if len(stars):
        zeros = sum(int((names[a:b] == 0).sum()) for a, b in _spans(len(stars), step))
    if count + zeros - 1 == len(stars):  # no name comes twice: they are the order
        order, done = scratch(len(stars), places(len(stars)), memory), 0
        for a, b in _spans(len(stars), step):
            name = np.asarray(names[a:b])
            at = np.where(name == 0, done + np.cumsum(name == 0) - 1, name.astype(np.int64) + zeros - 1)
            order[at] = np.arange(a, b)
            done += int((name == 0).sum())
    else:
        order = order_of(names, memory, small, levels)
    seeds = scratch(len(stars), stars.dtype, memory)
    for a, b in _spans(len(stars), step):
        seeds[a:b] = stars[order[a:b]]
    return seeds, names, order


def suffixes(text: np.ndarray, memory: int = 256 << 20, small: int = SMALL, levels: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """text: symbols of few kinds, the last of which is 0. All suffixes in order, and the common prefix of each with the one before it."""
    n, step = len(text), piece_of(memory)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    if levels is not None:
        levels.append(n)
    is_s = _types(text, memory)
    stars = _stars(text, is_s, memory)
    seeds, names, order = _sorted_stars(text, is_s, stars, memory, small, levels)
    common = scratch(len(seeds), np.uint16, memory)
    for a, b in _spans(len(seeds) - 1, step):
        x, y = np.asarray(order[a:b]), np.asarray(order[a + 1 : b + 1])
        same = common_prefixes(names, x, y).astype(np.int64)
        p, q = stars[x + same], stars[y + same]
        common[a + 1 : b + 1] = np.minimum(p - stars[x] + common_prefixes(text, p, q), MOST)
    del names, order, stars
    return _induce(text, is_s, seeds, common, memory)


def _until(text: np.ndarray, seeds: np.ndarray, start: int, symbol: int) -> int:
    """The first of the sorted seeds from start on whose symbol is larger."""
    a, b = start, len(seeds)
    while a < b:
        m = (a + b) // 2
        a, b = (m + 1, b) if text[seeds[m]] <= symbol else (a, m)
    return a


def _induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, of_seeds: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes and common prefixes of a text of few symbols, from its sorted S* suffixes and their common prefixes."""
    n, most, kind = len(text), piece_of(memory), places(len(text))
    top = _top(text, memory)
    carry = np.zeros(top + 1, np.int32)
    queue, sorted_l = DiskQueues(memory // 8, kind, np.uint16), DiskQueues(memory // 8, kind, np.uint16)
    begun: set[int] = set()

    def scan(place: np.ndarray, common: np.ndarray, wanted: bool) -> None:
        """Pushes what the next piece of a bucket induces; common[0] is that with the last of the piece before."""
        before = place - 1
        good = np.flatnonzero((place > 0) & (is_s[before] == wanted) & (text[before] != 0))
        before = before[good]
        to = np.asarray(text[before])
        order = np.argsort(to, kind="stable")
        before, to, at = before[order], to[order], good[order]
        low = int(common.min())
        if not len(to):
            np.minimum(carry, low, out=carry)
            return
        lows = RangeMinima(common)
        new = np.concatenate(([True], to[1:] != to[:-1]))
        cut, inner = np.flatnonzero(new), np.flatnonzero(~new)
        keys = to[cut]
        value = np.empty(len(to), np.int32)
        value[inner] = lows(at[inner - 1] + 1, at[inner])
        value[cut] = np.minimum(carry[keys], lows(np.zeros(len(cut), np.int64), at[cut]))
        value = np.minimum(value + 1, MOST).astype(np.uint16)
        np.minimum(carry, low, out=carry)
        last = at[np.append(cut[1:], len(to)) - 1]
        rest = np.flatnonzero(last < len(common) - 1)
        carry[keys] = MOST
        carry[keys[rest]] = lows(last[rest] + 1, np.full(len(rest), len(common) - 1))
        for key, i, j in zip(keys.tolist(), cut.tolist(), [*cut[1:].tolist(), len(to)], strict=True):
            if key not in begun:
                begun.add(key)
                value[i] = 0
            queue.push(key, before[i:j], value[i:j])

    at = zeros = 0
    for c in range(top + 1):  # L suffixes
        carry[:] = 0
        last = -1
        while (got := queue.take(c, most)) is not None:
            sorted_l.push(c, *got)
            last = int(got[0][-1])
            scan(*got, False)
        end = _until(text, seeds, at, c)
        for a, b in ((a + at, b + at) for a, b in _spans(end - at, most)):
            common = np.array(of_seeds[a:b])
            if a == at:
                common[0] = min(_run(text, last), _run(text, int(seeds[a]))) if last >= 0 else 0
            scan(np.asarray(seeds[a:b]), common, False)
        at = end
        zeros = end if c == 0 else zeros
    begun.clear()
    place, common = scratch(n, kind, memory), scratch(n, np.uint16, memory)
    place[:zeros] = seeds[:zeros]
    end = n
    for c in range(top, 0, -1):  # S suffixes, from the largest; both kinds go to their places
        carry[:] = 0
        last, k = -1, end
        while (got := queue.take(c, most)) is not None:
            p, l = got  # noqa: E741; l: with the suffix after it
            place[k - len(p) : k] = p[::-1]
            ups = np.arange(k, k - len(p), -1)
            inside = ups < end
            common[ups[inside]] = l[inside]
            k -= len(p)
            last = int(p[-1])
            scan(p, l, True)
        have_s, k_s = k < end, k
        first = True
        for p, l in sorted_l.pieces(c, most, backwards=True):  # noqa: E741
            down = np.empty(len(p), np.uint16)
            down[1:] = l[:0:-1]
            if first:
                down[0] = joint = min(_run(text, int(p[-1])), _run(text, last)) if have_s else 0
                if have_s:
                    common[k_s] = joint
            else:
                down[0] = above
            first, above = False, l[0]
            place[k - len(p) : k], common[k - len(p) : k] = p, l
            k -= len(p)
            scan(p[::-1], down, True)
        sorted_l.drop(c)
        end = k
        if end < n:
            common[end] = 0  # no common symbol with what is before
    queue.close(), sorted_l.close()
    return place, common


def _ranges(text: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of symbols begin, 0 being one of its own, and how many places each has: at most a piece, if it is not one symbol."""
    most, top = piece_of(memory), _top(text, memory)
    shift = max(0, top.bit_length() - 16)

    def counted(low: int, high: int, by: int) -> np.ndarray:
        out = np.zeros(((high - low) >> by) + 1, np.int64)
        for a, b in _spans(len(text), most):
            x = np.asarray(text[a:b]).astype(np.int64)
            x = x[(x >= low) & (x <= high)]
            out += np.bincount((x - low) >> by, minlength=len(out))
        return out

    starts, sizes = [0, 1], [len(text) - int(counted(1, max(1, top), 31).sum()), 0]

    def add(first: int, counts: np.ndarray, by: int) -> None:
        for i, m in enumerate(counts.tolist()):
            low = first + (i << by)
            if m > most and by:  # a bin of too many places: symbol by symbol
                add(low, counted(low, min(top, low + (1 << by) - 1), 0), 0)
            else:
                if sizes[-1] and sizes[-1] + m > most:
                    starts.append(low)
                    sizes.append(0)
                sizes[-1] += m

    if top:
        add(1, counted(1, top, shift), shift)
    return np.array(starts), np.array(sizes)


def _induce_ranges(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, memory: int) -> np.ndarray:
    """Suffixes of a text of many symbols, from its sorted S* suffixes."""
    n, most, kind = len(text), piece_of(memory), places(len(text))
    starts, sizes = _ranges(text, memory)
    lasts = np.append(starts[1:] - 1, np.iinfo(np.int64).max)
    queue, sorted_l = DiskQueues(memory // 8, kind, np.int64), DiskQueues(memory // 8, kind)

    def before(place: np.ndarray, wanted: bool) -> np.ndarray:
        """Which places have one before them that they induce in this scan."""
        b = place - 1
        return np.flatnonzero((place > 0) & (is_s[b] == wanted) & (text[b] != 0))

    def push(place: np.ndarray, rank: np.ndarray, wanted: bool, low: int, high: int) -> None:
        """What places in the order of the scan induce outside low..high."""
        good = before(place, wanted)
        b, r = place[good] - 1, rank[good]
        symbol = text[b]
        out = (symbol < low) | (symbol > high)
        b, r, symbol = b[out], r[out], symbol[out]
        to = np.searchsorted(starts, symbol, "right") - 1
        order = np.argsort(to, kind="stable")
        to, b, r = to[order], b[order], r[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(to)), bool), to[1:] != to[:-1])))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(to)], strict=False):
            queue.push(int(to[i]), b[i:j], r[i:j])

    def within(known: list[np.ndarray], kinds: list[int], wanted: bool, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a range in order and their kinds: known ones, each kind in order, and what they induce within the range (kind 1)."""
        where, kind_of = [*known], [np.full(len(x), k, np.int8) for x, k in zip(known, kinds, strict=True)]
        key = [np.arange(len(x)) for x in known]
        front = np.concatenate(known)
        front_id, parents = np.arange(len(front)), [np.arange(len(front))]
        total = len(front)
        while len(front):
            good = before(front, wanted)
            b = front[good] - 1
            symbol = text[b]
            inside = (symbol >= low) & (symbol <= high)
            front, parent = b[inside], front_id[good[inside]]
            front_id = np.arange(total, total + len(front))
            total += len(front)
            where.append(front)
            kind_of.append(np.ones(len(front), np.int8))
            key.append(np.zeros(len(front), np.int64))
            parents.append(parent)
        place, kinds_, key_, parent = (np.concatenate(x) for x in (where, kind_of, key, parents))
        symbol = np.asarray(text[place])
        order = np.lexsort((key_, kinds_, symbol))
        new = np.ones(total, bool)
        s, k, e = symbol[order], kinds_[order], key_[order]
        new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1]) | (e[1:] != e[:-1])
        rank = np.empty(total, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(total), 0))
        active = order[~(new & np.append(new[1:], True))]
        while len(active):  # groups of induced places: by their sources, their sources' sources, ...
            active = refine(rank, active, rank[parent[active]], total)
            parent = parent[parent]
        back = np.empty(total, np.int64)
        back[rank] = np.arange(total)
        return place[back], kinds_[back]

    at = rank = 0
    for r, (low, high, size) in enumerate(zip(starts.tolist(), lasts.tolist(), sizes.tolist(), strict=True)):  # L suffixes
        end = _until(text, seeds, at, high)
        if size > most:  # one symbol
            while (got := queue.take(r, most)) is not None:
                sorted_l.push(r, got[0])
                push(got[0], rank + np.arange(len(got[0])), False, low + 1, low)
                rank += len(got[0])
            for a, b in ((a + at, b + at) for a, b in _spans(end - at, most)):
                push(np.asarray(seeds[a:b]), rank + np.arange(b - a), False, low + 1, low)
                rank += b - a
        else:
            got = queue.take(r, n)
            place, kinds = within([np.zeros(0, kind) if got is None else got[0], np.asarray(seeds[at:end])], [0, 2], False, low, high)
            sorted_l.push(r, place[kinds != 2])
            push(place, rank + np.arange(len(place)), False, low, high)
            rank += len(place)
        at = end
    out, end = scratch(n, kind, memory), n
    for r in range(len(starts) - 1, -1, -1):  # S suffixes, from the largest
        low, high, size = int(starts[r]), int(lasts[r]), int(sizes[r])
        if low == 0 == high:  # the zeros, by place
            for a, b in _spans(end, most):
                out[a:b] = seeds[a:b]
            break
        if size > most:
            while (got := queue.take(r, most)) is not None:
                p = got[0]
                out[end - len(p) : end] = p[::-1]
                push(p, end - 1 - np.arange(len(p)), True, low + 1, low)
                end -= len(p)
            for (p,) in sorted_l.pieces(r, most, backwards=True):
                out[end - len(p) : end] = p
                push(p[::-1], end - 1 - np.arange(len(p)), True, low + 1, low)
                end -= len(p)
        else:
            got = queue.take(r, n)
            l = [p for (p,) in sorted_l.pieces(r, most)]  # noqa: E741
            place, _ = within([np.concatenate([*l, np.zeros(0, kind)]), np.zeros(0, kind) if got is None else got[0][::-1]], [0, 2], True, low, high)
            out[end - len(place) : end] = place
            push(place[::-1], end - 1 - np.arange(len(place)), True, low, high)
            end -= len(place)
        sorted_l.drop(r)
    queue.close(), sorted_l.close()
    return out
