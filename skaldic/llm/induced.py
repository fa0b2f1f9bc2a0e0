"""Induced suffix sorting with common-prefix values, on queues that go to disk.

Suffixes that start a falling-rising step of the text (left-most S) are ordered by naming the pieces between
them and, where names repeat, by ordering the string of names, which is in memory, by doubling. One rising scan over the buckets
of first characters induces all L suffixes from them, one falling scan all S suffixes. A scan takes suffixes
in final order and puts their left neighbours into first-in-first-out queues, one for each character, so that
the queues together are a priority queue by character and arrival; each holds tuples of a position and the
length of its common prefix with the one before, and what exceeds SPILL tuples is kept in a scratch file.
The common prefix of two induced neighbours is one more than the least value scanned between their sources.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples that the queues of one sort keep in memory.
SPILL = 4_000_000


class Queues:
    """First-in-first-out queues of (position, prefix) by character."""

    def __init__(self):
        self.parts: dict[int, list] = {}
        self.kept, self.file = 0, None

    def push(self, c: int, rows: np.ndarray) -> None:
        if self.kept > SPILL:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.parts.setdefault(c, []).append((self.file.tell(), rows.shape))
            self.file.write(np.ascontiguousarray(rows, np.int64).tobytes())
        else:
            self.kept += rows.size
            self.parts.setdefault(c, []).append(rows)

    def take(self, c: int) -> np.ndarray | None:
        parts = self.parts.pop(c, None)
        if parts is None:
            return None
        for k, p in enumerate(parts):
            if isinstance(p, tuple):
                self.file.seek(p[0])
                parts[k] = np.frombuffer(self.file.read(8 * int(np.prod(p[1]))), np.int64).reshape(p[1])
            else:
                self.kept -= p.size
        return parts[0] if len(parts) == 1 else np.concatenate(parts, axis=-1)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of `raw` on as one number, the first byte lowest."""
    out = np.empty(len(raw) - 7, np.uint64)
    for k in range(8):
        part = raw[k : k + (len(raw) - k) // 8 * 8].view("<u8")
        out[k::8] = part
    return out


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, up to `most`. `words`: eights() of a text that ends in `most` + 8 spare bytes."""
    out = np.full(len(a), most, np.int64)
    open_ = np.arange(len(a))
    for k in range(0, most, 8):
        if not len(open_):
            break
        x = words[np.minimum(a + k, len(words) - 1)] ^ words[np.minimum(b + k, len(words) - 1)]
        differ = x != 0
        lowest = x[differ]
        lowest &= ~lowest + np.uint64(1)
        out[open_[differ]] = np.minimum(k + (np.frexp(lowest.astype(np.float64))[1] - 1 >> 3), most)
        equal = ~differ
        open_, a, b = open_[equal], a[equal], b[equal]
    return out


def _scan(t, kind, buckets, queues, fixed, wanted, raw, most):
    """Scan buckets in order; return for each the induced positions and prefixes. fixed(c): what follows the induced in c."""
    since: dict[int, int] = {}
    out: dict[int, tuple] = {}

    def induce(positions, prefixes):
        left = positions - 1
        ok = np.flatnonzero((left >= 0) & (kind[left] == wanted))
        low = int(prefixes.min())
        pushed = []
        if len(ok):
            made = left[ok]
            chars = t[made]
            order = np.argsort(chars, kind="stable")
            made, chars, at = made[order], chars[order], ok[order]
            cuts = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
            # for each, the prefixes since the last one of its character; behind each character, those after its last one
            after = at + 1
            begin = np.append(0, after[:-1])
            begin[cuts] = 0
            spare = np.append(prefixes, most)
            values = np.minimum.reduceat(spare, np.stack([begin, after], 1).ravel())[::2]
            ends = np.append(cuts[1:], len(chars))
            rest = np.minimum.reduceat(spare, np.stack([after[ends - 1], np.full(len(ends), len(prefixes))], 1).ravel())[::2].tolist()
            heads = chars[cuts].tolist()
            values[cuts] = np.minimum(values[cuts], [since.get(c, -1) for c in heads])
            rows = np.stack([made, np.minimum(values + 1, most)])
            for c, x, y in zip(heads, cuts.tolist(), ends.tolist()):
                queues.push(c, rows[:, x:y])
            pushed = zip(heads, rest)
        for c, v in since.items():
            if low < v:
                since[c] = low
        since.update(pushed)

    for c in buckets:
        got, last = [], None
        while (rows := queues.take(c)) is not None:
            got.append(rows)
            last = rows[0][-1:]
            induce(rows[0], rows[1])
        positions, prefixes = fixed(c)
        if len(positions):
            prefixes = prefixes.copy()
            prefixes[0] = 0 if last is None else common_prefix(raw, last, positions[:1], most)[0]
            induce(positions, prefixes)
        if got:
            out[c] = got[0] if len(got) == 1 else np.concatenate(got, axis=-1)
    return out


def _kinds(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S (smaller than the one after it), and the places of the left-most S."""
    if len(t) == 1:
        return np.ones(1, bool), np.zeros(0, np.int64)
    step = np.sign(np.diff(t.astype(np.int64)))
    turn = np.minimum.accumulate(np.where(step != 0, np.arange(len(t) - 1), len(t))[::-1])[::-1]
    kind = np.append(step[turn] > 0, True)
    return kind, np.flatnonzero(kind[1:] & ~kind[:-1]) + 1


def _split(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order the members `open_` of whole groups of equal rank by a further key; those still equal to another, in order.

    A rank is the number of smaller ones, so that a split leaves all ranks outside the group as they are.
    """
    base = rank[open_]
    if len(key) and int(key.max()) < 1 << 31 and len(rank) < 1 << 31:
        order = np.argsort(base << 31 | key)
    else:
        order = np.lexsort((key, base))
    open_, base, key = open_[order], base[order], key[order]
    group = np.append(True, base[1:] != base[:-1])[: len(base)]
    fresh = np.flatnonzero(group | np.append(True, key[1:] != key[:-1])[: len(base)])
    group = np.flatnonzero(group)
    size = np.diff(np.append(fresh, len(base)))
    rank[open_] = np.repeat(base[fresh] + fresh - group[np.searchsorted(group, fresh, "right") - 1], size)
    return open_[np.repeat(size > 1, size)]


def order_stars(t: np.ndarray, kind: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """The suffix order of the stars, as places in `stars`.

    A piece goes from a star to the next one, which it includes. Pieces are ranked by their characters and kinds, a
    machine word of them at a time; where ranks repeat, the string of ranks is in memory and small, and is ordered by
    doubling (the ranks of h pieces and of the h after them are the rank of 2 h) in whole-array steps. The last piece
    is the smallest and the only one of its kind, so that no two equal stretches reach the end.
    """
    code = t.astype(np.int64) * 2 + kind
    size = np.append(stars[1:] + 1, len(t)) - stars
    bits = int(code.max()).bit_length()
    each = 62 // bits
    rank, open_ = np.zeros(len(stars), np.int64), np.arange(len(stars))
    same = []
    at = 0
    while len(open_):
        begin, left = stars[open_] + at, size[open_] - at
        word = np.zeros(len(open_), np.int64)
        for k in range(each):
            word <<= bits
            word |= np.where(k < left, code[np.minimum(begin + k, len(t) - 1)], 0)
        open_ = _split(rank, open_, word)
        at += each
        ended = size[open_] <= at  # equal ones have equal sizes: a piece that ended has a 0 where the other goes on
        same.append(open_[ended])
        open_ = open_[~ended]
    open_ = np.concatenate(same)
    h = 1
    while len(open_):
        open_ = _split(rank, open_, rank[open_ + h])
        h *= 2
    order = np.empty(len(stars), np.int64)
    order[rank] = np.arange(len(stars))
    return order


def suffix_sort(t: np.ndarray, raw: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes of t in order, and the prefixes shared with the one before, up to `most`.

    t: integers whose last is 0 and the only 0; raw: the text as bytes that are equal where t is, with spare bytes at the end.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    kind, stars = _kinds(t)
    raw = eights(raw)
    order = order_stars(t, kind, stars)
    stars = stars[order]
    first = t[stars]
    shared = np.concatenate(([0], common_prefix(raw, stars[:-1], stars[1:], most)))
    shared[np.concatenate(([True], first[1:] != first[:-1]))] = 0
    buckets = np.unique(t)
    low, high = np.searchsorted(first, buckets, "left"), np.searchsorted(first, buckets, "right")
    where = dict(zip(buckets.tolist(), zip(low.tolist(), high.tolist())))

    def star(c):
        a, b = where[c]
        return stars[a:b], shared[a:b]

    falling = _scan(t, kind, buckets.tolist(), Queues(), star, False, raw, most)
    empty = np.zeros(0, np.int64)

    def larger(c):
        rows = falling.get(c)
        if rows is None:
            return empty, empty
        return rows[0][::-1], np.concatenate(([0], rows[1][:0:-1]))

    rising = _scan(t, kind, buckets[::-1].tolist(), Queues(), larger, True, raw, most)
    sa, lcp = [], []
    rising[0] = np.array([[n - 1], [0]])
    for c in buckets.tolist():
        one, two = falling.get(c), rising.get(c)
        if one is not None:
            sa.append(one[0])
            lcp.append(one[1])
        if two is not None:
            sa.append(two[0][::-1])
            seam = common_prefix(raw, sa[-2][-1:], sa[-1][:1], most) if one is not None else np.zeros(1, np.int64)
            lcp.append(np.concatenate((seam, two[1][:0:-1])))
    return np.concatenate(sa), np.concatenate(lcp)
