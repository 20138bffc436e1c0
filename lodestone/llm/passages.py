"""Near-duplicate passages by compact windows.

For one hash function, every stretch of a text has the shingle of least hash
in it as its min-hash.  The Cartesian tree of the hashes groups the stretches:
all of those inside (l, r) that contain c have min-hash c, if c's hash is the
least between l and r.  Only nodes with room for a stretch of the asked length matter;
these are the minimisers of the windows of that length, and their l and r are
the nearest smaller values among themselves.  Windows of two functions whose intervals meet in
room enough form a cell, whose stretches share both min-hashes.  Places of documents go, with their texts, where the
first holder of each of their cells is, so that all holders of a cell meet, and are compared there shingle by shingle.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, bucket_of, ids_of, in_sorted, known_keys, pack, shared_keys, text_blocks, texts_of, unpack
from .common import NULL_ID, components, cut, gram_hashes, mix64, release, released, space_table, span_hashes, words_of

#: Words of a shingle, least words of a passage, least similarity, hash functions.
SHINGLE, WORDS, SIMILARITY, FUNCTIONS = 5, 50, 0.8, 6
#: Matching shingles further apart than this, in words, or this far off their diagonal, begin a new passage.
GAP, DRIFT = 25, 12
#: Nodes that are compared in one place; meetings of windows looked at in one go.
TILE, MEETINGS = 512, 1 << 21
#: Cells less than a length's this share apart are one place.
JOIN = 4

_SPACES = space_table()
_SEEDS = mix64(np.arange(1, 65)) | np.uint64(1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Shingle hashes of a block's rows, in order: ``flat[at[i]:at[i + 1]]`` are row i's, the p-th begins at word p."""

    def __init__(self, table: pa.Table, n: int):
        raw = texts_of(table)
        buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        stops = np.cumsum(np.array([len(x) + 1 for x in raw], np.int64))
        s, e = words_of(buf, _SPACES)
        doc = np.searchsorted(stops, s, "right")
        self.buf, self.begin, self.end, self.word = buf, s, e, np.searchsorted(doc, np.arange(len(raw) + 1))
        gram = gram_hashes(span_hashes(_SPACES[buf], s, e), n)
        inside = doc[:len(gram)] == doc[n - 1:] if len(gram) else np.zeros(0, bool)
        self.flat, self.of = gram[inside], doc[:len(inside)][inside]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(self.of, minlength=len(raw)))))
        self.ids = ids_of(table)

    def words(self, row: int, lo: int, hi: int) -> bytes:
        """The text from word ``lo`` to before word ``hi`` of a row."""
        return self.buf[self.begin[self.word[row] + lo]:self.end[self.word[row] + hi - 1]].tobytes()

    def inside(self, t: int) -> np.ndarray:
        """How many windows of ``t`` shingles before each place lie in a single row."""
        if not hasattr(self, "_inside"):
            self._inside = np.concatenate(([0], np.cumsum(self.of[:len(self.of) - t + 1] == self.of[t - 1:])))
        return self._inside


class Slices:
    """Some rows' shingles as ``Shingles`` has them."""

    def __init__(self, parts: list[np.ndarray]):
        n = np.array([len(p) for p in parts])
        self.flat, self.of, self.at = np.concatenate(parts), np.repeat(np.arange(len(parts)), n), np.concatenate(([0], np.cumsum(n)))


#: Windows of a strip, and the low bits of a hash that give way to the place within it.
STRIP = 1 << 14
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
_ORDER = np.arange(STRIP + 4096, dtype=np.uint64)
_FIRST = np.zeros(1, np.int64)


def hashed(shingles: np.ndarray, function: int) -> np.ndarray:
    """The shingles' hashes under a function; what counts are the high bits."""
    return shingles * _SEEDS[function]


def compact_windows(s: Shingles, t: int, function: int) -> tuple[np.ndarray, ...]:
    """(row, l, c, r, value) of the windows with room for ``t`` shingles; positions within the row, r included.

    Of equal least hashes the leftmost counts; a window that lies inside that of an equal hash is left out.
    """
    m = len(s.flat) - t + 1
    if m <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.astype(np.uint64)
    # Strips that stay in a core's cache; each run of windows with one minimiser counts if one of them lies in a single row.
    runs, ends, where = [], [], []
    for lo in range(0, m, STRIP):
        key = hashed(s.flat[lo:lo + STRIP + t - 1], function)
        key &= ~_PLACE
        key |= _ORDER[:len(key)]
        span = 1
        while span * 2 <= t:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < t:
            key = np.minimum(key[:len(key) - (t - span)], key[t - span:])
        key &= _PLACE
        first = np.concatenate((_FIRST, np.flatnonzero(key[1:] != key[:-1]) + 1))
        runs.append(first + lo)
        ends.append(np.append(first[1:], len(key)) + lo)
        where.append(key[first].astype(np.int64) + lo)
    run, end, c = np.concatenate(runs), np.concatenate(ends), np.concatenate(where)
    inside = s.inside(t)
    c = c[inside[end] > inside[run]]
    c = c[np.concatenate(([True], c[1:] != c[:-1]))] if len(c) else c
    v = hashed(s.flat[c], function) >> _PLACE_BITS
    value, row, i = v, s.of[c], np.arange(len(c))
    before = np.where((i > 0) & (row == row[i - 1]), i - 1, -1) if len(c) else i
    while len(bad := np.flatnonzero((before >= 0) & (value[before] >= value))):
        before[bad] = before[before[bad]]
    after = np.where((i + 1 < len(c)) & (row == row[(i + 1) % max(len(c), 1)]), i + 1, -1) if len(c) else i
    while len(bad := np.flatnonzero((after >= 0) & (value[after] >= value))):
        after[bad] = after[after[bad]]
    # Equal hashes between the same two smaller ones: the leftmost of them has the window that holds the others'.
    under = np.where(before >= 0, before, -1 - row)
    o = np.lexsort((i, value, under))
    keep = np.zeros(len(c), bool)
    keep[o] = np.concatenate(([True], (under[o][1:] != under[o][:-1]) | (value[o][1:] != value[o][:-1]))) if len(c) else keep
    left = np.where(before >= 0, c[before] + 1, s.at[row])
    right = np.where(after >= 0, c[after] - 1, s.at[row + 1] - 1)
    base = s.at[row]
    return row[keep], (left - base)[keep], (c - base)[keep], (right - base)[keep], value[keep]


def cells(s: Shingles, t: int, functions: int) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, key): what stretches of ``t`` shingles and more have as min-hashes under two functions at once.

    Windows of one function are joined with those of the next where their intervals meet in room for
    ``t`` shingles that holds both least hashes, at ``lo`` and ``hi`` (places in ``flat``): all stretches in that
    meeting have the same pair of min-hashes, which is the key.  The functions go in a ring.  Rows without an id have none.
    """
    every = []
    for f in range(functions):
        row, left, c, right, value = compact_windows(s, t, f)
        ok = s.ids[row] != NULL_ID
        base = s.at[row[ok]]
        every.append((row[ok], left[ok] + base, c[ok] + base, right[ok] + base, value[ok]))
    out = []
    for f in range(functions):
        row, la, ca, ra, va = every[f]
        _, lb, cb, rb, vb = every[(f + 1) % functions]
        lo, hi = np.searchsorted(cb, la, "left"), np.searchsorted(cb, ra, "right")
        total = np.cumsum(hi - lo)
        at = 0
        while at < len(row):  # a bounded number of meetings at a time
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MEETINGS, "right")))
            n = (hi - lo)[at:end]
            i = np.repeat(np.arange(at, end), n)
            j = np.repeat(lo[at:end], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            ok = (lb[j] <= ca[i]) & (ca[i] <= rb[j]) & (np.minimum(ra[i], rb[j]) - np.maximum(la[i], lb[j]) + 1 >= t)
            i, j = i[ok], j[ok]
            out.append((row[i], np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j]), mix64(va[i] * _PAIR + vb[j] * np.uint64(64) + np.uint64(f))))
            at = end
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def _runs(at: np.ndarray, free: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Runs of ``t`` free neighbouring positions at least, as index ranges."""
    i = np.flatnonzero(free)
    if len(i) < t:
        return []
    cut_at = np.flatnonzero((np.diff(i) > 1) | (np.diff(at[i]) > 1)) + 1
    return [(int(r[0]), int(r[-1]) + 1) for r in np.split(i, cut_at) if len(r) >= t]


def _tiles(runs: list[tuple[int, int]], t: int) -> list[tuple[int, int]]:
    """Parts of runs, of bounded size, such that each window of up to ``2 * t`` lies in one."""
    return [(at, min(at + 6 * t, hi)) for lo, hi in runs for at in range(lo, max(hi - 2 * t, lo + 1), 4 * t)]


def _before(x: np.ndarray) -> np.ndarray:
    """The place of the same value before each, or -1."""
    o = np.argsort(x, kind="stable")
    out = np.full(len(x), -1)
    same = x[o][1:] == x[o][:-1]
    out[o[1:][same]] = o[:-1][same]
    return out


def _distinct(before: np.ndarray, length: int, counted: np.ndarray) -> np.ndarray:
    """How many different counted values each window of ``length`` has; a value counts at its first place in the window."""
    p = np.flatnonzero(counted)
    m = len(before) - length + 1
    lo, hi = np.maximum(np.maximum(before[p] + 1, p - length + 1), 0), np.minimum(p, m - 1) + 1
    ok = lo < hi
    return np.cumsum(np.bincount(lo[ok], minlength=m + 1) - np.bincount(hi[ok], minlength=m + 1))[:m]


#: Sequences of more shingles than this go to ``stretches`` without a look at their windows first.
LOOKED_AT = 1 << 16


def _windows(x: np.ndarray, known: np.ndarray, t: int) -> tuple[np.ndarray, ...]:
    """(different shingles, those that are ``known`` too, whether the sequence reaches so far) of the windows of ``t`` to ``2 * t``: a row per start."""
    m, pad = len(x) - t + 1, 2 * t - 1
    i = np.arange(m)[:, None]
    new = np.lib.stride_tricks.sliding_window_view(np.concatenate((_before(x), np.full(pad, len(x)))), 2 * t)[:m] < i
    size = np.cumsum(new, 1, dtype=np.int32)[:, t - 1:]
    new &= np.lib.stride_tricks.sliding_window_view(np.concatenate((known, np.zeros(pad, bool))), 2 * t)[:m]
    return size, np.cumsum(new, 1, dtype=np.int32)[:, t - 1:], i + np.arange(t, 2 * t + 1) <= len(x)


def able(a: np.ndarray, b: np.ndarray, t: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each start in either sequence, where the shortest window that may be similar to one of the other ends; a place past all ends if none may.

    Two windows have no more in common than what one of them has in common with the whole other sequence, and together no
    less than the one and what the other lacks.  Windows of sizes that go together only are held against each other; what
    is ruled out on one side no longer counts on the other.
    """
    sides, ok = [], []
    for x, y in ((a, b), (b, a)):
        sides.append(_windows(x, np.isin(x, y), t))
        ok.append(sides[-1][2] & (sides[-1][1] >= similarity * sides[-1][0] - 1e-9))
        if not ok[-1].any():
            return np.full(len(a) - t + 1, 1 << 60), np.full(len(b) - t + 1, 1 << 60)
    n = np.arange(2 * t + 1)
    together = np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :]) - 1e-9
    left = -1
    while left != (left := int(ok[0].sum() + ok[1].sum())):
        for one, other in ((0, 1), (1, 0)):
            (size, have, _), (size_o, have_o, _) = sides[one], sides[other]
            lack = np.full(2 * t + 1, 4 * t)  # by size, the least that a window of the other lacks
            np.minimum.at(lack, size_o[ok[other]], (size_o - have_o)[ok[other]])
            ok[one] &= have >= similarity * (size + np.where(together, lack[None, :], 4 * t).min(1)[size]) - 1e-9
    return tuple(np.where(x.any(1), np.arange(len(x)) + x.argmax(1) + t, 1 << 60) for x in ok)


def _holding(tiles: list[tuple[int, int]], ends: np.ndarray) -> list[tuple[int, int]]:
    """Those of the tiles that one of the windows lies in."""
    return [(lo, hi) for lo, hi in tiles if (ends[lo:hi] <= hi).any()]


def stretches(a: np.ndarray, b: np.ndarray, t: int, similarity: float) -> list[tuple]:
    """(start, end, start, end, Jaccard) in shingles of similar stretches of two sequences, apart from each other in ``a``.

    Windows of ``t`` to ``2 * t`` shingles of one are held against such windows of the other, by sets and in any order.
    What two windows lack, ``similarity`` times the union less what is common, falls by one at most for each shingle put
    to either and by ``similarity`` for each taken away; lengths that are too near to a failed pair of lengths are passed over.
    """
    if len(a) < t or len(b) < t:
        return []
    in_b, last_a = np.isin(a, b), _before(a)
    common = len(np.unique(a[in_b]))
    if common < similarity * _distinct(last_a, t, np.ones(len(a), bool)).min():  # longer windows have no fewer values
        return []
    in_a, last_b = np.isin(b, a), _before(b)
    if common < similarity * _distinct(last_b, t, np.ones(len(b), bool)).min():
        return []
    by = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[by], a, "left"), np.searchsorted(b[by], a, "right")
    p = np.repeat(np.arange(len(a)), hi - lo)
    q = by[np.repeat(lo, hi - lo) + np.arange(len(p)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
    xs, ys = np.arange(t, min(2 * t, len(a)) + 1), np.arange(t, min(2 * t, len(b)) + 1)
    most = np.full((len(xs), len(ys)), np.inf)  # the most by which windows of two lengths can be similar enough

    def away(steps, here):
        return np.where(steps > here, steps - here, similarity * (here - steps))

    held: dict = {}

    def side(last, common, length, which):
        """Sizes of the windows, and the most by which one of them can do with all that the other sequence has."""
        if (which, length) not in held:
            size = _distinct(last, length, np.ones(len(last), bool))
            held[which, length] = size, float((_distinct(last, length, common) - similarity * size).max())
        return held[which, length]

    best = None
    while best is None and len(alive := np.flatnonzero(most > -1e-9)):
        k, m = divmod(int(alive[0]), len(ys))
        ahead = min(k + 2, len(xs) - 1), min(m + 2, len(ys) - 1)
        k, m = ahead if most[ahead] > -1e-9 else (k, m)
        x, y = int(xs[k]), int(ys[m])
        (size_a, able_a), (size_b, able_b) = side(last_a, in_b, x, 0), side(last_b, in_a, y, 1)
        if able_a < -1e-9 or able_b < -1e-9:
            if able_a < -1e-9:
                most = np.minimum(most, (able_a + away(xs, x))[:, None])
            if able_b < -1e-9:
                most = np.minimum(most, (able_b + away(ys, y))[None, :])
            continue
        v, w = len(size_a), len(size_b)
        p0, p1 = np.maximum(np.maximum(last_a[p] + 1, p - x + 1), 0), np.minimum(p, v - 1) + 1
        q0, q1 = np.maximum(np.maximum(last_b[q] + 1, q - y + 1), 0), np.minimum(q, w - 1) + 1
        ok = (p0 < p1) & (q0 < q1)
        p0, p1, q0, q1 = p0[ok] * (w + 1), p1[ok] * (w + 1), q0[ok], q1[ok]
        edge = np.bincount(np.concatenate((p0 + q0, p1 + q1)), minlength=(v + 1) * (w + 1)) - np.bincount(
            np.concatenate((p0 + q1, p1 + q0)), minlength=(v + 1) * (w + 1))
        both = np.cumsum(np.cumsum(edge.astype(np.int32).reshape(v + 1, w + 1), 0, dtype=np.int32), 1, dtype=np.int32)[:v, :w]
        union = size_a[:, None] + size_b[None, :] - both
        over = both - similarity * union
        top = float(over.max())
        if top > -1e-9:
            c = int(np.where(over > -1e-9, both / union, 0).argmax())
            i, j = divmod(c, w)
            best = i, i + x, j, j + y, float(both[i, j] / union[i, j])
        else:
            most = np.minimum(most, top + away(xs, x)[:, None] + away(ys, y)[None, :])
    if best is None:
        return []
    i0, i1, j0, j1, jaccard = best
    grown = True
    while grown:  # both ends, as long as they stay as similar
        grown = False
        for c in ((i0 - 1, i1, j0 - 1, j1), (i0, i1 + 1, j0, j1 + 1)):
            if c[0] >= 0 and c[2] >= 0 and c[1] <= len(a) and c[3] <= len(b):
                u, v = set(a[c[0]:c[1]].tolist()), set(b[c[2]:c[3]].tolist())
                if (got := len(u & v) / len(u | v)) >= jaccard:
                    (i0, i1, j0, j1), jaccard, grown = c, got, True
    rest = [(x[0] + off, x[1] + off, *x[2:]) for off, part in ((0, a[:i0]), (i1, a[i1:])) for x in stretches(part, b, t, similarity)]
    return sorted([(i0, i1, j0, j1, jaccard), *rest])


def common_passages(pa_: np.ndarray, a: np.ndarray, pb: np.ndarray, b: np.ndarray, n: int, words: int, similarity: float,
                    first: bool = False) -> list[tuple]:
    """(start, end, start, end, Jaccard) in words of the passages that two shingle sequences have in common.

    Matching shingles are chained along diagonals.  A chain whose two stretches are similar
    enough is a passage; one that is not is cut at its widest gap and its parts are looked at in turn.
    What no chain covers is left to ``stretches``, which holds all windows against each other; with ``first`` only
    where no chain is a passage, and then the first one found will do.
    """
    by = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[by], a, "left"), np.searchsorted(b[by], a, "right")
    hit = np.flatnonzero(hi > lo)
    p, q = pa_[hit], pb[by[np.minimum(lo[hit], len(b) - 1)]] if len(b) else hit
    for k in np.flatnonzero(hi[hit] - lo[hit] > 1).tolist():  # of several places the one nearest to the diagonal before
        places = pb[by[lo[hit[k]]:hi[hit[k]]]]
        q[k] = places[np.abs(places - p[k] - (q[k - 1] - p[k - 1] if k else 0)).argmin()]
    ends = np.flatnonzero((np.diff(p) > GAP) | (np.abs(np.diff(q - p)) > DRIFT)) + 1
    chains = [c for c in np.split(np.arange(len(p)), ends) if len(c)]
    out = []
    while chains:
        c = chains.pop()
        i0, i1, j0, j1 = int(p[c[0]]), int(p[c[-1]]), int(q[c].min()), int(q[c].max())
        if min(i1 - i0, j1 - j0) + n < words:
            continue
        x = np.unique(a[np.searchsorted(pa_, i0):np.searchsorted(pa_, i1, "right")])
        y = np.unique(b[np.searchsorted(pb, j0):np.searchsorted(pb, j1, "right")])
        both = len(np.intersect1d(x, y, assume_unique=True))
        jaccard = both / (len(x) + len(y) - both)
        if jaccard >= similarity:
            out.append((i0, i1 + n, j0, j1 + n, jaccard))
            continue
        gaps = np.maximum(np.diff(p[c]), np.abs(np.diff(q[c])))
        widest = np.flatnonzero(gaps == gaps.max()) if len(gaps) else gaps
        if len(widest) and gaps[widest[0]] > 1:
            k = int(widest[np.abs(2 * widest - len(gaps)).argmin()])
            chains += [c[:k + 1], c[k + 1:]]
    if first and out:
        return sorted(out)
    t = words - n + 1
    taken = np.zeros(len(pa_), bool)
    for i0, i1, *_ in out:
        taken |= (pa_ > i0 - n) & (pa_ < i1)
    parts = _tiles(_runs(pb, np.ones(len(pb), bool), t), t) if len(hit) else []
    mine = _tiles(_runs(pa_, ~taken, t), t) if parts else []
    if mine and max(len(a), len(b)) <= LOOKED_AT:
        of_a, of_b = able(a, b, t, similarity)
        mine, parts = _holding(mine, of_a), _holding(parts, of_b)
    for lo, hi in mine:
        for left, right in parts:
            out += [(int(pa_[lo]) + x[0], int(pa_[lo]) + x[1] + n - 1, int(pb[left]) + x[2], int(pb[left]) + x[3] + n - 1, x[4])
                    for x in stretches(a[lo:hi], b[left:right], t, similarity)]
            if first and out:
                return sorted(set(out))
    return sorted(set(out))


class Nodes:
    """Places of a block's rows where cells lie that other documents have too, near ones joined.

    ``lo``, ``hi``: first and last shingle of the place, as far around the cells' least hashes as a passage may reach, within
    ``flat``.  ``name``: a hash of the shingles there where they are ``t`` at least, so that equal places
    are one node, and else of the document and place.
    """

    def __init__(self, s: Shingles, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: int):
        o = np.lexsort((hi, lo, row))
        row, lo, hi = row[o], lo[o], hi[o]
        reach = np.maximum.accumulate(hi) if len(hi) else hi  # rows follow one another in ``flat``
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (lo[1:] > reach[:-1] + t // JOIN)))[:len(row)]
        first = np.flatnonzero(new)
        self.row = row[first]
        self.lo = np.maximum(lo[first] - 2 * t, s.at[self.row])
        self.hi = np.minimum((np.maximum.reduceat(hi, first) if len(first) else hi) + 2 * t, s.at[self.row + 1] - 1)
        self.name = named(s, self.row, self.lo, self.hi, t)
        self.of = np.empty(len(row), np.int64)
        self.of[o] = np.cumsum(new) - 1


def named(s: Shingles, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: int) -> np.ndarray:
    inside = span_hashes(s.flat, lo, hi + 1)
    own = mix64(inside ^ mix64(s.ids[row] + (lo - s.at[row])))
    return np.where(hi - lo + 1 >= t, inside, own).view(np.int64)


def least_distinct(s: Slices, t: int) -> np.ndarray:
    """How many different shingles a stretch of ``t`` has at least, for each row; inf for shorter rows."""
    out = np.full(len(s.at) - 1, np.inf)
    if len(s.flat) < t:
        return out
    o = np.lexsort((s.flat, s.of))
    last = np.full(len(o), -1)
    same = (s.flat[o][1:] == s.flat[o][:-1]) & (s.of[o][1:] == s.of[o][:-1])
    last[o[1:][same]] = o[:-1][same]
    inside = np.flatnonzero(s.of[:len(s.of) - t + 1] == s.of[t - 1:])
    np.minimum.at(out, s.of[inside], _distinct(last, t, np.ones(len(last), bool))[inside])
    return out


class Group:
    """Nodes that meet: what their shingle sequences have in common, by an inverted index of shingles."""

    def __init__(self, docs: np.ndarray, s: Slices, left: int, t: int, similarity: float, elsewhere: list[list]):
        self.docs, self.s, self.t, self.similarity, self.m = docs, s, t, similarity, len(docs)
        self.elsewhere, self.meet = elsewhere, defaultdict(list)
        for x, heads in enumerate(elsewhere):
            for h in heads:
                self.meet[h].append(x)
        o = np.lexsort((s.of, s.flat))
        f, h = s.flat[o], s.of[o]
        first = np.concatenate(([True], (f[1:] != f[:-1]) | (h[1:] != h[:-1])))[:len(o)]
        keys, self.holder = f[first], h[first]
        self.begin, self.stop = np.searchsorted(keys, s.flat, "left"), np.searchsorted(keys, s.flat, "right")
        self.single = np.zeros(len(o), bool)  # shingles that occur once in their node
        self.single[o] = first & np.concatenate((first[1:], [True]))[:len(o)]
        self.left, self.need = left, np.ceil(similarity * least_distinct(s, t) - 1e-9)

    def postings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, which of ``at``) for each node that has the shingle at each place."""
        size = self.stop[at] - self.begin[at]
        which = np.repeat(np.arange(len(at)), size)
        return self.holder[np.repeat(self.begin[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)], which

    def partners(self, x: int) -> np.ndarray:
        """Nodes of other documents with enough shingles of ``x``, those with the most first.

        What two stretches have in common is ``similarity`` times the different shingles of either at least, which are
        fewer than its length where shingles repeat.
        """
        mine = np.arange(self.s.at[x], self.s.at[x + 1])
        mine = mine[self.stop[mine] - self.begin[mine] > 1]
        if len(mine) < self.need[x]:
            return mine[:0]
        count = np.bincount(self.postings(mine[np.unique(self.s.flat[mine], return_index=True)[1]])[0], minlength=self.m)
        ys = np.flatnonzero((count >= np.maximum(self.need, self.need[x])) & (self.docs != self.docs[x]))
        if self.left:
            ys = ys[(ys < self.left) != (x < self.left)]
        if self.elsewhere[x]:
            ys = ys[~np.isin(ys, [y for h in self.elsewhere[x] for y in self.meet[h]])]
        return ys[np.argsort(-count[ys], kind="stable")]

    def lacking(self, x: int, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, least number of shingles of a stretch of ``x`` of so many that a node of ``ys`` lacks); inf for lengths that ``x`` hasn't."""
        size, t = int(self.s.at[x + 1] - self.s.at[x]), self.t
        lengths = np.unique(np.concatenate([np.linspace(t, 2 * t, 9).astype(int), 2 * t * 2 ** np.arange(1, 24)]))
        out = np.full((len(ys), len(lengths)), np.inf)
        to = np.full(self.m, -1)
        for lo in range(0, len(ys), max(1, 4_000_000 // size)):
            part = ys[lo:lo + max(1, 4_000_000 // size)]
            to[:] = -1
            to[part] = np.arange(len(part))
            lacks = np.broadcast_to(self.single[self.s.at[x]:self.s.at[x + 1]], (len(part), size)).copy()
            node, at = self.postings(np.arange(self.s.at[x], self.s.at[x + 1]))
            ok = to[node] >= 0
            lacks[to[node[ok]], at[ok]] = False
            total = np.concatenate([np.zeros((len(part), 1), np.int32), np.cumsum(lacks, 1, dtype=np.int32)], 1)
            for k, n in enumerate(lengths):
                if n <= size:
                    out[lo:lo + len(part), k] = (total[:, n:] - total[:, :-n]).min(1)
        return lengths, out

    def possible(self, lx: np.ndarray, ly: np.ndarray, lengths: np.ndarray) -> bool:
        """Whether stretches of the two may be similar: what either lacks of the other is at most 1 / similarity - 1 times what they have in common."""
        longest = np.append(lengths[1:], 1 << 60) - 1
        i, j = np.flatnonzero(np.isfinite(lx)), np.flatnonzero(np.isfinite(ly))
        a, b = lx[i][:, None], ly[j][None, :]
        common = np.minimum(longest[i][:, None] - a, longest[j][None, :] - b)
        return bool((a + b <= (1 / self.similarity - 1) * common + 1e-9).any())


def verified(docs: np.ndarray, at: np.ndarray, s: Slices, root: np.ndarray, left: int, elsewhere: list[list], n: int, words: int, similarity: float) -> list[tuple]:
    """(x, y, passages) between nodes of a group, x's document after y's: enough to connect all that their passages connect.

    ``at``: first word of each node in its document.  ``root``: what is connected already.  ``left``: if not 0, pairs
    of one of the first ``left`` nodes with one of the others only.  ``elsewhere``: other groups of each node; what meets there too isn't compared here.
    Each node is compared first with those that share the most with it, until that fails.  Of the pairs that are apart then, those
    are compared that a bound by counts of shingles lets pass.
    """
    group, out, failed = Group(docs, s, left, words - n + 1, similarity, elsewhere), [], set()

    def compare(x: int, y: int, bounded: bool = False) -> None:
        if root[x] == root[y] or (min(x, y), max(x, y)) in failed:
            return
        if not bounded:
            lengths, lx = group.lacking(x, np.array([y]))
            if not group.possible(lx[0], group.lacking(y, np.array([x]))[1][0], lengths):
                failed.add((min(x, y), max(x, y)))
                return
        if (docs[x], at[x], x) < (docs[y], at[y], y):
            x, y = y, x
        a, b = s.flat[s.at[x]:s.at[x + 1]], s.flat[s.at[y]:s.at[y + 1]]
        got = common_passages(np.arange(len(a)), a, np.arange(len(b)), b, n, words, similarity, first=True)
        if got:
            root[root == root[x]] = root[y]
            out.append((x, y, [(p[0] + at[x], p[1] + at[x], p[2] + at[y], p[3] + at[y], p[4]) for p in got]))
        else:
            failed.add((min(x, y), max(x, y)))

    if len(docs) == 2:
        if docs[0] != docs[1]:
            compare(0, 1)
        return out
    partners = [group.partners(x) for x in range(len(docs))]
    active = range(len(docs))
    while active:  # each joins the one that it shares the most with and isn't joined to, until that fails
        still = []
        for x in active:
            other = partners[x][root[partners[x]] != root[x]][:1].tolist()
            if other:
                compare(x, other[0])
                if root[x] == root[other[0]]:
                    still.append(x)
        active = still
    apart = [ys[root[ys] != root[x]] for x, ys in enumerate(partners)]
    bound = {x: group.lacking(x, ys) for x, ys in enumerate(apart) if len(ys)}
    where = {x: {int(y): k for k, y in enumerate(apart[x])} for x in bound}
    for x in bound:
        for k, y in enumerate(apart[x].tolist()):
            if x < y and root[x] != root[y] and x in where.get(y, {}) and group.possible(bound[x][1][k], bound[y][1][where[y][x]], bound[x][0]):
                compare(x, y, bounded=True)
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("of_doc_id", pa.int64()), ("of_start", pa.int64()),
                    ("of_end", pa.int64()), ("jaccard", pa.float64()), ("a", pa.int64()), ("b", pa.int64())])
_SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("m", pa.int32()), ("low", pa.binary()), ("name", pa.binary()),
                   ("place", pa.binary()), ("n", pa.int32()), ("node", pa.binary()), ("new", pa.binary()),
                   ("own", pa.int64()), ("text", pa.binary())])
_NODE = pa.schema([("g", pa.int32()), ("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("node", pa.int64()), ("heads", pa.list_(pa.int64()))])
_PLACED = pa.schema([("place", pa.int64()), ("head", pa.string()), ("side", pa.int32()), ("root", pa.int64()), ("node", pa.int64()), ("heads", pa.list_(pa.int64())), ("doc", pa.int64()), ("first", pa.int64()),
                     ("size", pa.int32()), ("text", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def classes(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, component_id, n_passages`` for every row of ``docs(doc_id, text)``; ``options`` are those of ``passages``.

    Documents link when they have similar passages; ``component_id`` is the smallest id reachable by links, itself included,
    ``n_passages`` how many places of the document ``passages`` names.  Rows without an id link with nothing and have a null component.
    """
    found = cut(passages(docs, **options))
    joined = components(found.select(F.col("of_doc_id").alias("a"), F.col("doc_id").alias("b")))
    places = found.select(F.explode(F.array(F.struct("doc_id", "start_word", "end_word"), F.struct(
        F.col("of_doc_id").alias("doc_id"), F.col("of_start").alias("start_word"), F.col("of_end").alias("end_word")))).alias("p")).select("p.*")
    count = places.distinct().groupBy("doc_id").agg(F.count("*").alias("n")).join(joined, F.col("doc_id") == F.col("id")).select("id", "component", "n")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(count, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n", F.lit(0)).alias("n_passages"))


def passages(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, n: int = SHINGLE, functions: int = FUNCTIONS,
             block_bytes: int = BLOCK_BYTES, tile: int = TILE) -> DataFrame:
    """``doc_id, start_word, end_word, of_doc_id, of_start, of_end, jaccard``: passages that another document has.

    Passages of ``words`` words at least whose ``n``-word shingle sets (A-Z lower-cased, words are runs without
    ``\\x20\\x09-\\x0D``) have a Jaccard similarity of ``similarity`` or more; ``doc_id`` is the larger of the two.
    Equal passages are one class: the holders are paired with the one of least block and id, with similarity 1.  Different
    passages that share cells are compared among themselves until each is connected with all it can reach and each of its
    passages has been found with one partner; pairs that are connected already aren't spelt out.
    A null or short text has no passages, rows without an id are left out, rows of one id aren't compared with each
    other, other columns are ignored, and an empty table gives no rows.
    """
    t, b = words - n + 1, text_blocks(docs, block_bytes)
    n_blocks = b.n

    def keys(table):
        row, _, _, key = cells(Shingles(table, n), t, functions)
        return key, row

    def send(key, left, right):
        """Of each shared cell the block's node of least name, for the cell's bucket; the block's nodes and cells (bucket -1) and its nodes' texts (-2)."""
        if not left.num_rows or not right.num_rows:
            return _table([], _SENT)
        s = Shingles(left, n)
        row, lo, hi, k = cells(s, t, functions)
        bucket, low = bucket_of(k, n_blocks)
        k = (bucket.astype(np.uint64) << np.uint64(32)) | low
        ok = in_sorted(k, known_keys(right))
        if not ok.any():
            return _table([], _SENT)
        nodes, k = Nodes(s, row[ok], lo[ok], hi[ok], t), k[ok]
        o = np.lexsort((nodes.name[nodes.of], k))
        k, of, g, base = k[o], nodes.of[o], key[0].as_py(), s.at[nodes.row]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        first = np.flatnonzero(new)
        rows = [(-1, g, len(nodes.row), None, pack(nodes.name), pack(np.concatenate([s.ids[nodes.row], nodes.lo - base, nodes.hi - base])), len(k),
                 pack(of.astype(np.int32)), pack(new.view(np.uint8)), None, None)]
        for name, i in zip(*(x.tolist() for x in np.unique(nodes.name, return_index=True))):  # equal places have one text
            text = s.words(nodes.row[i], nodes.lo[i] - base[i], nodes.hi[i] - base[i] + n)
            rows.append((-2, g, len(text), *[None] * 6, name, pa.compress(text, codec="zstd", asbytes=True)))
        k, name = k[first], nodes.name[of[first]]
        bucket, low = (k >> np.uint64(32)).astype(np.int64), k.astype(np.uint32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        rows += [(int(x[0]), g, len(x), y.tobytes(), pack(z), *[None] * 6) for x, y, z in zip(np.split(bucket, cuts), np.split(low, cuts), np.split(name, cuts))]
        return _table(rows, _SENT)

    def meet(table):
        """The node of least name of each cell, for each block that has the cell."""
        rows = table.to_pylist()
        low = [np.frombuffer(r["low"], np.uint32) for r in rows]
        every, name = np.concatenate(low), np.concatenate([unpack(r["name"], r["m"], np.int64) for r in rows])
        uniq, at = np.unique(every, return_inverse=True)
        least = np.full(len(uniq), np.iinfo(np.int64).max)
        np.minimum.at(least, at, name)
        heads = np.split(least[at], np.cumsum([len(x) for x in low])[:-1])
        return _table([(r["bucket"], r["g"], r["m"], r["low"], pack(h)) for r, h in zip(rows, heads)], pa.schema(list(_SENT)[:5]))

    def place(key, left, right):
        """The block's nodes with the heads of their cells."""
        if not left.num_rows or not right.num_rows:
            return _table([], _NODE)
        rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])  # the block's cells are in order of bucket and key, as it sent them
        head = np.concatenate([unpack(r["name"], r["m"], np.int64) for r in rows])
        r, g = left.to_pylist()[0], key[0].as_py()
        doc, lo, hi = unpack(r["place"], 3 * r["m"], np.int64).reshape(3, -1).tolist()
        of, new = unpack(r["node"], r["n"], np.int32).astype(np.int64), unpack(r["new"], r["n"], np.uint8)
        pairs = np.unique(np.stack([of, head[np.cumsum(new, dtype=np.int64) - 1]], 1), axis=0)
        each = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, r["m"])))
        return _table(list(zip([g] * r["m"], doc, lo, hi, unpack(r["name"], r["m"], np.int64).tolist(), each)), _NODE)

    sent = cut(b.grouped().cogroup(shared_keys(b, keys).groupBy("g")).applyInArrow(
        released(send), "bucket int, g int, m int, low binary, name binary, place binary, n int, node binary, new binary, own long, text binary"))
    texts = sent.where("bucket = -2").select(F.col("g").alias("text_g"), "own", F.col("m").alias("size"), "text")
    headed = sent.where("bucket >= 0").select("bucket", "g", "m", "low", "name").groupBy("bucket").applyInArrow(released(meet), "bucket int, g int, m int, low binary, name binary")
    member = cut(sent.where("bucket = -1").drop("own", "text").groupBy("g").cogroup(headed.groupBy("g")).applyInArrow(
        released(place), "g int, doc long, lo long, hi long, node long, heads array<bigint>"))
    heads = member.groupBy("node").agg(F.min(F.struct("doc", "g", "lo", "hi")).alias("h"))
    meetings = cut(member.select("node", F.explode("heads").alias("head")).distinct())
    sizes = meetings.groupBy("head").agg(F.count("*").alias("m")).where("m > 1").select(
        F.col("head").alias("of_head"), F.when(F.col("m") > tile, F.ceil(2 * F.col("m") / tile).cast("int")).alias("tiles"))
    meetings = meetings.join(sizes, F.col("head") == F.col("of_head"))
    asked = cut(meetings.join(meetings.groupBy("node").agg(F.collect_set("head").alias("heads")), "node").join(heads, "node").select(
        "node", "head", "heads", "tiles", F.col("h.g").alias("g"), F.col("h.doc").alias("doc"), F.col("h.lo").alias("lo"), F.col("h.hi").alias("hi"),
        F.col("node").alias("root"), F.lit(None).cast("int").alias("others"), F.lit(False).alias("main")))

    def spread(batches):
        """Each node, with its text, at each of its places."""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [(zlib.crc32(head.encode()) % (4 * n_blocks), head, side, r["root"], r["node"], r["heads"], r["doc"], r["lo"], r["size"], r["text"]) for head, side in _places(r)]
                if len(rows) >= 1000:
                    yield from _table(rows, _PLACED).to_batches()
                    rows = []
            if rows:
                yield from _table(rows, _PLACED).to_batches()
        release()

    def compare(table):
        groups, texts, rows = defaultdict(dict), {}, []
        for r in table.to_pylist():
            groups[r["head"]].setdefault(r["node"], r)
        for name, found in list(groups.items()):
            here = int(name.split("/")[0])
            for r in found.values():
                r["heads"] = [h for h in r["heads"] if h < here]
            if set.intersection(*(set(r["heads"]) for r in found.values())):
                del groups[name]  # all of them meet elsewhere
                continue
            for r in found.values():
                texts.setdefault(r["node"], (len(texts), r))
        if not groups:
            return _table([], _FOUND)
        every = Shingles(pa.table({"doc_id": pa.array([r["doc"] for _, r in texts.values()], pa.int64()),
                                   "text": pa.array([pa.decompress(r["text"], r["size"], codec="zstd", asbytes=True) for _, r in texts.values()], pa.binary())}), n)
        for found in groups.values():
            some = sorted(found.values(), key=lambda r: (r["side"], r["doc"], r["first"], r["node"]))
            s = Slices([every.flat[every.at[i]:every.at[i + 1]] for i in (texts[r["node"]][0] for r in some)])
            left = sum(r["side"] == 0 for r in some)
            _, root = np.unique(np.array([r["root"] for r in some], np.int64), return_inverse=True)
            for x, y, got in verified(np.array([r["doc"] for r in some]), np.array([r["first"] for r in some]), s, root, left if left < len(some) else 0,
                                      [r["heads"] for r in some], n, words, similarity):
                rows += [(some[x]["doc"], p[0], p[1], some[y]["doc"], *p[2:], some[x]["node"], some[y]["node"]) for p in got]
        return _table(rows, _FOUND)

    def links(asked: DataFrame) -> DataFrame:
        # Texts come from what the blocks sent; the documents aren't read again.  Places take long for their size: so many parts, whatever the size.
        placed = asked.join(texts, (F.col("g") == F.col("text_g")) & (F.col("node") == F.col("own"))).mapInArrow(
            spread, "place long, head string, side int, root long, node long, heads array<bigint>, doc long, first long, size int, text binary").repartition(n_blocks, "place")
        return cut(placed.groupBy("place").applyInArrow(
            released(compare), "doc_id long, start_word long, end_word long, of_doc_id long, of_start long, of_end long, jaccard double, a long, b long"))

    # First, the nodes of a head that fit a tile are compared whole; of more, each node with those of its own and the next half tile.
    found = links(asked)
    # Then, what is left unconnected of the larger ones: nodes outside the largest component with those inside it and with each other.
    large = asked.where("tiles is not null")
    if not large.isEmpty():
        joined = components(found.select("a", "b")).select(F.col("id").alias("node"), F.col("component").alias("found_root"))
        rest = cut(large.select("node", "head", "heads", "g", "doc", "lo", "hi").join(joined, "node", "left").withColumn("root", F.coalesce("found_root", "node")).drop("found_root"))
        parts = rest.groupBy("head", "root").agg(F.count("*").alias("m"))
        apart = parts.groupBy("head").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("within"), F.sum("m").alias("all")).where("roots > 1")
        apart = apart.select(F.col("head").alias("apart"), F.col("main").alias("main_root"), F.ceil(2 * F.col("within") / tile).cast("int").alias("inner"),
                             F.ceil(2 * (F.col("all") - F.col("within")) / tile).cast("int").alias("outer"))
        main = F.col("root") == F.col("main_root")
        rest = rest.join(apart, F.col("head") == F.col("apart")).select(
            "node", "head", "heads", F.when(main, F.col("inner")).otherwise(F.col("outer")).alias("tiles"), "g", "doc", "lo", "hi", "root",
            F.when(main, F.col("outer")).otherwise(F.col("inner")).alias("others"), main.alias("main"))
        if not rest.isEmpty():
            found = found.unionByName(links(rest))
    copies = member.select("doc", "lo", "hi", "node").join(heads, "node").where(F.col("doc") > F.col("h.doc")).select(
        F.col("doc").alias("doc_id"), F.col("lo").alias("start_word"), (F.col("hi") + n).alias("end_word"), F.col("h.doc").alias("of_doc_id"),
        F.col("h.lo").alias("of_start"), (F.col("h.hi") + n).alias("of_end"), F.lit(1.0).alias("jaccard"))
    return b.restored(found.drop("a", "b").unionByName(copies).distinct(), "doc_id", "of_doc_id")


def _places(r: dict) -> list[tuple[str, int]]:
    """(place, side) of a node: one, those of two neighbouring half tiles, or those where it meets the nodes of other components."""
    c, tiles = r["head"], r["tiles"]
    if tiles is None:
        return [(f"{c}", 0)]
    k = r["node"] % tiles
    if r["others"] is None:
        return [(f"{c}/{k}", 0), (f"{c}/{(k + 1) % tiles}", 0)]
    if r["main"]:
        return [(f"{c}/m{k}/{q}", 0) for q in range(r["others"])]
    return [(f"{c}/m{q}/{k}", 1) for q in range(r["others"])] + [(f"{c}/o{min(k, q)}/{max(k, q)}", int(q < k)) for q in range(tiles)]
