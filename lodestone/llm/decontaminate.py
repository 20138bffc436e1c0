"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question that
was given other values has the template of the original.  Windows of five template tokens
of the documents are looked up in a table of the benchmark's windows; where
enough of an item's windows lie along one alignment, the values behind the
placeholders are compared: one value of the item must stand for one value in
the document throughout.

A capital tells a name only inside a sentence, so texts have three readings, each looked up in its own table:
names by capitals inside sentences, by capitals anywhere but on common opening words, and none at all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mix64, span_hashes

#: Template tokens of a window, share of an item's windows that must be found, share of its slots that must agree.
WINDOW, COVERAGE, AGREEMENT = 5, 0.8, 0.8
#: Most characters of benchmark text in one block, whose table goes to every worker.
BLOCK_CHARS = 8_000_000
#: Equal windows of documents and items looked at in one go.
HITS = 4_000_000

UNITS = """mm cm m km mg g kg t ml l s sec second seconds min minute minutes h hour hours day days week weeks month months
year years mile miles inch inches foot feet yard yards pound pounds ounce ounces gallon gallons liter liters litre litres
meter meters metre metres gram grams kilogram kilograms kilometer kilometers dollar dollars cent cents euro euros percent
degree degrees mph kmh hz khz mhz ghz kb mb gb tb w kw v volt volts watt watts joule joules newton newtons""".split()
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
#: Words that open sentences and are no names.
OPENERS = """a an the this that these those there here it its he she they we you i his her their our your my one each every all some
any no both how what when where which who whom whose why if then so and but or for in on at by from to of with without as after before
during while since until because although though given suppose assume let is are was were be do does did has have had can could will
would should may might must not now next later today yesterday finally first second third also however therefore find calculate compute solve
determine evaluate simplify write show prove explain describe choose select consider use give name list answer question""".split()

_PLAIN, _NUMBER, _NAME, _UNIT = range(4)
#: Readings of capitals: inside sentences, anywhere but on openers, nowhere.
_INSIDE, _ANYWHERE, _NOWHERE = range(3)
_SLOT = mix64(np.arange(101, 105))


def _letters() -> np.ndarray:
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


_LETTER = _letters()


def _listed(words: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return np.unique(span_hashes(buf, ends - [len(w) for w in words], ends))


@dataclass
class Tokens:
    """Template tokens of many texts: class, hash of the value, text number; ``first[i]`` the first token of text ``i``."""

    kind: np.ndarray
    value: np.ndarray
    text: np.ndarray
    first: np.ndarray
    kinds: tuple[np.ndarray, ...] = ()

    def read(self, reading: int) -> Tokens:
        return Tokens(self.kinds[reading], self.value, self.text, self.first)

    @property
    def template(self) -> np.ndarray:
        return np.where(self.kind == _PLAIN, self.value, _SLOT[self.kind])


def tokens(texts: list[str | None]) -> Tokens:
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    lens = np.array([len(r) + 1 for r in raw], np.int64)
    digit = (buf >= 48) & (buf <= 57)
    solid = _LETTER[buf].copy()
    if len(buf) > 2:  # a point or comma between digits belongs to the number
        solid[1:-1] |= ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & digit[:-2] & digit[2:]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    s, e = edge[0::2], edge[1::2]
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    wide = np.zeros(len(buf), bool)  # Latin-1 capitals: 0xC3 0x80-0x9E but the multiplication sign
    if len(buf) > 1:
        wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[wide] += 32
    value = span_hashes(low, s, e)
    text = np.searchsorted(np.cumsum(lens), s, "right")
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    stop = np.isin(buf, np.frombuffer(b".!?:\n", np.uint8)) & ~solid
    stops = np.concatenate(([0], np.cumsum(stop)))
    opens = np.ones(len(s), bool)
    if len(s) > 1:
        opens[1:] = (stops[s[1:]] > stops[e[:-1]]) | (text[1:] != text[:-1])
    capital = ((buf[s] >= 65) & (buf[s] <= 90)) | ((e - s > 1) & wide[np.minimum(s + 1, max(len(buf) - 1, 0))]) if len(s) else np.zeros(0, bool)
    numeral, measure = np.isin(value, _listed(NUMBER_WORDS)), np.isin(value, _listed(UNITS))
    kinds = []
    for name in (capital & ~opens, capital & ~numeral & ~np.isin(value, _listed(OPENERS)), np.zeros(len(s), bool)):
        kind = np.where(digit[s] if len(s) else np.zeros(0, bool), _NUMBER, np.where(name, _NAME, _PLAIN))
        kind[numeral & (kind == _PLAIN)] = _NUMBER
        if len(s) > 1:
            unit = measure[1:] & (kind[:-1] == _NUMBER) & (text[1:] == text[:-1]) & (kind[1:] != _NUMBER)
            kind[1:][unit] = _UNIT
        kinds.append(kind)
    return Tokens(kinds[_INSIDE], value, text, first, tuple(kinds))


@dataclass
class Block:
    """The windows of some benchmark items, by hash; rows ``[at[i], at[i + 1])`` of item and pos have hash ``keys[i]``."""

    ids: list
    kind: list[np.ndarray]
    value: list[np.ndarray]
    n_windows: np.ndarray
    lengths: list[int]
    keys: dict[int, np.ndarray]
    at: dict[int, np.ndarray]
    item: dict[int, np.ndarray]
    pos: dict[int, np.ndarray]
    others: tuple[Block, ...] = ()


def block(items: list[tuple]) -> Block:
    """The first reading of some items, with the ``others``."""
    t = tokens([x for _, x in items])
    out, *others = (_block(items, t.read(k)) for k in (_INSIDE, _ANYWHERE, _NOWHERE))
    out.others = tuple(others)
    return out


def _block(items: list[tuple], t: Tokens) -> Block:
    """Items without tokens have no windows; one of fewer than ``WINDOW`` tokens is one window of its own length.

    Windows of placeholders alone say nothing of a template: an item has them only where it has no others, and then by their values.
    """
    sizes = np.diff(t.first)
    n = np.zeros(len(sizes), np.int64)
    out = Block([i for i, _ in items], [], [], n, sorted({int(min(WINDOW, x)) for x in sizes if x}), {}, {}, {}, {})
    template, by = t.template, defaultdict(list)
    for i in range(len(items)):
        a, b = t.first[i], t.first[i + 1]
        out.kind.append(t.kind[a:b])
        out.value.append(t.value[a:b])
        if b > a:
            w = int(min(WINDOW, b - a))
            h, plain = _windows(t.kind[a:b], template[a:b], t.value[a:b], w)
            at = np.flatnonzero(plain) if plain.any() else np.arange(len(h))
            n[i] = len(at)
            by[w].append((i, h[at], at))
    for w, found in by.items():
        h = np.concatenate([x for _, x, _ in found])
        item, pos = np.concatenate([np.full(len(x), i) for i, x, _ in found]), np.concatenate([at for _, _, at in found])
        o = np.argsort(h, kind="stable")
        out.keys[w], first = np.unique(h[o], return_index=True)
        out.at[w], out.item[w], out.pos[w] = np.append(first, len(h)), item[o], pos[o]
    return out


def _windows(kind: np.ndarray, template: np.ndarray, value: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``w`` tokens, and which of them have a plain word; the others are hashed by value."""
    h = gram_hashes(template, w)
    if not len(h):
        return h, np.zeros(0, bool)
    words = np.concatenate(([0], np.cumsum(kind == _PLAIN)))
    plain = words[w:] > words[:-w]
    bare = np.flatnonzero(~plain)
    if len(bare):
        h[bare] = gram_hashes(value, w)[bare] ^ _SLOT[0]
    return h, plain


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; null texts and ids are passed over."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    for r in rows.orderBy("i", "t").toLocalIterator():
        if held and size + len(r[1]) > chars:
            yield block(held)
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield block(held)


def matches(texts: list[str | None], b: Block, coverage: float = COVERAGE, agreement: float = AGREEMENT) -> list[tuple]:
    """(text number, item id, coverage, first and last token, slots, agreement) of every leak, by the first reading that shows it."""
    t = tokens(texts)
    out = _matches(t, b, coverage, agreement)
    for k, other in enumerate(b.others, 1):
        seen = {m[:2] for m in out}
        out += [m for m in _matches(t.read(k), other, coverage, agreement) if m[:2] not in seen]
    return out


def _alignment(diag: np.ndarray, pos: np.ndarray, need: float, wide: int) -> tuple | None:
    """(windows, diagonals, positions) of the band of ``wide`` diagonals that has the most windows of an item, if they are enough.

    The diagonals are ascending; one pass over them counts the windows of each band.
    """
    ends = np.searchsorted(diag, diag + wide, "right")
    starts = np.flatnonzero(np.concatenate(([True], diag[1:] != diag[:-1])))
    starts = starts[ends[starts] - starts >= need]
    if not len(starts):
        return None
    held, count, lo, hi, best = np.zeros(int(pos.max()) + 1, np.int64), 0, int(starts[0]), int(starts[0]), None
    if wide == 0:  # a window lies on a diagonal once
        s = int(starts[(ends[starts] - starts).argmax()])
        best = (int(ends[s]) - s, s, int(ends[s]))
    else:
        p = pos.tolist()
        for s in starts.tolist():
            if s > hi:
                held[:], count, lo, hi = 0, 0, s, s
            while lo < s:
                held[p[lo]] -= 1
                count -= held[p[lo]] == 0
                lo += 1
            while hi < ends[s]:
                count += held[p[hi]] == 0
                held[p[hi]] += 1
                hi += 1
            if count >= need and (best is None or count > best[0]):
                best = (int(count), s, int(ends[s]))
    return None if best is None else (best[0], diag[best[1]:best[2]], pos[best[1]:best[2]])


def _matches(t: Tokens, b: Block, coverage: float, agreement: float) -> list[tuple]:
    template, found = t.template, []
    for w in b.lengths:
        h, _ = _windows(t.kind, template, t.value, w)
        if not len(h):
            continue
        keys = b.keys[w]
        k = np.searchsorted(keys, h)
        ok = np.flatnonzero((k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == h) & (t.text[:len(h)] == t.text[w - 1:]))
        found.append((w, ok, b.at[w][k[ok]], b.at[w][k[ok] + 1]))
    texts = np.unique(np.concatenate([t.text[ok] for _, ok, _, _ in found])) if found else np.zeros(0, np.int64)
    out: list[tuple] = []
    _some(t, b, found, texts, 0, len(b.ids), coverage, agreement, out)
    return out


def _some(t: Tokens, b: Block, found: list[tuple], texts: np.ndarray, low: int, high: int, coverage: float, agreement: float, out: list[tuple]) -> None:
    """The matches of some texts (numbers, ascending) with the items from ``low`` to before ``high``, no more than ``HITS`` equal windows at a time."""
    if not len(texts):
        return
    parts = [(w, ok[s], lo[s], hi[s]) for w, ok, lo, hi in found for s in [slice(*np.searchsorted(t.text[ok], [texts[0], texts[-1] + 1]))]]
    if sum(int((hi - lo).sum()) for _, _, lo, hi in parts) > HITS and (len(texts) > 1 or high - low > 1):
        if len(texts) > 1:
            for half in (texts[:len(texts) // 2], texts[len(texts) // 2:]):
                _some(t, b, parts, half, low, high, coverage, agreement, out)
        else:
            # Entries of one window are in order of item, so a range of items is a range of them.
            middle = (low + high) // 2
            at = [np.array([lo_ + np.searchsorted(b.item[w][lo_:hi_], middle) for lo_, hi_ in zip(lo, hi)], np.int64) for w, _, lo, hi in parts]
            _some(t, b, [(w, ok, lo, m) for (w, ok, lo, _), m in zip(parts, at)], texts, low, middle, coverage, agreement, out)
            _some(t, b, [(w, ok, m, hi) for (w, ok, _, hi), m in zip(parts, at)], texts, middle, high, coverage, agreement, out)
        return
    hits = []
    for w, ok, lo, hi in parts:
        n = hi - lo
        where = np.repeat(ok, n)
        src = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        hits.append(np.stack([t.text[where], b.item[w][src], where - t.first[t.text[where]] - b.pos[w][src], b.pos[w][src]]))
    if not hits:
        return
    hit = np.concatenate(hits, 1)
    hit = hit[:, np.lexsort(hit[::-1])]
    new = np.flatnonzero(np.any(np.diff(hit[:2], axis=1, prepend=-1) != 0, axis=0))
    for lo, hi in zip(new, np.append(new[1:], hit.shape[1])):
        text, item = hit[0, lo], hit[1, lo]
        need = coverage * b.n_windows[item]
        if hi - lo < need:
            continue
        diag, pos = hit[2, lo:hi], hit[3, lo:hi]
        slack = max(1, len(b.kind[item]) // 10)  # words put in or left out move the alignment
        best = _alignment(diag, pos, need, 0) or _alignment(diag, pos, need, slack)  # a single diagonal that will do is taken alone
        if best is None:
            continue
        w = min(WINDOW, len(b.kind[item]))
        pairs = {(int(p) + j, int(p + d) + j) for d, p in zip(best[1], best[2]) for j in range(w)}
        a = t.first[text]
        votes: dict = defaultdict(lambda: defaultdict(int))
        for i, j in pairs:
            if b.kind[item][i] != _PLAIN:
                votes[int(b.kind[item][i]), int(b.value[item][i])][int(t.value[a + j])] += 1
        slots = sum(sum(v.values()) for v in votes.values())
        agree = sum(max(v.values()) for v in votes.values()) / slots if slots else 1.0
        if slots == len(pairs) and any(set(v) != {value} for (_, value), v in votes.items()):
            continue  # nothing but placeholders: only the same values are the same question
        if agree >= agreement:
            at = [j for _, j in pairs]
            out.append((int(text), b.ids[item], best[0] / b.n_windows[item], min(at), max(at) + 1, slots, agree))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, agreement: float = AGREEMENT) -> DataFrame:
    """``doc_id, item_id, coverage, first_token, end_token, slots, agreement``: a row for each document row and item it leaks.

    A null or empty text leaks nothing; null ids stay null; repeated rows are reported each; other columns are
    ignored; an empty benchmark or table gives no rows.  The benchmark goes
    through in blocks of at most ``BLOCK_CHARS`` characters, each against all documents.
    """
    schema = "doc_id long, item_id long, coverage double, first_token long, end_token long, slots long, agreement double"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for b in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(b)

        def find(batches, shared=shared):
            for part in slices(batches, 1):
                ids = part.column(0).to_pylist()
                rows = [(ids[m[0]], *m[1:]) for m in matches(part.column(1).to_pylist(), shared.value, coverage, agreement)]
                cols = list(zip(*rows)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

        out = out.unionByName(d.mapInArrow(find, schema))
    return out


def slices(batches, text_column: int, size: int = 4_000_000):
    """Parts of Arrow batches with about ``size`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    for b in batches:
        n = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(n, (n[lo - 1] if lo else 0) + size, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, agreement: float = AGREEMENT) -> DataFrame:
    """``docs`` without the rows that leak an item; all columns kept, nothing shuffled."""
    at = docs.columns.index("text")
    for b in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(b)

        def keep(batches, shared=shared):
            for part in slices(batches, at):
                bad = {m[0] for m in matches(part.column(at).to_pylist(), shared.value, coverage, agreement)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)]))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
