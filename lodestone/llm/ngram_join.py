"""N-gram Jaccard self-join: size-banded tiles with hashed bitmap signatures.

A text's set is its distinct word n-grams.  Two sets whose Jaccard similarity
reaches the threshold share one of their least hashes (the prefix filter),
so sets meet under the prefix hashes that more than one of them has.  Sets
that meet are held against each other by size and by bitmap: a bit of x that y lacks is an
n-gram of x that y lacks, so bit counts bound the overlap from above.
Sets that pass are clustered, and clusters are compared exactly,
sorted array with sorted array, in tiles of one size band and the next.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_BYTES, Blocks, bucket_of, ids_of, in_sorted, is_shared, known_keys, pack, rows_of, shared_keys, text_blocks, texts_of, unpack
from .common import NULL_ID, components, cut, drop_shuffles, gram_hashes, mix64, released, space_table, span_hashes, spanning, words_of

#: Sets of a tile; groups of at most so many sets are compared by shifts, larger ones set by set.
TILE, SMALL = 512, 24
_SPACES = space_table()
_SEED = np.uint64(0xA0761D6478BD642F)


class Sets:
    """The n-gram sets of a block's rows: ``flat[at[i]:at[i + 1]]`` are row i's sorted distinct hashes."""

    def __init__(self, table: pa.Table, n: int):
        raw = texts_of(table)
        buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        stops = np.cumsum(np.array([len(x) + 1 for x in raw], np.int64))
        s, e = words_of(buf, _SPACES)
        word = span_hashes(_SPACES[buf], s, e)
        doc = np.searchsorted(stops, s, "right")
        gram = gram_hashes(word, n)
        inside = doc[:len(gram)] == doc[n - 1:] if len(gram) else np.zeros(0, bool)
        gram, of = gram[inside], doc[:len(inside)][inside]
        count = np.bincount(doc, minlength=len(raw))
        few = np.flatnonzero((count > 0) & (count < n))  # fewer words than n: the whole sequence
        if len(few):
            first = np.searchsorted(doc, few)
            extra = np.array([gram_hashes(word[a:a + count[i]], int(count[i]))[0] ^ _SEED for i, a in zip(few, first)], np.uint64)
            gram, of = np.concatenate([gram, extra]), np.concatenate([of, few])
        o = np.lexsort((gram, of))
        gram, of = gram[o], of[o]
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1]))) if len(o) else np.zeros(0, bool)
        self.flat, self.of = gram[new], of[new]
        self.n = np.bincount(self.of, minlength=len(raw))
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.flat * np.uint64(0xE7037ED1A0B428DB)))), np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(self.flat ^ _SEED))))
        self.s1, self.s2 = (mix64(t[self.at[1:]] - t[self.at[:-1]] + self.n.astype(np.uint64)).view(np.int64) for t in sums)
        self.ids = ids_of(table)

    def distinct(self) -> np.ndarray:
        """Of the rows with a set and an id, the one of least id for each set."""
        rows = np.flatnonzero((self.n > 0) & (self.ids != NULL_ID))
        o = rows[np.lexsort((self.ids[rows], self.s2[rows], self.s1[rows], self.n[rows]))]
        new = np.concatenate(([True], (self.s1[o[1:]] != self.s1[o[:-1]]) | (self.s2[o[1:]] != self.s2[o[:-1]]) | (self.n[o[1:]] != self.n[o[:-1]]))) if len(o) else np.zeros(0, bool)
        return o[new]

    def prefix(self, rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of the least hashes of which two linked sets share one."""
        size = self.n[rows] - -(-num * self.n[rows] // den) + 1
        at = np.repeat(self.at[rows], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        return self.flat[at], np.repeat(rows, size)


def width(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: the power of two that is its size at least, 64 or more."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def bitmaps(sets: Sets, rows: np.ndarray) -> list[np.ndarray]:
    out = []
    for r, w in zip(rows, width(sets.n[rows])):
        bits = np.zeros(w, np.uint8)
        bits[(sets.flat[sets.at[r]:sets.at[r + 1]] >> np.uint64(20)).astype(np.int64) & (w - 1)] = 1
        out.append(np.packbits(bits, bitorder="little").view(np.uint64))
    return out


def may_link(ni, nj, missing_i, missing_j, num: int, den: int):
    """Whether sets of these sizes, with so many bits that the other lacks, can reach num / den."""
    most = np.minimum(ni - missing_i, nj - missing_j)
    return den * most >= num * (ni + nj - most)


def _pairs(group: np.ndarray, n: np.ndarray, maps: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of entries of one group (rows sorted by group and size) that sizes and bitmaps let pass."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    words = np.array([len(m) for m in maps], np.int64)
    i, j = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, SMALL):
        k = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if len(group) > d else np.zeros(0, np.int64)
        if not len(k):
            break
        k = k[den * n[k] >= num * n[k + d]]
        i.append(k)
        j.append(k + d)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if i:
        i, j = np.concatenate(i), np.concatenate(j)
        for wi, wj in {(int(a), int(b)) for a, b in zip(words[i], words[j])}:
            some = np.flatnonzero((words[i] == wi) & (words[j] == wj))
            for lo in range(0, len(some), max(1, 2_000_000 // wj)):
                a, b = i[some[lo:lo + max(1, 2_000_000 // wj)]], j[some[lo:lo + max(1, 2_000_000 // wj)]]
                x, y = np.stack([maps[t] for t in a]), _fold(np.stack([maps[t] for t in b]), wi)
                ok = may_link(n[a], n[b], np.bitwise_count(x & ~y).sum(1, dtype=np.int64), np.bitwise_count(y & ~x).sum(1, dtype=np.int64), num, den)
                out.append((a[ok], b[ok]))
    for s, z in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        out += _large(np.arange(s, s + z), n, maps, words, num, den)
    return [(int(a), int(b)) for x, y in out for a, b in zip(x, y)]


def _fold(m: np.ndarray, w: int) -> np.ndarray:
    while m.shape[-1] > w:
        half = m.shape[-1] // 2
        m = m[..., :half] | m[..., half:]
    return m


def _large(rows: np.ndarray, n: np.ndarray, maps: list[np.ndarray], words: np.ndarray, num: int, den: int) -> list:
    """One large group: each set against the next larger ones, those already connected with it left out."""
    out, root = [], np.arange(len(rows))
    by_width = {int(w): np.flatnonzero(words[rows] == w) for w in np.unique(words[rows])}
    mats = {w: np.stack([maps[rows[k]] for k in at]) for w, at in by_width.items()}
    for k in range(len(rows)):
        top = np.searchsorted(n[rows], den * n[rows[k]] // num, "right")
        for w, at in by_width.items():
            lo, hi = np.searchsorted(at, k + 1), np.searchsorted(at, top)
            if lo >= hi:
                continue
            some = np.arange(lo, hi)[root[at[lo:hi]] != root[k]]
            if not len(some):
                continue
            x, y = maps[rows[k]], _fold(mats[w][some], int(words[rows[k]]))
            ok = may_link(n[rows[k]], n[rows[at[some]]], np.bitwise_count(x & ~y).sum(1, dtype=np.int64), np.bitwise_count(y & ~x).sum(1, dtype=np.int64), num, den)
            hit = at[some[ok]]
            if len(hit):
                out.append((np.full(len(hit), rows[k]), rows[hit]))
                root[np.isin(root, root[hit])] = root[k]
    return out


def exact_links(sets: list[tuple], num: int, den: int, left: int | None = None) -> list[tuple[int, int]]:
    """Links enough to connect what all links between the sets connect.

    ``sets``: (size, array, id) sorted by size.  ``left``: only pairs of one of
    the first ``left`` and one of the others, for tiles that are compared inside elsewhere.
    """
    root, out = list(range(len(sets))), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    order = sorted(range(len(sets)), key=lambda k: sets[k][0])
    for x, i in enumerate(order):
        ni, a, id_i = sets[i]
        for j in order[x + 1:]:
            nj, b, id_j = sets[j]
            if num * nj > den * ni:
                break
            if left is not None and (i < left) == (j < left):
                continue
            if find(i) == find(j):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if den * both >= num * (ni + nj - both):
                root[find(j)] = find(i)
                out.append((id_i, id_j))
    return out


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block_bytes: int = BLOCK_BYTES, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    A-Z is lower-cased, words are runs without ``\\x20\\x09-\\x0D``; a text of fewer than n words is one shingle of all of
    them, one without words (or null) has an empty set and links with nothing.  Sets link at
    ``den * |intersection| >= num * |union|``; ``component_id`` is the smallest id reachable by links.
    Rows of one ``doc_id`` are one node; rows without an id link with nothing and have a null component.
    Empty tables give no rows; other columns are ignored.
    """
    b = text_blocks(docs, block_bytes)
    return b.restored(_join(b, n, num, den, tile).select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "doc_id", "component_id")


def deduplicate(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block_bytes: int = BLOCK_BYTES, tile: int = TILE) -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``jaccard_join`` links to one of smaller id.

    Of several rows of one id the one of least block and text stays; rows without an id all stay.
    """
    b = text_blocks(docs, block_bytes, whole_rows=True)
    keep = _join(b, n, num, den, tile).where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.min("g").alias("g"))

    def pick(left, right):
        if not left.num_rows:
            return left.select(["rest", "text"])
        ids, good = ids_of(left), np.sort(right.column("doc_id").to_numpy()) if right.num_rows else np.zeros(0, np.int64)
        order = np.array(sorted(range(len(ids)), key=lambda i, t=left.column("text").to_pylist(): (ids[i], t[i])))
        first = np.ones(len(ids), bool)
        first[order[1:]] = ids[order[1:]] != ids[order[:-1]]
        return left.filter(pa.array((ids == NULL_ID) | (first & in_sorted(ids, good)))).select(["rest", "text"])

    kept = b.grouped().cogroup(keep.groupBy("g")).applyInArrow(released(pick), T.StructType([b.frame.schema["rest"], b.frame.schema["text"]]))
    return rows_of(kept, docs)


def _join(b: Blocks, n: int, num: int, den: int, tile: int) -> DataFrame:
    """``doc_id, g, n, component_id`` of every row."""
    n_blocks = b.n

    def digest(table):
        s = Sets(table, n)
        return pa.table({"doc_id": table.column("doc_id"), "g": table.column("g"), "n": pa.array(s.n, pa.int64()), "s1": pa.array(s.s1, pa.int64()), "s2": pa.array(s.s2, pa.int64())})

    def keys(table):
        s = Sets(table, n)
        return s.prefix(s.distinct(), num, den)

    def send(key, left, right):
        rows = []
        if left.num_rows and right.num_rows:
            s = Sets(left, n)
            h, of = s.prefix(s.distinct(), num, den)
            ok = is_shared(h, known_keys(right), n_blocks)
            bucket, low = bucket_of(h[ok], n_blocks)
            of = of[ok]
            used = np.unique(of)
            maps = dict(zip(used.tolist(), bitmaps(s, used)))
            o = np.argsort(bucket, kind="stable")
            for part in (np.split(o, np.flatnonzero(np.diff(bucket[o])) + 1) if len(o) else []):
                mine, index = np.unique(of[part], return_inverse=True)
                rows.append((int(bucket[part[0]]), len(part), len(mine), low[part].tobytes(), pack(index.astype(np.int32)), pack(s.n[mine].astype(np.int64)),
                             s.s1[mine].tobytes(), b"".join(maps[int(r)].tobytes() for r in mine)))
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=["bucket", "n", "m", "low", "idx", "size", "s1", "maps"])

    def meet(table):
        low, idx, size, s1, maps, base = [], [], [], [], [], 0
        for r in table.to_pylist():
            low.append(np.frombuffer(r["low"], np.uint32))
            idx.append(unpack(r["idx"], r["n"], np.int32) + base)
            m = unpack(r["size"], r["m"], np.int64)
            size.append(m)
            s1.append(np.frombuffer(r["s1"], np.int64))
            flat = np.frombuffer(r["maps"], np.uint64)
            maps += np.split(flat, np.cumsum(width(m) // 64)[:-1])
            base += r["m"]
        low, idx, size, s1 = (np.concatenate(x) for x in (low, idx, size, s1))
        # Equal sets of several blocks are one.
        _, first, same = np.unique(s1, return_index=True, return_inverse=True)
        idx = first[same[idx]]
        o = np.lexsort((s1[idx], size[idx], low))
        low, idx = low[o], idx[o]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (idx[1:] != idx[:-1])))
        low, idx = low[new], idx[new]
        alone = np.bincount(np.cumsum(np.concatenate(([True], low[1:] != low[:-1]))) - 1)
        many = np.repeat(alone > 1, alone)
        low, idx = low[many], idx[many]
        found = _pairs(low, size[idx], [maps[k] for k in idx], num, den) if len(low) else []
        i, j = (idx[np.array(x, np.int64)] for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        keep = spanning(base, i, j)
        return pa.table({"a": pa.array(s1[i[keep]], pa.int64()), "b": pa.array(s1[j[keep]], pa.int64())})

    digests = cut(b.grouped().applyInArrow(released(digest), "doc_id long, g int, n long, s1 long, s2 long"))
    shared = shared_keys(b, keys)
    sent = b.grouped().cogroup(shared.groupBy("g")).applyInArrow(released(send), "bucket int, n int, m int, low binary, idx binary, size binary, s1 binary, maps binary")
    plausible = cut(sent.groupBy("bucket").applyInArrow(released(meet), "a long, b long").distinct())
    drop_shuffles(b.frame.sparkSession)
    clusters = cut(components(plausible))
    drop_shuffles(b.frame.sparkSession)
    links = _verify(b, digests, clusters, n, num, den, tile)

    known = digests.where("n > 0 and doc_id is not null")
    classes = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    # Rows of one id are one node, also when their texts differ: the least ids of their classes belong together.
    twice = known.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select(F.col("doc_id").alias("t"))
    same = known.join(twice, F.col("doc_id") == F.col("t"), "left_semi").join(
        classes.select(F.col("n").alias("cn"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), "rep"),
        (F.col("n") == F.col("cn")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    comps = components(links.unionByName(same)).select(F.col("id").alias("k"), F.col("component").alias("c"))
    roots = classes.join(comps, F.col("rep") == F.col("k"), "left").select(
        F.col("n").alias("cn"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("c", "rep").alias("root"))
    out = digests.join(roots, (F.col("n") == F.col("cn")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "g", "n", F.coalesce("root", "doc_id").alias("component_id"))


def _verify(b: Blocks, digests: DataFrame, clusters: DataFrame, n: int, num: int, den: int, tile: int) -> DataFrame:
    """Exact links (``a``, ``b``: least ids of two sets) that connect the sets of each cluster.

    A cluster of at most ``tile`` sets is compared in one place.  A larger one is cut into bands of
    sizes, of which only neighbours can link, and bands into tiles; each pair of tiles is a key of its own.
    """
    member = digests.where("n > 0 and doc_id is not null").select("g", "s1", "n").distinct().join(
        clusters.select(F.col("id").alias("k"), "component"), F.col("s1") == F.col("k")).select("g", "s1", "n", "component")
    member = cut(member)
    # Sizes beyond num / den of each other differ by one band at least, and linked sizes by one at most.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num) * (1 + 1e-9)))).cast("int")
    each = member.select("component", "s1", "n").distinct()
    total = each.groupBy("component").agg(F.count("*").alias("total"))
    per_band = each.groupBy("component", band.alias("band")).agg(F.count("*").alias("m")).join(total, "component").where(F.col("total") > tile)
    per_band = per_band.select(F.col("component").alias("pc"), F.col("band").alias("pb"), F.ceil(F.col("m") / tile).cast("int").alias("t"))
    up = per_band.select(F.col("pc").alias("uc"), (F.col("pb") - 1).alias("ub"), F.col("t").alias("t_up"))
    down = per_band.select(F.col("pc").alias("dc"), (F.col("pb") + 1).alias("db"), F.col("t").alias("t_down"))
    plan = per_band.join(up, (F.col("pc") == F.col("uc")) & (F.col("pb") == F.col("ub")), "left").join(
        down, (F.col("pc") == F.col("dc")) & (F.col("pb") == F.col("db")), "left").select("pc", "pb", "t", F.coalesce("t_up", F.lit(0)).alias("t_up"), F.coalesce("t_down", F.lit(0)).alias("t_down"))
    placed = member.withColumn("band", band).join(plan, (F.col("component") == F.col("pc")) & (F.col("band") == F.col("pb")), "left")
    places = 4 * b.n
    told = placed.select("g", "s1", "component", "band", "t", "t_up", "t_down")

    def send(key, left, right):
        rows = []
        if left.num_rows and right.num_rows:
            s = Sets(left, n)
            where = {r["s1"]: r for r in right.to_pylist()}
            for i in s.distinct():
                r = where.get(int(s.s1[i]))
                if r is None:
                    continue
                own = (int(s.n[i]), int(s.s1[i]), int(s.s2[i]), int(s.ids[i]), s.flat[s.at[i]:s.at[i + 1]].tobytes())
                c = r["component"]
                if r["t"] is None:
                    rows.append((f"s{c % places}", c, 0, *own))
                    continue
                k, t, band_ = int(s.s1[i]) % r["t"], r["t"], r["band"]
                for other in range(t):
                    p, q = min(k, other), max(k, other)
                    rows.append((f"{c}/{band_}/{p}/{band_}/{q}", c, 0 if k == p else 1, *own))
                rows += [(f"{c}/{band_}/{k}/{band_ + 1}/{q}", c, 0, *own) for q in range(r["t_up"])]
                rows += [(f"{c}/{band_ - 1}/{p}/{band_}/{k}", c, 1, *own) for p in range(r["t_down"])]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=["place", "c", "side", "n", "s1", "s2", "id", "a"])

    def compare(table):
        by: dict = defaultdict(dict)
        for r in table.to_pylist():
            key = (r["n"], r["s1"], r["s2"])
            of = by[r["c"]]
            if key not in of or r["id"] < of[key][2]:
                of[key] = (r["n"], np.frombuffer(r["a"], np.uint64), r["id"], r["side"])
        out = []
        for of in by.values():
            sets = sorted(of.values(), key=lambda x: (x[3], x[0], x[2]))
            left = sum(x[3] == 0 for x in sets)
            out += exact_links([x[:3] for x in sets], num, den, left if 0 < left < len(sets) else None)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    arrays = b.grouped().cogroup(told.groupBy("g")).applyInArrow(released(send), "place string, c long, side int, n long, s1 long, s2 long, id long, a binary")
    return cut(arrays.groupBy("place").applyInArrow(released(compare), "a long, b long"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, s FROM s),
c AS (SELECT min(doc_id) AS rep, n, list_sort(s) AS s FROM n WHERE n > 0 GROUP BY n, list_sort(s)),
m AS (SELECT n.doc_id, n.n, c.rep FROM n LEFT JOIN c ON c.n = n.n AND c.s = list_sort(n.s)),
t AS (SELECT rep, n, md5_number(unnest(s)) AS h FROM c),
r AS (SELECT rep, n, h, row_number() OVER (PARTITION BY rep ORDER BY h) AS k FROM t),
p AS (SELECT rep, n, h FROM r WHERE k <= n - ((85 * n + 99) // 100) + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.h = b.h AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
i AS (SELECT cand.a, cand.b, count(*) AS i FROM cand JOIN t x ON x.rep = cand.a JOIN t y ON y.rep = cand.b AND y.h = x.h GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN c x ON x.rep = i.a JOIN c y ON y.rep = i.b WHERE 100 * i.i >= 85 * (x.n + y.n - i.i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT rep AS x, rep AS y FROM c UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT m.doc_id, m.n::BIGINT AS n_shingles, coalesce(comp.c, m.doc_id) AS component_id FROM m LEFT JOIN comp ON comp.x = m.rep
"""
