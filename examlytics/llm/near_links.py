"""Links between similar sets that share a bucket and are not yet in one component.

A bucket (a band of minima, an inverted list) may hold very many sets, and many of its pairs may
miss the threshold by little.  The sets of a bucket outside its largest component (the rest) are
compared with all others of the bucket, in pairs of tiles of bounded size; the largest component
is not compared with itself.  Inside a pair of tiles

* sets of different components are compared by parity bitmaps: the bits in which they differ are a
  lower bound of the symmetric difference, so no pair at the threshold is passed over;
* a remaining pair is confirmed on the full sets, in the least bucket that the two share (so a pair is
  confirmed once, however many buckets it meets in), and unless links found before in the tiles join it already;
* only the links that join two components are returned: at most one a set and pair of tiles.

So what is returned, and what is shipped, grows with the sets and not with their pairs.  Where most buckets hold
unrelated sets, or the same sets meet in many buckets, :func:`clusters` first makes, by bitmaps alone, one bucket of whatever
can link, and leaves out the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, salted_join
from .components import components

#: Sets and bytes of a tile; a task holds two tiles.
TILE_SETS = 1024
TILE_BYTES = 16 << 20
#: Logarithms of the least and the largest number of cells of a parity bitmap that is shipped instead of a set.
LEAST_BITS, MOST_BITS = 9, 16
#: Parts of a bucket's members when it is joined back to them.
SALTS = 4


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of a and b elements with a Jaccard similarity of ``percent`` per cent or more."""
    return -(-percent * (a + b) // (100 + percent))


def parity(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Bitmap of each set: whether a cell holds an odd number of its elements."""
    out = np.empty((len(sets), bits // 64), np.uint64)
    for i, x in enumerate(sets):
        odd = np.bincount(((x >> np.uint64(11)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0


def _find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _tile_links(bucket: int, sets: list[np.ndarray], keys: list[np.ndarray], roots: list, left: np.ndarray, right: np.ndarray,
                percent: int) -> list[tuple[int, int]]:
    """Confirmed links (indices) that join components, between ``left`` and ``right`` sets of a bucket."""
    number: dict = {}
    root = np.array([number.setdefault(r, len(number)) for r in roots])
    up = list(range(len(number)))
    size = np.array([len(s) for s in sets])
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * np.median(size) + 1)), 10, 16))
    maps = parity(sets, bits)
    rows = max(1, (1 << 22) // max(1, len(right) * maps.shape[1]))
    same_tile = len(left) and len(right) and left[0] == right[0]
    out = []
    for i in range(0, len(left), rows):
        some = left[i:i + rows]
        a, b = size[some, None], size[None, right]
        c = needed(a, b, percent)
        near = (root[some, None] != root[None, right]) & (c <= np.minimum(a, b))
        near &= np.bitwise_count(maps[some, None] ^ maps[None, right]).sum(axis=-1, dtype=np.int64) <= a + b - 2 * c
        if same_tile:
            near &= some[:, None] < right[None, :]
        for x, y in zip(*np.nonzero(near)):
            x, y = int(some[x]), int(right[y])
            p, q = _find(up, int(root[x])), _find(up, int(root[y]))
            if p == q or int(np.intersect1d(keys[x], keys[y])[0]) != bucket:
                continue
            if overlap(sets[x], sets[y]) >= needed(size[x], size[y], percent):
                up[p] = q
                out.append((x, y))
    return out


def _parts(n: Column, elements: Column) -> Column:
    return F.greatest(F.ceil(n / TILE_SETS), F.ceil(8 * elements / TILE_BYTES)).cast("int")


def _dealt(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Rows of the pairs of tiles: bucket, t1, t2, tile, class, root and the columns of ``payload`` (by class)."""
    per_root = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    open_ = (per_root.groupBy("bucket").agg(F.max(F.struct("n", "elements", "root")).alias("big"), F.sum("n").alias("n"), F.sum("elements").alias("elements"))
             .filter("n > big.n")
             .select("bucket", F.col("big.root").alias("big"), _parts(F.col("big.n"), F.col("big.elements")).alias("big_tiles"),
                     _parts(F.col("n") - F.col("big.n"), F.col("elements") - F.col("big.elements")).alias("rest_tiles")))
    placed = salted_join(members, open_, ["bucket"], "class", salts=SALTS)
    in_big, place = F.col("root") == F.col("big"), F.xxhash64("class", "bucket")
    tile = F.when(in_big, F.pmod(place, "big_tiles")).otherwise(F.col("big_tiles") + F.pmod(place, "rest_tiles")).cast("int")
    other = F.explode(F.sequence(F.when(in_big, F.col("big_tiles")).otherwise(F.lit(0)), F.col("big_tiles") + F.col("rest_tiles") - 1))
    placed = placed.select("bucket", "class", "root", tile.alias("tile"), other.alias("other")).select(
        "bucket", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "class", "root")
    return placed.join(payload, "class").repartition("bucket", "t1", "t2").sortWithinPartitions("bucket", "t1", "t2")


def _by_tiles(fn):
    """Batches sorted by bucket, t1, t2 -> ``fn(key, batches)`` of each."""
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("bucket", "t1", "t2")]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(batch)]):
                key = tuple(int(k[lo]) for k in keys)
                if key != now and held:
                    yield fn(now, pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield fn(now, pa.Table.from_batches(held))
    return tiles


def bitmap(x: np.ndarray) -> bytes:
    """Parity bitmap of a set, with about as many cells as elements."""
    return parity([x], 1 << int(np.clip(np.ceil(np.log2(max(1, len(x)))), LEAST_BITS, MOST_BITS))).tobytes()


class Bitmaps:
    """Parity bitmaps of different lengths.  Folding one in half by xor gives the bitmap of half the cells, so any two can be compared."""

    def __init__(self, column):
        raw = column.to_pylist()
        self.words = np.array([len(m) // 8 for m in raw], np.int64)
        self.groups = {}
        self.place = np.empty(len(raw), np.int64)
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.place[at] = np.arange(len(at))
            self.groups[w] = np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(-1, w)

    def take(self, rows: np.ndarray, own: int, words: int) -> np.ndarray:
        """Bitmaps of ``rows``, which have ``own`` words, folded to ``words``."""
        m = self.groups[own][self.place[rows]]
        while m.shape[-1] > words:
            half = m.shape[-1] // 2
            m = m[..., :half] ^ m[..., half:]
        return m


def may_link(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with parity bitmaps x and y (last axis: words) can be at the threshold."""
    c = needed(a, b, percent)
    return (c <= np.minimum(a, b)) & (np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= a + b - 2 * c)


def may_link_pairs(a: np.ndarray, b: np.ndarray, x: Bitmaps, y: Bitmaps, percent: int) -> np.ndarray:
    """``may_link`` of each row of two columns."""
    out = np.zeros(len(a), bool)
    for p, q in {*zip(x.words.tolist(), y.words.tolist())}:
        at = np.flatnonzero((x.words == p) & (y.words == q))
        w = min(p, q)
        out[at] = may_link(a[at], b[at], x.take(at, p, w), y.take(at, q, w), percent)
    return out


def may_link_matrix(size: np.ndarray, maps: Bitmaps, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """``may_link`` of each of ``left`` with each of ``right``; sizes too unlike are not compared."""
    out = np.zeros((len(left), len(right)), bool)
    for p in np.unique(maps.words[left]).tolist():
        i = np.flatnonzero(maps.words[left] == p)
        for q in np.unique(maps.words[right]).tolist():
            if max(p, q) > 2 * min(p, q):
                continue
            j = np.flatnonzero(maps.words[right] == q)
            a, b, w = left[i], right[j], min(p, q)
            step = max(1, (1 << 22) // max(1, len(j) * w))
            for k in range(0, len(i), step):
                some = a[k:k + step]
                out[np.ix_(i[k:k + step], j)] = may_link(size[some, None], size[None, b], maps.take(some, p, w)[:, None], maps.take(b, q, w)[None], percent)
    return out


def clusters(members: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """(class, bucket): the members that can link, by size and parity bitmap, with one of another root in their bucket, and
    their cluster (the number of one of its classes).  Whatever can link is in one cluster; each class is in one only, so its set
    need not be shipped to all the buckets that it is in.

    ``members``: bucket, class (bigint), root, size; ``light``: class, size, bits.  A pair of tiles returns one link
    for each member that has any, and the links that join roots: not the pairs."""
    def links(key: tuple, t: pa.Table) -> pa.RecordBatch:
        size, maps, tile = t.column("n").to_numpy(), Bitmaps(t.column("bits")), t.column("tile").to_numpy()
        number: dict = {}
        root = np.array([number.setdefault(r, len(number)) for r in t.column("root").to_pylist()])
        up = list(range(len(number)))
        left, right = np.flatnonzero(tile == key[1]), np.flatnonzero(tile == key[2])
        u, v = [], []
        for i in range(0, len(left), 256):
            some = left[i:i + 256]
            near = may_link_matrix(size, maps, some, right, percent) & (root[some, None] != root[None, right])
            met = np.flatnonzero(near.any(axis=0))
            u.extend(right[met].tolist())
            v.extend(some[near[:, met].argmax(axis=0)].tolist())
            for x in np.flatnonzero(near.any(axis=1)):
                partners = right[near[x]]
                _, first = np.unique(root[partners], return_index=True)
                for j, y in enumerate(partners[first].tolist()):
                    p, q = _find(up, int(root[some[x]])), _find(up, int(root[y]))
                    if j == 0 or p != q:
                        up[p] = q
                        u.append(int(some[x]))
                        v.append(y)
        name = t.column("class").combine_chunks()
        return pa.RecordBatch.from_arrays([name.take(pa.array(k, pa.int64())) for k in (u, v)], names=["u", "v"])

    dealt = _dealt(members, light.select("class", F.col("size").alias("n"), "bits"))
    met = cut(map_batches(dealt, _by_tiles(links), "u bigint, v bigint").distinct())
    some = met.select(F.explode(F.array("u", "v")).alias("class")).distinct()
    same_root = some.join(members.select("class", "root").distinct(), "class").select(F.col("class").alias("u"), F.col("root").alias("v"))
    return components(met.unionByName(same_root)).select(F.col("node").alias("class"), F.col("root").alias("bucket")).join(some, "class")


def spanning_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): confirmed links between classes of different roots that share a bucket, enough of them to
    join whatever any such link joins.

    ``members``: bucket, class, root, size; ``sets``: class, keys (all its buckets), set (sorted, 8 bytes an element)."""
    def links(key: tuple, t: pa.Table) -> pa.RecordBatch:
        name = t.column("class").combine_chunks()
        full = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("set")]
        keys = [np.asarray(k.values) for k in t.column("keys")]
        tile = t.column("tile").to_numpy()
        left, right = np.flatnonzero(tile == key[1]), np.flatnonzero(tile == key[2])
        found = _tile_links(key[0], full, keys, t.column("root").to_pylist(), left, right, percent)
        return pa.RecordBatch.from_arrays([name.take(pa.array([p[k] for p in found], pa.int64())) for k in (0, 1)], names=["u", "v"])

    kind = members.schema["class"].dataType.simpleString()
    return map_batches(_dealt(members, sets.select("class", "keys", "set")), _by_tiles(links), f"u {kind}, v {kind}")
