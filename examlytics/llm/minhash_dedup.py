"""Near-duplicate documents by MinHash banding.

1. A document's set is its distinct ``WIDTH``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
   lower-cased), as 64-bit hashes; with fewer words, the whole sequence is the one shingle.
   Documents with the same set form a class: one 128-bit digest of the set.  Only classes are
   compared, so exact copies cost one row each, however many.
2. n x ``ROWS`` minima of universal hashes a*x + b give n band keys, n = ``bands_for(percent)``: a pair
   of Jaccard similarity at the threshold misses all bands with probability below ``MISS`` (0.85: 24
   bands of 5, 8e-7; 0.80: 35 bands of 5, 9e-7).
3. Classes that share a band key with another get a longer signature, ``SIGNATURE`` minima of two
   bits each, and their full set, read in one more pass over the texts.
4. Every class is paired with up to four hubs of each of its buckets.  Pairs pass signature verification (estimate within ``SLACK`` standard deviations) and
   are then confirmed on the full sets.  Components of the confirmed links follow by alternating
   large-star and small-star.
5. Links that the first classes missed can only join different components.  So within each bucket
   that still holds more than one component, classes of different components are compared on their
   full sets, in pairs of tiles of bounded size, and only links that join two components are returned
   (:mod:`near_links`), one a class and pair of tiles at most.  A bucket of one component is skipped whole.

Steps 2 and 3 are the only ones that can lose a link, with probability below 2e-6 for a pair at
the threshold and less above it; nothing is capped.  The threshold ``percent`` is the caller's: op3
links at ``PERCENT``.

Defined cases: null text, empty text and text without words have the empty set (n_shingles 0), link with
nothing and keep their own id as component.  Repeated rows share a class.  component_id is the
smallest non-null id of the component, null if all its ids are null; ``keep_one`` keeps one row of
each component (smallest id first, then the smallest row key) and every row with the empty set.
Tables without rows give no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, keyed_rows, map_batches, mix64, powers, row_key, salted_join, text_bytes, word_hashes
from .components import components
from .near_links import spanning_links

WIDTH = 5
#: Threshold of op3.
PERCENT = 85
ROWS = 5
#: Most that banding may miss of the pairs at the threshold.
MISS = 1e-6
SIGNATURE = 1024
SLACK = 4.75
#: Classes whose full sets are compared with those of another such block at a time.
BLOCK = 512
_SEED = 20_240_501
_BASE = 0x9FB21C651E98DF25


@lru_cache(maxsize=4)
def universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


def bands_for(percent: int) -> int:
    """Least number of bands of ROWS that a pair at the threshold all misses with probability MISS at most."""
    return math.ceil(math.log(MISS) / math.log1p(-(percent / 100) ** ROWS)) if percent < 100 else 1


def minima(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Minimum of each of ``n`` universal hashes over the set ``x``, some shingles at a time."""
    a, b = universal(n, seed)
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 18) // n)
    for i in range(0, len(x), step):
        np.minimum(best, (x[i:i + step, None] * a + b).min(axis=0), out=best)
    return best


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    b, off = text_bytes(column)
    for i, j in blocks(off):
        part = off[i:j + 1] - off[i]
        (w,), _, _, rows = word_hashes(b[off[i]:off[j]], part, lower=True)
        p = powers(_BASE, WIDTH)
        long = len(w) - WIDTH + 1
        s = mix64(sum((w[k:k + long] * p[k] for k in range(WIDTH)), np.zeros(max(long, 0), np.uint64))) if long > 0 else w[:0]
        for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if hi - lo >= WIDTH:
                yield np.unique(s[lo:hi - WIDTH + 1])
            elif hi > lo:
                whole = np.cumsum(w[lo:hi] * p[:hi - lo])[-1:]
                yield mix64(whole ^ mix64(np.array([hi - lo], np.uint64)))
            else:
                yield w[:0]


def _signed_lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(flat))


def classes_of(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """One row per input row: __id, __key, n_shingles, __class (null for the empty set), __bands."""
    src = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()
    n = bands_for(percent)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            size, digest, bands = [], [], []
            for x in shingle_sets(batch.column("__text")):
                size.append(len(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                m = minima(x, n * ROWS, _SEED).reshape(n, ROWS) if len(x) else np.zeros((0, ROWS), np.uint64)
                key = tag[:len(m)].copy()
                for r in range(ROWS):
                    key = mix64(key + m[:, r])
                bands.append(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__key"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), _signed_lists(bands)],
                names=["__id", "__key", "n_shingles", "__class", "__bands"])

    return map_batches(src, sets, f"__id {kind}, __key binary, n_shingles bigint, __class binary, __bands array<bigint>")


def signatures(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class, bands, set, sig) of the classes in ``wanted`` (__key, class, bands): the full set as 8-byte
    hashes and SIGNATURE two-bit minima in 64-bit words."""
    texts = docs.select(row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text")).join(wanted, "__key")
    texts = texts.dropDuplicates(["__key"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = (np.arange(32, dtype=np.uint64) * np.uint64(2))
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                full, sig = [], []
                for x in shingle_sets(batch.column("__text")):
                    full.append(x.tobytes())
                    two = (minima(x, SIGNATURE, _SEED + 1) >> np.uint64(20)) & np.uint64(3)
                    sig.append((two.reshape(-1, 32) << shift).sum(axis=1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("bands"), pa.array(full, pa.binary()), _signed_lists(sig)],
                                                 names=["class", "bands", "set", "sig"])

    return map_batches(texts.select("__text", "class", "bands"), signed, "class binary, bands array<bigint>, set binary, sig array<bigint>")


def unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of two-bit minima in which signatures differ (last axis: words)."""
    z = x ^ y
    return np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def most_unlike(percent: int = PERCENT) -> int:
    """Signature verification: differing minima that a pair at the threshold exceeds with probability 1e-6."""
    p = 0.75 * (1 - percent / 100)
    return int(SIGNATURE * p + SLACK * (SIGNATURE * p * (1 - p)) ** 0.5) + 1


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, n_sets: int | None = None) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets (``n_sets`` of them).

    Classes are dealt to blocks of about BLOCK by hash, pairs to pairs of blocks.  A class's set goes once to each
    pair of blocks that holds one of its pairs, ahead of the pairs; a task holds the sets of two blocks at a time."""
    n = max(1, -(-(sets.count() if n_sets is None else n_sets) // BLOCK))

    def block(c: str):
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    placed = pairs.select(F.least(block("a"), block("b")).alias("lo"), F.greatest(block("a"), block("b")).alias("hi"), "a", "b")
    wanted = placed.select("lo", "hi", F.explode(F.array("a", "b")).alias("class")).distinct()
    return confirmed_in_blocks(placed, wanted.join(sets.select("class", "set"), "class"), percent)


def confirmed_in_blocks(placed: DataFrame, shipped: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The confirmed pairs of ``placed`` (lo, hi, a, b); ``shipped``: lo, hi, class, set of both sides of each."""
    none = F.lit(None).cast(placed.schema["a"].dataType)
    dealt = (shipped.select("lo", "hi", F.col("class").alias("a"), none.alias("b"), "set")
             .unionByName(placed.withColumn("set", F.lit(None).cast("binary")))
             .repartition("lo", "hi").sortWithinPartitions("lo", "hi", F.col("b").asc_nulls_first()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            kept = []
            full = batch.column("set")
            for i, (lo, hi, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "a", "b")))):
                if (lo, hi) != now:
                    now, held = (lo, hi), {}
                if b is None:
                    held[a] = np.frombuffer(full[i].as_buffer(), np.uint64).copy()
                    continue
                x, y = held[a], held[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["u", "v"])

    kind = placed.schema["a"].dataType.simpleString()
    return map_batches(dealt, check, f"u {kind}, v {kind}")


def _words(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)


def alike(pairs: DataFrame, sig: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that pass signature verification."""
    both = (pairs.join(sig.select(F.col("class").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("class").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = unlike(_words(batch.column("sa"), SIGNATURE // 32), _words(batch.column("sb"), SIGNATURE // 32))
            yield batch.select(["a", "b"]).filter(pa.array(far <= most_unlike(percent)))

    return map_batches(both, check, "a binary, b binary")


def near_components(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """(class, root) of every class that links with another, from ``classes_of`` rows of the same ``percent``."""
    classes = (rows.filter("n_shingles > 0").groupBy(F.col("__class").alias("class"))
               .agg(F.min("__key").alias("__key"), F.first("n_shingles").alias("size"), F.first("__bands").alias("bands")))
    banded = classes.select("class", "size", F.explode("bands").alias("band"))
    bucket = Window.partitionBy("band")
    hubs = [F.min("class"), F.max("class"), F.min_by("class", F.xxhash64("class", F.lit(1))), F.min_by("class", F.xxhash64("class", F.lit(2)))]
    members = (banded.withColumn("n", F.count(F.lit(1)).over(bucket)).filter("n > 1")
               .withColumn("hubs", F.array_distinct(F.array(*[h.over(bucket) for h in hubs]))).drop("n"))
    members = cut(members)
    wanted = members.select("class").distinct().join(classes, "class")
    sets = cut(signatures(docs, wanted, id_col, text_col))
    sig = sets.select("class", "sig")

    stars = (members.select("class", F.explode("hubs").alias("hub")).filter("class <> hub")
             .select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct())
    first = components(confirmed(cut(alike(stars, sig, percent)), sets, percent))

    known = members.select(F.col("band").alias("bucket"), "class", "size").join(first.withColumnRenamed("node", "class"), "class", "left")
    more = spanning_links(known.withColumn("root", F.coalesce("root", "class")), sets.withColumnRenamed("bands", "keys"), percent)
    linked = first.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(linked.unionByName(more)).select(F.col("node").alias("class"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: the id column, n_shingles, component_id, kept, and __key.  Sets with a
    Jaccard similarity of ``percent`` per cent or more link."""
    rows = cut(classes_of(docs, id_col, text_col, percent))
    linked = cut(near_components(rows, docs, id_col, text_col, percent))
    rows = rows.drop("__bands")
    least = rows.filter("n_shingles > 0").groupBy(F.col("__class").alias("class")).agg(F.min("__id").alias("least"))
    roots = least.join(linked, "class", "left").withColumn("root", F.coalesce("root", "class"))
    by_root = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = (salted_join(roots.select("class", "root"), by_root, ["root"], "class")
             .select(F.col("class").alias("__class"), "component_id", F.col("root").alias("__root")))
    some = salted_join(rows.filter("n_shingles > 0"), named, ["__class"], "__key")
    none = rows.filter("n_shingles = 0").withColumn("component_id", F.col("__id"))
    out = some.unionByName(none, allowMissingColumns=True)
    return out.select(F.col("__id").alias(id_col), "n_shingles", "component_id",
                      F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"), "__key", "__root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component and every row with the empty set, with all columns."""
    stay = near_duplicates(docs, id_col, text_col, percent).filter("kept").select("__key", "__root").distinct()
    rows = keyed_rows(docs, id_col, text_col).join(stay, "__key")
    # rows that share the smallest id, or have no id at all: one by key, then by the other columns
    nth = Window.partitionBy("__root").orderBy("__key", F.xxhash64("__row"))
    single = rows.filter("__root is not null").withColumn("__nth", F.row_number().over(nth)).filter("__nth = 1")
    return single.select("__row.*").unionByName(rows.filter("__root is null").select("__row.*"))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
