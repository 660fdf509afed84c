"""Shingle Jaccard join by size: subsets for small sets, inverted lists for large ones.

1. A document's set is its distinct ``WIDTH``-word shingles (see :mod:`minhash_dedup`), sorted
   64-bit hashes; equal sets (of one 128-bit digest) are one class and compared once, however many copies.
2. The boundary between small and large is the size with the least estimated cost over the histogram
   of sizes: rows of all subsets that small sets enumerate against rows of inverted lists and
   elements verified for the others (:func:`boundary`).
3. Two small sets link exactly when they share a subset of the c elements that the threshold needs of
   their sizes.  Each enumerates its c-subsets, for every c that its size and a partner's can need.  As c
   grows with the sizes, whatever links by a subset also links with the smallest set that has it: a star
   says all, without a verification.
4. Pairs with a large set meet in inverted lists.  In a common order of all elements, two sets at the
   threshold share one of the first n - ceil(t n) + 1 of each, so only these are listed.  The order is rarest
   first: by counts in ``COUNTERS`` cells over all sets (a table of fixed size), then by hash, so very frequent
   shingles come last and their lists are short or empty.
   A listed element is shuffled once, with the tag of its set (once a set and task, however many copies): what
   lists one set only, or sets too unlike in size, ends there.
5. Each list links its members with two hubs: by size and parity bitmap first, then on full sets, which are
   read for the classes that need them only.  The other members of lists of more than three, where they then still hold
   more than one component, go to :mod:`near_links`: every remaining pair of different components is
   compared, by bitmaps and then, within clusters of what can link, on full sets; only links that join components are returned.
6. Components by alternating large-star and small-star.

Every pair at the threshold is found, whatever the cell counts are; nothing is capped or sampled.

Defined cases: null text, empty text and text without words have the empty set (n_shingles 0), link
with nothing and keep their own id as component.  Repeated rows share a class.  component_id is the smallest
non-null id of the component, null if all its ids are null.  Tables without rows give no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bit_table import bit_table, holds
from .common import cut, map_batches, row_key, salted_join
from .components import FEW, components
from .minhash_dedup import BLOCK, confirmed_in_blocks, shingle_sets
from .near_links import Bitmaps, bitmap, clusters, may_link_pairs, needed, spanning_links

PERCENT = 80
#: Cells of the element counts (a power of two); 8 bytes each on the driver and in every task.
COUNTERS = 1 << 20
_CHUNK = 1 << 12
#: Largest boundary that is considered.
MOST_SMALL = 40
#: Cost, in 8-byte words shuffled, of a listed element, an enumerated subset and an element (with its text) that is verified.
LISTED, SUBSET, VERIFIED = 8, 8, 2
#: Parts of an inverted list's members when it is joined back to them.
SALTS = 2
#: Ratio of the sizes that follow each other in tags.
STEP = 1.05
#: Leading bits of an element that name its list.  Elements that share them share a list: more to compare, nothing lost.
NAMED = 40


def element_counts(docs: DataFrame, text_col: str, cells: int = COUNTERS) -> np.ndarray:
    """Number of elements in each of ``cells`` cells, over the sets of all rows.  Tasks add up whole tables and send
    them in compressed chunks; the driver gets ``cells`` numbers."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some, held = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for x in shingle_sets(batch.column("__text")):
                some.append((x & np.uint64(cells - 1)).astype(np.int64))
                held += len(x)
                if held > cells:
                    total += np.bincount(np.concatenate(some), minlength=cells)
                    some, held = [], 0
        if some:
            total += np.bincount(np.concatenate(some), minlength=cells)
        parts = total.reshape(-1, _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())],
                                         names=["chunk", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, s in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                held[c] = held.get(c, 0) + np.frombuffer(zlib.decompress(s.as_buffer()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary())],
                                         names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    rows = map_batches(map_batches(docs.select(F.col(text_col).alias("__text")), add, kind).repartition("chunk"), merge, kind).collect()
    out = np.zeros((cells // _CHUNK, _CHUNK), np.int64)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def set_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: __id, __key, size, digest (null for the empty set), tag (of digest and size), bits (the parity
    bitmap) and the whole set if it may be small."""
    src = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                size, digest, bits, small = [], [], [], []
                for x in shingle_sets(batch.column("__text")):
                    size.append(len(x))
                    digest.append(_digest(x) if len(x) else None)
                    bits.append(bitmap(x))
                    small.append(x.tobytes() if 0 < len(x) <= MOST_SMALL else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id"), batch.column("__key"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                     pa.array([_tag(d, n) if d else None for d, n in zip(digest, size)], pa.int64()), pa.array(bits, pa.binary()), pa.array(small, pa.binary())],
                    names=["__id", "__key", "size", "digest", "tag", "bits", "small"])

    return map_batches(src, made, f"__id {kind}, __key binary, size bigint, digest binary, tag bigint, bits binary, small binary")


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _tag(digest: bytes, size: int) -> int:
    """56 bits of a set's digest over 8 bits of its size, so that tags tell most sets that are too unlike in size to link."""
    return int.from_bytes(digest[:7], "little", signed=True) << 8 | min(255, int(math.log(size) / math.log(STEP)))


def _size_code(tag: str) -> Column:
    return F.col(tag).bitwiseAND(F.lit(255))


def size_steps(percent: int) -> int:
    """Most by which the size codes of two sets that link differ."""
    return int(math.log(100 / percent) / math.log(STEP) + 1e-9) + 1


def postings(docs: DataFrame, text_col: str, counts, least: int, percent: int) -> DataFrame:
    """(bucket, tag): the lists of the listed elements of every set of ``least`` or more, once a set and task."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, tags, held = [], [], 0
            for x in shingle_sets(batch.column("__text")):
                if len(x) < max(1, least) or (digest := _digest(x)) in seen:
                    continue
                seen.add(digest)
                some = _first_elements(x, counts.value, percent) >> (64 - NAMED) << (64 - NAMED)
                keys.append(some)
                tags.append(np.full(len(some), _tag(digest, len(x)), np.int64))
                held += len(some)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(tags))], names=["bucket", "tag"])
                    keys, tags, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(tags))], names=["bucket", "tag"])

    return map_batches(docs.select(F.col(text_col).alias("__text")), made, "bucket bigint, tag bigint")


def shared_lists(rows: DataFrame, percent: int) -> DataFrame:
    """(bucket, tag, hi, n): the n > 1 members of each list of ``rows`` (bucket, tag) that by size can link with another, of a
    list of two the lesser only.  hi: the largest tag, in the rows of the least and the largest (null in the others)."""
    bucket = Window.partitionBy("bucket")
    lo, hi = F.min("tag").over(bucket), F.max("tag").over(bucket)
    members = rows.withColumns({"lo": lo, "hi": hi}).filter("lo < hi").select("bucket", "tag").distinct()
    code, by_size = _size_code("tag"), bucket.orderBy(_size_code("tag"))
    steps = members.withColumns({"down": code - F.lag(code).over(by_size), "up": F.lead(code).over(by_size) - code})
    near = steps.filter(F.least("down", "up") <= size_steps(percent)).select("bucket", "tag")
    near = near.withColumns({"lo": lo, "hi": hi, "n": F.count(F.lit(1)).over(bucket)}).filter("n > 2 or tag = lo")
    return near.select("bucket", "tag", F.when(F.expr("tag in (lo, hi)"), F.col("hi")).alias("hi"), "n")


def listed(n: int, percent: int) -> int:
    """Elements of a set of n that are listed."""
    return n - -(-percent * n // 100) + 1


def shared_counts(n: int, most: int, percent: int) -> list[int]:
    """The distinct numbers of elements that a set of n must share with a set of some size up to ``most`` to link."""
    sizes = range(-(-percent * n // 100), min(most, 100 * n // percent) + 1)
    return sorted({int(needed(n, r, percent)) for r in sizes if needed(n, r, percent) <= min(n, r)})


def boundary(histogram: dict[int, int], percent: int) -> int:
    """Largest small size: the one of least estimated cost (0: no set is small)."""
    def cost(most: int) -> int:
        subsets = sum(k * sum(comb(n, c) for c in shared_counts(n, most, percent)) for n, k in histogram.items() if 0 < n <= most)
        lists = sum(k * (LISTED * listed(n, percent) + VERIFIED * n) for n, k in histogram.items() if n >= -(-percent * (most + 1) // 100))
        return SUBSET * subsets + lists

    return min(range(MOST_SMALL + 1), key=cost)


def small_links(small: DataFrame, most: int, percent: int) -> DataFrame:
    """(u, v): links that join the small classes (class, size, set) that share a subset."""
    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shared, source = [], [], []
            for i, s in enumerate(batch.column("set").to_pylist()):
                elements = [s[j:j + 8] for j in range(0, len(s), 8)]
                for c in shared_counts(len(elements), most, percent):
                    made = [hashlib.blake2b(b"".join(p), digest_size=16).digest() for p in combinations(elements, c)]
                    keys += made
                    shared += [c] * len(made)
                    source += [i] * len(made)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shared, pa.int64()), batch.column("class").take(at),
                                              batch.column("size").take(at)], names=["key", "shared", "class", "size"])

    rows = map_batches(small.select("class", "size", "set"), subsets, "key binary, shared bigint, class bigint, size bigint")
    hubs = rows.groupBy("key").agg(F.min(F.struct("size", "class")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = F.col("size") + F.col("hub.size")
    links = F.col("shared") * (100 + percent) >= sizes * percent
    return (salted_join(rows, hubs.select("key", "hub"), ["key"], "class").filter((F.col("class") != F.col("hub.class")) & links)
            .select(F.col("class").alias("u"), F.col("hub.class").alias("v")).distinct())


def _first_elements(x: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    n = listed(len(x), percent)
    rank = counts[(x & np.uint64(len(counts) - 1)).astype(np.int64)]
    return x[np.lexsort((x, rank))[:n]].view(np.int64)


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sorted set of each wanted class, from its text, and the columns of ``wanted`` (one row a __key) but __key."""
    spark = docs.sparkSession
    only = spark.sparkContext.broadcast(bit_table(wanted.select(F.xxhash64("__key"))))
    texts = docs.select(row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text")).withColumn("__hash", F.xxhash64("__key"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(only.value, batch.column("__hash").to_numpy()))).select(["__key", "__text"])

    texts = map_batches(texts, some, "__key binary, __text string").join(wanted, "__key").dropDuplicates(["__key"])
    kept = [c for c in wanted.columns if c != "__key"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                sets = pa.array([x.tobytes() for x in shingle_sets(batch.column("__text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], sets], names=[*kept, "set"])

    kinds = [f"{c} {wanted.schema[c].dataType.simpleString()}" for c in kept]
    return map_batches(texts.select("__text", *kept), made, ", ".join([*kinds, "set binary"]))


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes, of the pairs (s, t) of their tags, that can be at the threshold by size and parity bitmap."""
    def of(c: str, tag: str) -> DataFrame:
        return sets.select(F.col("tag").alias(tag), F.col("class").alias(c), F.col("size").alias(f"n{c}"), F.col("bits").alias(f"m{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                yield batch.select(["a", "b"]).filter(pa.array(may_link_pairs(a, b, Bitmaps(batch.column("ma")), Bitmaps(batch.column("mb")), percent)))

    both = pairs.join(of("a", "s"), "s").join(of("b", "t"), "t").select("a", "b", "na", "nb", "ma", "mb")
    return map_batches(both, check, "a bigint, b bigint")


def confirmed_stars(stars: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes (class, __key) at the threshold, on their full sets.

    A class is dealt to a block with the others of the least class that it meets, so most pairs lie in one block and a set goes
    to few; of a class that more than BLOCK meet, by hash.  A set goes from its text to the blocks, without a join on its way.
    Up to FEW pairs are dealt in one partition, where no step shuffles."""
    few = stars.count() <= FEW
    stars = stars.coalesce(1) if few else stars
    met = stars.select(F.inline(F.array(*[F.struct(F.col(x).alias("class"), F.col(y).alias("other")) for x, y in ("ab", "ba")])))
    places = cut(met.groupBy("class").agg(F.min("other").alias("least")).select("class", F.least("class", "least").alias("place")))
    places = places.coalesce(1) if few else places
    n = max(1, -(-places.count() // BLOCK))
    sizes = places.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    block = F.pmod(F.xxhash64("place", F.pmod(F.xxhash64("class"), "parts")), F.lit(n)).cast("int")
    blocks = salted_join(places, sizes, ["place"], "class", salts=SALTS).select("class", block.alias("block"))
    x, y = (blocks.select(F.col("class").alias(c), F.col("block").alias(f"at_{c}")) for c in ("a", "b"))
    placed = cut(stars.join(x, "a").join(y, "b").select(F.least("at_a", "at_b").alias("lo"), F.greatest("at_a", "at_b").alias("hi"), "a", "b"))
    placed = placed.coalesce(1) if few else placed
    wanted = (placed.select(F.explode(F.array("a", "b")).alias("class"), F.struct("lo", "hi").alias("at"))
              .groupBy("class").agg(F.collect_set("at").alias("ats")).join(classes.select("class", "__key"), "class"))
    shipped = full_sets(docs, wanted, id_col, text_col).select("class", "set", F.inline("ats"))
    return confirmed_in_blocks(placed, shipped, percent)


def large_links(docs: DataFrame, classes: DataFrame, counts, most: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(u, v): links that join classes (class, tag, __key, size, bits) of which one at least is large."""
    least = -(-percent * (most + 1) // 100)
    lists = cut(shared_lists(postings(docs, text_col, counts, least, percent), percent))
    hubs = lists.filter("tag < hi").select("bucket", F.col("tag").alias("lo"), "hi", "n")
    members = lists.filter("n > 2")
    # the hubs of a list, any two, are its members if it has two
    stars = (salted_join(members.select("bucket", "tag"), hubs.filter("n > 2").drop("n"), ["bucket"], "tag", salts=SALTS)
             .select("tag", F.explode(F.array("lo", "hi")).alias("hub")).filter("tag <> hub")
             .select(F.least("tag", "hub").alias("s"), F.greatest("tag", "hub").alias("t"))
             .unionByName(hubs.filter("n = 2").select(F.col("lo").alias("s"), F.col("hi").alias("t")))
             .filter(F.abs(_size_code("s") - _size_code("t")) <= size_steps(percent)).distinct())
    stars = cut(likely(stars, classes, percent))
    first = cut(components(confirmed_stars(stars, docs, classes, percent, id_col, text_col)))
    # the hubs have met all: in lists of up to three that is every pair
    long_ = members.filter("n > 3 and hi is null").join(classes.select("tag", "class", "size"), "tag").select("bucket", "class", "size")
    known = cut(long_.join(first.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")))
    linked = first.select(F.col("node").alias("u"), F.col("root").alias("v"))
    left = cut(clusters(known, classes, percent))
    if left.isEmpty():
        return linked
    roots = known.select("class", "root", "size").distinct()
    named = left.join(classes.select("class", "__key"), "class").select("class", "__key", F.array("bucket").alias("keys"))
    held = full_sets(docs, named, id_col, text_col)
    return linked.unionByName(spanning_links(left.join(roots, "class"), held, percent))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                 cells: int = COUNTERS) -> DataFrame:
    """One row per input row: the id column, n_shingles, component_id.  Sets with a Jaccard similarity of ``percent``
    per cent or more link."""
    counts = docs.sparkSession.sparkContext.broadcast(element_counts(docs, text_col, cells))
    rows = cut(set_rows(docs, id_col, text_col))
    some = rows.filter("size > 0")
    # the number stands for the class from here on: it is fixed by the checkpoint
    classes = cut(some.groupBy("digest").agg(F.min("__key").alias("__key"), F.min("__id").alias("least"), F.count(F.lit(1)).alias("rows"),
                                             *[F.first(c).alias(c) for c in ("size", "tag", "bits", "small")])
                  .withColumn("class", F.monotonically_increasing_id()))
    histogram = {r["size"]: r["n"] for r in classes.filter(F.col("size") <= 2 * MOST_SMALL).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = boundary(histogram, percent)
    small = small_links(classes.filter(F.col("size") <= most).withColumnRenamed("small", "set"), most, percent)
    large = large_links(docs, classes.select("class", "tag", "__key", "size", "bits"), counts, most, percent, id_col, text_col)
    linked = cut(components(small.unionByName(large)))

    # what has no link and no copy keeps its own id and joins nothing
    known = classes.select("class", "digest", "least", "rows")
    roots = known.join(linked.withColumnRenamed("node", "class"), "class")
    by_root = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted_join(roots.select("digest", "root"), by_root, ["root"], "digest").select("digest", "component_id")
    copies = known.filter("rows > 1").join(linked.select(F.col("node").alias("class")), "class", "left_anti").select("digest", F.col("least").alias("component_id"))
    ids = salted_join(some.select("__id", "__key", "size", "digest"), named.unionByName(copies), ["digest"], "__key", how="left")
    # null only where all ids of the component are, or where the row stands alone
    ids = ids.select("__id", "size", F.coalesce("component_id", "__id").alias("component_id"))
    out = ids.unionByName(rows.filter("size = 0").select("__id", "size", F.col("__id").alias("component_id")))
    return out.select(F.col("__id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def op11_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
