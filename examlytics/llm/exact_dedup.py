"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of ``chunk_bytes`` bytes of its UTF-8 form.  The hash of a chunk x is
sum(x[i] * B**i) modulo a 31-bit prime, for two primes; a text's fingerprint is the sum of its
chunk hashes, each shifted by B**(bytes before it), so chunks are hashed independently, in any
order, and combined by addition.  With the byte length it names a candidate group.

Equal fingerprints are only candidates.  Every member of a group of two or more is then compared
with the group's representative, chunk by chunk, in a merge join sorted by chunk number, which
holds one chunk of each at a time.  Members that differ leave the group (they are told apart by
the SHA-256 of their text).

Hot groups: members of a group are dealt to ceil(size / 512) parts, and only the representative's
chunks are copied to each part.  No group is gathered.

Defined cases: null text counts as empty, so null and empty texts form one group.  A null id
sorts below all others.  Repeated rows (same id, same text) count one by one, and one of them is
kept.  Of several rows with the largest id one stays.  An empty table gives an empty result.
Columns other than id and text are not read; ``drop_copies`` passes them through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed_rows, map_batches, row_key, salted_join, text_bytes

CHUNK_BYTES = 1 << 16
#: Fixed primes below 2**31 and bases of the two hashes.
PRIMES = (2147483647, 2147483629)
FACTORS = (1000003, 998244353)
PART_ROWS = 512


def _power_table(f: int, n: int) -> np.ndarray:
    """B**0 .. B**(n-1) modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    p = PRIMES[f]
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(FACTORS[f], len(out), p)) % np.uint64(p)])
    return out[:n]


def chunk_hash(b: np.ndarray, f: int, table: np.ndarray) -> int:
    """sum(b[i] * B**i) mod p; a byte times a 31-bit power, 2**25 of them at most, fits in 64 bits."""
    return int(np.dot(b.astype(np.uint64), table[:len(b)]) % np.uint64(PRIMES[f]))


def combine(chunks: list[tuple[int, int]], f: int) -> int:
    """Hash of a concatenation from its chunks' (hash, length), in order."""
    p, total, before = PRIMES[f], 0, 0
    for h, n in chunks:
        total = (total + h * pow(FACTORS[f], before, p)) % p
        before += n
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: __id, __key (row identity), __sha, __h1, __h2, __n (bytes)."""
    src = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__key"),
                      F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__sha"), F.col(text_col).alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_power_table(f, chunk_bytes) for f in (0, 1)]
        for batch in batches:
            b, off = text_bytes(batch.column("__text"))
            found = np.zeros((2, len(batch)), np.int64)
            for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                for f in (0, 1):
                    found[f, i] = combine([(chunk_hash(b[at:min(at + chunk_bytes, hi)], f, tables[f]), min(chunk_bytes, hi - at))
                                           for at in range(lo, hi, chunk_bytes)], f)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__key"), batch.column("__sha"), pa.array(found[0]), pa.array(found[1]), pa.array(np.diff(off))],
                names=["__id", "__key", "__sha", "__h1", "__h2", "__n"])

    return map_batches(src, hashed, f"__id {kind}, __key binary, __sha string, __h1 bigint, __h2 bigint, __n bigint")


def _chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row per chunk of each row's text; an empty text has one empty chunk."""
    keep = ["__h1", "__h2", "__n", "__part", "__key", "__is_top"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = text_bytes(batch.column("__text"))
            for i in range(len(batch)):
                lo, hi = int(off[i]), int(off[i + 1])
                cuts = list(range(lo, hi, chunk_bytes)) or [lo]
                same = [pa.repeat(batch.column(c)[i], len(cuts)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(range(len(cuts)), pa.int64()),
                     pa.array([b[at:min(at + chunk_bytes, hi)].tobytes() for at in cuts], pa.binary())],
                    names=[*keep, "__seq", "__chunk"])

    return map_batches(
        rows.select(*keep, "__text"), split, "__h1 bigint, __h2 bigint, __n bigint, __part int, __key binary, __is_top boolean, __seq bigint, __chunk binary")


GROUP = ["__h1", "__h2", "__n"]


def differing(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Keys of the rows whose text is not that of their group's representative."""
    sizes = (prints.groupBy(GROUP).agg(F.count(F.lit(1)).alias("__size"), F.max(F.struct("__id", "__key")).alias("__top"))
             .filter("__size > 1")
             .select(*GROUP, F.ceil(F.col("__size") / PART_ROWS).cast("int").alias("__parts"), F.col("__top.__key").alias("__top")))
    members = salted_join(prints.select(*GROUP, "__key"), sizes, GROUP, "__key")
    texts = docs.select(row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    rows = texts.join(members.dropDuplicates(["__key"]), "__key").dropDuplicates(["__key"])
    dealt = rows.withColumn("__is_top", F.col("__key") == F.col("__top")).withColumn("__part", F.explode(
        F.when(F.col("__is_top"), F.sequence(F.lit(0), F.col("__parts") - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("__key"), F.col("__parts")).cast("int")))))
    chunks = _chunks(dealt, chunk_bytes)
    top = chunks.filter("__is_top").select(*GROUP, "__part", "__seq", F.col("__chunk").alias("__top_chunk"))
    return (chunks.filter("not __is_top").join(top, [*GROUP, "__part", "__seq"], "left")
            .filter(~F.col("__chunk").eqNullSafe(F.col("__top_chunk"))).select("__key").distinct())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: the id column, keep_id, group_size, kept, text_sha256, and __key."""
    prints = cut(fingerprints(docs, id_col, text_col, chunk_bytes))
    odd = cut(differing(docs, prints, id_col, text_col, chunk_bytes).withColumn("__odd", F.lit(True)))
    # a row that differs from its representative is told apart by its SHA-256
    split = (prints.join(odd, "__key", "left")
             .withColumn("__sub", F.when(F.col("__odd"), F.col("__sha")).otherwise(F.lit(""))))
    group = [*GROUP, "__sub"]
    nth = Window.partitionBy(*group, "__key").orderBy("__id")
    split = split.withColumn("__nth", F.row_number().over(nth))
    groups = (split.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"), F.max("__id").alias("keep_id"))
              .filter("group_size > 1"))
    out = salted_join(split, groups, group, "__key", how="left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("__id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("__id").eqNullSafe(keep_id) & (F.col("__nth") == 1)).alias("kept"), F.col("__sha").alias("text_sha256"), "__key")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = exact_groups(docs, id_col, text_col).filter("kept").select("__key")
    rows = keyed_rows(docs, id_col, text_col).join(stay, "__key")
    # rows that agree in id and text but not in other columns: the first by the columns' hash
    first = Window.partitionBy("__key").orderBy(F.xxhash64("__row"))
    return rows.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").select("__row.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
