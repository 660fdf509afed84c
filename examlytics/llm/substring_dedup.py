"""Exact substring deduplication by difference-cover anchors.

A window is ``WINDOW`` = 50 consecutive words of one document.  A window is a repeat if its word
sequence also starts in a document with a smaller id; every word that a repeat covers is removed.

Hashing every window would shuffle one row a word.  Instead, shorter windows of ``ANCHOR`` =
WINDOW - PERIOD + 1 words are hashed only at places whose index modulo ``PERIOD`` is in ``COVER``, a
difference cover: for any two places there is a shift below PERIOD that takes both into the
cover.  So two equal windows share an equal anchor at the same shift.

1. One pass gives each row's content key (SHA-256 of the text), word count and the digest it has if
   nothing is removed.  Of rows with equal texts the one with the smallest id stands for all: a copy of 50
   words or more loses every word, since each of its windows starts in the smallest row too.
2. Anchors (6 of 31 places) are grouped by hash.  A group with two different texts yields its members.
3. The representatives with such members get their places and their text (a bit table drops most other texts
   before they are shuffled).  Every window that contains a
   matched anchor is a candidate ("extension"): windows are grouped by a 128-bit hash, and a member
   whose id is not the group's smallest is a repeat.
4. Those texts drop the covered words and are digested again.

Only minima and maxima are taken over a group, in a buffer that spills: a passage shared by very many
documents takes one task's time but bounded memory, and no pairs are formed.  Copies are joined by
content with salted keys.

Defined cases: null text has no words.  Documents of fewer than 50 words keep all words.  A null id
sorts before all others.  Rows with the same id never remove each other's words, whether their texts
are equal or not.  Repeated rows get a result each.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bit_table import bit_table, holds
from .common import blocks, cut, map_batches, salted_join, signed, text_bytes, window_hashes, word_hashes

WINDOW = 50
#: A perfect difference set: every residue modulo 31 is a difference of two of its members.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1


def _positions(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place within the row of each window of ``k`` words that lies in one row; ``rows`` are word offsets."""
    n = np.maximum(np.diff(rows) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def plain_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __tag, __content, n_words, plain_sha256) of every row; the digest is that of all words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__tag"), F.unhex(F.sha2(text, 256)).alias("__content"), text.alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = text_bytes(batch.column("__text"))
            words = [b[i:j].tobytes().split() for i, j in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("__id", "__tag", "__content")), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())],
                names=["__id", "__tag", "__content", "n_words", "plain_sha256"])

    return map_batches(src, counted, f"__id {kind}, __tag bigint, __content binary, n_words bigint, plain_sha256 string")


def anchors(texts: DataFrame) -> DataFrame:
    """(hash, __tag, place) of the anchors of (__id, __tag, __text)."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.zeros(PERIOD, bool)
        member[list(COVER)] = True
        for batch in batches:
            b, off = text_bytes(batch.column("__text"))
            tag = batch.column("__tag").to_numpy()
            for i, j in blocks(off):
                (w,), _, _, rows = word_hashes(b[off[i]:off[j]], off[i:j + 1] - off[i])
                row, place = _positions(rows, ANCHOR)
                some = member[place % PERIOD] & (np.diff(rows) >= WINDOW)[row]
                row, place = row[some], place[some]
                at = window_hashes(w, ANCHOR)[rows[row] + place] if len(row) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([signed(at), pa.array(tag[row + i]), pa.array(place.astype(np.int32))], names=["hash", "__tag", "place"])

    return map_batches(texts.select("__tag", "__text"), found, "hash bigint, __tag bigint, place int")


def matched(rows: DataFrame) -> DataFrame:
    """(__tag, places) of the anchors that two different texts share."""
    group = Window.partitionBy("hash")
    shared = rows.withColumn("__lo", F.min("__tag").over(group)).withColumn("__hi", F.max("__tag").over(group)).filter("__lo < __hi")
    return shared.groupBy("__tag").agg(F.collect_set("place").alias("places"))


def repeated(windows_: DataFrame) -> DataFrame:
    """(__id, __tag, places) of the windows that a smaller id has as well."""
    own = F.struct("__id")  # a struct orders null first
    later = windows_.withColumn("__least", F.min(own).over(Window.partitionBy("h1", "h2"))).filter(F.col("__least") < own)
    return later.groupBy("__id", "__tag").agg(F.collect_set("place").alias("places"))


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(__id, __tag, __text) of the wanted (__id, __tag), once each: a bit table drops most other texts before the shuffle, and the
    rows stay dealt by ``__row`` for :func:`with_places`."""
    only = texts.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.xxhash64("__id", "__tag"))))
    kind = texts.schema["__id"].dataType.simpleString()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(only.value, batch.column("__hash").to_numpy()))).select(["__id", "__tag", "__text"])

    found = map_batches(texts.select("__id", "__tag", "__text", F.xxhash64("__id", "__tag").alias("__hash")), some, f"__id {kind}, __tag bigint, __text string")
    return found.withColumn("__row", F.struct("__id", "__tag")).dropDuplicates(["__row"])


def with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(__id, __tag, __text, places) of the rows that have places; a struct is equal to another where both hold null."""
    row = F.struct("__id", "__tag")
    texts = texts if "__row" in texts.columns else texts.withColumn("__row", row)
    return texts.join(places.select(row.alias("__row"), "places"), "__row").select("__id", "__tag", "__text", "places")


def windows(texts: DataFrame) -> DataFrame:
    """(h1, h2, __id, __tag, place) of every window of (__id, __tag, __text, places) that contains a matched anchor."""
    kind = texts.schema["__id"].dataType.simpleString()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = text_bytes(batch.column("__text"))
            flat, at = batch.column("places").flatten().to_numpy(), batch.column("places").offsets.to_numpy()
            at = at - at[0]
            for i, j in blocks(off):
                hashes, _, _, words = word_hashes(b[off[i]:off[j]], off[i:j + 1] - off[i], families=2)
                n = np.maximum(np.diff(words) - WINDOW + 1, 0)
                hit_row = np.repeat(np.arange(j - i), np.diff(at[i:j + 1]))
                hit = flat[at[i]:at[j]]
                lo = np.maximum(hit - (PERIOD - 1), 0)
                hi = np.minimum(hit, n[hit_row] - 1)
                change = np.zeros(int(words[-1]) + 2, np.int64)
                np.add.at(change, words[hit_row] + lo, 1)
                np.add.at(change, words[hit_row] + hi + 1, -1)
                spot = np.flatnonzero(np.cumsum(change) > 0)
                row = np.searchsorted(words, spot, "right") - 1
                h1, h2 = (window_hashes(h, WINDOW, f) for f, h in enumerate(hashes))
                source = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [signed(h1[spot]), signed(h2[spot]), batch.column("__id").take(source), batch.column("__tag").take(source),
                     pa.array((spot - words[row]).astype(np.int32))], names=["h1", "h2", "__id", "__tag", "place"])

    return map_batches(texts, extend, f"h1 bigint, h2 bigint, __id {kind}, __tag bigint, place int")


def without_repeats(texts: DataFrame) -> DataFrame:
    """(__id, __tag, removed, left_sha256, left_text) of (__id, __tag, __text, places of repeated windows)."""
    kind = texts.schema["__id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = text_bytes(batch.column("__text"))
            removed, left = [], []
            for i in range(len(batch)):
                words = b[off[i]:off[i + 1]].tobytes().split()
                p = batch.column("places")[i].values.to_numpy()
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, p, 1)
                np.add.at(change, p + WINDOW, -1)
                stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                removed.append(len(words) - len(stay))
                left.append(b" ".join([words[k] for k in stay]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__tag"), pa.array(removed, pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), pa.array(left, pa.binary()).cast(pa.string())],
                names=["__id", "__tag", "removed", "left_sha256", "left_text"])

    return map_batches(texts, digest, f"__id {kind}, __tag bigint, removed bigint, left_sha256 string, left_text string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: the id column, n_words, n_removed, kept_sha256 and, ``with_text``, kept_text."""
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__tag"), F.col(text_col).alias("__text"))
    rows = cut(plain_words(docs, id_col, text_col))
    # a text that no other row has needs no partner
    least = rows.groupBy("__content").agg(F.min(F.struct("__id")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = (salted_join(rows, least, ["__content"], "__id", how="left")
            .withColumn("first", F.col("least").isNull() | F.col("__id").eqNullSafe(F.col("least.__id"))).drop("least"))

    hits = matched(anchors(texts))
    firsts = rows.filter(F.col("first") & (F.col("n_words") >= WINDOW)).select("__id", "__tag").distinct()
    wanted = cut(firsts.join(hits, "__tag"))
    chosen = cut(with_places(texts_of(texts, wanted), wanted))
    changed = without_repeats(with_places(chosen.drop("places"), repeated(windows(chosen))))
    changed = cut(changed if with_text else changed.drop("left_text"))

    same = rows["__id"].eqNullSafe(changed["__id"]) & (rows["__tag"] == changed["__tag"]) & rows["first"]
    out = rows.join(changed, same, "left").select(rows["__id"], rows["__tag"], "n_words", "plain_sha256", "first",
                                                  *[changed[c] for c in changed.columns if c not in ("__id", "__tag")])
    gone = ~F.col("first") & (F.col("n_words") >= WINDOW)
    n_removed = F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0)))
    sha = F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha256", "plain_sha256"))
    if not with_text:
        return out.select(F.col("__id").alias(id_col), "n_words", n_removed.alias("n_removed"), sha.alias("kept_sha256"))
    plain = F.array_join(F.filter(F.split(F.coalesce("__text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    each = out.withColumn("gone", gone).withColumn("n_removed", n_removed).withColumn("kept_sha256", sha).dropDuplicates(["__id", "__tag"])
    joined = texts.join(each, texts["__id"].eqNullSafe(each["__id"]) & (texts["__tag"] == each["__tag"]))
    return joined.select(texts["__id"].alias(id_col), "n_words", "n_removed", "kept_sha256",
                         F.when(F.col("gone"), F.lit("")).otherwise(F.coalesce("left_text", plain)).alias("kept_text"))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM rep)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
