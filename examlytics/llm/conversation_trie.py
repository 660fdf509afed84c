"""Prefix trie of rebuilt conversations, rolled up in bands of depth.

1. Turns are ranked inside their conversation by a global position (range partitions and their
   offsets), so a conversation of any length is spread over many tasks.  From here on a turn is a
   digest of (role, text) and a word count.
2. Conversation c is rebuilt: the first h turns of c - c % GROUP (h = crc32(c) % HEADS), then its
   own turns after its first h.
3. The identity of a prefix of d turns is its depth and the sum of four 32-bit hashes of (place,
   turn) over the prefix: 128 bits, and a sum, so prefixes of a long conversation are made in
   blocks of BLOCK turns and shifted by the totals of the blocks before.
4. Equal identities are one node, represented by its smallest conversation.  As a conversation that
   is smallest in a prefix is smallest in all its continuations, a node is one row (conversation,
   depth) of the sequences, and joins on those keys meet no hot key.
5. Rollup over subtrees: bands are HEIGHT depths high.  A node explodes to its ancestors within its
   band only (HEIGHT rows at most).  The band roots with their band totals form a trie of their
   own, HEIGHT times as shallow, rolled up in the same way; its completed totals then explode to
   the ancestors in the band above each root.  A trie of depth D takes log(D) / log(HEIGHT) rounds
   and at most HEIGHT rows a node and level.

The digest of the conversations that end at a node streams their sorted ids: runs of ids are
joined in range partitions, then one task a node reads the runs, one at a time (SHA-256 is sequential).

Defined cases: null role and null text are empty.  Turns are ordered by turn (null first), then by
the digest of role and text; repeated turns all count.  A null conv_id is one conversation whose
decimal is empty: it has no base, is smaller than all others and shows as null (the id -2**63 is
taken for it).  A rebuilt conversation without turns is a member of the root alone.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dashboard import global_position
from .common import cut, map_batches, salted_join

GROUP, HEADS = 20, 4
BLOCK = 1024
HEIGHT = 16
#: Ids joined to one text before the digest.
RUN = 4096
_NULL = -(1 << 63)
_WORD = r"[^\x20\x09-\x0D]+"
_TERMS = ["__s1", "__s2", "__s3", "__s4"]


def ranked_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, content, words, position): turns in order, positions over the whole table."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    content = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(F.coalesce(F.col(conv_col).cast("bigint"), F.lit(_NULL)).alias("conv"), F.col(turn_col).alias("__turn"),
                        content.alias("content"), F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("words"))
    return global_position(rows, ["conv", "__turn", "content"]).drop("__turn")


def decimal(conv: str = "conv") -> Column:
    return F.when(F.col(conv) == _NULL, F.lit("")).otherwise(F.col(conv).cast("string"))


def rebuilt(ranked: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, content, words) of the rebuilt conversations, depth from 1, and (conv, length) of each."""
    convs = ranked.groupBy("conv").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv", "start", "n", (F.crc32(F.encode(decimal(), "UTF-8")) % heads).alias("h"),
                         F.when(F.col("conv") != _NULL, F.col("conv") - F.col("conv") % group).alias("base"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = cut(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    placed = salted_join(ranked, convs.select("conv", "start", "h", "taken", length.alias("length")), ["conv"], "position")
    at = F.col("position") - F.col("start")
    own = (placed.filter(at >= F.col("h"))
           .select("conv", (F.col("taken") + at - F.col("h") + 1).alias("depth"), "content", "words", "length"))
    first = (placed.filter(at < heads - 1)
             .select(F.col("conv").alias("base"), at.alias("at"), "content", "words"))
    head = (first.join(convs.select("conv", "base", "h", length.alias("length")), "base").filter("at < h")
            .select("conv", (F.col("at") + 1).alias("depth"), "content", "words", "length"))
    return own.unionByName(head), convs.select("conv", length.alias("length"))


def _identity(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def _root() -> Column:
    return _identity(F.lit(0), [F.lit(0)] * 4)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, words, ends): identity of each prefix and of the prefix one turn shorter."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("content")), 256)
    rows = rows.withColumn("__d", digest).select(
        "conv", "depth", "words", "length", F.floor((F.col("depth") - 1) / BLOCK).alias("__block"),
        *[F.conv(F.substring("__d", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(c) for i, c in enumerate(_TERMS)])
    before = Window.partitionBy("conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "__block").agg(*[F.sum(c).alias(c) for c in _TERMS])
    offsets = totals.select("conv", "__block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_off") for c in _TERMS])
    upto = Window.partitionBy("conv", "__block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", *[F.sum(c).over(upto).alias(f"{c}_run") for c in _TERMS]).join(offsets, ["conv", "__block"])
    whole = [F.col(f"{c}_run") + F.col(f"{c}_off") for c in _TERMS]
    shorter = [s - F.col(c) for s, c in zip(whole, _TERMS)]
    return run.select("conv", "depth", _identity(F.col("depth"), whole).alias("key"), _identity(F.col("depth") - 1, shorter).alias("parent"),
                      "words", (F.col("depth") == F.col("length")).alias("ends"))


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rollup(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(key, leaves, saved): what the strict descendants of each node add to it.

    ``rows`` holds the sequences (conv, depth from 1, key, parent); leaves and saved are set on the one row of each node."""
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    band = F.floor((F.col("depth") - 1) / height)
    upto = Window.partitionBy("conv", "__band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    pathed = rows.withColumn("__band", band).withColumn("path", F.collect_list("parent").over(upto))
    root_row = F.col("depth") % height == 0

    def up(some: DataFrame) -> DataFrame:
        return some.select(F.explode("path").alias("key"), "leaves", "saved")

    inner = _summed(up(pathed.filter(~root_row & F.col("leaves").isNotNull())))
    if deepest < height:
        return inner
    inner = cut(inner)
    tops = pathed.filter(root_row).select("conv", (F.col("depth") / height).cast("bigint").alias("depth"), "key", "path", "leaves", "saved")
    added = inner.select("key", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    mine = tops.filter("leaves is not null").join(added, "key", "left").select(
        "conv", "depth", "key", "path", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
    tops = cut(mine.unionByName(tops.filter("leaves is null")))
    below = rollup(tops.select("conv", "depth", "key", F.col("path")[0].alias("parent"), "leaves", "saved"), height)
    below = below.select("key", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    complete = tops.filter("leaves is not null").join(below, "key", "left").select(
        "path", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
    return _summed(inner.unionByName(up(complete)))


def _id_digests(ends: DataFrame, most: int = RUN) -> DataFrame:
    """(key, ends_sha256): digest of the comma-joined decimal ids of each key, numerically ascending."""
    dealt = ends.select("key", "conv", decimal().alias("id")).repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids = None, None, []
        out: list[tuple] = []
        for batch in batches:
            for k, c, i in zip(*(batch.column(n).to_pylist() for n in ("key", "conv", "id"))):
                if ids and (k != key or len(ids) == most):
                    out.append((key, first, ",".join(ids)))
                    ids = []
                if not ids:
                    key, first = k, c
                ids.append(i)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "conv", "ids"), r)) for r in out], run_schema)
                out = []
        if ids:
            yield pa.RecordBatch.from_pylist([{"key": key, "conv": first, "ids": ",".join(ids)}], run_schema)

    run_schema = pa.schema([("key", pa.binary()), ("conv", pa.int64()), ("ids", pa.string())])
    joined = map_batches(dealt, runs, "key binary, conv bigint, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            keys, made = [], []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    sha.update(b",")
                else:
                    if sha is not None:
                        keys.append(key)
                        made.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made, pa.string())], names=["key", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    return map_batches(joined.repartition("key").sortWithinPartitions("key", "conv"), digest, "key binary, ends_sha256 string")


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
         group: int = GROUP, heads: int = HEADS, height: int = HEIGHT) -> DataFrame:
    """One row per node: key, parent_key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(ranked_turns(turns, conv_col, turn_col, role_col, text_col), group, heads)
    seq = cut(prefixes(rows))
    ends = F.sum(F.col("ends").cast("bigint")).alias("n_ends")
    deep = seq.groupBy("key", "parent", "depth", "words").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), ends)
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.count_if(F.col("length") == 0).alias("n_ends")).filter("n_convs > 0")
    top = top.select(_root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"),
                     F.lit(0).cast("bigint").alias("words"), "n_convs", "conv", "n_ends")
    nodes = deep.unionByName(top)
    kids = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                .withColumn("leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))

    held = nodes.select("conv", "depth", "leaves", "saved")
    below = rollup(cut(seq.select("conv", "depth", "key", "parent").join(held, ["conv", "depth"], "left")), height)
    totals = _summed(nodes.select("key", "leaves", "saved").unionByName(below))

    # the parent's smallest conversation is the node's own, but where the node is its conversation's first
    firsts = nodes.groupBy("conv").agg(F.min("depth").alias("depth")).join(nodes.select("conv", "depth", "key", "parent"), ["conv", "depth"])
    forks = nodes.filter("n_children > 1 or n_children > 0 and n_ends > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    branch = salted_join(firsts.filter("parent is not null").select("key", "parent"), forks, ["parent"], "key").select("key", "parent_conv")

    ended = seq.filter("ends").select("key", "conv").unionByName(convs.filter("length = 0").select(_root().alias("key"), "conv"))
    out = (nodes.drop("leaves", "saved").join(totals, "key").join(branch, "key", "left").join(_id_digests(ended), "key", "left"))

    def shown(c: str) -> Column:
        return F.when(F.col(c) != _NULL, F.col(c))

    return out.select("key", F.col("parent").alias("parent_key"), shown("conv").alias("conv_id"), "depth",
                      F.when(F.col("depth") > 0, F.when(F.col("parent_conv").isNull(), shown("conv")).otherwise(shown("parent_conv"))).alias("parent_conv_id"),
                      "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(turns).drop("key", "parent_key")


_CRC_BIT = "CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384) ELSE t // 2 END"
OP13_SQL = rf"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, content) - 1 AS p FROM (
    SELECT conv_id AS c, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS content,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations)),
v AS (
  SELECT c, n, c - c % 20 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], [CAST(i AS BIGINT) for i in range(8)]), lambda t, i: {_CRC_BIT})), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
w AS (SELECT v.*, least(v.h, coalesce(b.n, 0)) AS taken FROM v LEFT JOIN v b ON b.c = v.base),
r AS (
  SELECT w.c, p + 1 AS d, content, words FROM w JOIN t ON t.c = w.base AND p < h
  UNION ALL SELECT w.c, taken + p - h + 1, content, words FROM w JOIN t ON t.c = w.c AND p >= h),
s AS (
  SELECT c, d, words, md5(string_agg(content, ',') OVER (PARTITION BY c ORDER BY d)) AS key,
         coalesce(md5(string_agg(content, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 'root') AS parent,
         d = max(d) OVER (PARTITION BY c) AS ends FROM r
  UNION ALL SELECT c, 0, 0, 'root', NULL, c NOT IN (SELECT c FROM r) FROM w),
n AS (
  SELECT key, any_value(parent) AS parent, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM s GROUP BY key),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.parent = n.key) AS n_children FROM n),
a AS (
  SELECT s.key, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(k.own) AS saved_tokens
  FROM k JOIN s ON s.c = k.conv_id AND s.d <= k.depth GROUP BY s.key)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
       CAST(a.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN a USING (key) LEFT JOIN n q ON q.key = k.parent
"""
