"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become tokens: lower-cased runs of letters and digits; in scripts that write no spaces between words
(Chinese, Japanese, Thai, Lao, Khmer, Burmese) every letter is a token.  A seed is a fixed mask over a few
consecutive tokens that looks at the positions marked 1 and ignores the others, so a hit survives
substitutions at the ignored ones.  Every position of every training and benchmark text is hashed
under each mask and the hashes are joined.  With the first two masks of ``MASKS``, any ``WINDOW`` = 20
aligned tokens with up to four substitutions contain a hit, as do most shorter items with a fifth of their tokens
substituted.  Items of the lengths where they miss a pattern, or do not fit, have a shorter mask as well
(``LENGTHS``), so that every permitted pattern of every length has a hit (tests/llm checks them all).

Around each hit the two token runs are compared on the hit's diagonal, substitutions allowed:
a document is contaminated by an item if ``WINDOW`` aligned tokens (all tokens of a shorter item)
agree in at least ``PERCENT`` per cent of places.

Cost: training positions are first tested against a bit table of the benchmark's seed hashes, first
tokens and first pairs of tokens, the cheapest test first.  The table has 2**FILTER_BITS bits whatever the benchmark's size, so it is a constant of bounded size in the plan; false
positives only cost work, and every survivor goes through the exact join.  A surviving
row carries just the 2 * REACH + 1 token hashes around it.  The benchmark's rows go into the join
as an ordinary side: Spark broadcasts it below its own threshold and shuffles beyond it.

Defined cases: null or empty texts and items without tokens match nothing.  Items of one to four tokens match
where a document holds them whole, common words too: what is in the benchmark is taken at its word.  Repeated documents and repeated items are
judged one by one; several items or places count once each in ``hits``.  A null item id is reported as null.
An empty benchmark leaves every document clean.  Other columns are not read; ``drop_contaminated``
passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed_rows, row_key

#: Seeds: 1 marks a token that must agree.  All but the last begin with two such tokens.
MASKS = ("111011", "11100011", "1111", "111", "11", "1")
#: Numbers of tokens of the items that each mask is for; None for all.
LENGTHS = (None, None, (4, 8, 10, 11, 15), (3, 6, 7), (2, 5), (1,))
WINDOW = 20
PERCENT = 80
MIN_ITEM = 1
#: Tokens kept on each side of a hit: a window that holds it lies within.
REACH = WINDOW
FILTER_BITS = 20
SPLIT = "[^\\p{L}\\p{N}]+"
#: Letters of scripts without spaces; none lies before the first of them, which is tested first.
UNSPACED = ("[[\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u31F0-\\u31FF\\u3400-\\u4DBF\\u4E00-\\u9FFF"
            "\\uA9E0-\\uA9FF\\uAA60-\\uAA7F\\uF900-\\uFAFF\\uFF66-\\uFF9F\\x{20000}-\\x{3FFFF}]&&\\p{L}]")
PERHAPS_UNSPACED = "[\\u0E00-\\x{10FFFF}]"


def token_hashes(text: Column) -> Column:
    given = F.coalesce(text, F.lit(""))
    spaced = F.when(given.rlike(PERHAPS_UNSPACED), F.regexp_replace(given, UNSPACED, " $0 ")).otherwise(given)
    words = F.filter(F.split(F.lower(spaced), SPLIT), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_hash(h: Column, i: Column, k: int) -> Column:
    """Hash of the tokens from 0-based place ``i`` that mask ``k`` selects; null if the mask does not fit."""
    own = F.xxhash64(F.lit(k), *[F.get(h, i + at) for at, bit in enumerate(MASKS[k]) if bit == "1"])
    return F.when(i + len(MASKS[k]) <= F.size(h), own)


def pair_hash(a: Column, b: Column) -> Column:
    """Of the two tokens that every mask but the last begins with."""
    return a.bitwiseXOR(F.shiftleft(b, 1))


def seeds_at(h: Column, places: Column, of_items: bool = False) -> Column:
    """(seed, at) of every mask at the given places; of items, only of the masks for their length."""
    def under(k: int) -> Column:
        seeds = F.transform(places, lambda i: F.struct(seed_hash(h, i, k).alias("seed"), i.alias("at")))
        return F.when(F.size(h).isin(*LENGTHS[k]), seeds).otherwise(F.slice(seeds, 1, 0)) if of_items and LENGTHS[k] else seeds

    each = [under(k) for k in range(len(MASKS))]
    return F.filter(F.flatten(F.array(*each)), lambda s: s["seed"].isNotNull())


def around(h: Column, place: Column) -> Column:
    """The tokens from REACH before a place to REACH behind it; null beyond the text's ends."""
    return F.transform(F.sequence(place - REACH, place + REACH), lambda i: F.when(i >= 0, F.get(h, i.cast("int"))))


def benchmark_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(seed, item, item_tokens, around) for each place of each item under each mask."""
    items = (benchmark.select(F.col(id_col).alias("__item"), token_hashes(F.col(text_col)).alias("__h"))
             .filter(F.size("__h") >= MIN_ITEM))
    h = F.col("__h")
    return (items.withColumn("__s", F.explode(seeds_at(h, F.sequence(F.lit(0), F.size(h) - 1), of_items=True)))
            .select(F.col("__s.seed").alias("__seed"), "__item", F.size(h).alias("__item_tokens"),
                    around(h, F.col("__s.at")).alias("__theirs"), F.get(h, F.col("__s.at")).alias("__t0"),
                    F.get(h, F.col("__s.at") + 1).alias("__t1")))


def _bit(seed: Column) -> tuple[Column, Column]:
    at = F.shiftrightunsigned(seed, 64 - FILTER_BITS)
    return F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")


def filter_table(seeds: DataFrame) -> Column:
    """The benchmark's seeds, their first tokens and first token pairs as a constant array of
    2**FILTER_BITS bits in 64-bit words."""
    hashes = seeds.select(F.explode(F.array("__seed", "__t0", pair_hash(F.col("__t0"), F.col("__t1")))).alias("x"))
    word, bit = _bit(F.col("x"))
    rows = hashes.filter("x is not null").select(word.alias("w"), F.expr("1L").alias("one"), bit.alias("b")).groupBy("w").agg(
        F.expr("bit_or(shiftleft(one, b))").alias("bits")).collect()  # at most 2**(FILTER_BITS - 6) rows
    table = [0] * (1 << (FILTER_BITS - 6))
    for r in rows:
        table[r["w"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded to a constant


def longest_agreement(ours: Column, theirs: Column, item_tokens: Column) -> Column:
    """Whether WINDOW aligned tokens (or the whole of a shorter item) around the hit agree in PERCENT of places."""
    width = F.least(F.lit(WINDOW), item_tokens)
    equal = F.zip_with(ours, theirs, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("int")))
    inside = F.transform(equal, lambda x: x.isNotNull().cast("int"))
    agree = F.transform(equal, lambda x: F.coalesce(x, F.lit(0)))

    def total(a: Column, i: Column) -> Column:
        return F.aggregate(F.slice(a, i, width), F.lit(0), lambda s, x: s + x)

    return F.exists(F.sequence(F.lit(1), F.lit(2 * REACH + 2) - width),
                    lambda i: (total(inside, i) == width) & (total(agree, i) * 100 >= width * PERCENT))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(__key, id, __item, __hits): documents and the items found in them; __hits counts the seed hits behind it."""
    seeds = cut(benchmark_seeds(benchmark, item_col, item_text_col))
    table = filter_table(seeds)
    rows = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__key"), token_hashes(F.col(text_col)).alias("__h"))

    def maybe(s: Column) -> Column:
        word, bit = _bit(s)
        return F.getbit(F.get(F.col("__table"), word), bit) == 1

    # a cascade of cheaper tests first: the token, the pair (or the token alone as an item), and only then the seeds
    places = F.filter(F.transform(F.col("__h"), lambda x, i: F.when(
        maybe(x) & (maybe(pair_hash(x, F.get(F.col("__h"), i + 1))) | maybe(seed_hash(F.col("__h"), i, len(MASKS) - 1))), i)),
        lambda i: i.isNotNull())
    marked = F.filter(seeds_at(F.col("__h"), F.col("__places")), lambda s: maybe(s["seed"]))
    with_context = F.transform(marked, lambda s: F.struct(s["seed"].alias("seed"), around(F.col("__h"), s["at"]).alias("ours")))
    hits = (rows.withColumn("__table", table).withColumn("__places", places).withColumn("__s", F.explode(with_context))
            .select("__id", "__key", F.col("__s.seed").alias("__seed"), F.col("__s.ours").alias("__ours")))
    found = hits.join(seeds.drop("__t0", "__t1"), "__seed").filter(longest_agreement(F.col("__ours"), F.col("__theirs"), F.col("__item_tokens")))
    return found.groupBy("__key", "__item").agg(F.first("__id").alias("__id"), F.count(F.lit(1)).alias("__hits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    bad = contaminated(docs, benchmark, id_col, text_col).select("__key").distinct()
    return keyed_rows(docs, id_col, text_col).join(bad, "__key", "left_anti").select("__row.*")


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("__id").alias("doc_id"), F.col("__item").alias("item_id"))
