"""Connected components by alternating large-star and small-star.

Edges are pairs of node ids.  Large-star links every larger neighbour of a node to the
smallest of its neighbourhood; small-star does the same for its smaller neighbours and itself.
Alternating the two turns every component into a star around its smallest node.  Each half step
is an aggregate (minimum neighbour, combined before the shuffle) and an equi-join, so a node with
very many neighbours is never gathered.  Lineage is cut by a reliable checkpoint once a round.

A graph of up to ``FEW`` edges is worked through in one partition, where no step shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60
#: Edges (two ids each) that one task takes.
FEW = 1 << 17


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) for each of the pairs of columns, without a union (which would lose the partitioning)."""
    made = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return df.select(F.inline(made))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v, as large-star leaves them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _pairs(edges.join(least, "u"), ("v", "m"), ("u", "m")).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, root): root is the smallest node of the component; nodes without an
    edge do not appear."""
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MAX_ROUNDS):
        if before[0] <= FEW:
            edges = edges.coalesce(1)
        edges = cut(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    if before[0] <= FEW:
        edges = edges.coalesce(1)
    return _pairs(edges, ("u", "v"), ("v", "v")).select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
