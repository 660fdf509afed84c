"""Positions within very large groups, without one task per group.

A plain ``row_number()`` over ``partitionBy(group)`` sends each group to a
single task; a group holding a third of all rows would then be sorted by one
core.  Here the group is salted by a bucket of its ordering key: ranks are
computed inside each (group, bucket) and shifted by the number of earlier
rows of the same group, taken from a per-(group, bucket) count table whose
size is rows / bucket_size at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = 1024


def prefix_offsets(counts: DataFrame, group: str, bucket: str, n: str = "_n") -> DataFrame:
    """Rows of the same group in all earlier buckets, per (group, bucket)."""
    w = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(group, bucket, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint").alias("_offset"))


def bucketed_rank(df: DataFrame, group: str, order: str, bucket: str, out: str,
                  counts: DataFrame | None = None) -> DataFrame:
    """0-based position of each row within ``group`` in ``order`` order.

    ``bucket`` must be monotone in ``order`` within a group (for example
    ``order div B``).  The window runs per (group, bucket).  Rows per (group,
    bucket) are counted on the input, before the window, so the rows shuffle
    once and the counts go through a partial aggregate; ``counts`` (group,
    bucket, _n) gives them where the caller can count closer to the scan.
    """
    w = Window.partitionBy(group, bucket).orderBy(order)
    local = df.withColumn("_local", F.row_number().over(w) - 1)
    if counts is None:
        counts = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    return (local.join(prefix_offsets(counts, group, bucket), [group, bucket])
            .withColumn(out, (F.col("_offset") + F.col("_local")).cast("bigint"))
            .drop("_local", "_offset"))
