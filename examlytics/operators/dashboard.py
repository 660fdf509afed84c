"""Dashboard queries over the results table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import name_matches


def overview_kpis(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, mean mark rounded half-to-even to 2 places.

    One aggregate, one pass, partial aggregation before the (single-row)
    shuffle.  Rounding follows numpy (scale, round half to even, unscale);
    Spark's ``round``/``bround`` differ on some values, ``rint`` does not.
    An empty table gives 0 for every figure.
    """
    agg = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.avg("marks").alias("_avg"),
    )
    avg = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.rint(F.col("_avg") * 100.0) / 100.0)
    return agg.select("total", "passed", "failed", avg.alias("avg_marks"))


SAVE_ORDER = ["saved_at", "record_id"]


def value_counts(results: DataFrame, column: str, weight: str | None = None,
                 first_seen: str | None = None) -> DataFrame:
    """``(value, n)`` for the non-null values of ``column``, most frequent first.

    Ties are ordered by first appearance, as pandas does: the earliest
    (saved_at, record_id) of each value, a ``min`` that aggregates map-side.
    ``first_seen`` names a precomputed column of that key (for pre-counted
    input); without save-order columns ties fall back to the value.
    ``weight`` names a column of row multiplicities (n = sum of weights).
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")
    if first_seen is not None:
        first = F.min(first_seen)
    elif all(c in results.columns for c in SAVE_ORDER):
        return _counts_in_save_order(results.where(F.col(column).isNotNull()), column, n)
    else:
        first = F.lit(None)
    return (results.where(F.col(column).isNotNull())
            .groupBy(column).agg(n.alias("n"), first.alias("_first"))
            .orderBy(F.desc("n"), F.asc("_first"), F.asc(column))
            .drop("_first"))


def _counts_in_save_order(rows: DataFrame, column: str, n) -> DataFrame:
    """Counts and first save times in a hash aggregate (a minimum over a struct would sort every row); the
    record id is looked up only among the rows of a value's first moment, for values that tie on both."""
    counts = rows.groupBy(column).agg(n.alias("n"), F.min("saved_at").alias("_at"))
    tied = counts.withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy("n", "_at"))).where("_ties > 1")
    first = (rows.select(column, F.col("saved_at").alias("_at"), "record_id").join(tied.select(column, "_at"), [column, "_at"])
             .groupBy(column).agg(F.min("record_id").alias("_id")))
    return (counts.join(first, column, "left").orderBy(F.desc("n"), F.asc("_at"), F.asc("_id"), F.asc(column))
            .select(column, "n"))


def status_distribution(results: DataFrame) -> DataFrame:
    return value_counts(results, "status")


def department_distribution(results: DataFrame) -> DataFrame:
    """Case-sensitive, untrimmed department counts."""
    return value_counts(results, "department")


def global_position(df: DataFrame, order_cols: list[str], out: str = "position",
                    checkpoint: bool = True) -> DataFrame:
    """0-based row position in ``order_cols`` order, computed without a
    single-partition window.

    Range-partition and sort on the keys, tag each row with
    ``monotonically_increasing_id`` (partition id in the high bits, local
    index in the low 33), cut lineage with a reliable checkpoint so both uses
    below see the same ids, then add the number of rows in all earlier
    partitions.  The per-partition count table has one row per partition, so
    broadcasting it is bounded by the partition count, not by the data.
    """
    tagged = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    if checkpoint:
        from ..session import shared_root
        shared_root(df.sparkSession)
        tagged = tagged.checkpoint(eager=True)
    tagged = tagged.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_local", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_offset"))
    return (tagged.join(F.broadcast(offsets), "_part")
            .withColumn(out, (F.col("_offset") + F.col("_local")).cast("bigint"))
            .drop("_mid", "_part", "_local", "_offset"))


def marks_series(results: DataFrame) -> DataFrame:
    """Mark of every record against its 0-based position in save order
    (saved_at, then record_id)."""
    base = results.select("saved_at", "record_id", "marks")
    return global_position(base, ["saved_at", "record_id"]).select("position", "record_id", "marks")


def validate_pattern(spark: SparkSession, pattern: str) -> None:
    """Fail fast on the driver for a bad pattern instead of inside every task."""
    spark.sql("SELECT 'x' RLIKE ?", args=[pattern]).collect()


def student_search(results: DataFrame, pattern: str) -> DataFrame:
    """Records whose student name matches ``pattern`` (Java regex,
    case-insensitive incl. non-ASCII letters, anywhere in the name).
    Null names never match (the app raises on them)."""
    validate_pattern(results.sparkSession, pattern)
    return results.where(F.col("student_name").isNotNull() & name_matches("student_name", pattern))


def pass_records(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "PASS")


def fail_records(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "FAIL")


def record_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("n_records"))
