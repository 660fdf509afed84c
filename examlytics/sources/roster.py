"""Examiner roster checks against the results table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roster_lookup(results: DataFrame, roster: DataFrame, name_col: str = "username") -> DataFrame:
    """Per examiner name in the results: record count and whether the name is
    on the roster.  Results are aggregated first (partial aggregation), so the
    join sees one row per examiner on each side.  Passwords are not carried.
    """
    per_examiner = results.groupBy("examiner_name").agg(F.count(F.lit(1)).alias("n_records"))
    names = roster.select(F.col(name_col).alias("examiner_name")).distinct().withColumn("_on", F.lit(True))
    return (per_examiner.join(names, "examiner_name", "left")
            .select("examiner_name", "n_records", F.coalesce("_on", F.lit(False)).alias("known")))


def unknown_examiner_records(results: DataFrame, roster: DataFrame, name_col: str = "username") -> DataFrame:
    return results.join(roster.select(F.col(name_col).alias("examiner_name")), "examiner_name", "left_anti")


def read_roster_csv(spark, path: str, name_col: str = "Username") -> DataFrame:
    """Examiner roster from a CSV export of the roster sheet.  Only the
    user name is kept; passwords are never loaded into a DataFrame."""
    from pyspark.sql import types as T
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return (spark.read.option("header", True).schema(schema).csv(path)
            .select(F.col(f"`{name_col}`").alias("username")).where(F.col("username").isNotNull()))
