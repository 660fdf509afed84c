"""Small literal tables built on the JVM (no Python worker, no RDD)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A DataFrame of fixed rows, as a local relation of typed literals."""
    st = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs))).select(
        *[F.col(f.name).cast(f.dataType) for f in st.fields])


def empty_frame(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """Zero rows with the given columns (for a table that does not exist yet)."""
    st = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
