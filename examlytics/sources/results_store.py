"""The results table: Parquet, partitioned by save date, with a ledger of its committed loads.

Replaces the application's read-everything/rewrite-everything spreadsheet: an append writes only
new files, readers use a declared schema, and ``saved_date`` partitions let date filters prune
whole directories.

Every append, batch or micro-batch, is a *load*.  Its rows are written to directories
``saved_date=<day>/part=<id>`` that belong to this attempt alone, and become visible by one commit
of the :mod:`ledger`.  Rows keep the name of their load, so a load that is repeated replaces its own
rows, also after :func:`compact` has merged many loads' small files into sized ones.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RESULTS, RESULT_COLUMNS
from . import ledger
from .literals import empty_frame

PARTITION_COL = "saved_date"
PART_COL = "part"
LOAD_COL = "load"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
STORED = T.StructType([*RESULTS.fields, T.StructField(LOAD_COL, T.StringType()), T.StructField(PARTITION_COL, T.DateType()),
                       T.StructField(PART_COL, T.StringType())])


def conform(df: DataFrame) -> DataFrame:
    """Align any record frame to the results schema by column name: missing
    columns become null, extra columns are dropped, types are cast."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RESULTS.fields])


def entry(day: str, part: str) -> str:
    return f"{PARTITION_COL}={day}/{PART_COL}={part}"


def day_of(key: str) -> str:
    return key.split("/")[0].split("=", 1)[1]


def _write_part(rows: DataFrame, path: str) -> list[str]:
    """Write rows (results columns and their load) as one part; its ledger keys, one a day.

    Rows are rebalanced by day first: one file per day and output partition, with hot days split,
    instead of one file per task and day.  Dynamic overwrite gives each write a staging folder of its
    own, so writers do not touch each other's files."""
    spark, part = rows.sparkSession, uuid.uuid4().hex
    (rows.withColumn(PARTITION_COL, F.to_date("saved_at")).withColumn(PART_COL, F.lit(part)).hint("rebalance", PARTITION_COL)
     .sortWithinPartitions(PARTITION_COL, LOAD_COL).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(PARTITION_COL, PART_COL).parquet(path))
    root, fs, _ = ledger.hadoop_path(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"{PARTITION_COL}=*/{PART_COL}={part}")) or []
    return [entry(s.getPath().getParent().getName().split("=", 1)[1], part) for s in found]


def results_append(records: DataFrame, path: str, load: str | None = None, sequence: tuple[str, int] | None = None) -> None:
    """Append records (bag semantics: no de-duplication, like each save click).

    Repeating an append under the same ``load`` (a retried micro-batch, a job run again) replaces that load's rows and no
    others; rows that a compaction has merged are taken out of their days in the same commit.  ``sequence`` (a stream, its
    batch number) tells that a load with a larger number than the last is new, so that nothing is looked up for it.
    """
    spark = records.sparkSession
    refuse_foreign_layout(spark, path)
    name = load or f"batch-{uuid.uuid4().hex}"
    keys = _write_part(conform(records).withColumn(LOAD_COL, F.lit(name)), path)

    def decide(state: ledger.State) -> dict:
        old = [k for k, v in state.entries.items() if v["load"] == name]
        put = {k: {"load": name} for k in keys}
        fresh = load is None or (sequence is not None and state.facts.get(f"last {sequence[0]}", -1) < sequence[1])
        merged = [] if fresh else [k for k, v in state.entries.items() if v["load"] is None]
        if merged:
            rows = scan_keys(spark, path, merged)
            hit = [entry(str(r[0] or NO_DAY), r[1]) for r in rows.where(F.col(LOAD_COL) == name).select(PARTITION_COL, PART_COL).distinct().collect()]
            if hit:
                kept = _write_part(scan_keys(spark, path, hit).where(F.col(LOAD_COL) != name).select(*RESULT_COLUMNS, LOAD_COL), path)
                put.update({k: {"load": None} for k in kept})
                old += hit
        change = {"put": put, "drop": old}
        if sequence is not None:
            change["set"] = {f"last {sequence[0]}": max(sequence[1], state.facts.get(f"last {sequence[0]}", -1))}
        return change

    ledger.commit(spark, path, decide)


def refuse_foreign_layout(spark: SparkSession, path: str) -> None:
    """A stream file sink's metadata log would hide every file that the sink did not write."""
    log, fs, _ = ledger.hadoop_path(spark, f"{path}/_spark_metadata")
    if fs.exists(log):
        raise ValueError(f"{path} was written by a stream file sink; use another store")


def scan_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of these directories, with their load, day and part."""
    return spark.read.schema(STORED).option("basePath", path).parquet(*[f"{path.rstrip('/')}/{k}" for k in keys])


def live_keys(spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None) -> list[str]:
    """Ledger keys of the live directories, of the days in the range."""
    keys = sorted(ledger.read_ledger(spark, path).entries)
    if not keys and any(n.startswith(f"{PARTITION_COL}=") for n in ledger.names(spark, path)) and ledger.FOLDER not in ledger.names(spark, path):
        raise ValueError(f"{path} holds days but no ledger; append its records to a new store")
    lo, hi = date_from or "", date_to or "~"
    ranged = date_from is not None or date_to is not None
    return [k for k in keys if not ranged or (day_of(k) != NO_DAY and lo <= day_of(k) <= hi)]


def saved_results(spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Scan of the results table with the declared schema.  A missing table
    reads as an empty frame that still has every column.

    ``date_from`` / ``date_to`` (inclusive, 'yyyy-MM-dd') choose the day directories that are listed and read.
    """
    refuse_foreign_layout(spark, path)
    for day in (date_from, date_to):
        if day is not None:
            dt.date.fromisoformat(day)
    keys = live_keys(spark, path, date_from, date_to)
    df = scan_keys(spark, path, keys) if keys else empty_frame(spark, STORED)
    if date_from is not None:
        df = df.where(F.col(PARTITION_COL) >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.where(F.col(PARTITION_COL) <= F.lit(date_to).cast("date"))
    return df.select(*RESULT_COLUMNS)


def compact(spark: SparkSession, path: str, min_parts: int = 2) -> int:
    """Merge the parts of every day that has ``min_parts`` or more into sized files (the advisory partition size), and
    swap each day by one commit.  Appends that commit meanwhile stay beside the merged part; a day whose parts another
    writer has replaced meanwhile stays as it is.  Returns the number of days swapped."""
    refuse_foreign_layout(spark, path)
    days: dict[str, list[str]] = {}
    for key in ledger.read_ledger(spark, path).entries:
        days.setdefault(day_of(key), []).append(key)
    days = {d: ks for d, ks in days.items() if len(ks) >= min_parts}
    if not days:
        return 0
    rows = scan_keys(spark, path, sorted(k for ks in days.values() for k in ks)).select(*RESULT_COLUMNS, LOAD_COL)
    made = _write_part(rows, path)
    swapped: list[str] = []

    def decide(state: ledger.State) -> dict | None:
        swapped[:] = [k for k in made if all(x in state.entries for x in days[day_of(k)])]
        if not swapped:
            return None
        return {"put": {k: {"load": None} for k in swapped}, "drop": [x for k in swapped for x in days[day_of(k)]]}

    ledger.commit(spark, path, decide)
    return len(swapped)


def vacuum(spark: SparkSession, path: str, retain_hours: float = 168.0) -> int:
    """Remove directories that are not live and older than ``retain_hours``; their number."""
    return ledger.sweep(spark, path, f"{PARTITION_COL}=*/{PART_COL}=*", lambda p: "/".join(p.rstrip("/").split("/")[-2:]), retain_hours)
