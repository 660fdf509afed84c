"""Dashboard figures that are kept beside the results store and follow its loads.

``_states``: one row a (day, part, department, status) of the store: its number of records, number and
sum of marks, and first key in save order.  Such rows add up, so every headline figure is a merge
of them; the records are not read again.
``_series``: every day's marks in save order, with a sequence number inside the day's segments.  A position in
the whole series is the number of records in earlier days and segments plus the place in the segment, so a new load
moves offsets and rewrites its own days only.

Both are brought up to date by a refresh, which reads the parts (days) of the store that it does not cover
yet and commits what it covers to a :mod:`ledger` of its own.  A load that was repeated, or a day that was
compacted, has other parts, so its old rows drop out.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger, results_store as store
from .literals import empty_frame

STATES = ("key string, saved_date date, department string, status string, n bigint, marks_n bigint, marks_sum decimal(38,0), "
          "first struct<saved_at:timestamp_ntz,record_id:string>")
SERIES = "saved_at timestamp_ntz, record_id string, marks bigint, seq bigint, refresh string, saved_date date"
#: A refresh that finds more refreshes than this before it merges them.
MOST_REFRESHES = 16
#: ``monotonically_increasing_id`` counts inside a partition in its low bits.
_SEGMENT = 33


def _state_rows(records: DataFrame) -> DataFrame:
    key = F.concat(F.lit(f"{store.PARTITION_COL}="), F.coalesce(F.col(store.PARTITION_COL).cast("string"), F.lit(store.NO_DAY)),
                   F.lit(f"/{store.PART_COL}="), F.col(store.PART_COL))
    return (records.groupBy(key.alias("key"), store.PARTITION_COL, "department", "status")
            .agg(F.count(F.lit(1)).alias("n"), F.count("marks").alias("marks_n"), F.sum(F.col("marks").cast("decimal(20,0)")).cast("decimal(38,0)").alias("marks_sum"),
                 F.min(F.struct("saved_at", "record_id")).alias("first")))


def refresh_states(spark: SparkSession, path: str) -> int:
    """Make the states of all parts that have none; their number (day directories of loads)."""
    table = f"{path.rstrip('/')}/_states"
    live = set(store.live_keys(spark, path))
    covered = ledger.read_ledger(spark, table).entries
    missing = sorted(live - covered.keys())
    stale = [k for k in covered if k not in live]
    if not missing and not stale:
        return 0
    change: dict = {"drop": stale, "put": {}}
    refreshes = sorted({v["refresh"] for k, v in covered.items() if k in live})
    merged = sorted(live & covered.keys()) if len(refreshes) >= MOST_REFRESHES else []
    if missing or merged:
        made = uuid.uuid4().hex
        parts = [_state_rows(store.scan_keys(spark, path, missing))] if missing else []
        if merged:
            parts.append(_read_states(spark, table, {k: covered[k] for k in merged}))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rows.hint("rebalance").write.parquet(f"{table}/refresh={made}")
        change["put"] = {k: {"refresh": made} for k in [*missing, *merged]}
    ledger.commit(spark, table, lambda state: change)
    return len(missing)


def _read_states(spark: SparkSession, table: str, entries: dict[str, dict]) -> DataFrame:
    if not entries:
        return empty_frame(spark, STATES)
    paths = sorted({f"{table}/refresh={v['refresh']}" for v in entries.values()})
    return spark.read.schema(STATES).parquet(*paths).where(F.col("key").isin(sorted(entries)))


def states(spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """State rows of the live parts (of the days in the range), brought up to date."""
    refresh_states(spark, path)
    table = f"{path.rstrip('/')}/_states"
    covered = ledger.read_ledger(spark, table).entries
    return _read_states(spark, table, {k: covered[k] for k in store.live_keys(spark, path, date_from, date_to) if k in covered})


def overview_kpis(rows: DataFrame) -> DataFrame:
    """``dashboard.overview_kpis`` of the records behind the states."""
    def of(status: str):
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0)).cast("bigint")

    agg = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"), of("PASS").alias("passed"), of("FAIL").alias("failed"),
                   F.sum("marks_n").alias("_n"), F.sum("marks_sum").cast("double").alias("_sum"))
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))
    return agg.select("total", "passed", "failed", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.rint(mean * 100.0) / 100.0).alias("avg_marks"))


# --- marks series -----------------------------------------------------------

def refresh_series(spark: SparkSession, path: str) -> int:
    """Put the marks of every day whose parts have changed in save order; the number of such days."""
    table = f"{path.rstrip('/')}/_series"
    days: dict[str, list[str]] = {}
    for key in store.live_keys(spark, path):
        days.setdefault(store.day_of(key), []).append(key)
    mark = {d: hashlib.sha256("\n".join(sorted(ks)).encode()).hexdigest() for d, ks in days.items()}
    covered = ledger.read_ledger(spark, table).entries
    changed = [d for d in days if covered.get(d, {}).get("parts") != mark[d]]
    stale = [d for d in covered if d not in days]
    if not changed and not stale:
        return 0
    put = {}
    if changed:
        made = uuid.uuid4().hex
        rows = store.scan_keys(spark, path, [k for d in changed for k in days[d]]).select(store.PARTITION_COL, "saved_at", "record_id", "marks")
        (rows.repartitionByRange("saved_at", "record_id").sortWithinPartitions("saved_at", "record_id")
         .withColumn("seq", F.monotonically_increasing_id()).withColumn("refresh", F.lit(made))
         .write.partitionBy("refresh", store.PARTITION_COL).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table))
        segments: dict[str, list] = {d: [] for d in changed}
        written = _read_series(spark, table, {d: {"refresh": made} for d in changed})
        found = written.groupBy(store.PARTITION_COL, F.shiftright("seq", _SEGMENT).alias("segment")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
        for r in found.collect():                       # one row a day and file
            segments[str(r[0] or store.NO_DAY)].append([r["first"], r["n"]])
        put = {d: {"parts": mark[d], "refresh": made, "segments": sorted(segments[d])} for d in changed}
    ledger.commit(spark, table, lambda state: {"drop": stale, "put": put})
    return len(changed)


def _read_series(spark: SparkSession, table: str, days: dict[str, dict]) -> DataFrame:
    if not days:
        return empty_frame(spark, SERIES)
    paths = [f"{table}/refresh={v['refresh']}/{store.PARTITION_COL}={d}" for d, v in sorted(days.items())]
    return spark.read.schema(SERIES).option("basePath", table).parquet(*paths)


def marks_series(spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """``dashboard.marks_series`` of the stored records (of the days in the range): their mark against their 0-based position in
    save order.  Only offsets depend on other days, one for each day and file."""
    refresh_series(spark, path)
    table = f"{path.rstrip('/')}/_series"
    covered = ledger.read_ledger(spark, table).entries
    wanted = {store.day_of(k) for k in store.live_keys(spark, path, date_from, date_to)}
    days = {d: v for d, v in covered.items() if d in wanted}
    offsets, before = [], 0
    for day in sorted(days, key=lambda d: (d != store.NO_DAY, d)):        # records without a save time come first
        for first, n in days[day]["segments"]:
            offsets.append((days[day]["refresh"], first >> _SEGMENT, day, before - first))
            before += n
    if not offsets:
        return empty_frame(spark, "position bigint, record_id string, marks bigint")
    shift = spark.createDataFrame(offsets, "refresh string, segment bigint, day string, shift bigint")
    day = F.coalesce(F.col(store.PARTITION_COL).cast("string"), F.lit(store.NO_DAY))
    rows = _read_series(spark, table, days).select("refresh", F.shiftright("seq", _SEGMENT).alias("segment"), day.alias("day"), "seq", "record_id", "marks")
    return rows.join(F.broadcast(shift), ["refresh", "segment", "day"]).select(
        (F.col("seq") + F.col("shift")).alias("position"), "record_id", "marks")
