"""Per-student report text (the PDF report re-aimed as a text column), and a table of the latest records
that follows the results store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..schemas import RESULT_COLUMNS, RESULTS
from . import ledger, results_store as store
from .literals import empty_frame


def latest_per_roll(results: DataFrame) -> DataFrame:
    """Latest record per roll number (a re-saved report overwrites the file,
    so the last save wins).

    ``row_number() = 1`` runs as a partial WindowGroupLimit before the
    shuffle: a roll number with millions of saves sends one row per map
    partition.
    """
    w = Window.partitionBy("roll_number").orderBy(F.desc("saved_at"), F.desc("record_id"))
    return results.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def report_text(results: DataFrame) -> DataFrame:
    """Report text of the latest record per roll number."""
    return render_reports(latest_per_roll(results))


def render_reports(latest: DataFrame) -> DataFrame:
    """One report per row: title, the student/project/examiner lines, a
    blank line, then the evaluation text."""

    def line(label, col):
        return F.concat(F.lit(label + ": "), F.coalesce(F.col(col), F.lit("")))

    # field labels are the results sheet's own column names
    name, roll, dept, title = K.SHEET_COLUMNS[1:5]
    report = F.concat_ws(
        "\n", F.lit(K.REPORT_TITLE), line(name, "student_name"), line(roll, "roll_number"),
        line(dept, "department"), line(title, "project_title"), line("Examiner", "examiner_name"),
        F.lit(""), F.coalesce(F.col("result"), F.lit("")))
    return latest.select("roll_number",
                         F.concat(F.coalesce("roll_number", F.lit("")), F.lit(K.REPORT_NAME_SUFFIX)).alias("report_name"),
                         report.alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Report table, range-partitioned and sorted by roll number.

    One file per student (the app's layout) would mean millions of files or
    directories; a sorted Parquet table keeps lookups of one student cheap
    through row-group min/max statistics on ``roll_number``.
    """
    (reports.repartitionByRange("roll_number").sortWithinPartitions("roll_number")
     .write.mode("overwrite").parquet(path))


def read_report(spark, path: str, roll_number: str) -> DataFrame:
    """One student's report; the equality filter is pushed to the Parquet scan."""
    return spark.read.parquet(path).where(F.col("roll_number") == roll_number)


# ---------------------------------------------------------------------------
# Latest records, kept: one row per roll, in buckets of roll numbers, each
# bucket one live part of a ledger.  A refresh reads the loads of the results
# store that are new and rewrites the buckets of their rolls only.
# ---------------------------------------------------------------------------

#: Buckets of a new table.  A refresh rewrites whole buckets, so they should be small beside the table.
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce("roll_number", F.lit(""))), F.lit(buckets)).cast("int")


def _read_buckets(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    if not keys:
        return empty_frame(spark, RESULTS)
    paths = [f"{table.rstrip('/')}/{k}" for k in sorted(keys)]
    return spark.read.schema(RESULTS).parquet(*paths)


def refresh_latest(spark: SparkSession, store_path: str, table: str, buckets: int = BUCKETS) -> int:
    """Bring the table of latest records up to date with the results store; the number of buckets rewritten.

    New loads can only replace a roll's row by a later one, so their own latest rows are merged with those of their buckets.  Where
    loads have gone (repeated, or merged by a compaction), the rolls that they held are taken from the store anew: the change set
    is read from the directories that have gone, or is everything if those were vacuumed."""
    live = set(store.live_keys(spark, store_path))

    def same_store(state: ledger.State) -> bool:
        return state.facts.get("sources") == before.facts.get("sources")

    before = ledger.read_ledger(spark, table)
    buckets = before.facts.get("buckets", buckets)
    known = set(before.facts.get("sources", []))
    new, gone = sorted(live - known), sorted(known - live)
    if not new and not gone:
        return 0
    lost = [k for k in gone if not ledger.names(spark, f"{store_path.rstrip('/')}/{k}")]
    rows = store.scan_keys(spark, store_path, new).select(*RESULT_COLUMNS) if new else empty_frame(spark, RESULTS)
    if lost:
        latest, touched = latest_per_roll(store.saved_results(spark, store_path)), list(range(buckets))
    else:
        changed = rows if not gone else rows.unionByName(store.scan_keys(spark, store_path, gone).select(*RESULT_COLUMNS))
        touched = sorted(r[0] for r in changed.select(_bucket(buckets)).distinct().collect())
        held = _read_buckets(spark, table, [k for k in before.entries if _number(k) in touched])
        if gone:
            rolls = changed.select(F.col("roll_number").alias("_roll")).distinct()
            mine = F.col("roll_number").eqNullSafe(F.col("_roll"))
            held = held.join(rolls, mine, "left_anti")
            rows = store.saved_results(spark, store_path).join(rolls, mine, "left_semi")
        latest = latest_per_roll(latest_per_roll(rows).unionByName(held))
    part = uuid.uuid4().hex
    (latest.withColumn("bucket", _bucket(buckets)).withColumn("part", F.lit(part)).repartition("bucket").sortWithinPartitions("bucket", "roll_number")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "part").parquet(table))
    made = [k for k in (f"bucket={b}/part={part}" for b in touched) if ledger.names(spark, f"{table.rstrip('/')}/{k}")]

    def decide(state: ledger.State) -> dict | None:
        if not same_store(state):
            return None                              # another refresh came first
        return {"drop": [k for k in state.entries if _number(k) in touched], "put": {k: {} for k in made},
                "set": {"sources": sorted(live), "buckets": buckets}}

    done = ledger.commit(spark, table, decide)
    return len(touched) if done.facts.get("sources") == sorted(live) else refresh_latest(spark, store_path, table, buckets)


def _number(key: str) -> int:
    return int(key.split("/")[0].split("=")[1])


def latest_records(spark: SparkSession, table: str, roll_number: str | None = None) -> DataFrame:
    """The kept latest records; of one roll, from its bucket alone."""
    state = ledger.read_ledger(spark, table)
    if roll_number is None:
        return _read_buckets(spark, table, list(state.entries))
    one = spark.range(1).select(F.lit(roll_number).alias("roll_number")).select(_bucket(state.facts.get("buckets", BUCKETS))).first()[0]
    return _read_buckets(spark, table, [k for k in state.entries if _number(k) == one]).where(F.col("roll_number") == roll_number)


def vacuum_latest(spark: SparkSession, table: str, retain_hours: float = 168.0) -> int:
    """Remove replaced buckets older than ``retain_hours``; their number."""
    return ledger.sweep(spark, table, "bucket=*/part=*", lambda p: "/".join(p.rstrip("/").split("/")[-2:]), retain_hours)
