"""Structured Streaming forms of the proctoring, answer and results jobs.

Sources are Parquet file streams with a declared schema; each job takes its
domain's columns (a violation log, an answer log, saved evaluations), whatever
table they come from.  Stateful jobs run
in update mode and append each micro-batch's changed rows to a table of
micro-batches (:mod:`batches`); a reader keeps the last row per key, and
:func:`merge_latest` merges them into one row per key while the stream runs.  Event
time is a UTC instant built from the wall-clock ``timestamp_ntz`` column
(``withWatermark`` refuses ``timestamp_ntz``), independent of the session
time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.results import result_build
from ..operators.sessions import blank_answer_filter
from ..schemas import EVENTS
from ..sources.results_store import results_append
from . import batches


def table_glob(sf_dir: str, name: str) -> str:
    """Path of a table for the file stream source.  A one-character class
    makes it a glob that matches exactly ``<name>.parquet``, which the source
    accepts both as a single file and as a directory of part files (a plain
    file path is refused: its base path must be a directory)."""
    return f"{sf_dir.rstrip('/')}/{name}.parque[t]"


def read_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream, with a declared schema (no inference).  ``max_files_per_trigger`` bounds
    the first micro-batch, which otherwise takes the whole backlog."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def read_event_stream(spark: SparkSession, path: str,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    return read_stream(spark, path, EVENTS, max_files_per_trigger)


def utc_instant(ntz: str, spark: SparkSession) -> Column:
    """The instant whose UTC wall clock is the ``timestamp_ntz`` value."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ntz)).cast("timestamp")


def _upsert_sink(path: str, checkpoint: str):
    """Each micro-batch's changed rows are a part of their own, which a replay replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batches.commit_batch(batch, path, batches.stream_name(checkpoint), batch_id)
    return write


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys and c != batches.ORDER]
    latest = F.max_by(F.struct(*values), batches.ORDER).alias("_v")
    return rows.groupBy(*keys).agg(latest).select(*keys, *[F.col("_v")[c].alias(c) for c in values])


def last_per_key(spark: SparkSession, path: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """Read an update-mode table: the row from the latest batch per key, from the merged part and the tail.
    A sink that never received a batch (no input) reads as empty."""
    return _latest(batches.live_batches(spark, path, schema and f"{schema}, {batches.ORDER} bigint"), keys)


def merge_latest(spark: SparkSession, path: str, keys: list[str], schema: str | None = None, min_parts: int = 8) -> bool:
    """Merge an update-mode table into a snapshot of one row per key, sorted by key in sized files, and swap it in (the stream may
    run).  Nothing is done below ``min_parts`` parts, so that a snapshot is rewritten once for many micro-batches."""
    def merge(rows: DataFrame) -> DataFrame:
        return _latest(rows, keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return batches.swap(spark, path, merge, schema and f"{schema}, {batches.ORDER} bigint", min_parts)


def _start(df: DataFrame, checkpoint: str, sink, mode: str, trigger_available_now: bool):
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(availableNow=True) if trigger_available_now else w).start()


def violations_stream(proctor: DataFrame, checkpoint: str, sink: str, delay: str = "1 hour",
                      trigger_available_now: bool = True):
    """Violations per session as a windowed streaming count, and whether the
    session has reached the violation limit and must end.

    ``proctor``: session_id (one per user and UTC day), ts.  Rows that come later than ``delay`` are
    dropped by the watermark; the query's progress reports how many
    (:func:`dropped_rows`).  :func:`terminations_stream` has no such limit.
    """
    v = (proctor.select("session_id", utc_instant("ts", proctor.sparkSession).alias("t"))
         .withWatermark("t", delay)
         .groupBy(F.window("t", "1 day"), "session_id").agg(F.count(F.lit(1)).alias("n_violations"))
         .select("session_id", "n_violations", (F.col("n_violations") >= K.VIOLATION_LIMIT).alias("must_end")))
    return _start(v, checkpoint, _upsert_sink(sink, checkpoint), "update", trigger_available_now)


def dropped_rows(query) -> int:
    """Rows that the query's watermark has dropped so far, over its recent progress."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def answers_stream(log: DataFrame, checkpoint: str, sink: str, delay: str = "8 days",
                   trigger_available_now: bool = True):
    """Last non-blank answer per (session, slot).

    ``log``: session_id, session_start (instant), idx, answer, ts, event_id.  The session's start is part of
    the key and carries the watermark, so state for closed sessions is dropped.
    """
    agg = (blank_answer_filter(log).withWatermark("session_start", delay)
           .groupBy("session_start", "session_id", "idx")
           .agg(F.max_by("answer", F.struct("ts", "event_id")).alias("answer"))
           .select("session_id", "idx", "answer"))
    return _start(agg, checkpoint, _upsert_sink(sink, checkpoint), "update", trigger_available_now)


def results_stream(raw: DataFrame, checkpoint: str, store: str, trigger_available_now: bool = True):
    """Stateless: each saved evaluation (``raw``: the columns of ``result_build``, student columns included)
    becomes a record of the results store, the one that batch appends write.

    A micro-batch is a load named after the checkpoint and its number: a
    retried one replaces its own rows.
    """
    name = batches.stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        results_append(batch, store, f"stream-{name}-{batch_id}", sequence=(name, batch_id))

    return _start(result_build(raw), checkpoint, write, "append", trigger_available_now)


# ---------------------------------------------------------------------------
# Terminations: the moment a session reaches the violation limit.  "k-th
# smallest per key" over all input so far is kept as parts: every micro-batch
# is reduced to a count and at most k earliest rows per session (a partial
# group limit: a hot session sends k rows per map partition) and committed as
# a part; the reader takes the k-th earliest over the parts.  There is no state
# and no watermark: a late event revises the moment.  Parts merge into a new
# generation under the running stream.
# ---------------------------------------------------------------------------

TERMINATION_PARTS = "session_id string, n_violations bigint, ts timestamp_ntz, event_id bigint, batch_id bigint"


def _earliest(rows: DataFrame, limit: int) -> DataFrame:
    first = Window.partitionBy("session_id").orderBy("ts", "event_id")
    return (rows.select("session_id", "ts", "event_id").withColumn("_rn", F.row_number().over(first))
            .where(F.col("_rn") <= limit))


def _parts(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per session carries the count (so that parts add up), the others its earliest events."""
    rows = rows.drop("_rn").withColumn("n_violations", F.lit(0).cast("bigint"))
    return (counts.withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("event_id", F.lit(None).cast("bigint"))
            .unionByName(rows))


def terminations_stream(proctor: DataFrame, checkpoint: str, sink: str, limit: int = K.VIOLATION_LIMIT,
                        trigger_available_now: bool = True):
    """Parts for :func:`terminations`; ``proctor``: session_id, ts, event_id."""
    name = batches.stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_violations"))
        batches.commit_batch(_parts(counts, _earliest(batch, limit)), sink, name, batch_id)

    return _start(proctor.select("session_id", "ts", "event_id"), checkpoint, write, "append", trigger_available_now)


def _counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("session_id").agg(F.sum("n_violations").alias("n_violations"))


def terminations(spark: SparkSession, sink: str, limit: int = K.VIOLATION_LIMIT) -> DataFrame:
    """Sessions that have reached ``limit`` violations so far: count and moment, as ``violations_terminate``
    gives over all input.  A sink without any batch reads as empty."""
    parts = batches.live_batches(spark, sink, TERMINATION_PARTS)
    kth = _earliest(parts.where(F.col("event_id").isNotNull()), limit).where(F.col("_rn") == limit)
    return kth.join(_counts(parts), "session_id").select(
        "session_id", "n_violations", F.col("ts").alias("terminated_at"), F.col("event_id").alias("terminating_event_id"))


def _generation(parts: DataFrame, limit: int) -> DataFrame:
    return _parts(_counts(parts), _earliest(parts.where(F.col("event_id").isNotNull()), limit)).hint("rebalance")


def merge_terminations(spark: SparkSession, sink: str, limit: int = K.VIOLATION_LIMIT, min_parts: int = 8) -> bool:
    """Merge the parts into a new generation (a count and at most ``limit`` rows per session) and swap it in; the stream may
    run.  A session's events may come later still: they add to the generation's."""
    return batches.swap(spark, sink, lambda parts: _generation(parts, limit), TERMINATION_PARTS, min_parts)


def compact_terminations(spark: SparkSession, sink: str, out: str, limit: int = K.VIOLATION_LIMIT) -> None:
    """Write one generation of the parts at a new place (a copy for a stream that starts anew from there)."""
    batches.commit_batch(_generation(batches.live_batches(spark, sink, TERMINATION_PARTS), limit), out, "copy", 0)
