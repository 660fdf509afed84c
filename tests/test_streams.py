"""Batch = stream: the streaming jobs over ordered micro-batches give the
same result as their batch operators."""

import os
import tempfile

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from examlytics.operators import sessions as S
from examlytics.plans import catalog, fixtures as fx
from examlytics.sources import results_store
from examlytics.sources.tables import read_table
from examlytics.streaming import streams as G


@pytest.fixture(scope="module")
def split_events():
    """events.parquet cut into 4 files in time order (one micro-batch each)."""
    t = pq.read_table(f"{SF_SMALL}/events.parquet")
    t = t.take(pc.sort_indices(t, [("ts", "ascending")]))
    d = tempfile.mkdtemp(prefix="examlytics-stream-in-")
    n = t.num_rows
    for i in range(4):
        f = os.path.join(d, f"events_{i}.parquet")
        pq.write_table(t.slice(i * n // 4, (i + 1) * n // 4 - i * n // 4), f)
        # the file source takes files in modification-time order; make it the time order
        os.utime(f, (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
    return d


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def _run(start, spark, name):
    base = tempfile.mkdtemp(prefix=f"examlytics-{name}-")
    q = start(f"{base}/ck", f"{base}/sink")
    q.awaitTermination()
    return f"{base}/sink", q


def test_violations_stream_equals_batch(spark, split_events):
    ev = G.read_event_stream(spark, split_events, max_files_per_trigger=1)
    sink, q = _run(lambda ck, s: G.violations_stream(fx.proctor_of(ev), ck, s), spark, "viol")
    got = G.last_per_key(spark, sink, ["session_id"])
    batch = (fx.proctor(spark, SF_SMALL).groupBy("session_id").count()
             .withColumn("must_end", F.col("count") >= 3))
    assert rows(got) == rows(batch)
    assert len(q.recentProgress) >= 4


def test_answers_stream_equals_batch(spark, split_events):
    ev = G.read_event_stream(spark, split_events, max_files_per_trigger=1)
    sink, _ = _run(lambda ck, s: G.answers_stream(fx.answers_of(ev), ck, s), spark, "ans")
    got = G.last_per_key(spark, sink, ["session_id", "idx"])
    batch = S.answer_upsert(S.blank_answer_filter(fx.answer_log(spark, SF_SMALL)))
    assert rows(got) == rows(batch)


def test_results_stream_equals_batch(spark, split_events):
    ev = G.read_event_stream(spark, split_events, max_files_per_trigger=2)
    cu = read_table(spark, SF_SMALL, "customer")
    sink, _ = _run(lambda ck, s: G.results_stream(fx.records_of(ev, cu), ck, s), spark, "res")
    got = results_store.saved_results(spark, sink)
    assert rows(got) == rows(catalog.results(spark, SF_SMALL))


def test_violations_stream_ignores_session_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = catalog.QUERIES["violations_stream"](spark, SF_SMALL).drop("must_end")
        batch = fx.proctor(spark, SF_SMALL).groupBy("session_id").count()
        assert rows(got) == rows(batch)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_restart_from_checkpoint_skips_processed_files(spark, split_events):
    base = tempfile.mkdtemp(prefix="examlytics-restart-")
    ev = G.read_event_stream(spark, split_events)
    G.violations_stream(fx.proctor_of(ev), f"{base}/ck", f"{base}/sink").awaitTermination()
    first = rows(G.last_per_key(spark, f"{base}/sink", ["session_id"]))
    q = G.violations_stream(fx.proctor_of(G.read_event_stream(spark, split_events)), f"{base}/ck", f"{base}/sink")
    q.awaitTermination()
    assert rows(G.last_per_key(spark, f"{base}/sink", ["session_id"])) == first


def test_answer_state_is_evicted_after_sessions_close(spark, split_events):
    ev = G.read_event_stream(spark, split_events, max_files_per_trigger=1)
    _, q = _run(lambda ck, s: G.answers_stream(fx.answers_of(ev), ck, s), spark, "evict")
    progress = [p for p in q.recentProgress if p["numInputRows"] > 0]
    state = [p["stateOperators"][0] for p in progress]
    # later micro-batches evict the state of sessions the watermark has closed
    assert sum(s.get("numRowsRemoved", 0) for s in state) > 0
    peak_keys = fx.answer_log(spark, SF_SMALL).select("session_id", "idx").distinct().count()
    assert state[-1]["numRowsTotal"] < peak_keys


def test_late_violations_are_dropped_by_watermark(spark, tmp_path):
    # batch 1: a click on day 20; batch 2: three clicks a week earlier (past the 1-hour delay)
    import datetime as dt
    import pyarrow as pa
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()),
                        ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    d = tmp_path / "in"
    d.mkdir()
    def write(name, rows):
        pq.write_table(pa.Table.from_pylist(rows, schema=schema), str(d / name))
    write("events_0.parquet", [dict(event_id=1, ts=dt.datetime(2024, 1, 20, 12), user_id=1,
                                    event_type="click", value=0.0, props="{}")])
    os.utime(d / "events_0.parquet", (1_700_000_000, 1_700_000_000))
    base = tempfile.mkdtemp(prefix="examlytics-late-")
    q = G.violations_stream(fx.proctor_of(G.read_event_stream(spark, str(d))), f"{base}/ck", f"{base}/sink")
    q.awaitTermination()
    write("events_1.parquet", [dict(event_id=10 + i, ts=dt.datetime(2024, 1, 13, 12, i), user_id=1,
                                    event_type="click", value=0.0, props="{}") for i in range(3)])
    q = G.violations_stream(fx.proctor_of(G.read_event_stream(spark, str(d))), f"{base}/ck", f"{base}/sink")
    q.awaitTermination()
    got = rows(G.last_per_key(spark, f"{base}/sink", ["session_id"]))
    assert got == [("1-2024-01-20", 1, False)]      # the late day-13 clicks never form a session


def test_terminations_stream_equals_batch_out_of_order(spark, split_events):
    """Count and moment as in the batch form, whatever the order of the files; the parts can be compacted."""
    events = spark.read.parquet(split_events)
    mixed = tempfile.mkdtemp(prefix="examlytics-mixed-") + "/in"
    events.repartition(5, F.xxhash64("event_id")).write.parquet(mixed)
    batch = rows(S.violations_terminate(fx.proctor(spark, SF_SMALL)))
    ev = fx.proctor_of(G.read_event_stream(spark, mixed, max_files_per_trigger=1))
    sink, q = _run(lambda ck, s: G.terminations_stream(ev, ck, s), spark, "term")
    assert len(q.recentProgress) >= 5 and rows(G.terminations(spark, sink)) == batch
    G.compact_terminations(spark, sink, f"{sink}-small")
    assert rows(G.terminations(spark, f"{sink}-small")) == batch
    assert spark.read.parquet(f"{sink}-small").count() <= spark.read.parquet(sink).count()


def test_late_event_revises_the_moment(spark, tmp_path):
    base = str(tmp_path)
    schema = "session_id string, ts timestamp_ntz, event_id bigint"

    def add(rows_):
        spark.createDataFrame(rows_, "session_id string, ts string, event_id bigint").selectExpr(
            "session_id", "cast(ts as timestamp_ntz) ts", "event_id").coalesce(1).write.mode("append").parquet(f"{base}/in")
        G.terminations_stream(G.read_stream(spark, f"{base}/in", schema), f"{base}/ck", f"{base}/sink").awaitTermination()
        return G.terminations(spark, f"{base}/sink").select("n_violations", F.col("terminated_at").cast("string")).collect()

    assert add([("a", f"2024-02-01 12:{m}:00", m) for m in (10, 20, 30)])[0] == (3, "2024-02-01 12:30:00")
    assert add([("a", "2024-02-01 12:15:00", 99)])[0] == (4, "2024-02-01 12:20:00")


def test_answers_of_two_months_stay_apart(spark, tmp_path):
    import datetime as dt
    import pyarrow as pa
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()),
                        ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    d = tmp_path / "in"
    d.mkdir()
    for i, month in enumerate((1, 2)):
        pq.write_table(pa.Table.from_pylist([dict(event_id=8 * (i + 1), ts=dt.datetime(2024, month, 3, 12), user_id=7, event_type="click",
                                                  value=0.0, props=f"month {month}")], schema=schema), str(d / f"e{i}.parquet"))
    log = fx.answers_of(G.read_event_stream(spark, str(d), max_files_per_trigger=1))
    G.answers_stream(log, f"{tmp_path}/ck", f"{tmp_path}/sink", delay="60 days").awaitTermination()
    got = rows(G.last_per_key(spark, f"{tmp_path}/sink", ["session_id", "idx"]))
    assert got == [("7-2024-01-0", 0, "month 1"), ("7-2024-02-0", 0, "month 2")]
