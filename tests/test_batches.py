"""Micro-batch tables: snapshot and tail, replays before and after a swap, restarts, late events."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from examlytics import jobs
from examlytics.operators import sessions as S
from examlytics.plans import fixtures as fx
from examlytics.sources import ledger
from examlytics.streaming import batches, streams as G
from paths import SF_SMALL


def rows(df):
    return sorted(map(tuple, df.collect()))


def batch(spark, values):
    return spark.createDataFrame(values, "k string, v bigint")


def parts(spark, table):
    return sorted(ledger.read_ledger(spark, table).entries)


def test_snapshot_and_tail(spark, tmp_path):
    t = str(tmp_path / "t")
    for n in range(6):
        batches.commit_batch(batch(spark, [("a", n), (f"k{n}", n)]), t, "s", n)
    want = [("a", 5), *[(f"k{n}", n) for n in range(6)]]
    assert rows(G.last_per_key(spark, t, ["k"])) == want
    assert not G.merge_latest(spark, t, ["k"], min_parts=7) and G.merge_latest(spark, t, ["k"], min_parts=6)
    assert len(parts(spark, t)) == 1 and rows(G.last_per_key(spark, t, ["k"])) == want
    batches.commit_batch(batch(spark, [("a", 6)]), t, "s", 6)
    got = G.last_per_key(spark, t, ["k"])
    # the snapshot and one micro-batch are read, not the six before
    assert rows(got) == [("a", 6), *want[1:]] and {os.path.dirname(f).split("batch_id=")[1].split("/")[0] for f in got.inputFiles()} == {"5", "6"}


def test_replays_leave_one_copy(spark, tmp_path):
    t = str(tmp_path / "t")
    for n in range(3):
        batches.commit_batch(batch(spark, [("a", n), (f"k{n}", n)]), t, "s", n)
    batches.commit_batch(batch(spark, [("a", 2), ("k2", 2)]), t, "s", 2)              # replayed before the swap
    assert len(parts(spark, t)) == 3
    G.merge_latest(spark, t, ["k"], min_parts=1)
    before = parts(spark, t)
    batches.commit_batch(batch(spark, [("a", 2), ("k2", 2)]), t, "s", 2)              # and after it
    assert parts(spark, t) == before and rows(G.last_per_key(spark, t, ["k"])) == [("a", 2), ("k0", 0), ("k1", 1), ("k2", 2)]


def test_batch_during_a_swap_stays(spark, tmp_path):
    t = str(tmp_path / "t")
    for n in range(2):
        batches.commit_batch(batch(spark, [("a", n)]), t, "s", n)

    def merge(some):
        batches.commit_batch(batch(spark, [("a", 2), ("b", 2)]), t, "s", 2)
        return G._latest(some, ["k"])

    assert batches.swap(spark, t, merge) and len(parts(spark, t)) == 2
    assert rows(G.last_per_key(spark, t, ["k"])) == [("a", 2), ("b", 2)]
    # a second swap that read the same parts is passed over
    assert not batches.swap(spark, t, lambda some: (G.merge_latest(spark, t, ["k"], min_parts=1), some.drop("batch_id"))[1])
    assert rows(G.last_per_key(spark, t, ["k"])) == [("a", 2), ("b", 2)]


def test_a_new_checkpoint_goes_on(spark, tmp_path):
    """Batch numbers of a stream that starts anew come after those of the stream before."""
    t = str(tmp_path / "t")
    for n in range(3):
        batches.commit_batch(batch(spark, [("a", n)]), t, "first", n)
    G.merge_latest(spark, t, ["k"], min_parts=1)
    batches.commit_batch(batch(spark, [("a", 100)]), t, "second", 0)
    assert rows(G.last_per_key(spark, t, ["k"])) == [("a", 100)]


def test_vacuum_and_empty(spark, tmp_path):
    t = str(tmp_path / "t")
    assert rows(G.last_per_key(spark, t, ["k"], "k string, v bigint")) == []
    with pytest.raises(ValueError, match="no micro-batches"):
        G.last_per_key(spark, t, ["k"])
    for n in range(3):
        batches.commit_batch(batch(spark, [("a", n)]).limit(0 if n == 1 else 1), t, "s", n)
    G.merge_latest(spark, t, ["k"], min_parts=1)
    assert batches.vacuum(spark, t, 1) == 0 and batches.vacuum(spark, t, 0) == 3
    assert rows(G.last_per_key(spark, t, ["k"])) == [("a", 2)]


@pytest.fixture(scope="module")
def mixed():
    """Events of all days in six files, dealt by a hash."""
    from pyspark.sql import SparkSession
    d = tempfile.mkdtemp(prefix="examlytics-mixed-")
    SparkSession.active().read.parquet(f"{SF_SMALL}/events.parquet").repartition(6, F.xxhash64("event_id")).write.parquet(f"{d}/in")
    return [f"{d}/in/{f}" for f in sorted(os.listdir(f"{d}/in")) if f.endswith(".parquet")]


def _feed(path, files):
    os.makedirs(path, exist_ok=True)
    for f in files:
        os.link(f, f"{path}/{os.path.basename(f)}")


def test_answers_equal_batch_over_swaps_and_restarts(spark, mixed, tmp_path):
    base = str(tmp_path)
    for i in range(0, 6, 2):
        _feed(f"{base}/in", mixed[i:i + 2])
        ev = G.read_event_stream(spark, f"{base}/in", max_files_per_trigger=1)
        G.answers_stream(fx.answers_of(ev), f"{base}/ck", f"{base}/sink", delay="400 days").awaitTermination()
        jobs.run(spark, jobs.parser().parse_args(["merge", "--kind", "answers", "--sink", f"{base}/sink", "--min-parts", "2"]))
        assert len(parts(spark, f"{base}/sink")) == 1
    got = G.last_per_key(spark, f"{base}/sink", ["session_id", "idx"])
    assert rows(got) == rows(S.answer_upsert(S.blank_answer_filter(fx.answer_log(spark, SF_SMALL))))


def test_terminations_equal_batch_over_generations(spark, mixed, tmp_path):
    """Generations swapped between runs of the stream; an event later than all others but earlier in time comes last."""
    base = str(tmp_path)
    for i in range(0, 6, 3):
        _feed(f"{base}/in", mixed[i:i + 3])
        ev = fx.proctor_of(G.read_event_stream(spark, f"{base}/in", max_files_per_trigger=1))
        G.terminations_stream(ev, f"{base}/ck", f"{base}/sink").awaitTermination()
        jobs.run(spark, jobs.parser().parse_args(["merge", "--sink", f"{base}/sink", "--min-parts", "1"]))
        assert len(parts(spark, f"{base}/sink")) == 1
    assert rows(G.terminations(spark, f"{base}/sink")) == rows(S.violations_terminate(fx.proctor(spark, SF_SMALL)))


def test_late_event_after_the_swap_and_replay(spark, tmp_path):
    t = str(tmp_path / "t")

    def events(values):
        return spark.createDataFrame(values, "session_id string, ts string, event_id bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    def feed(n, values):
        e = events(values)
        counts = e.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_violations"))
        batches.commit_batch(G._parts(counts, G._earliest(e, 3)), t, "s", n)

    first = [("a", f"2024-02-01 12:{m}:00", m) for m in (10, 20, 30, 40, 50)]
    feed(0, first)
    assert G.merge_terminations(spark, t, min_parts=1)
    feed(0, first)                                                   # replayed after the swap: not counted again
    feed(1, [("a", "2024-02-01 12:15:00", 99)])                      # earlier than the third: it revises the moment
    got = G.terminations(spark, t).select("n_violations", F.col("terminated_at").cast("string")).collect()
    assert [tuple(r) for r in got] == [(6, "2024-02-01 12:20:00")]
    G.merge_terminations(spark, t, min_parts=1)
    assert spark.read.parquet(f"{t}/{parts(spark, t)[0]}").count() == 4      # a count and the three earliest rows
    G.compact_terminations(spark, t, f"{t}-copy")
    assert rows(G.terminations(spark, f"{t}-copy")) == rows(G.terminations(spark, t))
    sessions = spark.createDataFrame([("a",), ("b",)], "session_id string")
    assert rows(S.exclude_terminated(sessions, G.terminations(spark, t))) == [("b",)]
