"""The store's ledger: committed loads, compaction, repeated loads, concurrent writers."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from examlytics.operators import results as R
from examlytics.plans import catalog, fixtures as fx
from examlytics.sources import ledger, results_store as store
from paths import SF_SMALL


def records(spark, ids, day="2024-01-05", text="marks 60"):
    rows = [(str(i), "alice", f"S{i}", str(i), "CS", "p", text) for i in ids]
    cols = "record_id string, examiner_name string, student_name string, roll_number string, department string, project_title string, result string"
    return R.result_build(spark.createDataFrame(rows, cols).withColumn("saved_at", F.lit(f"{day} 10:00:00").cast("timestamp_ntz")))


def ids(spark, path):
    return sorted(int(r.record_id) for r in store.saved_results(spark, path).collect())


def data_files(path, keys):
    return sum(f.endswith(".parquet") for k in keys for f in os.listdir(f"{path}/{k}"))


def test_thousand_one_row_loads_read_as_few_files(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = (records(spark, range(1000)).withColumn("load", F.concat(F.lit("l"), "record_id")).withColumn("saved_date", F.to_date("saved_at"))
            .withColumn("part", F.concat(F.lit("p"), "record_id")))
    rows.repartition(8, "part").write.partitionBy("saved_date", "part").parquet(path)
    for i in range(0, 1000, 25):
        ledger.commit(spark, path, lambda state, i=i: {"put": {store.entry("2024-01-05", f"p{k}"): {"load": f"l{k}"} for k in range(i, i + 25)}})
    assert len(store.live_keys(spark, path)) == 1000 and ids(spark, path) == list(range(1000))
    assert len([n for n in os.listdir(f"{path}/_ledger") if n.startswith("s")]) > 0    # whole states bound what a reader opens
    assert store.compact(spark, path) == 1
    keys = store.live_keys(spark, path)
    assert len(keys) == 1 and data_files(path, keys) == 1 and ids(spark, path) == list(range(1000))
    # a load repeated after the compaction still replaces itself, and nothing else
    store.results_append(records(spark, [7], text="marks 90"), path, "l7")
    got = {r.record_id: r.marks for r in store.saved_results(spark, path).collect()}
    assert len(got) == 1000 == store.saved_results(spark, path).count() and got["7"] == 90 and got["8"] == 60
    assert data_files(path, store.live_keys(spark, path)) == 2


def test_vacuum_removes_what_is_not_live(spark, tmp_path):
    path = str(tmp_path / "s")
    for i in range(4):
        store.results_append(records(spark, [i]), path, f"l{i}")
    planned = store.saved_results(spark, path)            # a reader that planned before the swap
    store.compact(spark, path)
    assert store.vacuum(spark, path, retain_hours=1) == 0 and planned.count() == 4
    assert store.vacuum(spark, path, retain_hours=0) == 4 and ids(spark, path) == [0, 1, 2, 3]
    assert sum(n.startswith("part=") for n in os.listdir(f"{path}/saved_date=2024-01-05")) == 1


def test_repeat_on_other_days_replaces_all_days(spark, tmp_path):
    path = str(tmp_path / "s")
    store.results_append(records(spark, [1], "2024-01-05").unionByName(records(spark, [2], "2024-01-06")), path, "x")
    store.results_append(records(spark, [3], "2024-01-06"), path, "y")
    store.compact(spark, path, min_parts=1)
    store.results_append(records(spark, [4], "2024-01-07"), path, "x")
    assert ids(spark, path) == [3, 4]
    store.results_append(records(spark, [4]).limit(0), path, "x")          # a load may become empty
    assert ids(spark, path) == [3]
    store.results_append(records(spark, [5]), path)                         # loads without a name never replace
    store.results_append(records(spark, [5]), path)
    assert ids(spark, path) == [3, 5, 5]


def test_half_written_load_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    store.results_append(records(spark, [1]), path, "a")
    store._write_part(store.conform(records(spark, [2])).withColumn("load", F.lit("b")), path)   # the writer died before its commit
    assert ids(spark, path) == [1]


def test_append_during_compaction_stays(spark, tmp_path, monkeypatch):
    """A load committed, and another repeated, between a compaction's read and its commit."""
    path = str(tmp_path / "s")
    for i in range(3):
        store.results_append(records(spark, [i], f"2024-01-0{5 + i % 2}"), path, f"l{i}")
        store.results_append(records(spark, [10 + i], f"2024-01-0{5 + i % 2}"), path, f"m{i}")
    write, done = store._write_part, []

    def slow(rows, p):
        made = write(rows, p)
        if not done:
            done.append(1)
            store.results_append(records(spark, [99], "2024-01-05"), path, "late")
            store.results_append(records(spark, [50], "2024-01-06"), path, "l1")     # replaces record 1, of the other day
        return made

    monkeypatch.setattr(store, "_write_part", slow)
    assert store.compact(spark, path) == 1                                           # the day that changed is left as it was
    assert ids(spark, path) == [0, 2, 10, 11, 12, 50, 99]
    assert store.compact(spark, path) == 2 and ids(spark, path) == [0, 2, 10, 11, 12, 50, 99]


def test_concurrent_appends_and_compactions_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    failed = []

    def work(k):
        try:
            for i in range(4):
                store.results_append(records(spark, [10 * k + i]), path, f"w{k}-{i}")
                if k == 0:
                    store.compact(spark, path)
        except Exception as exc:  # noqa: BLE001
            failed.append(exc)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and ids(spark, path) == sorted(10 * k + i for k in range(4) for i in range(4))


def test_two_commits_get_two_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    seen = []

    def decide(state):
        seen.append(state.version)
        if len(seen) == 1:
            ledger.commit(spark, path, lambda s: {"put": {"other": {}}})
        return {"put": {"mine": {"after": sorted(state.entries)}}}

    ledger.commit(spark, path, decide)
    assert seen == [0, 1] and ledger.read_ledger(spark, path).entries == {"other": {}, "mine": {"after": ["other"]}}
    assert ledger.commit(spark, path, lambda s: None).version == 2


def test_stream_replays_look_nothing_up_but_replace(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(3):
        store.results_append(records(spark, [n]), path, f"st-{n}", sequence=("st", n))
    store.compact(spark, path)
    store.results_append(records(spark, [3]), path, "st-3", sequence=("st", 3))
    store.results_append(records(spark, [2], text="marks 10"), path, "st-2", sequence=("st", 2))   # a batch is replayed after the compaction
    got = {r.record_id: r.marks for r in store.saved_results(spark, path).collect()}
    assert got == {"0": 60, "1": 60, "2": 10, "3": 60}


def test_days_without_a_ledger_are_refused(spark, tmp_path):
    path = str(tmp_path / "old")
    records(spark, [1]).withColumn("saved_date", F.to_date("saved_at")).write.partitionBy("saved_date").parquet(path)
    with pytest.raises(ValueError, match="no ledger"):
        store.saved_results(spark, path)


def test_compacted_store_equals_records(spark, tmp_path):
    path = str(tmp_path / "s")
    whole = catalog.results(spark, SF_SMALL)
    for i in range(5):
        store.results_append(whole.where(F.col("record_id").cast("bigint") % 5 == i), path, f"l{i}")
    days = store.compact(spark, path)
    assert days == whole.select(F.to_date("saved_at")).distinct().count()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(store.saved_results(spark, path)) == key(whole)
    week = store.saved_results(spark, path, "2024-01-08", "2024-01-14")
    assert key(week) == key(whole.where(F.to_date("saved_at").between("2024-01-08", "2024-01-14")))
    assert len(week.inputFiles()) == 7
