"""States and series beside the store equal the figures of the records, whatever the loads did."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from examlytics.operators import dashboard as D
from examlytics.plans import catalog
from examlytics.sources import dashboard_store as K, ledger, results_store as store
from paths import SF_SMALL


def same(spark, path, date_from=None, date_to=None):
    """All figures from what is kept, against the records."""
    saved = store.saved_results(spark, path, date_from, date_to)
    states = K.states(spark, path, date_from, date_to)
    assert K.overview_kpis(states).collect() == D.overview_kpis(saved).collect()
    for column in ("status", "department"):
        assert D.value_counts(states, column, "n", "first").collect() == D.value_counts(saved, column).collect()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(K.marks_series(spark, path, date_from, date_to)) == key(D.marks_series(saved))


@pytest.fixture(scope="module")
def whole(spark):
    rows = catalog.results(spark, SF_SMALL)
    literal = spark.range(3).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]).withColumn("record_id", F.lit("9"))
    return rows.unionByName(literal.withColumn("status", F.lit("FAIL"))).cache()          # records without a time, a mark or a department


def test_figures_follow_loads(spark, whole, tmp_path):
    path = str(tmp_path / "s")
    of = F.pmod(F.xxhash64("record_id"), F.lit(3))
    same(spark, path)                                                    # no store yet
    store.results_append(whole.where(of == 0), path, "a")
    assert K.refresh_states(spark, path) > 0 and K.refresh_states(spark, path) == 0
    same(spark, path)
    store.results_append(whole.where(of == 1).where("status = 'PASS'"), path, "b")      # appended out of order, between the days
    same(spark, path)
    store.compact(spark, path)
    store.results_append(whole.where(of == 1), path, "b")                # repeated after the compaction
    store.results_append(whole.where(of == 2), path, "c")
    same(spark, path)
    same(spark, path, "2024-01-08", "2024-01-14")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(K.marks_series(spark, path)) == key(D.marks_series(whole))


def test_a_load_moves_only_its_own_days(spark, whole, tmp_path):
    path = str(tmp_path / "s")
    store.results_append(whole, path, "a")
    days = K.refresh_series(spark, path)
    assert days > 20
    before = ledger.read_ledger(spark, f"{path}/_series").entries
    extra = whole.where("record_id = '7'").withColumn("saved_at", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    store.results_append(extra, path, "b")
    assert K.refresh_series(spark, path) == 1
    after = ledger.read_ledger(spark, f"{path}/_series").entries
    assert {d for d in after if after[d] != before.get(d)} == {"2024-01-03"}
    same(spark, path)


def test_no_record_is_read_for_a_figure(spark, whole, tmp_path):
    path = str(tmp_path / "s")
    store.results_append(whole, path, "a")
    states = K.states(spark, path)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        K.overview_kpis(states).explain("formatted")
    scans = [line for line in out.getvalue().splitlines() if line.startswith(("Location", "ReadSchema"))]
    assert all("_states" in line for line in scans if line.startswith("Location")) and not any("marks:" in line or "result:" in line for line in scans)
    assert states.count() < whole.count() / 2


def test_refreshes_are_merged(spark, whole, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MOST_REFRESHES", 3)
    path = str(tmp_path / "s")
    for i in range(6):
        store.results_append(whole.where(F.pmod(F.xxhash64("record_id"), F.lit(6)) == i).where("saved_at < '2024-01-04'"), path, f"l{i}")
        K.refresh_states(spark, path)
    live = {v["refresh"] for v in ledger.read_ledger(spark, f"{path}/_states").entries.values()}
    assert len(live) <= 3 < len([n for n in os.listdir(f"{path}/_states") if n.startswith("refresh=")])
    same(spark, path)


def test_marks_beyond_bigint_sums(spark, tmp_path):
    """Sums of large marks do not overflow."""
    path = str(tmp_path / "s")
    big = 9 * 10 ** 18
    rows = spark.createDataFrame([(str(i), big, "PASS") for i in range(4)], "record_id string, marks bigint, status string")
    store.results_append(rows.withColumn("saved_at", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")), path, "a")
    assert K.overview_kpis(K.states(spark, path)).first().avg_marks == float(big)
