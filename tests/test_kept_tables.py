"""The kept latest records and the name index follow the store and give the rows of a full scan."""

import os
import random

import pytest
from pyspark.sql import functions as F

from examlytics.operators import dashboard as D
from examlytics.sources import ledger, name_index as N, reports, results_store as store
from test_ledger import records  # noqa: E402


def rows(df):
    return sorted(map(str, df.collect()))


def saves(spark, values):
    """(record_id, roll, time) as records."""
    base = records(spark, [0]).drop("record_id", "roll_number", "saved_at")
    table = spark.createDataFrame(values, "record_id string, roll_number string, at string").withColumn("saved_at", F.col("at").cast("timestamp_ntz")).drop("at")
    return table.crossJoin(base)


def check_latest(spark, path, table):
    reports.refresh_latest(spark, path, table, buckets=8)
    want = reports.latest_per_roll(store.saved_results(spark, path))
    assert rows(reports.latest_records(spark, table)) == rows(want.select(reports.RESULT_COLUMNS))


def test_latest_follows_loads(spark, tmp_path):
    path, table = str(tmp_path / "s"), str(tmp_path / "latest")
    rng = random.Random(1)
    check_latest(spark, path, table)

    def some(lo, n):
        return [(str(lo + i), rng.choice([None, "", *map(str, range(30))]), rng.choice([None, f"2024-01-0{rng.randint(1, 4)} 10:00:00"])) for i in range(n)]

    first = some(100, 40)
    store.results_append(saves(spark, first), path, "a")
    check_latest(spark, path, table)
    store.results_append(saves(spark, some(50, 30)), path, "b")           # earlier ids, later or equal times: ties across loads
    check_latest(spark, path, table)
    store.compact(spark, path)
    check_latest(spark, path, table)
    store.results_append(saves(spark, first[:5]), path, "a")              # repeated with fewer rows: rolls fall back to other records
    check_latest(spark, path, table)
    store.results_append(saves(spark, some(300, 10)), path, "c")
    store.compact(spark, path)
    store.vacuum(spark, path, 0)                                          # what the change set would be read from is gone
    check_latest(spark, path, table)
    assert reports.refresh_latest(spark, path, table) == 0


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, table = str(tmp_path / "s"), str(tmp_path / "latest")
    store.results_append(saves(spark, [(str(i), str(i), "2024-01-01 10:00:00") for i in range(200)]), path, "a")
    assert reports.refresh_latest(spark, path, table, buckets=16) == 16
    before = set(ledger.read_ledger(spark, table).entries)
    store.results_append(saves(spark, [("900", "7", "2024-01-01 09:00:00"), ("901", "7", "2024-01-02 10:00:00")]), path, "b")
    assert reports.refresh_latest(spark, path, table) == 1
    after = set(ledger.read_ledger(spark, table).entries)
    assert len(before & after) == 15 and len(after) == 16
    one = reports.latest_records(spark, table, "7")
    assert [r.record_id for r in one.collect()] == ["901"] and len(one.inputFiles()) == 1
    assert reports.vacuum_latest(spark, table, 0) == 1
    check_latest(spark, path, table)


NAMES = ["Customer#000001", "customer#12", "Ann Lee", "ANN LEE", "Straße", "Keith", "İnan", "ınan", "Miſter", "a.b", "ab", "", "Émile Zola", "xxANNxx"]
PATTERNS = ["customer#0+1[0-9]$", "ann", "^ann lee$", "keith", "inan", "mister", "straße", "a\\.b", "a.b", "ab?c?", "(ann|lee)", "ann.*lee", "émile", "zola",
            "x{2}ann", "x+ann", "(?:ann)", "ann(xx)?", "customer#[01]+", "\\bann\\b", "nobody", "ann++", "cust.mer#\\d+", "c?ustomer", "[^]a]nn le", "emil|ann", "\\Qa.b\\E"]


@pytest.fixture(scope="module")
def named_store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names") / "s")
    for i in range(3):
        r = records(spark, range(len(NAMES)), day=f"2024-02-0{i + 1}")
        name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("record_id").cast("int") + 1)
        named = r.withColumn("student_name", F.when(F.col("record_id").cast("int") % 3 == i, name))
        store.results_append(named, path, f"l{i}")
        if i == 1:
            N.refresh_index(spark, path)
    return path


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_gives_the_rows_of_a_scan(spark, named_store, pattern):
    want = D.student_search(store.saved_results(spark, named_store), pattern)
    assert rows(N.indexed_search(spark, named_store, pattern)) == rows(want)


def test_required_runs():
    assert N.required_runs("customer#0+1[0-9]$") == ["customer#0"]
    assert N.required_runs("ann.*lee") == ["ann", "lee"] and N.required_runs("ab*cde") == ["cde"]
    assert N.required_runs("abc?def") == ["def"] and N.required_runs("abcd{2,3}ef") == ["abc"] and N.required_runs("xya+bc") == ["xya", "abc"]
    assert N.required_runs("a\\.bc") == ["a.bc"] and N.required_runs("(abc)def") == ["def"]
    for none in ("a|b", "(?:abc)", "\\Qabc\\E", "abc(", "\\x41bc", "[a[b]]cde", "ab"):
        assert N.required_runs(none) == []


def test_parts_without_a_match_are_not_scanned(spark, named_store):
    found = N.indexed_search(spark, named_store, "keith")
    days = {os.path.dirname(f).split("saved_date=")[1].split("/")[0] for f in found.inputFiles() if "saved_date=" in f}
    assert len(days) == 1 and found.count() == 1


def test_a_trigram_of_all_names_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Every name begins with ``customer``: one trigram has a row for each of them."""
    monkeypatch.setattr(N, "TASK_ROWS", 500, raising=False)
    path = str(tmp_path / "hot")
    base = records(spark, [0]).drop("record_id", "student_name")
    names = spark.range(1000).select(F.col("id").cast("string").alias("record_id"), F.format_string("Customer#%04d", "id").alias("student_name"))
    store.results_append(names.crossJoin(base), path, "one")
    N.refresh_index(spark, path)
    index = spark.read.parquet(f"{path}/_names/refresh=*")
    a_file = [r[1] for r in index.groupBy(F.input_file_name()).count().collect()]
    assert index.where("gram = 'cus'").count() == 1000 and max(a_file) <= 1000
    want = D.student_search(store.saved_results(spark, path), "customer#00+1[0-9]$")
    found = N.indexed_search(spark, path, "customer#00+1[0-9]$")
    assert rows(found) == rows(want) and found.count() == 10
