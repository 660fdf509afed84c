import os
import tempfile

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from examlytics.plans import catalog
from examlytics.schemas import RESULT_COLUMNS
from examlytics.sources import ingest, results_store


def test_missing_store_reads_as_empty_with_columns(spark):
    df = results_store.saved_results(spark, "/tmp/definitely-not-here-examlytics")
    assert df.columns == RESULT_COLUMNS and df.count() == 0


def test_append_conforms_columns_and_keeps_text(spark):
    path = tempfile.mkdtemp(prefix="examlytics-test-") + "/store"
    old = spark.createDataFrame([("1", "007", "NA")], "record_id string, roll_number string, department string")
    results_store.results_append(old.withColumn("saved_at", F.lit(None).cast("timestamp_ntz")), path)
    results_store.results_append(old, path)          # saved_at missing entirely -> null
    rows = results_store.saved_results(spark, path).collect()
    assert len(rows) == 2                             # bag semantics, no de-duplication
    assert {r.roll_number for r in rows} == {"007"}   # leading zeros survive
    assert {r.department for r in rows} == {"NA"}     # "NA" stays a value


def test_decode_drops_invalid_bytes(spark):
    df = spark.createDataFrame([(1, bytearray("héllo".encode() + b"\xff\xfe" + "😀".encode()))],
                               "doc_id long, content binary")
    assert ingest.text_ingest(df).first().text == "héllo😀"


def test_route_kinds(spark):
    files = spark.createDataFrame(
        [("a.pdf", "application/pdf"), ("b.docx", "x"), ("c.DOCX", "x"), ("d.txt", "text/plain"),
         ("e.py", "x"), ("f.ipynb", "x"), ("g.html", "text/html"), ("h.PDF", "x")],
        "name string, media_type string")
    got = {r.name: (r.kind, r.accepted) for r in ingest.ingest_route(files).collect()}
    assert got["a.pdf"] == ("pdf", False) and got["b.docx"] == ("docx", False)
    assert got["c.DOCX"] == ("docx", False) and got["d.txt"] == ("text", True)
    assert got["e.py"][1] and got["f.ipynb"][1]
    assert got["g.html"] == ("unsupported", False) and got["h.PDF"] == ("unsupported", False)


def test_read_uploads_binary_files(spark):
    d = tempfile.mkdtemp(prefix="examlytics-up-")
    with open(os.path.join(d, "p.py"), "wb") as f:
        f.write(b"print('x')\xff\n")
    with open(os.path.join(d, "r.pdf"), "wb") as f:
        f.write(b"%PDF-1.4")
    got = {r.name: (r.kind, r.text) for r in ingest.read_uploads(spark, d).collect()}
    assert got["p.py"] == ("text", "print('x')\n")
    assert got["r.pdf"] == ("pdf", None)


def test_legacy_csv_roundtrip_keeps_text(spark):
    from examlytics.sources import legacy
    d = tempfile.mkdtemp(prefix="examlytics-legacy-")
    with open(os.path.join(d, "sheet.csv"), "w") as f:
        f.write("Examiner Name,Student Name,Roll Number,Department,Project Title,Marks,Status,Timestamp\n")
        f.write("alice,Ann,007,NA,Robot,85/100,PASS,2024-01-05 10:11:12\n")
        f.write("bob,Bo,12,CS,Site,absent,FAIL,2024-01-06 09:00:00\n")
        f.write("bob,Bo,12,CS,Site,absent,FAIL,not a time\n")
    got = legacy.read_legacy_csv(spark, d).orderBy("saved_at").collect()
    assert [r.roll_number for r in got if r.student_name == "Ann"] == ["007"]
    assert {r.department for r in got} == {"NA", "CS"}
    assert {(r.marks_label, r.marks) for r in got} == {("85/100", 85), ("absent", None)}
    assert sum(r.saved_at is None for r in got) == 1          # unreadable time -> null, row kept
    out = tempfile.mkdtemp(prefix="examlytics-legacy-out-") + "/sheet"
    legacy.write_legacy_csv(legacy.read_legacy_csv(spark, d), out)
    again = legacy.read_legacy_csv(spark, out).collect()
    key = lambda r: (r.examiner_name, r.roll_number, r.marks_label, str(r.saved_at))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_legacy_csv_by_header_name(spark):
    """A reordered header, an empty field and a quoted line break."""
    from examlytics.sources import legacy
    d = tempfile.mkdtemp(prefix="examlytics-legacy-order-")
    with open(os.path.join(d, "sheet.csv"), "w") as f:
        f.write("Student Name,Examiner Name,Roll Number,Department,Project Title,Marks,Status,Timestamp\n")
        f.write('Ann,alice,007,"","Robot\narm",85/100,PASS,2024-01-05 10:11:12\n')
    row = legacy.read_legacy_csv(spark, d).first()
    assert (row.student_name, row.examiner_name, row.department, row.project_title) == ("Ann", "alice", "", "Robot\narm")


def test_one_store_for_batch_and_stream(spark):
    """Both writers' rows are read back, by day too; a second --once run without options loses nothing; a load that is
    repeated replaces itself."""
    from examlytics import jobs
    base = tempfile.mkdtemp(prefix="examlytics-store-")
    raw = catalog.fx.results_raw(spark, SF_SMALL)
    odd = F.col("record_id").cast("bigint") % 2 == 1
    raw.where(odd).write.parquet(f"{base}/batch")
    for _ in range(2):
        jobs.run(spark, jobs.parser().parse_args(["results", "--input", f"{base}/batch", "--store", f"{base}/store", "--load", "first"]))
    late = F.dayofmonth("saved_at") > 15
    for part in (~late, late):
        raw.where(~odd & part).repartition(2).write.mode("append").parquet(f"{base}/in")
        jobs.run(spark, jobs.parser().parse_args(["stream", "--input", f"{base}/in", "--store", f"{base}/store", "--once", "--max-files", "1"]))
    key = lambda df: sorted(map(str, df.collect()))
    want = catalog.results(spark, SF_SMALL)
    assert key(results_store.saved_results(spark, f"{base}/store")) == key(want)
    day = results_store.saved_results(spark, f"{base}/store", "2024-01-08", "2024-01-20")
    assert key(day) == key(want.where("saved_at >= '2024-01-08' and saved_at < '2024-01-21'"))


def test_store_of_a_file_sink_is_refused(spark):
    base = tempfile.mkdtemp(prefix="examlytics-foreign-")
    os.makedirs(f"{base}/_spark_metadata")
    with pytest.raises(ValueError, match="file sink"):
        results_store.saved_results(spark, base)


def test_store_writes_one_file_per_day(spark):
    base = tempfile.mkdtemp(prefix="examlytics-files-") + "/store"
    results_store.results_append(catalog.results(spark, SF_SMALL).repartition(16), base)
    days = [d for d in os.listdir(base) if d.startswith("saved_date=")]
    files = sum(f.endswith(".parquet") for _, _, names in os.walk(base) for f in names)
    assert files == len(days)


def test_python_decodes_invalid_text_only(spark):
    from examlytics.sources import ingest
    rows = [("a.txt", b"ok \xc3\xa9"), ("b.txt", b"x\xffy"), ("c.txt", b"cut \xe2\x82"), ("d.pdf", b"\xff"), ("e.txt", None), ("f.txt", b"")]
    df = spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in rows], "name string, content binary")
    got = {r.name: r.text for r in df.select("name", ingest.decode_text("content", F.col("name").endswith(".txt")).alias("text")).collect()}
    assert got == {"a.txt": "ok é", "b.txt": "xy", "c.txt": "cut ", "d.pdf": None, "e.txt": None, "f.txt": ""}


def test_roster_csv_drops_passwords(spark):
    from examlytics.sources import roster
    d = tempfile.mkdtemp(prefix="examlytics-roster-")
    with open(os.path.join(d, "examiners.csv"), "w") as f:
        f.write("Username,Password\nalice,1234\nbob,secret\n")
    r = roster.read_roster_csv(spark, d)
    assert r.columns == ["username"] and sorted(x.username for x in r.collect()) == ["alice", "bob"]
    results = spark.createDataFrame([("alice",), ("carol",), ("alice",)], "examiner_name string")
    got = {x.examiner_name: (x.n_records, x.known) for x in roster.roster_lookup(results, r).collect()}
    assert got == {"alice": (2, True), "carol": (1, False)}
    assert roster.unknown_examiner_records(results, r).count() == 1


def test_store_prunes_days_and_pushes_status(spark):
    import contextlib
    import io
    from paths import SF_SMALL
    from examlytics.operators import dashboard as D
    from examlytics.plans import catalog
    path = tempfile.mkdtemp(prefix="examlytics-store-") + "/results"
    r = catalog.results(spark, SF_SMALL)
    results_store.results_append(r, path)
    week = results_store.saved_results(spark, path, "2024-01-08", "2024-01-14")
    want = r.where(F.to_date("saved_at").between("2024-01-08", "2024-01-14"))
    assert week.count() == want.count() > 0
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        D.pass_records(week).explain("formatted")
    plan = buf.getvalue()
    assert "PartitionFilters: [isnotnull(saved_date" in plan and "2024-01-08" in plan
    assert "EqualTo(status,PASS)" in plan


def test_two_appends_keep_rows_without_a_time(spark):
    path = tempfile.mkdtemp(prefix="examlytics-null-") + "/store"
    rows = spark.createDataFrame([("1", None), ("2", None)], "record_id string, saved_at timestamp_ntz")
    early = F.coalesce(F.dayofmonth("saved_at") < 15, F.lit(False))
    results_store.results_append(rows.where(early), path)
    results_store.results_append(rows.where(~early), path)
    assert results_store.saved_results(spark, path).count() == 2
