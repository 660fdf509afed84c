import subprocess
import sys
import tempfile

from paths import ROOT, SF_SMALL
from examlytics import jobs
from examlytics.functions.questions import NO_CHOICES_QUESTIONS, SHORT_LIST_QUESTIONS
from examlytics.operators import sessions as S
from examlytics.plans import catalog, fixtures as fx


def run(spark, *args):
    jobs.run(spark, jobs.parser().parse_args(list(args)))


def test_results_dashboard_reports_jobs(spark):
    base = tempfile.mkdtemp(prefix="examlytics-jobs-")
    store = f"{base}/store"
    fx.results_raw(spark, SF_SMALL).write.parquet(f"{base}/in")
    run(spark, "results", "--input", f"{base}/in", "--store", store)
    run(spark, "dashboard", "--store", store, "--out", f"{base}/dash")
    kpis = spark.read.parquet(f"{base}/dash/kpis").first()
    want = catalog.QUERIES["overview_kpis"](spark, SF_SMALL).first()
    assert tuple(kpis) == tuple(want)
    assert spark.read.parquet(f"{base}/dash/marks_series").count() == kpis.total
    run(spark, "reports", "--store", store, "--out", f"{base}/reports")
    assert spark.read.parquet(f"{base}/reports").count() == catalog.QUERIES["report_text"](spark, SF_SMALL).count()


def test_questions_job_reads_json(spark):
    base = tempfile.mkdtemp(prefix="examlytics-jobs-q-")
    six = "\\n".join(f"Q{i}: item {i}" for i in range(1, 8))
    rows = [("ok", '{"choices":[{"message":{"content":"' + six + '"}}]}', "Logical"), ("none", "{}", "Basic"), ("broken", "{", None),
            ("short", '{"choices":[{"message":{"content":"Q1: a"}}]}', "Overall")]
    spark.createDataFrame(rows, "prompt_id string, raw string, section string").write.parquet(f"{base}/in")
    run(spark, "questions", "--input", f"{base}/in", "--out", f"{base}/out")
    got = {}
    for r in spark.read.parquet(f"{base}/out").orderBy("prompt_id", "idx").collect():
        got.setdefault(r.prompt_id, []).append(r.question)
    assert got["ok"] == [f"item {i}" for i in range(1, 7)]
    assert "Basic" in got["none"][0] and got["none"][1:] == NO_CHOICES_QUESTIONS
    assert "Technical" in got["broken"][0] and got["broken"][1:] == SHORT_LIST_QUESTIONS
    assert "Overall" in got["short"][0] and got["short"][1:] == SHORT_LIST_QUESTIONS


def test_sessions_and_final_jobs(spark):
    base = tempfile.mkdtemp(prefix="examlytics-jobs-s-")
    fx.answer_log(spark, SF_SMALL).write.parquet(f"{base}/typed")
    fx.voice_log(spark, SF_SMALL).where("event_id % 2 = 0").write.parquet(f"{base}/voice")
    fx.sessions(spark, SF_SMALL).write.parquet(f"{base}/sessions")
    fx.session_proctor(spark, SF_SMALL).write.parquet(f"{base}/violations")
    run(spark, "sessions", "--typed", f"{base}/typed", "--voice", f"{base}/voice", "--sessions", f"{base}/sessions",
        "--violations", f"{base}/violations", "--out", f"{base}/out")
    ended = {r.session_id for r in S.violations_terminate(fx.session_proctor(spark, SF_SMALL)).collect()}
    resume = {r.session_id for r in spark.read.parquet(f"{base}/out/resume").collect()}
    assert ended and resume and not ended & resume
    assert spark.read.parquet(f"{base}/out/progress").count() == fx.sessions(spark, SF_SMALL).count() - len(ended)
    spark.createDataFrame([("a", 0, "why"), ("a", 1, "how")], "session_id string, idx bigint, question string").write.parquet(f"{base}/q")
    spark.createDataFrame([("a", 1, "so")], "session_id string, idx bigint, answer string").write.parquet(f"{base}/a")
    spark.createDataFrame([("a", "Ann", "1", "CS", "Robot")], "session_id string, student_name string, roll_number string, "
                          "department string, project_title string").write.parquet(f"{base}/st")
    run(spark, "final", "--input", f"{base}/q", "--answers", f"{base}/a", "--students", f"{base}/st", "--out", f"{base}/final")
    assert "Q1: why\nA1: \n\nQ2: how\nA2: so" in spark.read.parquet(f"{base}/final").first().prompt


def test_terminations_job(spark):
    base = tempfile.mkdtemp(prefix="examlytics-jobs-t-")
    fx.proctor(spark, SF_SMALL).select("session_id", "ts", "event_id").repartition(4).write.parquet(f"{base}/in")
    run(spark, "terminations", "--input", f"{base}/in", "--sink", f"{base}/parts", "--out", f"{base}/out", "--once", "--max-files", "1")
    want = S.violations_terminate(fx.proctor(spark, SF_SMALL))
    assert sorted(map(str, spark.read.parquet(f"{base}/out").collect())) == sorted(map(str, want.collect()))


def test_job_session_keeps_submit_options():
    """Master and shuffle partitions of the submission survive."""
    code = ("from pyspark import SparkConf\nfrom examlytics.session import get_spark\ns = get_spark()\n"
            "print(s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'))")
    env = {**__import__("os").environ, "PYTHONPATH": ROOT,
           "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=400 --conf spark.ui.enabled=false pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-2:] == ["local[2]", "400"], out.stderr[-500:]
