import datetime as dt

import pytest
from pyspark.sql import functions as F

from examlytics.functions import constants as K
from examlytics.operators import dashboard as D
from examlytics.operators import prompts as B
from examlytics.operators import sessions as S
from examlytics.sources.reports import report_text

SETTINGS = "doc_id long, mode string, section string, difficulty string, style string, text string"


def test_exam_mode_always_medium_and_defaults(spark):
    df = spark.createDataFrame([
        (1, K.MODE_EXAM, "Defense", "Expert", "HOD Panel", "t"),
        (2, K.MODE_PRACTICE, None, None, None, "t"),
        (3, K.MODE_PRACTICE, "Defense", "Easy", "Friendly 🙂", "t"),   # exam section in practice
        (4, K.MODE_EXAM, "Overall", None, "Friendly 🙂", "t"),          # practice style in exam
    ], SETTINGS)
    got = {r.doc_id: r for r in B.settings_resolve(df).collect()}
    assert got[1].difficulty == "Medium" and got[1].valid
    assert (got[2].section, got[2].difficulty, got[2].style) == ("Technical", "Medium", "Strict 😐")
    assert got[2].valid
    assert not got[3].valid and not got[4].valid


@pytest.mark.parametrize("style,pattern", [
    ("Friendly 🙂", "Friendly"), ("Strict 😐", "Strict"), ("Interview 💼", "Interview"),
    ("Rapid Fire ⚡", "Rapid Fire"), ("Defense Panel 🔥", "Defense Panel"),
    ("External Examiner", "External Examiner"),
    ("AI Strict Judge", "Strict"),       # contains "Strict": the earlier pattern wins
    ("Formal Board", None), ("HOD Panel", None),
])
def test_style_first_match(spark, style, pattern):
    df = spark.createDataFrame([(style,)], "style string")
    got = df.select(B.style_text("style")).first()[0]
    want = dict(B.STYLE_TEXT).get(pattern, "")
    assert got == want


def test_section_and_difficulty_lookup(spark):
    df = spark.createDataFrame([("Basic", "Easy"), ("Unknown", "Impossible"), (None, None)], "s string, d string")
    rows = df.select(B.section_text("s"), B.difficulty_text("d")).collect()
    assert rows[0][0] == B.SECTION_TEXT["Basic"] and rows[0][1] == B.DIFFICULTY_TEXT["Easy"]
    assert rows[1][0] == B.SECTION_DEFAULT_TEXT and rows[1][1] == ""
    assert rows[2][0] == B.SECTION_DEFAULT_TEXT and rows[2][1] == ""


def test_prompt_questions_truncates_and_has_contract(spark):
    text = "x" * 13000
    df = spark.createDataFrame([(1, K.MODE_PRACTICE, "Basic", "Easy", "Friendly 🙂", text)], SETTINGS)
    p = B.prompt_questions(df).first().prompt
    assert "x" * 12000 in p and "x" * 12001 not in p
    for i in range(1, 7):
        assert f"Q{i}: ..." in p


def test_report_text_latest_per_roll(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("1", "ex", "Ann", "7", "CS", "P", "Score 80", t),
            ("2", "ex", "Ann", "7", "CS", "P2", "Score 90", t + dt.timedelta(days=1)),
            ("3", "ex", None, "8", None, "P3", None, t)]
    df = spark.createDataFrame(rows, "record_id string, examiner_name string, student_name string, "
                                     "roll_number string, department string, project_title string, "
                                     "result string, saved_at timestamp_ntz")
    got = {r.roll_number: r for r in report_text(df).collect()}
    assert got["7"].report.endswith("\n\nScore 90") and "Project Title: P2" in got["7"].report
    assert got["7"].report_name == "7_viva_report"
    assert got["8"].report.splitlines()[1] == "Student Name: "


def test_kpis_on_empty_table(spark):
    df = spark.createDataFrame([], "marks bigint, status string")
    r = D.overview_kpis(df).first()
    assert (r.total, r.passed, r.failed, r.avg_marks) == (0, 0, 0, 0.0)


def test_bad_search_pattern_fails_on_driver(spark):
    df = spark.createDataFrame([("Ann",)], "student_name string")
    with pytest.raises(Exception):
        D.student_search(df, "([unclosed")


def test_exclude_terminated(spark):
    s = spark.createDataFrame([("a", 0), ("b", 2)], "session_id string, resume_idx long")
    t = spark.createDataFrame([("b", 3)], "session_id string, n_violations long")
    assert [r.session_id for r in S.exclude_terminated(s, t).collect()] == ["a"]


def test_result_build_stamps_wall_clock_when_missing(spark):
    from examlytics.operators.results import result_build, saved_at_text
    raw = spark.createDataFrame([("1", "ex", "Ann", "7", "CS", "P", "Overall 72/100")],
                                "record_id string, examiner_name string, student_name string, "
                                "roll_number string, department string, project_title string, result string")
    r = result_build(raw).select("*", saved_at_text().alias("t")).first()
    assert (r.marks, r.marks_label, r.status) == (72, "72/100", "PASS")
    assert r.saved_at is not None and r.saved_at.microsecond == 0 and len(r.t) == 19
