"""Operators compose into the exam flow: response -> questions -> answers
-> transcript -> final prompt; final response -> record -> dashboard."""

import tempfile

from pyspark.sql import functions as F

from paths import SF_SMALL
from examlytics.functions import constants as K
from examlytics.operators import dashboard as D
from examlytics.operators import parse as P
from examlytics.operators import prompts as B
from examlytics.operators import results as R
from examlytics.operators import sessions as S
from examlytics.plans import fixtures as fx
from examlytics.sources import reports, results_store


def test_exam_flow(spark):
    questions = P.question_limit(fx.raw_questions(spark, SF_SMALL))
    qa = fx.qa(spark, SF_SMALL)
    answers = qa.select("conv_id", "idx", "answer").where(F.col("answer").isNotNull())
    transcripts = S.transcript_assemble(questions, answers)
    counts = transcripts.select(F.size(F.split("transcript", "\n\nQ")).alias("n")).distinct().collect()
    assert [r.n for r in counts] == [K.QUESTIONS_PER_SESSION]          # always six blocks
    prompts = B.prompt_final(transcripts, fx.sessions_students(spark, SF_SMALL))
    assert prompts.count() == transcripts.count() == fx.raw_questions(spark, SF_SMALL).count()

    # final responses come back; the record is built and saved, then read by the dashboard
    finals = prompts.select(F.col("conv_id").cast("string").alias("prompt_id"), F.lit("final").alias("kind"),
                            F.to_json(F.struct(F.array(F.struct(F.struct(
                                F.concat(F.lit("Overall Score: "), (F.col("conv_id") % 101).cast("string"),
                                         F.lit("/100")).alias("content")).alias("message"))).alias("choices")))
                            .alias("raw"))
    evaluated = P.completion_extract(finals)
    raw = evaluated.join(fx.sessions_students(spark, SF_SMALL).withColumn(
        "prompt_id", F.col("conv_id").cast("string")), "prompt_id").select(
        F.col("prompt_id").alias("record_id"), F.lit("examiner").alias("examiner_name"), "student_name",
        "roll_number", "department", "project_title", F.col("content").alias("result"))
    path = tempfile.mkdtemp(prefix="examlytics-e2e-") + "/results"
    results_store.results_append(R.result_build(raw), path)
    saved = results_store.saved_results(spark, path)
    k = D.overview_kpis(saved).first()
    assert k.total == k.passed + k.failed == raw.count()
    rep = tempfile.mkdtemp(prefix="examlytics-rep-") + "/reports"
    reports.write_reports(reports.report_text(saved), rep)
    one = reports.read_report(spark, rep, "3").collect()
    assert len(one) == 1 and "Roll Number: 3" in one[0].report


def test_final_gate_per_session_mode(spark):
    log = spark.createDataFrame([("a", i, "x", None, i) for i in range(6)] + [("b", 0, "x", None, 9)],
                                "session_id string, idx bigint, answer string, ts timestamp_ntz, event_id bigint")
    sessions = spark.createDataFrame([("a", K.MODE_EXAM, 6), ("b", K.MODE_EXAM, 1)],
                                     "session_id string, mode string, n_questions int")
    assert sorted(r.session_id for r in S.final_gate(log, sessions).collect()) == ["a", "b"]
    practice = sessions.withColumn("mode", F.lit(K.MODE_PRACTICE))
    assert S.final_gate(log, practice).count() == 0
