import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from examlytics.functions import constants as K
from examlytics.operators import sessions as S
from examlytics.operators.dashboard import global_position

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def ts(m):
    return T0 + dt.timedelta(minutes=m)


def answers_df(spark, rows):
    return spark.createDataFrame(rows, "session_id string, idx bigint, answer string, ts timestamp_ntz, event_id bigint")


def test_blank_then_real_and_tie(spark):
    rows = [("s", 0, "first", ts(0), 1), ("s", 0, "  ", ts(5), 2),      # blank later: ignored
            ("s", 1, "a", ts(1), 3), ("s", 1, "b", ts(1), 4),           # same ts: higher event id wins
            ("s", 2, "　", ts(1), 5)]                               # only blank: no answer
    got = {(r.idx, r.answer) for r in S.answer_upsert(S.blank_answer_filter(answers_df(spark, rows))).collect()}
    assert got == {(0, "first"), (1, "b")}


@pytest.mark.parametrize("answered,resume,pct,complete", [
    ([], 0, 0, False), ([0, 1], 2, 33, False), ([0, 2, 5], 1, 50, False),
    ([0, 1, 2, 3, 4, 5], None, 100, True), ([1, 2, 3, 4, 5], 0, 83, False),
])
def test_progress_resume_gate(spark, answered, resume, pct, complete):
    rows = [("s", i, "ans", ts(i), i) for i in answered] + [("s", 0, " ", ts(9), 99)]
    log = answers_df(spark, rows)
    p = S.progress(log).first()
    assert (p.answered, p.progress_pct, p.complete) == (len(answered), pct, complete)
    r = S.resume_point(log).collect()
    assert (r[0].resume_idx if r else None) == resume
    assert S.final_gate(log).count() == (1 if complete else 0)
    assert S.final_gate(log, mode="Student Practice").count() == 0


@pytest.mark.parametrize("n,terminated", [(2, None), (3, 3), (4, 3)])
def test_violations_terminate(spark, n, terminated):
    rows = [("s", "click", ts(10 - i), i) for i in range(n)]   # reverse time order on purpose
    df = spark.createDataFrame(rows, "session_id string, kind string, ts timestamp_ntz, event_id bigint")
    got = S.violations_terminate(df).collect()
    if terminated is None:
        assert got == []
    else:
        assert got[0].n_violations == n
        assert got[0].terminated_at == ts(10 - (n - 1) + 2)   # third earliest
        assert got[0].terminating_event_id == n - 3


def test_transcript_assemble_missing_answer(spark):
    q = spark.createDataFrame([(1, 1, "second?"), (1, 0, "first?")], "conv_id long, idx long, question string")
    a = spark.createDataFrame([(1, 0, "yes")], "conv_id long, idx long, answer string")
    t = S.transcript_assemble(q, a).first().transcript
    assert t == "Q1: first?\nA1: yes\n\nQ2: second?\nA2: "


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_global_position_is_partition_invariant(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.range(0, 2000).select(((F.col("id") * 7919) % 2000).alias("k"), F.col("id").alias("v"))
        got = global_position(df, ["k"]).select("position", "k").collect()
        assert sorted((r.position, r.k) for r in got) == [(i, i) for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_session_top_k_plan(spark):
    # A session holding most rows must be cut to k rows per map partition before the shuffle.
    hot = F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.col("id").cast("string"))
    df = spark.range(0, 5000).select(hot.alias("session_id"), F.lit("click").alias("kind"),
                                     F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
                                     F.col("id").alias("event_id"))
    out = S.violations_terminate(df)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    plan = buf.getvalue()
    # partial limit below the exchange, final limit above it
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan and "Final" in plan
    assert out.where(F.col("session_id") == "hot").first().terminating_event_id == 2


def test_resume_point_includes_sessions_without_answers(spark):
    log = answers_df(spark, [("a", 0, "x", ts(0), 1)])
    sessions = spark.createDataFrame([("a",), ("b",)], "session_id string")
    got = {r.session_id: r.resume_idx for r in S.resume_point(log, sessions=sessions).collect()}
    assert got == {"a": 1, "b": 0}


def test_eight_questions_pass_the_gate(spark):
    log = answers_df(spark, [("a", i, "x", ts(i), i) for i in range(8)] + [("b", i, "x", ts(i), i) for i in range(7)] + [("c", 100, "x", ts(0), 1)])
    sessions = spark.createDataFrame([("a", K.MODE_EXAM, 8), ("b", K.MODE_EXAM, 8), ("c", K.MODE_EXAM, 101), ("d", K.MODE_EXAM, 0)],
                                     "session_id string, mode string, n_questions int")
    assert [tuple(r) for r in S.final_gate(log, sessions).collect()] == [("a", 8)]
    assert {r.session_id: r.resume_idx for r in S.resume_point(log, sessions=sessions).collect()} == {"b": 7, "c": 0}


def test_terminated_sessions_are_left_out(spark):
    sessions = spark.createDataFrame([("a",), ("b",)], "session_id string")
    proctor = answers_df(spark, [("a", 0, "", ts(i), i) for i in range(3)] + [("b", 0, "", ts(i), i) for i in range(2)])
    left = S.exclude_terminated(S.resume_point(answers_df(spark, []), sessions=sessions), S.violations_terminate(proctor))
    assert [r.session_id for r in left.collect()] == ["b"]
