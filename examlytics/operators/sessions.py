"""Positional session state: answers, transcripts, progress, proctoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.json import parsed, transcription_text
from ..functions.text import progress_percent, ustrip


def blank_answer_filter(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Drop submissions that are empty after a Unicode-aware strip."""
    return answers.where(ustrip(answer_col) != F.lit(""))


def answer_upsert(answers: DataFrame, keys=("session_id", "idx")) -> DataFrame:
    """Last write wins per (session, slot): the answer with the greatest
    (ts, event_id).  ``max_by`` is partially aggregated before the shuffle, so
    a hot session costs one row per map partition, not all its rows."""
    return (answers.groupBy(*keys)
            .agg(F.max_by("answer", F.struct("ts", "event_id")).alias("answer")))


def voice_upsert(voice: DataFrame, keys=("session_id", "idx")) -> DataFrame:
    """Voice answers: normalise the transcription response, then the same
    blank rule and last-write-wins as typed answers.

    The blank test sits in the ordering key (``max_by`` skips rows whose
    key is null) rather than in a filter: a filter would be pushed below the
    projection with the JSON parsing inlined, parsing every response twice.
    """
    staged = voice.select(*keys, "ts", "event_id", "raw", parsed("raw").alias("_v"))
    normalised = staged.select(*keys, "ts", "event_id", transcription_text("raw", v="_v").alias("answer"))
    order = F.when(ustrip("answer") != F.lit(""), F.struct("ts", "event_id"))
    return (normalised.groupBy(*keys).agg(F.max_by("answer", order).alias("answer"))
            .where(F.col("answer").isNotNull()))


def merge_channels(typed: DataFrame, voice: DataFrame, keys=("session_id", "idx")) -> DataFrame:
    """One answer log of both channels: typed answers (answer) and voice answers (raw, a transcription
    response, normalised).  Blank ones are dropped; the last write per slot then wins across channels
    (:func:`answer_upsert`)."""
    staged = voice.select(*keys, "ts", "event_id", "raw", parsed("raw").alias("_v"))
    spoken = staged.select(*keys, transcription_text("raw", v="_v").alias("answer"), "ts", "event_id")
    return blank_answer_filter(typed.select(*keys, "answer", "ts", "event_id")).unionByName(blank_answer_filter(spoken))


def answered_slots(answer_log: DataFrame) -> DataFrame:
    """The distinct (session_id, idx) with a non-blank answer.  Combined before
    the shuffle, so a hot session sends one row per slot and map partition;
    there is no limit on the number of slots."""
    return (answer_log.where((ustrip("answer") != F.lit("")) & (F.col("idx") >= 0))
            .select("session_id", "idx").distinct())


def _per_session(answer_log: DataFrame, sessions: DataFrame | None, n_questions: int) -> DataFrame:
    """(session_id, _n, answered, first_open) of every session: answered slots below the session's own
    number of questions, and the length of the answered run from slot 0.

    ``sessions`` (session_id and, if they differ, n_questions) lists every session, with or
    without submissions; without it every session of the log has ``n_questions``.
    """
    base = (answer_log.select("session_id").distinct().withColumn("_n", F.lit(n_questions).cast("bigint")) if sessions is None
            else sessions.select("session_id", (F.col("n_questions") if "n_questions" in sessions.columns else F.lit(n_questions))
                                 .cast("bigint").alias("_n")))
    slots = answered_slots(answer_log).join(base, "session_id").where(F.col("idx") < F.col("_n"))
    # distinct slots in order: idx equals its rank exactly on the unbroken run from 0
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("idx")) - 1
    counted = slots.withColumn("_run", (rank == F.col("idx")).cast("int")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("answered"), F.sum("_run").alias("first_open"))
    zero = F.lit(0).cast("bigint")
    return base.join(counted, "session_id", "left").select(
        "session_id", "_n", F.coalesce("answered", zero).alias("answered"), F.coalesce("first_open", zero).alias("first_open"))


def progress(answer_log: DataFrame, n_questions: int = K.QUESTIONS_PER_SESSION,
             sessions: DataFrame | None = None) -> DataFrame:
    """Per session: answered slots, ``int(i / n * 100)``, completion, label."""
    n = F.col("_n")
    done = F.col("answered") >= n
    return _per_session(answer_log, sessions, n_questions).select(
        "session_id", "answered",
        F.when(n > 0, progress_percent("answered", "_n")).otherwise(F.lit(0)).alias("progress_pct"), done.alias("complete"),
        F.when(done, F.lit("complete")).otherwise(
            F.concat(F.lit("Question "), (F.col("answered") + 1).cast("string"), F.lit(" / "), n.cast("string"))).alias("label"))


def final_gate(answer_log: DataFrame, sessions: DataFrame | None = None, mode: str = K.MODE_EXAM,
               n_questions: int = K.QUESTIONS_PER_SESSION) -> DataFrame:
    """Sessions ready for the final evaluation: exam mode, questions present
    and every question answered.

    ``sessions`` (session_id, mode, n_questions) gives both per session;
    without it every session has ``mode`` and ``n_questions``.
    """
    p = _per_session(answer_log, sessions, n_questions)
    modes = p.select("session_id").withColumn("mode", F.lit(mode)) if sessions is None else sessions.select("session_id", "mode")
    return (p.where((F.col("_n") > 0) & (F.col("answered") >= F.col("_n")))
            .join(modes.where(F.col("mode") == K.MODE_EXAM), "session_id").select("session_id", "answered"))


def resume_point(answer_log: DataFrame, n_questions: int = K.QUESTIONS_PER_SESSION,
                 sessions: DataFrame | None = None) -> DataFrame:
    """Unfinished sessions and the first slot still unanswered (0-based).

    Finished sessions are left out; a session with only blank submissions
    resumes at 0.  With ``sessions`` (session_id, n_questions) the sessions
    without any submission are included, and those without questions left out.
    """
    return (_per_session(answer_log, sessions, n_questions).where(F.col("first_open") < F.col("_n"))
            .select("session_id", F.col("first_open").alias("resume_idx")))


def transcript_assemble(questions: DataFrame, answers: DataFrame | None = None,
                        key: str = "conv_id") -> DataFrame:
    """Numbered question/answer blocks in question order, '' for a missing
    answer.  ``questions``: (key, idx, question); ``answers``: (key, idx,
    answer), at most one row per slot (after :func:`answer_upsert`), or None
    when ``questions`` already carries an ``answer`` column.  Questions are a
    session's final list (six, from the question operators), which bounds the
    list that is gathered here."""
    j = questions if answers is None else questions.join(answers, [key, "idx"], "left")
    block = F.concat(
        F.lit("Q"), (F.col("idx") + 1).cast("string"), F.lit(": "), F.coalesce("question", F.lit("")),
        F.lit("\nA"), (F.col("idx") + 1).cast("string"), F.lit(": "), F.coalesce("answer", F.lit("")))
    return (j.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))).alias("blocks"))
            .select(key, F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n").alias("transcript")))


def violations_terminate(proctor: DataFrame, limit: int = K.VIOLATION_LIMIT) -> DataFrame:
    """Sessions that reach ``limit`` violations, with the moment they must end
    (time of the ``limit``-th violation in (ts, event_id) order).

    ``row_number() = k`` is planned as a partial WindowGroupLimit before the
    shuffle, so each map partition sends at most k rows per session; the
    counts are a separate partial aggregate.  Both sides of the final join
    have one row per session.
    """
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    kth = (proctor.select("session_id", "ts", "event_id")
           .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == limit)
           .select("session_id", F.col("ts").alias("terminated_at"),
                   F.col("event_id").alias("terminating_event_id")))
    counts = proctor.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_violations"))
    return kth.join(counts, "session_id").select(
        "session_id", "n_violations", "terminated_at", "terminating_event_id")


def exclude_terminated(sessions: DataFrame, terminated: DataFrame, key: str = "session_id") -> DataFrame:
    """Drop sessions that reached the violation limit (from
    :func:`violations_terminate`) from resume/final-gate outputs: a
    terminated exam can be neither resumed nor graded."""
    return sessions.join(terminated.select(key), key, "left_anti")
