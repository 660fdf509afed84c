"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator key.  Each reads the whole input tables (through the fixture views)
so its work grows with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dashboard as D
from ..operators import parse as P
from ..operators import prompts as B
from ..operators import results as R
from ..operators import sessions as S
from ..session import scratch_path
from ..sources import dashboard_store as K
from ..sources import ingest as I
from ..sources import reports, results_store, roster
from ..sources.literals import literal_frame
from ..sources.name_index import indexed_search, refresh_index
from ..sources.tables import read_table
from ..streaming import streams as G
from . import fixtures as fx

SEARCH_PATTERN = "customer#0+1[0-9]$"
ROSTER = ["signup", "purchase", "view"]
LITERAL_FILES = [
    ("report.pdf", "application/pdf"),
    ("notes.docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("NOTES.DOCX", "application/octet-stream"),
    ("main.py", "text/x-python"),
    ("readme.txt", "text/plain"),
    ("analysis.ipynb", "application/json"),
    ("scan.PDF", "application/octet-stream"),
    ("archive.zip", "application/zip"),
]
LITERAL_LABELS = [(-1, "absent"), (-2, ""), (-3, None), (-4, "N/A"), (-5, "nan")]
ANSWER_SINK = "session_id string, idx bigint, answer string"
STRIP_AROUND = " \t\u00a0\u3000\x1c\n"
URL_PATH = r"^[a-zA-Z]+://[^/?#]*([^?#]*)"


def results(spark: SparkSession, sf_dir: str, students: bool = True) -> DataFrame:
    return R.result_build(fx.results_raw(spark, sf_dir, students))


LITERAL_RESULTS = [(-1, "score " + "9" * 25), (-2, "0" * 30 + "7"), (-3, "\u0668\u0665 of \u0661\u0660\u0660"), (-4, "no mark"),
                   (-5, None), (-6, "049"), (-7, "050"), (-8, "\U0001d7d3\U0001d7ce/100"), (-9, "\u00b2 and 7")]


def _result_texts(spark, sf_dir):
    """Documents as evaluation texts, and literals: runs beyond bigint, leading zeros, digits of other scripts."""
    return fx.result_text(spark, sf_dir).unionByName(literal_frame(spark, LITERAL_RESULTS, "doc_id bigint, text string"))


def _docs_marks(spark, sf_dir):
    return R.mark_extract(_result_texts(spark, sf_dir), "text")


def _saved_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    results_store.results_append(results(spark, sf_dir), path)
    return results_store.saved_results(spark, path)


def _results_append(spark, sf_dir):
    """Two save batches (before / from the 15th of the month) appended to
    one table; reading it back must give every record of both."""
    path = scratch_path(spark, "results")
    r = results(spark, sf_dir)
    early = F.coalesce(F.dayofmonth("saved_at") < 15, F.lit(False))   # a null time goes to the second batch
    results_store.results_append(r.where(early), path)
    results_store.results_append(r.where(~early), path)
    return results_store.saved_results(spark, path)


def _loaded_store(spark, sf_dir, students: bool = False, between=None):
    """A store as it comes to be: three loads, ``between`` (a refresh of what is kept beside the store), a compaction, a load after
    it, and an earlier load repeated (it was cut short the first time)."""
    path = scratch_path(spark, "store")
    r = results(spark, sf_dir, students)
    of = F.pmod(F.col("record_id").cast("bigint"), F.lit(4))
    for i in range(3):
        rows = r.where(of == i)
        results_store.results_append(rows.where("status = 'PASS'") if i == 1 else rows, path, f"load-{i}")
    if between is not None:
        between(spark, path)
    results_store.compact(spark, path)
    results_store.results_append(r.where(of == 3), path, "load-3")
    results_store.results_append(r.where(of == 1), path, "load-1")
    return path


def _results_compacted(spark, sf_dir):
    return results_store.saved_results(spark, _loaded_store(spark, sf_dir, students=True))


def _states(spark, sf_dir, students: bool = False):
    return K.states(spark, _loaded_store(spark, sf_dir, students, between=K.refresh_states))


def _marks_series_stored(spark, sf_dir):
    return K.marks_series(spark, _loaded_store(spark, sf_dir, between=K.refresh_series))


def _report_text_kept(spark, sf_dir):
    """Reports of the kept table of latest records, refreshed before and after the store's later loads."""
    table = scratch_path(spark, "latest")
    path = _loaded_store(spark, sf_dir, students=True, between=lambda s, p: reports.refresh_latest(s, p, table))
    reports.refresh_latest(spark, path, table)
    return reports.render_reports(reports.latest_records(spark, table))


def _student_search_indexed(spark, sf_dir):
    return indexed_search(spark, _loaded_store(spark, sf_dir, students=True, between=refresh_index), SEARCH_PATTERN)


def _ingest_files(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "url").select(
        F.regexp_extract("url", URL_PATH, 1).alias("name"), F.lit("text/html").alias("media_type"))
    lit = literal_frame(spark, LITERAL_FILES, "name string, media_type string")
    return pages.unionByName(lit)


def _labels(spark, sf_dir):
    docs = R.mark_label(_docs_marks(spark, sf_dir), "text").select(
        F.col("doc_id").alias("label_id"), "marks_label")
    return docs.unionByName(literal_frame(spark, LITERAL_LABELS, "label_id bigint, marks_label string"))


def _stream_dir(spark, name):
    base = scratch_path(spark, f"stream-{name}")
    return f"{base}/checkpoint", f"{base}/sink"


def _stream_input(spark, sf_dir):
    """The events as a stream of several micro-batches: written in four files, dealt by a hash (so out of time
    order), and read two at a time."""
    path = scratch_path(spark, "stream-input")
    read_table(spark, sf_dir, "events").repartition(4, F.xxhash64("event_id")).write.parquet(path)
    return G.read_event_stream(spark, path, max_files_per_trigger=2)


def _violations_stream(spark, sf_dir):
    ck, sink = _stream_dir(spark, "violations")
    # the four files mix all days, so the delay spans the input
    G.violations_stream(fx.proctor_of(_stream_input(spark, sf_dir)), ck, sink, delay="400 days").awaitTermination()
    return G.last_per_key(spark, sink, ["session_id"], "session_id string, n_violations bigint, must_end boolean")


def _answers_stream(spark, sf_dir):
    ck, sink = _stream_dir(spark, "answers")
    G.answers_stream(fx.answers_of(_stream_input(spark, sf_dir)), ck, sink, delay="400 days").awaitTermination()
    return G.last_per_key(spark, sink, ["session_id", "idx"], ANSWER_SINK)


def _answers_merged(spark, sf_dir):
    """The answer stream in two runs, its table merged after the first and read with the tail of the second."""
    ck, sink = _stream_dir(spark, "answers")
    path = scratch_path(spark, "stream-input")
    for half in range(2):
        part = read_table(spark, sf_dir, "events").where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half)
        part.repartition(2, F.xxhash64("event_id", F.lit(1))).write.mode("append").parquet(path)
        log = fx.answers_of(G.read_event_stream(spark, path, max_files_per_trigger=1))
        G.answers_stream(log, ck, sink, delay="400 days").awaitTermination()
        if half == 0:
            G.merge_latest(spark, sink, ["session_id", "idx"], ANSWER_SINK, min_parts=1)
    return G.last_per_key(spark, sink, ["session_id", "idx"], ANSWER_SINK)


def _terminations_merged(spark, sf_dir):
    """The same of the terminations: a generation of the first run's parts and the tail of the second."""
    ck, sink = _stream_dir(spark, "terminations")
    path = scratch_path(spark, "stream-input")
    for half in range(2):
        part = read_table(spark, sf_dir, "events").where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half)
        part.repartition(2, F.xxhash64("event_id", F.lit(1))).write.mode("append").parquet(path)
        G.terminations_stream(fx.proctor_of(G.read_event_stream(spark, path, max_files_per_trigger=1)), ck, sink).awaitTermination()
        if half == 0:
            G.merge_terminations(spark, sink, min_parts=1)
    return G.terminations(spark, sink)


def _terminations_stream(spark, sf_dir):
    ck, sink = _stream_dir(spark, "terminations")
    G.terminations_stream(fx.proctor_of(_stream_input(spark, sf_dir)), ck, sink).awaitTermination()
    return G.terminations(spark, sink)


def _results_stream(spark, sf_dir):
    """Half of the records appended as a batch, half by the stream, into one store."""
    ck, store = _stream_dir(spark, "results")
    customers = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    odd = F.col("record_id").cast("bigint") % 2 == 1
    results_store.results_append(results(spark, sf_dir).where(odd), store)
    G.results_stream(fx.records_of(_stream_input(spark, sf_dir), customers).where(~odd), ck, store).awaitTermination()
    return results_store.saved_results(spark, store)


def _department_distribution(spark, sf_dir):
    """Department counts of the results records.  Records are counted per
    roll number (user) before the customer join, so the join sees one row
    per user rather than one per record (a hot user is absorbed by the
    partial aggregate); same result as counting the joined records."""
    ev = read_table(spark, sf_dir, "events", "user_id", "ts", "event_id")
    per_user = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_records"),
        F.min(F.struct(F.col("ts").alias("saved_at"), F.col("event_id").cast("string").alias("record_id")))
        .alias("_first"))
    cu = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    joined = per_user.join(cu, per_user.user_id == cu.c_custkey, "left").select(
        F.col("c_mktsegment").alias("department"), "_records", "_first")
    return D.value_counts(joined, "department", weight="_records", first_seen="_first")


def _report_text(spark, sf_dir):
    """Latest record per roll first (events only), then the student
    attributes for those rows: the customer join sees one row per student."""
    latest = reports.latest_per_roll(results(spark, sf_dir, students=False)).drop("student_name", "department")
    cu = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(
        F.col("c_custkey").cast("string").alias("roll_number"), F.col("c_name").alias("student_name"),
        F.col("c_mktsegment").alias("department"))
    return reports.render_reports(latest.join(cu, "roll_number", "left"))


def _turns(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")


def _question_lines(spark, sf_dir):
    """Lines of each conversation's response (the
    response is the turns joined as ``Q<turn+1>: <text>``; see
    fixtures.raw_questions for the one-string form)."""
    label = F.concat(F.lit("Q"), (F.col("turn") + 1).cast("string"), F.lit(": "))
    return P.response_lines(_turns(spark, sf_dir), "conv_id", "turn", "text", label)


def _parsed_questions(spark, sf_dir):
    return P.question_lines_parse(_question_lines(spark, sf_dir), "conv_id", "turn")


def _transcripts(spark, sf_dir):
    """The six questions of each conversation joined to the last answer of either channel."""
    keys = ("conv_id", "idx")
    answers = S.answer_upsert(S.merge_channels(*fx.exam_answers(spark, sf_dir), keys=keys), keys)
    return S.transcript_assemble(P.question_lines_limit(_question_lines(spark, sf_dir), "conv_id", "turn"), answers)


def _answer_log(spark, sf_dir):
    return fx.answer_log(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # A: sources and sinks
    "saved_results": _saved_results,
    "roster_lookup": lambda s, d: roster.roster_lookup(
        fx.results_raw(s, d, students=False), literal_frame(s, [(n,) for n in ROSTER], "username string")),
    "text_ingest": lambda s, d: I.text_ingest(fx.upload_bytes(s, d)),
    "ingest_route": lambda s, d: I.ingest_route(_ingest_files(s, d)),
    "results_append": _results_append,
    "results_compacted": _results_compacted,
    "report_text": _report_text,
    "report_text_kept": _report_text_kept,
    # B: settings and prompt datasets
    "settings_resolve": lambda s, d: B.settings_resolve(fx.settings(s, d)),
    "section_template": lambda s, d: B.section_template(B.settings_resolve(fx.settings(s, d))),
    "difficulty_template": lambda s, d: B.difficulty_template(B.settings_resolve(fx.settings(s, d))),
    "style_template": lambda s, d: B.style_template(B.settings_resolve(fx.settings(s, d))),
    "text_truncate": lambda s, d: B.text_truncate(fx.result_text(s, d)),
    "prompt_questions": lambda s, d: B.prompt_questions(fx.settings(s, d)),
    "prompt_eval": lambda s, d: B.prompt_eval(fx.qa(s, d)),
    "prompt_model_answer": lambda s, d: B.prompt_model_answer(fx.qa(s, d), fx.result_text(s, d)),
    "prompt_final": lambda s, d: B.prompt_final(_transcripts(s, d), fx.sessions_students(s, d)),
    # C: response parsing and result records
    "completion_extract": lambda s, d: P.completion_extract(fx.responses(s, d)),
    "completion_state": lambda s, d: P.completion_state(fx.responses(s, d)),
    "question_parse": _parsed_questions,
    "question_fallback": lambda s, d: P.question_lines_final(_parsed_questions(s, d), _turns(s, d), "conv_id"),
    "question_limit": lambda s, d: P.question_lines_limit(_question_lines(s, d), "conv_id", "turn"),
    "question_chain": lambda s, d: P.questions_from_responses(fx.question_responses(s, d), section_col="section"),
    "transcription_normalize": lambda s, d: P.transcription_normalize(fx.transcriptions(s, d)),
    "mark_extract": lambda s, d: _docs_marks(s, d).select("doc_id", "marks"),
    "mark_label": lambda s, d: R.mark_label(_docs_marks(s, d), "text").select("doc_id", "marks", "marks_label"),
    "pass_status": lambda s, d: R.pass_status(_docs_marks(s, d), "text").select("doc_id", "marks", "status"),
    "result_build": lambda s, d: results(s, d),
    "strip": lambda s, d: fx.result_text(s, d).select("doc_id", T.ustrip(F.concat(
        F.lit(STRIP_AROUND), "text", F.lit(STRIP_AROUND))).alias("stripped")),
    "saved_at_text": lambda s, d: results(s, d, students=False).select("record_id", R.saved_at_text().alias("saved_at_text")),
    "marks_reparse": lambda s, d: R.marks_reparse(_labels(s, d)),
    # D/H: session state
    "transcript_assemble": _transcripts,
    "answer_upsert": lambda s, d: S.answer_upsert(S.blank_answer_filter(_answer_log(s, d))),
    "voice_upsert": lambda s, d: S.voice_upsert(fx.voice_log(s, d)),
    "blank_answer_filter": lambda s, d: S.blank_answer_filter(_answer_log(s, d)).select(
        "session_id", "idx", "answer", "ts", "event_id"),
    "progress": lambda s, d: S.progress(_answer_log(s, d)),
    "final_gate": lambda s, d: S.final_gate(_answer_log(s, d), fx.sessions(s, d)),
    "resume_point": lambda s, d: S.resume_point(_answer_log(s, d), sessions=fx.sessions(s, d)),
    "active_final_gate": lambda s, d: S.exclude_terminated(
        S.final_gate(_answer_log(s, d), fx.sessions(s, d)), S.violations_terminate(fx.session_proctor(s, d))),
    "active_resume_point": lambda s, d: S.exclude_terminated(
        S.resume_point(_answer_log(s, d), sessions=fx.sessions(s, d)), S.violations_terminate(fx.session_proctor(s, d))),
    "violations_terminate": lambda s, d: S.violations_terminate(fx.proctor(s, d)),
    # E: dashboard
    "overview_kpis": lambda s, d: D.overview_kpis(results(s, d, students=False)),
    "status_distribution": lambda s, d: D.status_distribution(results(s, d, students=False)),
    "department_distribution": _department_distribution,
    "marks_series": lambda s, d: D.marks_series(results(s, d, students=False)),
    "student_search": lambda s, d: D.student_search(results(s, d), SEARCH_PATTERN),
    "student_search_indexed": _student_search_indexed,
    "pass_records": lambda s, d: D.pass_records(results(s, d)),
    "fail_records": lambda s, d: D.fail_records(results(s, d)),
    "kpis_from_states": lambda s, d: K.overview_kpis(_states(s, d)),
    "status_from_states": lambda s, d: D.value_counts(_states(s, d), "status", "n", "first"),
    "department_from_states": lambda s, d: D.value_counts(_states(s, d, students=True), "department", "n", "first"),
    "marks_series_stored": _marks_series_stored,
    "record_count": lambda s, d: D.record_count(results(s, d, students=False)),
    # G: streaming forms
    "violations_stream": _violations_stream,
    "answers_stream": _answers_stream,
    "results_stream": _results_stream,
    "terminations_stream": _terminations_stream,
    "answers_merged": _answers_merged,
    "terminations_merged": _terminations_merged,
}
