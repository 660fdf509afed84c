"""Fixture views: the exam-domain tables derived from the driver tables.

Each function mirrors a view in FIXTURES.md §3 and has a DuckDB twin in
:mod:`examlytics.plans.oracle`.  All are lazy DataFrames over the whole
input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.ordering import DEFAULT_BUCKET, bucketed_rank
from ..sources.literals import literal_frame
from ..sources.tables import read_table


def _events(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "events", *cols)


def results_raw(spark: SparkSession, sf_dir: str, students: bool = True) -> DataFrame:
    """Result records before mark extraction (events as saved evaluations).

    ``customer`` is keyed by ``c_custkey``, so the left join never changes
    the row count; callers that need no student columns pass
    ``students=False`` and skip the join entirely.  The join itself is left
    to the planner: broadcast while ``customer`` is under the configured
    ``autoBroadcastJoinThreshold`` (a size check on the scan), sort-merge
    beyond it.
    """
    ev = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "props")
    return records_of(ev, read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment") if students else None)


def records_of(ev: DataFrame, customers: DataFrame | None) -> DataFrame:
    """Events (a table or a stream) as saved evaluations."""
    if customers is not None:
        cu = customers.select("c_custkey", "c_name", "c_mktsegment")
        ev = ev.join(cu, ev.user_id == cu.c_custkey, "left")
        name, dept = F.col("c_name"), F.col("c_mktsegment")
    else:
        name = dept = F.lit(None).cast("string")
    return ev.select(
        F.col("event_id").cast("string").alias("record_id"),
        F.col("event_type").alias("examiner_name"),
        name.alias("student_name"),
        F.col("user_id").cast("string").alias("roll_number"),
        dept.alias("department"),
        F.concat(F.lit("Project "), F.col("event_id").cast("string")).alias("project_title"),
        F.col("props").alias("result"),
        F.col("ts").alias("saved_at"),
    )


def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model response per conversation: ``Q<turn+1>: <text>`` lines in turn order."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    line = F.concat(F.lit("Q"), (F.col("turn") + 1).cast("string"), F.lit(": "), F.col("text"))
    return (conv.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
            .select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("raw")))


def qa(spark: SparkSession, sf_dir: str, bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """User turns as questions (0-based position among user turns) and the
    assistant reply that directly follows each one (null when missing).

    Turns are salted into buckets of ``bucket_size`` so a conversation of any
    length is spread over many tasks.  An assistant turn is keyed to the
    bucket of the turn before it, so a reply always sits in its question's
    bucket and ``lead`` finds it; positions are made global per conversation
    by :func:`bucketed_rank`.  One shuffle of the rows (on conv_id, bucket), one of the bucket counts.
    """
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    key_turn = F.when(F.col("role") == "assistant", F.col("turn") - 1).otherwise(F.col("turn"))
    keyed = conv.withColumn("_bucket", F.floor(key_turn / bucket_size))
    w = Window.partitionBy("conv_id", "_bucket").orderBy("turn")
    nxt = keyed.select(
        "conv_id", "_bucket", "turn", "role", F.col("text").alias("question"),
        F.lead("role").over(w).alias("_next_role"), F.lead("turn").over(w).alias("_next_turn"),
        F.lead("text").over(w).alias("_next_text"))
    reply = (F.col("_next_role") == "assistant") & (F.col("_next_turn") == F.col("turn") + 1)
    users = nxt.where(F.col("role") == "user").select(
        "conv_id", "_bucket", "turn", "question", F.when(reply, F.col("_next_text")).alias("answer"))
    per_bucket = (keyed.where(F.col("role") == "user").groupBy("conv_id", "_bucket")
                  .agg(F.count(F.lit(1)).alias("_n")))  # counted on the scan, before the window
    return bucketed_rank(users, "conv_id", "turn", "_bucket", "idx", per_bucket).select(
        "conv_id", "idx", "question", "answer")


# Literal malformed responses added to the derived ones (fixed test rows).
BAD_RESPONSES = [
    ("bad-01", "eval", '{"choices":[]}'),
    ("bad-02", "eval", '{"choices":null}'),
    ("bad-03", "model_answer", '{"error":1}'),
    ("bad-04", "model_answer", "{bad"),
    ("bad-05", "eval", "[1]"),
    ("bad-06", "eval", "5"),
    ("bad-07", "model_answer", '"s"'),
    ("bad-08", "eval", '{"choices":[{"message":{"content":null}}]}'),
    ("bad-09", "eval", None),
    ("bad-10", "eval", '["choices"]'),
    ("bad-11", "model_answer", '"no choices here"'),
    ("bad-12", "eval", '{"choices":[{"message":{"content":7}}]}'),
    ("bad-13", "model_answer", "null"),
    ("bad-14", "eval", '{"choices":"choices"}'),
]


def question_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-generation replies of sessions: a text's numbered sentences as completions, with each document's section,
    and the broken replies.  Documents of few sentences have too few questions."""
    docs = settings(spark, sf_dir).select("doc_id", "section", "text")
    part = F.transform(F.split("text", r"\. |\.\n"), lambda x, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), x))
    content = F.array_join(part, "\n")
    derived = docs.select(F.concat(F.lit("q:"), F.col("doc_id").cast("string")).alias("prompt_id"),
                          F.when(F.col("doc_id") % 8 != 7, F.col("section")).alias("section"), _chat_json(content).alias("raw"))
    bad = literal_frame(spark, [(i, "Logical", r) for i, _, r in BAD_RESPONSES], "prompt_id string, section string, raw string")
    return derived.unionByName(bad)


def _chat_json(content_col):
    return F.to_json(F.struct(F.array(F.struct(F.struct(content_col.alias("content")).alias("message"))).alias("choices")))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat-completion responses: replies wrap the assistant answers (kind
    ``eval``) and the questions (kind ``model_answer``), plus bad literals."""
    pid = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("idx").cast("string"))
    # One pass over qa: each row yields its eval and its model-answer response.
    both = qa(spark, sf_dir).select(pid.alias("pid"), F.explode(F.array(
        F.struct(F.lit("eval").alias("kind"), F.col("answer").alias("content")),
        F.struct(F.lit("model_answer").alias("kind"), F.col("question").alias("content")))).alias("r"))
    derived = both.select(F.concat(F.col("r.kind"), F.lit(":"), F.col("pid")).alias("prompt_id"),
                          F.col("r.kind").alias("kind"), _chat_json(F.col("r.content")).alias("raw"))
    bad = literal_frame(spark, BAD_RESPONSES, "prompt_id string, kind string, raw string")
    return derived.unionByName(bad)


BAD_TRANSCRIPTIONS = [
    ("bad-01", '{"text":"   "}'),
    ("bad-02", '{"error":{"message":"rate limited"}}'),
    ("bad-03", "{bad"),
    ("bad-04", None),
    ("bad-05", '{"text":null}'),
    ("bad-06", '{"text":5}'),
    ("bad-07", '["text"]'),
    ("bad-08", "[1,2]"),
    ("bad-09", '"plain words"'),
    ("bad-10", '"some text"'),
    ("bad-11", "42"),
    ("bad-12", '{"text":"\\u00a0hello\\u3000"}'),
]


def transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech-to-text responses: user turns wrapped as ``{"text": ...}``."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    derived = conv.where(F.col("role") == "user").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"),
        F.to_json(F.struct(F.col("text").alias("text"))).alias("raw"))
    bad = literal_frame(spark, BAD_TRANSCRIPTIONS, "item_id string, raw string")
    return derived.unionByName(bad)


SLOTS = 8


def week_session(user="user_id", ts="ts"):
    """Session of an answer: user, year, month and week of the month."""
    week = F.floor((F.dayofmonth(ts) - 1) / 7)
    return F.concat(F.col(user).cast("string"), F.lit("-"), F.date_format(ts, "yyyy-MM"), F.lit("-"), week.cast("string"))


def answers_of(ev: DataFrame) -> DataFrame:
    """Events (a table or a stream) as answer submissions: slot = event_id % 8, 'view' events submit a
    blank answer.  session_start is the first day of the session's week, as an instant."""
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    start_day = F.unix_date(F.trunc(F.to_date("ts"), "month")) + week * 7
    return ev.select(
        week_session().alias("session_id"), (F.col("event_id") % SLOTS).alias("idx"),
        F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("props")).alias("answer"),
        "ts", "event_id", "event_type", F.timestamp_seconds(start_day * 86400).alias("session_start"))


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers_of(_events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "props")).drop("session_start")


def exam_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Typed and spoken submissions of the exam on a conversation's questions: the user's key is the
    conversation's, slot = event_id % 6, 'view' is blank, 'error' and 'click' are spoken ('error': failed)."""
    ev = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "props").select(
        F.col("user_id").alias("conv_id"), (F.col("event_id") % K.QUESTIONS_PER_SESSION).alias("idx"), "ts", "event_id", "event_type",
        F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("props")).alias("answer"))
    spoken = F.col("event_type").isin("error", "click")
    raw = (F.when(F.col("event_type") == "error", F.concat(F.lit('{"error": '), F.col("answer"), F.lit("}")))
           .otherwise(F.to_json(F.struct(F.col("answer").alias("text")))))
    return ev.where(~spoken), ev.where(spoken).withColumn("raw", raw)


QUESTION_COUNTS = [0, 3, 6, 8]


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its mode and number of questions: those with submissions, and one per customer
    without any.  Both modes and all counts occur, sessions without questions included."""
    ev = _events(spark, sf_dir, "ts", "user_id").select(F.col("user_id").alias("u"), week_session().alias("session_id")).distinct()
    cu = read_table(spark, sf_dir, "customer", "c_custkey").select(
        F.col("c_custkey").alias("u"), F.concat(F.col("c_custkey").cast("string"), F.lit("-none")).alias("session_id"))
    modes, counts = (F.array(*[F.lit(v) for v in values]) for values in (K.MODES, QUESTION_COUNTS))
    return ev.unionByName(cu).select(
        "session_id", F.element_at(modes, (F.col("u") % 2 + 1).cast("int")).alias("mode"),
        F.element_at(counts, (F.floor(F.col("u") / 2) % len(QUESTION_COUNTS) + 1).cast("int")).alias("n_questions"))


def session_proctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations within the answer sessions (the 'error' events)."""
    ev = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    return ev.where(F.col("event_type") == "error").select(
        week_session().alias("session_id"), F.col("event_type").alias("kind"), "ts", "event_id")


def voice_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice submissions: each answer as a transcription response; 'error'
    events carry an error object instead of text."""
    al = answer_log(spark, sf_dir)
    raw = (F.when(F.col("event_type") == "error",
                  F.concat(F.lit('{"error": '), F.col("answer"), F.lit("}")))
           .otherwise(F.to_json(F.struct(F.col("answer").alias("text")))))
    return al.select("session_id", "idx", raw.alias("raw"), "ts", "event_id")


def proctor_of(ev: DataFrame) -> DataFrame:
    """Events (a table or a stream) as proctoring violations: error/click, session = (user, day)."""
    return ev.where(F.col("event_type").isin("error", "click")).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.to_date("ts").cast("string")).alias("session_id"),
        F.col("event_type").alias("kind"), "ts", "event_id")


def proctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proctor_of(_events(spark, sf_dir, "event_id", "ts", "user_id", "event_type"))


UNKNOWN_SECTION = "Viva Lite"
UNKNOWN_DIFFICULTY = "Impossible"
UNKNOWN_STYLE = "Calm Mentor"


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document exam settings, cycling through every allowed value plus
    one unknown value for each setting."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    sections = K.PRACTICE_SECTIONS + K.EXAM_SECTIONS + [UNKNOWN_SECTION]
    diffs = K.DIFFICULTIES + [UNKNOWN_DIFFICULTY]
    styles = K.PRACTICE_STYLES + K.EXAM_STYLES + [UNKNOWN_STYLE]

    def pick(values):
        arr = F.array(*[F.lit(v) for v in values])
        return F.element_at(arr, (F.col("doc_id") % len(values) + 1).cast("int"))

    mode = F.when(F.col("doc_id") % 7 != 3, pick(K.MODES))  # some rows have no mode
    return docs.select("doc_id", mode.alias("mode"), pick(sections).alias("section"),
                       pick(diffs).alias("difficulty"), pick(styles).alias("style"), "text")


def upload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded file bytes: the document text in UTF-8, as it is or with an invalid byte at the start, in the middle or at
    the end, or with a character cut short."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    text, kind = F.encode("text", "UTF-8"), F.col("doc_id") % 5
    bad = F.lit(bytearray(b"\xff"))
    half = F.floor(F.length("text") / 2).cast("int")
    middle = F.concat(F.encode(F.substr("text", F.lit(1), half), "UTF-8"), bad, F.encode(F.substr("text", half + 1), "UTF-8"))
    cut_short = F.lit(bytearray(b"\xe2\x82"))  # the first two bytes of a three-byte character
    return docs.select("doc_id", F.when(kind == 0, text).when(kind == 1, F.concat(bad, text)).when(kind == 2, middle)
                       .when(kind == 3, F.concat(text, cut_short)).otherwise(F.concat(text, bad)).alias("content"))


def sessions_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student attributes for a conversation (session): customer with the same key."""
    cu = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    return cu.select(F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("student_name"),
                     F.col("c_custkey").cast("string").alias("roll_number"),
                     F.col("c_mktsegment").alias("department"),
                     F.concat(F.lit("Project "), F.col("c_custkey").cast("string")).alias("project_title"))
