"""Model-response parsing on DataFrames (completion text, question lists,
transcriptions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.json import (completion_content, completion_state as _state, document_kind, parsed, transcription_failed,
                              transcription_text)
from ..functions.questions import (chosen_questions, fallback_questions, limit_questions, parse_questions,
                                   parsed_count, with_fallback)
from ..functions.text import ustrip
from .ordering import DEFAULT_BUCKET, bucketed_rank

FALLBACK_BY_KIND = {"eval": K.TEXT_EVAL_FAILED, "model_answer": K.TEXT_MODEL_ANSWER_FAILED,
                    "final": K.TEXT_EVAL_FAILED}


def completion_extract(responses: DataFrame, raw_col: str = "raw", kind_col: str = "kind") -> DataFrame:
    """Content of ``choices[0].message.content``; on any failure (missing row,
    bad JSON, wrong shape, null content) the fallback text of the call kind."""
    fallback = F.element_at(F.create_map(*[F.lit(x) for kv in FALLBACK_BY_KIND.items() for x in kv]),
                            F.col(kind_col))
    content = completion_content(raw_col)
    return responses.select(
        "prompt_id", kind_col,
        F.coalesce(content, fallback, F.lit(K.TEXT_EVAL_FAILED)).alias("content"),
        content.isNull().alias("failed"))


def completion_state(responses: DataFrame, raw_col: str = "raw") -> DataFrame:
    """ok / no_choices / failed for a question-generation response."""
    return _parsed_once(responses, "prompt_id", raw_col).select("prompt_id", _state(raw_col, v="_v", kind="_kind").alias("state"))


def _parsed_once(responses: DataFrame, key: str, raw_col: str, *extra) -> DataFrame:
    """The parsed document (_v) and its kind (_kind) as columns of their own, so that neither is computed again where it is used."""
    staged = responses.select(key, raw_col, *extra, parsed(raw_col).alias("_v"))
    return staged.select("*", document_kind(raw_col, "_v").alias("_kind"))


def _exploded(df: DataFrame, key: str, arr: str, extra=(), explode=F.posexplode) -> DataFrame:
    return df.select(key, *extra, explode(arr).alias("idx", "question")).select(
        key, F.col("idx").cast("bigint").alias("idx"), "question", *extra)


def question_parse(raw_questions: DataFrame, key: str = "conv_id", raw_col: str = "raw") -> DataFrame:
    """Every ``Q..: text`` line of each response, one row per question."""
    return _exploded(raw_questions.select(key, parse_questions(raw_col).alias("qs")), key, "qs")


def question_fallback(raw_questions: DataFrame, key: str = "conv_id", raw_col: str = "raw",
                      section=None) -> DataFrame:
    """Parsed list, or the six fallback questions when fewer than six parsed."""
    section = F.lit(K.DEFAULT_SECTION) if section is None else section
    p = raw_questions.select(key, parse_questions(raw_col).alias("p"), section.alias("section"))
    q = p.select(key, with_fallback("p", "section").alias("qs"),
                 (parsed_count("p") < K.QUESTIONS_PER_SESSION).alias("used_fallback"))
    return _exploded(q, key, "qs", extra=("used_fallback",))


def question_limit(raw_questions: DataFrame, key: str = "conv_id", raw_col: str = "raw",
                   section=None) -> DataFrame:
    """The final question list: exactly six per response, in order."""
    section = F.lit(K.DEFAULT_SECTION) if section is None else section
    p = raw_questions.select(key, parse_questions(raw_col).alias("p"), section.alias("section"))
    return _exploded(p.select(key, limit_questions(with_fallback("p", "section")).alias("qs")), key, "qs")


def questions_from_responses(responses: DataFrame, key: str = "prompt_id", raw_col: str = "raw",
                             section_col: str | None = None) -> DataFrame:
    """Chat-completion responses (JSON) to exactly six questions each, in one projection: the content, the state of the
    reply, the parsed list, and the fallback that the state calls for, opening with the session's section
    (``section_col``; null or absent: the default section)."""
    section = F.lit(K.DEFAULT_SECTION) if section_col is None else F.coalesce(F.col(section_col), F.lit(K.DEFAULT_SECTION))
    staged = _parsed_once(responses, key, raw_col, section.alias("_section"))
    read = staged.select(key, "_section", _state(raw_col, v="_v", kind="_kind").alias("_state"),
                         parse_questions(completion_content(raw_col, v="_v")).alias("_parsed"))
    ok = F.when(F.col("_state") == "ok", F.col("_parsed"))
    # the list is never empty; posexplode would infer a filter on its size, with the whole chain in it
    return _exploded(read.select(key, chosen_questions("_state", ok, "_section").alias("qs")), key, "qs", explode=F.posexplode_outer)


def transcription_normalize(transcriptions: DataFrame, key: str = "item_id",
                            raw_col: str = "raw") -> DataFrame:
    staged = transcriptions.select(key, raw_col, parsed(raw_col).alias("_v"))
    return staged.select(key, transcription_text(raw_col, v="_v").alias("transcript"),
                         transcription_failed(raw_col, v="_v").alias("failed"))


# ---------------------------------------------------------------------------
# Line-table form: the same parse when a response is stored as many rows of
# text (one row per part, e.g. per conversation turn) rather than one string.
# Nothing is collected per response: every line is parsed on its own, kept
# lines are ranked per response with a bucketed rank (skew-safe), and the
# fallback decision comes from a partial count per response.
# ---------------------------------------------------------------------------

def response_lines(parts: DataFrame, key: str, part_col: str, text_col: str,
                   first_line_prefix=None) -> DataFrame:
    """(key, part, ln, line): the lines of each part, in order (a null part keeps a null line, so every key
    stays).  Splitting the
    concatenation of the parts on '\\n' gives exactly these lines in
    (part, ln) order; ``first_line_prefix`` is prepended to each part's first
    line (as when parts are joined after a per-part label)."""
    exploded = parts.select(key, part_col, F.posexplode_outer(F.split(text_col, "\n")).alias("ln", "line"))
    if first_line_prefix is not None:
        exploded = exploded.withColumn(
            "line", F.when(F.col("ln") == 0, F.concat(first_line_prefix, F.col("line"))).otherwise(F.col("line")))
    return exploded


def question_lines(lines: DataFrame, key: str, part_col: str) -> DataFrame:
    """Every ``Q..: text`` line of the lines table, in no order: one projection."""
    s = ustrip(F.col("line"))
    kept = lines.select(key, part_col, "ln", s.alias("s")).where(s.startswith("Q") & s.contains(":"))
    q = kept.select(key, part_col, "ln", ustrip(F.substr("s", F.instr("s", ":") + 1)).alias("question"))
    return q.where(F.col("question") != "")


def question_lines_parse(lines: DataFrame, key: str, part_col: str,
                         bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """Every ``Q..: text`` line, one row per question with its 0-based
    position in (part, ln) order within the response."""
    q = question_lines(lines, key, part_col).withColumn("_bucket", F.floor(F.col(part_col) / bucket_size))
    ordered = q.withColumn("_ord", F.struct(part_col, "ln"))
    return bucketed_rank(ordered, key, "_ord", "_bucket", "idx").select(key, "idx", "question")


def question_lines_limit(lines: DataFrame, key: str, part_col: str, section=None) -> DataFrame:
    """The final six questions of each response: its first six lines, or the fallback where there are fewer.

    Two scans: the first six lines per response (``row_number() <= 6``, a partial group limit before the
    shuffle: a hot response sends six rows per map partition), and the response keys."""
    section = F.lit(K.DEFAULT_SECTION) if section is None else section
    first = F.row_number().over(Window.partitionBy(key).orderBy(part_col, "ln"))
    top = (question_lines(lines, key, part_col).withColumn("_rn", first).where(F.col("_rn") <= K.QUESTIONS_PER_SESSION)
           .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rn", "question"))).alias("_top")))  # six at most
    listed = F.when(F.size("_top") >= K.QUESTIONS_PER_SESSION, F.transform("_top", lambda x: x["question"]))
    per = lines.select(key).distinct().join(top, key, "left")
    return _exploded(per.select(key, F.coalesce(listed, fallback_questions(section)).alias("qs")), key, "qs")


def question_lines_final(parsed: DataFrame, responses: DataFrame, key: str, section=None) -> DataFrame:
    """Every parsed question, or the six fallback questions where fewer than six parsed (no limit).
    ``responses`` lists every response key, so a response with no parsed line still gets its fallback."""
    section = F.lit(K.DEFAULT_SECTION) if section is None else section
    counts = parsed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    per = responses.select(key).distinct().join(counts, key, "left").select(
        key, (F.coalesce("_n", F.lit(0)) < K.QUESTIONS_PER_SESSION).alias("used_fallback"))
    kept = parsed.join(per.where(~F.col("used_fallback")), key)
    fb = per.where(F.col("used_fallback")).select(
        key, "used_fallback", F.posexplode(fallback_questions(section)).alias("idx", "question"))
    return kept.select(key, "idx", "question", "used_fallback").unionByName(
        fb.select(key, F.col("idx").cast("bigint").alias("idx"), "question", "used_fallback"))


def completion_for_prompts(prompts: DataFrame, responses: DataFrame, key: str = "prompt_id",
                           kind: str = "eval") -> DataFrame:
    """Content for every prompt: a prompt with no response row (the call
    failed before any reply) gets the same fallback as an unreadable one."""
    r = responses.select(key, F.col("raw"))
    joined = prompts.select(key).join(r, key, "left").withColumn("kind", F.lit(kind))
    return completion_extract(joined.withColumnRenamed(key, "prompt_id")).withColumnRenamed("prompt_id", key)
