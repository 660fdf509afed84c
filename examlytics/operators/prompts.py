"""Prompt-dataset builders: settings, instruction lookups and the four
prompt kinds.  The model call itself happens outside Spark; these produce
the prompt tables it consumes.  All wording here is our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import truncate_chars

SECTION_TEXT = {
    "Basic": "- Stay with purpose, users and outcome; a first-year student should follow every question.",
    "Technical": "- Pick concrete files, calls or tables from the text and ask what they do and why they are needed.",
    "Logical": "- Give a situation and ask what the program does then; ask for the reasoning behind each answer.",
    "Overall": "- One question each on goal, parts, data, a difficult moment, testing and result.",
    "Technical Depth": "- Choose two modules and keep asking below the surface: inputs, state, failures, cost.",
    "Presentation": "- Ask for short spoken summaries to different listeners, and for the story behind a choice.",
    "Defense": "- State an objection in every question and let the student answer it.",
}
SECTION_DEFAULT_TEXT = "- Spread the questions evenly over the project text."

DIFFICULTY_TEXT = {
    "Easy": "- Each answer can be found in one sentence of the text.",
    "Medium": "- Each answer needs two places of the text to be brought together.",
    "Difficult": "- Each answer needs a consequence that the text does not spell out.",
    "Expert": "- Each answer needs numbers, limits or counter-examples that the student must work out.",
}

# Ordered: the first pattern contained in the style wins.
STYLE_TEXT = [
    ("Friendly", "- Open each question with what the student did well."),
    ("Strict", "- One sentence a question, no courtesies, no hints."),
    ("Interview", "- Ask as a future employer would who has read the text."),
    ("Rapid Fire", "- At most ten words a question."),
    ("Defense Panel", "- Let several panel members speak in turn."),
    ("External Examiner", "- Ask as a visitor who does not know the course."),
    ("AI Strict Judge", "- Name the criterion that each question tests."),
]


def _map_lookup(mapping: dict, key: Column) -> Column:
    """Exact-match lookup in a literal map: no join, no shuffle, codegen'd."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.element_at(m, key)


def section_text(section) -> Column:
    return F.coalesce(_map_lookup(SECTION_TEXT, F.col(section) if isinstance(section, str) else section),
                      F.lit(SECTION_DEFAULT_TEXT))


def difficulty_text(difficulty) -> Column:
    c = F.col(difficulty) if isinstance(difficulty, str) else difficulty
    return F.coalesce(_map_lookup(DIFFICULTY_TEXT, c), F.lit(""))


def style_text(style) -> Column:
    c = F.col(style) if isinstance(style, str) else style
    expr = None
    for pattern, text in STYLE_TEXT:
        cond = c.contains(pattern)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return F.coalesce(expr, F.lit(""))


def settings_resolve(settings: DataFrame, *keep: str) -> DataFrame:
    """Effective settings per row and whether they are an allowed combination.

    Missing values take the defaults (mode: practice); exam mode always runs at Medium.
    Allowed values are literal sets (``isin``), so no join is needed.
    """
    mode = F.coalesce(F.col("mode"), F.lit(K.MODE_PRACTICE))
    exam = mode == K.MODE_EXAM
    section = F.coalesce(F.col("section"), F.lit(K.DEFAULT_SECTION))
    difficulty = F.when(exam, F.lit(K.EXAM_DIFFICULTY)).otherwise(
        F.coalesce(F.col("difficulty"), F.lit(K.DEFAULT_DIFFICULTY)))
    style = F.coalesce(F.col("style"), F.lit(K.DEFAULT_STYLE))
    valid = (F.when(exam, section.isin(*K.EXAM_SECTIONS) & style.isin(*K.EXAM_STYLES))
             .when(mode == K.MODE_PRACTICE,
                   section.isin(*K.PRACTICE_SECTIONS) & style.isin(*K.PRACTICE_STYLES)
                   & difficulty.isin(*K.DIFFICULTIES))
             .otherwise(F.lit(False)))
    return settings.select("doc_id", mode.alias("mode"), section.alias("section"), difficulty.alias("difficulty"),
                           style.alias("style"), valid.alias("valid"), *keep)


def section_template(resolved: DataFrame) -> DataFrame:
    return resolved.select("doc_id", "section", section_text("section").alias("section_text"))


def difficulty_template(resolved: DataFrame) -> DataFrame:
    return resolved.select("doc_id", "difficulty", difficulty_text("difficulty").alias("difficulty_text"))


def style_template(resolved: DataFrame) -> DataFrame:
    return resolved.select("doc_id", "style", style_text("style").alias("style_text"))


def text_truncate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Project text as it enters the two prompts (12,000 / 10,000 characters)."""
    return docs.select("doc_id",
                       truncate_chars(text_col, K.QUESTION_TEXT_BUDGET).alias("question_text"),
                       truncate_chars(text_col, K.MODEL_ANSWER_TEXT_BUDGET).alias("answer_text"))


NL = "\n"


def prompt_questions(settings: DataFrame) -> DataFrame:
    """Question-generation prompt per document: settings with their
    instructions, the rules, the truncated project text and the six-line
    ``Q1:`` .. ``Q6:`` output contract."""
    r = settings_resolve(settings, "text")
    contract = NL.join(f"Q{i}: ..." for i in range(1, K.QUESTIONS_PER_SESSION + 1))
    prompt = F.concat_ws(
        NL,
        F.lit(f"Write exactly {K.QUESTIONS_PER_SESSION} oral-exam questions about the project below."),
        F.concat(F.lit("Mode: "), F.col("mode")),
        F.concat(F.lit("Section: "), F.col("section")), section_text("section"),
        F.concat(F.lit("Difficulty: "), F.col("difficulty")), difficulty_text("difficulty"),
        F.concat(F.lit("Examiner style: "), F.col("style")), style_text("style"),
        F.lit("Rules: questions come only from the project, each covers a different aspect, "
              "from easiest (Q1) to hardest (Q6)."),
        F.lit("Project:"), F.coalesce(truncate_chars("text", K.QUESTION_TEXT_BUDGET), F.lit("")),
        F.lit("Answer format:"), F.lit(contract))
    return r.select("doc_id", prompt.alias("prompt"))


def prompt_eval(qa: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per answered question: grade request with the ``Marks: X/10`` contract."""
    prompt = F.concat_ws(
        NL, F.concat(F.lit("Question: "), F.coalesce("question", F.lit(""))),
        F.lit("Student answer:"), F.coalesce("answer", F.lit("")),
        F.lit("Grade the answer. Reply with one line only:"), F.lit(K.MARKS_CONTRACT))
    return qa.select(key, "idx", prompt.alias("prompt"))


def prompt_model_answer(qa: DataFrame, docs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per question: request for a short ideal answer from the project text.

    The text is cut to 10,000 characters before the join so the shuffle moves
    at most that much per document.
    """
    d = docs.select(F.col("doc_id").alias(key),
                    truncate_chars("text", K.MODEL_ANSWER_TEXT_BUDGET).alias("project_text"))
    prompt = F.concat_ws(
        NL, F.lit("Using only the project text below, give a short ideal answer (3-5 lines)."),
        F.lit("Project:"), F.coalesce("project_text", F.lit("")),
        F.lit("Question:"), F.coalesce("question", F.lit("")), F.lit("Ideal answer:"))
    return qa.join(d, key, "left").select(key, "idx", prompt.alias("prompt"))


def prompt_final(transcripts: DataFrame, students: DataFrame, key: str = "conv_id") -> DataFrame:
    """Final evaluation request per session: student attributes + transcript."""
    prompt = F.concat_ws(
        NL, F.lit("Evaluate this oral examination as an external examiner."),
        F.concat(F.lit("Name: "), F.coalesce("student_name", F.lit(""))),
        F.concat(F.lit("Roll: "), F.coalesce("roll_number", F.lit(""))),
        F.concat(F.lit("Department: "), F.coalesce("department", F.lit(""))),
        F.concat(F.lit("Project: "), F.coalesce("project_title", F.lit(""))),
        F.lit("Transcript:"), F.coalesce("transcript", F.lit("")),
        F.lit("Give: overall score out of 100, technical skills, communication, strengths, "
              "weaknesses, final verdict."))
    return transcripts.join(students, key, "left").select(key, prompt.alias("prompt"))
