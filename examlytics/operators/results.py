"""Result records: mark extraction, label, status and the record itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_int, mark_digits, mark_label as _label, pass_status as _status, reparse_marks
from ..schemas import RESULT_COLUMNS


def mark_extract(df: DataFrame, text_col: str = "result", out: str = "marks") -> DataFrame:
    """First run of decimal digits in the evaluation text -> bigint mark; none -> 0.

    Traps kept on purpose: '1. Score: 85/100' -> 1, '85.5' -> 85, '-5' -> 5,
    no upper cap.  Only this numeric column is null beyond bigint; label and
    status come from the digits and have no limit.
    """
    return df.withColumn(out, first_int(text_col))


def mark_label(df: DataFrame, text_col: str = "result", out: str = "marks_label") -> DataFrame:
    """``"N/100"`` for the mark of the evaluation text."""
    return df.withColumn(out, _label(mark_digits(text_col)))


def pass_status(df: DataFrame, text_col: str = "result", out: str = "status") -> DataFrame:
    """PASS when the text's mark is 50 or more, FAIL below, null for a null text."""
    return df.withColumn(out, _status(mark_digits(text_col)))


def stamp_saved_at(df: DataFrame) -> DataFrame:
    """Save time for records saved now: the session-time-zone wall clock,
    to the second, as ``timestamp_ntz`` (the app stores local wall-clock
    text).  Batch rebuilds keep the event time carried by the data."""
    return df.withColumn("saved_at", F.date_trunc("second", F.localtimestamp()))


def saved_at_text(col="saved_at"):
    """Display form ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM-dd HH:mm:ss")


def result_build(raw: DataFrame) -> DataFrame:
    """Assemble the stored record: raw attributes + marks, label and status.

    ``raw`` needs record_id, examiner_name, student_name, roll_number,
    department, project_title and result; ``saved_at`` is stamped with the
    wall clock when absent.  One projection, no shuffle.
    """
    if "saved_at" not in raw.columns:
        raw = stamp_saved_at(raw)
    d = F.col("_digits")
    return raw.withColumn("_digits", mark_digits("result")).select(
        "record_id", "examiner_name", "student_name", "roll_number", "department",
        "project_title", "result", d.try_cast("bigint").alias("marks"), _label(d).alias("marks_label"),
        _status(d).alias("status"), "saved_at",
    ).select(*RESULT_COLUMNS)


def marks_reparse(df: DataFrame, label_col: str = "marks_label", out: str = "marks") -> DataFrame:
    """Numeric mark from a marks label: first digit run, null when there is none
    (unlike :func:`mark_extract`, which gives 0).  For imported legacy rows."""
    return df.withColumn(out, reparse_marks(label_col))
