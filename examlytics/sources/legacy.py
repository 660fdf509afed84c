"""Import/export of the results sheet in the exam application's own column
layout, as CSV (the spreadsheet interchange format).

Import reads every column as text (no inference: roll "007" stays "007",
department "NA" stays a value), re-parses marks from the ``N/100`` label
(null when it has no digits) and the timestamp text.  Export writes the
same eight columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SHEET_COLUMNS as LEGACY_COLUMNS
from ..functions.constants import SHEET_TIMESTAMP as LEGACY_TIMESTAMP
from ..functions.text import reparse_marks
from ..schemas import RESULT_COLUMNS
from .results_store import conform

_TO_OURS = dict(zip(LEGACY_COLUMNS, ["examiner_name", "student_name", "roll_number", "department",
                                     "project_title", "marks_label", "status", "saved_at_text"]))


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Legacy sheet rows -> results records (``result`` text is not in the
    sheet and stays null).

    Columns are taken by their header names, whatever their order; a missing
    column is an error.  Quoted line breaks stay in their field and empty text stays empty (only an absent
    field is null).  ``record_id`` is a digest of the row's eight values, so equal rows share it.
    """
    raw = (spark.read.option("header", True).option("multiLine", True).option("nullValue", "\x00").option("emptyValue", "")
           .option("inferSchema", False).csv(path)
           .select(*[F.col(f"`{c}`").cast("string").alias(o) for c, o in _TO_OURS.items()]))
    rec = raw.select(
        F.sha2(F.to_json(F.struct(*_TO_OURS.values())), 256).alias("record_id"),
        "examiner_name", "student_name", "roll_number", "department", "project_title",
        F.lit(None).cast("string").alias("result"),
        reparse_marks("marks_label").alias("marks"), "marks_label", "status",
        F.try_to_timestamp(F.col("saved_at_text"), F.lit(LEGACY_TIMESTAMP)).cast("timestamp_ntz").alias("saved_at"))
    return conform(rec).select(*RESULT_COLUMNS)


def write_legacy_csv(results: DataFrame, path: str) -> None:
    """Results -> the eight sheet columns, one CSV dataset (header per file)."""
    ours = {o: c for c, o in _TO_OURS.items()}
    cols = [F.col(o).alias(ours[o]) for o in ["examiner_name", "student_name", "roll_number", "department",
                                              "project_title", "marks_label", "status"]]
    out = results.select(*cols, F.date_format("saved_at", LEGACY_TIMESTAMP).alias(ours["saved_at_text"]))
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
