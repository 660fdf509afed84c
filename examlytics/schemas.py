"""Declared schemas.  Nothing is inferred on read (the reference infers on
every spreadsheet read, which turns roll "007" into 7 and "NA" into a
missing value; we keep text as text)."""

from pyspark.sql import types as T

RESULTS = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("examiner_name", T.StringType()),
    T.StructField("student_name", T.StringType()),
    T.StructField("roll_number", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("project_title", T.StringType()),
    T.StructField("result", T.StringType()),
    T.StructField("marks", T.LongType()),
    T.StructField("marks_label", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("saved_at", T.TimestampNTZType()),
])

#: Saved evaluations before marks are extracted, and proctoring violations (stream inputs).
EVALUATIONS = T.StructType([f for f in RESULTS.fields if f.name not in ("marks", "marks_label", "status")])
VIOLATIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
])

RESULT_COLUMNS = [f.name for f in RESULTS.fields]

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

ANSWERS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("answer", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
])

RESPONSES = T.StructType([
    T.StructField("prompt_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("raw", T.StringType()),
])
