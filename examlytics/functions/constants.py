"""Constants shared by the operators.

FIXED VALUES — these must equal the exam application's own values for the
results to agree (option lists, limits, thresholds, output formats).  They
are stated here once, in their natural order.
"""

# ---- FIXED VALUES (selectors, limits and formats of the exam application) ----
QUESTIONS_PER_SESSION = 6
QUESTION_TEXT_BUDGET = 12000          # characters of project text in the question prompt
MODEL_ANSWER_TEXT_BUDGET = 10000      # characters of project text in the model-answer prompt
PASS_MARK = 50                        # marks >= 50 of 100 -> PASS
VIOLATION_LIMIT = 3                   # the session ends at the third violation
MARKS_SUFFIX = "/100"                 # marks label format "N/100"

MODE_PRACTICE = "Student Practice"
MODE_EXAM = "University Final Exam"
MODES = [MODE_PRACTICE, MODE_EXAM]

PRACTICE_SECTIONS = ["Basic", "Technical", "Logical"]
EXAM_SECTIONS = ["Overall", "Technical Depth", "Presentation", "Defense"]
DIFFICULTIES = ["Easy", "Medium", "Difficult", "Expert"]
PRACTICE_STYLES = ["Friendly 🙂", "Strict 😐", "Interview 💼", "Rapid Fire ⚡", "Defense Panel 🔥"]
EXAM_STYLES = ["Formal Board", "HOD Panel", "External Examiner", "AI Strict Judge"]

DEFAULT_SECTION = "Technical"
DEFAULT_DIFFICULTY = "Medium"
DEFAULT_STYLE = "Strict 😐"
EXAM_DIFFICULTY = "Medium"            # exam mode never changes the difficulty

# Results sheet: column headers, timestamp text format, report file suffix.
SHEET_COLUMNS = ["Examiner Name", "Student Name", "Roll Number", "Department", "Project Title",
                 "Marks", "Status", "Timestamp"]
SHEET_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"
REPORT_NAME_SUFFIX = "_viva_report"

# Output contract requested from the grading call.
MARKS_CONTRACT = "Marks: X/10"

# Characters Python's str.strip() removes (str.isspace), by code point.
PY_WHITESPACE_CODEPOINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
# ---- end of fixed values ----

PY_WHITESPACE = "".join(chr(c) for c in PY_WHITESPACE_CODEPOINTS)

# Our own wording (the application's texts are not reused).
TEXT_EVAL_FAILED = "Evaluation unavailable."
TEXT_MODEL_ANSWER_FAILED = "Model answer unavailable."
TEXT_NO_SPEECH = "[no speech detected]"
TEXT_TRANSCRIPTION_FAILED = "Transcription failed: unreadable response"
REPORT_TITLE = "Oral Examination Report"
