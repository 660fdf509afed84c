"""Independent DuckDB SQL for every registered query (the correctness gate).

Written against the raw driver tables (pre-registered views), with the
fixture views as CTEs.  Where Spark uses a bounded trick (bit masks,
partial window limits, range-partitioned positions), the SQL states the
plain definition (anti joins, QUALIFY, a global row_number).
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions import questions as Q
from ..operators import parse as P
from ..operators import prompts as B
from ..sources import ingest as I
from . import catalog as C
from . import fixtures as fx


def q(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


WS = "(" + " || ".join(f"chr({c})" for c in K.PY_WHITESPACE_CODEPOINTS) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _digit_tables() -> tuple[str, str]:
    import unicodedata
    chars = [chr(c) for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) is not None]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


DIGITS = _digit_tables()


def mark_text(x: str) -> str:
    """Digits of the first run, in ASCII, without leading zeros; '0' without digits; null for null."""
    d = f"ltrim(translate(regexp_extract({x}, '(\\p{{Nd}}+)', 1), {q(DIGITS[0])}, {q(DIGITS[1])}), '0')"
    return f"(CASE WHEN {d} = '' THEN '0' ELSE {d} END)"


def first_int(x: str) -> str:
    return f"TRY_CAST({mark_text(x)} AS BIGINT)"


def status(digits: str) -> str:
    return f"CASE WHEN {digits} IS NULL THEN NULL WHEN TRY_CAST({digits} AS DOUBLE) >= 50 THEN 'PASS' ELSE 'FAIL' END"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join("NULL" if v is None else (str(v) if isinstance(v, int) else q(v))
                                      for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(cols)}))"


WEEK_SESSION = "CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m') || '-' || CAST((day(ts) - 1) // 7 AS VARCHAR)"

_J = "TRY_CAST(raw AS JSON)"
STATE = f"""CASE
            WHEN {_J} IS NULL THEN 'failed'
            WHEN json_type({_J}) NOT IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN 'failed'
            WHEN json_type({_J}) = 'OBJECT' AND NOT list_contains(json_keys({_J}), 'choices') THEN 'no_choices'
            WHEN json_type({_J}) = 'ARRAY'
                 AND NOT coalesce(list_contains(json_extract_string({_J}, '$[*]'), 'choices'), false) THEN 'no_choices'
            WHEN json_type({_J}) = 'VARCHAR' AND strpos(json_extract_string({_J}, '$'), 'choices') = 0 THEN 'no_choices'
            WHEN json_type({_J}) = 'OBJECT'
                 AND coalesce(json_type({_J}, '$.choices[0].message.content') = 'VARCHAR', false) THEN 'ok'
            ELSE 'failed' END"""


def question_list(raw: str) -> str:
    return f"""list_filter(list_transform(list_filter(list_transform(
        string_split({raw}, chr(10)), lambda x: {strip('x')}),
        lambda x: starts_with(x, 'Q') AND contains(x, ':')),
        lambda x: {strip("substr(x, strpos(x, ':') + 1)")}), lambda x: x <> '')"""


VIEWS = {
    "results_raw": """SELECT CAST(e.event_id AS VARCHAR) AS record_id, e.event_type AS examiner_name,
        c.c_name AS student_name, CAST(e.user_id AS VARCHAR) AS roll_number, c.c_mktsegment AS department,
        'Project ' || CAST(e.event_id AS VARCHAR) AS project_title, e.props AS result, e.ts AS saved_at
        FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
    "results": f"""SELECT record_id, examiner_name, student_name, roll_number, department, project_title, result,
        TRY_CAST(digits AS BIGINT) AS marks, digits || '/100' AS marks_label, {status('digits')} AS status, saved_at
        FROM (SELECT *, {mark_text('result')} AS digits FROM results_raw)""",
    "doc_marks": f"""SELECT doc_id, digits, TRY_CAST(digits AS BIGINT) AS marks FROM (
        SELECT doc_id, {mark_text('text')} AS digits FROM (SELECT doc_id, text FROM documents
          UNION ALL SELECT * FROM {values(C.LITERAL_RESULTS, ['doc_id', 'text'])}))""",
    "raw_questions": """SELECT conv_id, string_agg('Q' || CAST(turn + 1 AS VARCHAR) || ': ' || text, chr(10)
        ORDER BY turn) AS raw FROM conversations GROUP BY conv_id""",
    "parsed": f"SELECT conv_id, {question_list('raw')} AS qs FROM raw_questions",
    "question_responses": f"""SELECT 'q:' || CAST(doc_id AS VARCHAR) AS prompt_id, CASE WHEN doc_id % 8 <> 7 THEN section END AS section,
          CAST(to_json({{'choices': [{{'message': {{'content': array_to_string(list_transform(range(1, 1 + len(p)),
            lambda i: 'Q' || CAST(i AS VARCHAR) || ': ' || p[i]), chr(10))}}}}]}}) AS VARCHAR) AS raw
          FROM (SELECT doc_id, section, string_split_regex(text, '\\. |\\.\\n') AS p FROM settings)
        UNION ALL SELECT prompt_id, 'Logical', raw FROM {values(fx.BAD_RESPONSES, ['prompt_id', 'kind', 'raw'])}""",
    "qa": """SELECT u.conv_id, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) - 1 AS idx,
        u.text AS question, a.text AS answer
        FROM conversations u LEFT JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        WHERE u.role = 'user'""",
    "responses": f"""SELECT 'eval:' || CAST(conv_id AS VARCHAR) || ':' || CAST(idx AS VARCHAR) AS prompt_id,
          'eval' AS kind, CAST(to_json({{'choices': [{{'message': {{'content': answer}}}}]}}) AS VARCHAR) AS raw FROM qa
        UNION ALL
        SELECT 'model_answer:' || CAST(conv_id AS VARCHAR) || ':' || CAST(idx AS VARCHAR), 'model_answer',
          CAST(to_json({{'choices': [{{'message': {{'content': question}}}}]}}) AS VARCHAR) FROM qa
        UNION ALL SELECT * FROM {values(fx.BAD_RESPONSES, ['prompt_id', 'kind', 'raw'])}""",
    "transcriptions": f"""SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS item_id,
          CAST(to_json({{'text': text}}) AS VARCHAR) AS raw FROM conversations WHERE role = 'user'
        UNION ALL SELECT * FROM {values(fx.BAD_TRANSCRIPTIONS, ['item_id', 'raw'])}""",
    "answer_log": f"""SELECT {WEEK_SESSION} AS session_id,
        event_id % {fx.SLOTS} AS idx, CASE WHEN event_type = 'view' THEN '  ' ELSE props END AS answer,
        ts, event_id, event_type FROM events""",
    "voice_log": """SELECT session_id, idx, CASE WHEN event_type = 'error' THEN '{"error": ' || answer || '}'
        ELSE CAST(to_json({'text': answer}) AS VARCHAR) END AS raw, ts, event_id FROM answer_log""",
    "proctor": """SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
        event_type AS kind, ts, event_id FROM events WHERE event_type IN ('error', 'click')""",
    "session_proctor": f"""SELECT {WEEK_SESSION} AS session_id, ts, event_id FROM events
        WHERE event_type = 'error'""",
    "sessions": f"""SELECT session_id, {lst(K.MODES)}[u % 2 + 1] AS mode,
        {fx.QUESTION_COUNTS}[u // 2 % {len(fx.QUESTION_COUNTS)} + 1] AS n_questions FROM (
          SELECT DISTINCT user_id AS u, {WEEK_SESSION} AS session_id FROM events
          UNION ALL SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '-none' FROM customer)""",
    "settings": f"""SELECT doc_id,
        CASE WHEN doc_id % 7 <> 3 THEN {lst(K.MODES)}[doc_id % 2 + 1] END AS mode,
        {lst(K.PRACTICE_SECTIONS + K.EXAM_SECTIONS + [fx.UNKNOWN_SECTION])}[doc_id % 8 + 1] AS section,
        {lst(K.DIFFICULTIES + [fx.UNKNOWN_DIFFICULTY])}[doc_id % 5 + 1] AS difficulty,
        {lst(K.PRACTICE_STYLES + K.EXAM_STYLES + [fx.UNKNOWN_STYLE])}[doc_id % 10 + 1] AS style,
        text FROM documents""",
    "resolved": f"""SELECT doc_id, mode, section, difficulty, style,
        CASE WHEN mode = {q(K.MODE_EXAM)} THEN section IN {tuple(K.EXAM_SECTIONS)} AND style IN {tuple(K.EXAM_STYLES)}
             WHEN mode = {q(K.MODE_PRACTICE)} THEN section IN {tuple(K.PRACTICE_SECTIONS)}
                  AND style IN {tuple(K.PRACTICE_STYLES)} AND difficulty IN {tuple(K.DIFFICULTIES)}
             ELSE false END AS valid, text
        FROM (SELECT doc_id, coalesce(mode, {q(K.MODE_PRACTICE)}) AS mode, coalesce(section, {q(K.DEFAULT_SECTION)}) AS section,
              CASE WHEN settings.mode = {q(K.MODE_EXAM)} THEN {q(K.EXAM_DIFFICULTY)}
                   ELSE coalesce(difficulty, {q(K.DEFAULT_DIFFICULTY)}) END AS difficulty,
              coalesce(style, {q(K.DEFAULT_STYLE)}) AS style, text FROM settings)""",
}
DEPENDS = {
    "results": ["results_raw"], "parsed": ["raw_questions"], "responses": ["qa"],
    "question_responses": ["settings"], "voice_log": ["answer_log"], "resolved": ["settings"],
}


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return f"WITH {ctes}\n{sql}"


def _fallback_list(section_sql: str, rest: list[str]) -> str:
    first = f"{q(Q.SECTION_OPENING[0])} || {section_sql} || {q(Q.SECTION_OPENING[1])}"
    return "[" + first + ", " + ", ".join(q(r) for r in rest) + "]"


def _map_case(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {col} {whens} ELSE {q(default)} END)"


def style_case(col: str) -> str:
    whens = " ".join(f"WHEN contains({col}, {q(p)}) THEN {q(t)}" for p, t in B.STYLE_TEXT)
    return f"(CASE {whens} ELSE '' END)"


def transcription_case(raw: str) -> str:
    F_ = q(K.TEXT_TRANSCRIPTION_FAILED)
    j = f"TRY_CAST({raw} AS JSON)"
    jt = f"json_type({j})"
    txt = strip(f"json_extract_string({j}, '$.text')")
    return f"""(CASE WHEN {j} IS NULL THEN {F_}
        WHEN {jt} NOT IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN {F_}
        WHEN {jt} = 'OBJECT' THEN (CASE WHEN NOT list_contains(json_keys({j}), 'text') THEN CAST({raw} AS VARCHAR)
             WHEN json_type({j}, '$.text') = 'VARCHAR' THEN
               (CASE WHEN {txt} = '' THEN {q(K.TEXT_NO_SPEECH)} ELSE {txt} END)
             ELSE {F_} END)
        WHEN {jt} = 'ARRAY' THEN (CASE WHEN coalesce(list_contains(json_extract_string({j}, '$[*]'), 'text'), false)
             THEN {F_} ELSE CAST({raw} AS VARCHAR) END)
        ELSE (CASE WHEN strpos(json_extract_string({j}, '$'), 'text') > 0 THEN {F_}
             ELSE json_extract_string({j}, '$') END) END)"""


VIEWS["limited"] = f"""SELECT conv_id, unnest(generate_series(0, 5)) AS idx, unnest(
    (CASE WHEN coalesce(len(qs), 0) < 6 THEN {_fallback_list(q(K.DEFAULT_SECTION), Q.SHORT_LIST_QUESTIONS)} ELSE qs END)[1:6]) AS question
    FROM parsed"""
VIEWS["exam_answers"] = f"""SELECT conv_id, idx, ts, event_id, CASE WHEN event_type = 'view' THEN '  '
      WHEN event_type IN ('error', 'click') THEN {transcription_case('raw')} ELSE props END AS answer
    FROM (SELECT user_id AS conv_id, event_id % 6 AS idx, ts, event_id, event_type, props,
            CASE WHEN event_type = 'error' THEN '{{"error": ' || props || '}}'
                 ELSE CAST(to_json({{'text': props}}) AS VARCHAR) END AS raw FROM events)"""
VIEWS["exam"] = f"""SELECT l.conv_id, l.idx, l.question, a.answer FROM limited l LEFT JOIN (
    SELECT conv_id, idx, answer FROM exam_answers WHERE {strip('answer')} <> ''
    QUALIFY row_number() OVER (PARTITION BY conv_id, idx ORDER BY ts DESC, event_id DESC) = 1) a
    ON a.conv_id = l.conv_id AND a.idx = l.idx"""
DEPENDS |= {"limited": ["parsed"], "exam": ["limited", "exam_answers"]}

NL = "chr(10)"
RESULT_COLS = "*"


def _build() -> dict[str, str]:
    o: dict[str, str] = {}
    o["result_build"] = with_views("SELECT * FROM results", "results")
    o["saved_results"] = o["result_build"]
    o["results_append"] = o["result_build"]
    o["results_stream"] = o["result_build"]
    o["pass_records"] = with_views("SELECT * FROM results WHERE status = 'PASS'", "results")
    o["fail_records"] = with_views("SELECT * FROM results WHERE status = 'FAIL'", "results")
    o["record_count"] = with_views("SELECT count(*) AS n_records FROM results", "results")
    o["overview_kpis"] = with_views(
        """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed,
           count(*) FILTER (WHERE status = 'FAIL') AS failed,
           CASE WHEN count(*) = 0 THEN CAST(0 AS DOUBLE) ELSE round_even(avg(marks) * 100, 0) / 100 END AS avg_marks
           FROM results""", "results")
    for key, col in [("status_distribution", "status"), ("department_distribution", "department")]:
        o[key] = with_views(f"""SELECT {col}, count(*) AS n FROM results WHERE {col} IS NOT NULL
            GROUP BY {col} ORDER BY n DESC, min((saved_at, record_id)), {col}""", "results")
    o["marks_series"] = with_views(
        "SELECT row_number() OVER (ORDER BY saved_at, record_id) - 1 AS position, record_id, marks FROM results",
        "results")
    o["student_search"] = with_views(
        f"SELECT * FROM results WHERE regexp_matches(student_name, {q(C.SEARCH_PATTERN)}, 'i')", "results")
    o["roster_lookup"] = with_views(
        f"""SELECT examiner_name, count(*) AS n_records, examiner_name IN {tuple(C.ROSTER)} AS known
            FROM results_raw GROUP BY examiner_name""", "results_raw")
    o["report_text"] = with_views(
        f"""SELECT roll_number, roll_number || '_viva_report' AS report_name,
            concat_ws({NL}, {q(K.REPORT_TITLE)}, 'Student Name: ' || coalesce(student_name, ''),
              'Roll Number: ' || coalesce(roll_number, ''), 'Department: ' || coalesce(department, ''),
              'Project Title: ' || coalesce(project_title, ''), 'Examiner: ' || coalesce(examiner_name, ''),
              '', coalesce(result, '')) AS report
            FROM results
            QUALIFY row_number() OVER (PARTITION BY roll_number ORDER BY saved_at DESC, record_id DESC) = 1""",
        "results")
    o["text_ingest"] = "SELECT doc_id, text FROM documents"
    text_cond = " OR ".join(f"suffix(lower(name), {q(s)})" for s in I.TEXT_SUFFIXES)
    reasons = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in I.REJECT_REASON.items())
    o["ingest_route"] = f"""WITH files AS (
          SELECT regexp_extract(url, {q(C.URL_PATH)}, 1) AS name, 'text/html' AS media_type FROM pages
          UNION ALL SELECT * FROM {values(C.LITERAL_FILES, ['name', 'media_type'])}),
        k AS (SELECT name, CASE WHEN media_type = 'application/pdf' THEN 'pdf'
              WHEN suffix(lower(name), '.docx') THEN 'docx' WHEN {text_cond} THEN 'text'
              ELSE 'unsupported' END AS kind FROM files)
        SELECT name, kind, kind = 'text' AS accepted, CASE kind {reasons} END AS reason FROM k"""
    # B
    o["settings_resolve"] = with_views(
        "SELECT doc_id, mode, section, difficulty, style, valid FROM resolved", "resolved")
    o["section_template"] = with_views(
        f"SELECT doc_id, section, {_map_case('section', B.SECTION_TEXT, B.SECTION_DEFAULT_TEXT)} AS section_text "
        "FROM resolved", "resolved")
    o["difficulty_template"] = with_views(
        f"SELECT doc_id, difficulty, {_map_case('difficulty', B.DIFFICULTY_TEXT, '')} AS difficulty_text "
        "FROM resolved", "resolved")
    o["style_template"] = with_views(
        f"SELECT doc_id, style, {style_case('style')} AS style_text FROM resolved", "resolved")
    o["text_truncate"] = (f"SELECT doc_id, substr(text, 1, {K.QUESTION_TEXT_BUDGET}) AS question_text, "
                          f"substr(text, 1, {K.MODEL_ANSWER_TEXT_BUDGET}) AS answer_text FROM documents")
    contract = "\n".join(f"Q{i}: ..." for i in range(1, K.QUESTIONS_PER_SESSION + 1))
    o["prompt_questions"] = with_views(
        f"""SELECT doc_id, concat_ws({NL},
            {q(f'Write exactly {K.QUESTIONS_PER_SESSION} oral-exam questions about the project below.')},
            'Mode: ' || mode, 'Section: ' || section,
            {_map_case('section', B.SECTION_TEXT, B.SECTION_DEFAULT_TEXT)},
            'Difficulty: ' || difficulty, {_map_case('difficulty', B.DIFFICULTY_TEXT, '')},
            'Examiner style: ' || style, {style_case('style')},
            {q('Rules: questions come only from the project, each covers a different aspect, from easiest (Q1) to hardest (Q6).')},
            'Project:', coalesce(substr(text, 1, {K.QUESTION_TEXT_BUDGET}), ''),
            'Answer format:', {q(contract)}) AS prompt FROM resolved""", "resolved")
    o["prompt_eval"] = with_views(
        f"""SELECT conv_id, idx, concat_ws({NL}, 'Question: ' || coalesce(question, ''), 'Student answer:',
            coalesce(answer, ''), 'Grade the answer. Reply with one line only:', 'Marks: X/10') AS prompt FROM qa""",
        "qa")
    o["prompt_model_answer"] = with_views(
        f"""SELECT qa.conv_id, qa.idx, concat_ws({NL},
            'Using only the project text below, give a short ideal answer (3-5 lines).', 'Project:',
            coalesce(substr(d.text, 1, {K.MODEL_ANSWER_TEXT_BUDGET}), ''), 'Question:', coalesce(qa.question, ''),
            'Ideal answer:') AS prompt FROM qa LEFT JOIN documents d ON d.doc_id = qa.conv_id""", "qa")
    transcript = f"""SELECT conv_id, string_agg('Q' || CAST(idx + 1 AS VARCHAR) || ': ' || coalesce(question, '')
            || {NL} || 'A' || CAST(idx + 1 AS VARCHAR) || ': ' || coalesce(answer, ''), {NL} || {NL} ORDER BY idx)
            AS transcript FROM exam GROUP BY conv_id"""
    o["transcript_assemble"] = with_views(transcript, "exam")
    o["prompt_final"] = with_views(
        f"""SELECT t.conv_id, concat_ws({NL}, 'Evaluate this oral examination as an external examiner.',
            'Name: ' || coalesce(c.c_name, ''), 'Roll: ' || coalesce(CAST(c.c_custkey AS VARCHAR), ''),
            'Department: ' || coalesce(c.c_mktsegment, ''),
            'Project: ' || coalesce('Project ' || CAST(c.c_custkey AS VARCHAR), ''),
            'Transcript:', coalesce(t.transcript, ''),
            'Give: overall score out of 100, technical skills, communication, strengths, weaknesses, final verdict.')
            AS prompt FROM ({transcript}) t LEFT JOIN customer c ON c.c_custkey = t.conv_id""", "exam")
    # C
    fb = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in P.FALLBACK_BY_KIND.items())
    o["completion_extract"] = with_views(
        f"""SELECT prompt_id, kind, coalesce(content, CASE kind {fb} END, {q(K.TEXT_EVAL_FAILED)}) AS content,
            content IS NULL AS failed FROM (SELECT prompt_id, kind,
              json_extract_string(TRY_CAST(raw AS JSON), '$.choices[0].message.content') AS content
            FROM responses)""", "responses")
    o["completion_state"] = with_views(f"SELECT prompt_id, {STATE} AS state FROM responses", "responses")
    o["transcription_normalize"] = with_views(
        f"""SELECT item_id, t AS transcript, t = {q(K.TEXT_TRANSCRIPTION_FAILED)} AS failed
            FROM (SELECT item_id, {transcription_case('raw')} AS t FROM transcriptions)""", "transcriptions")
    o["question_parse"] = with_views(
        """SELECT conv_id, unnest(generate_series(0, len(qs) - 1)) AS idx, unnest(qs) AS question
           FROM parsed""", "parsed")
    fallback = _fallback_list(q(K.DEFAULT_SECTION), Q.SHORT_LIST_QUESTIONS)
    o["question_fallback"] = with_views(
        f"""SELECT conv_id, unnest(generate_series(0, len(fq) - 1)) AS idx, unnest(fq) AS question, used_fallback
            FROM (SELECT conv_id, coalesce(len(qs), 0) < 6 AS used_fallback,
                  CASE WHEN coalesce(len(qs), 0) < 6 THEN {fallback} ELSE qs END AS fq FROM parsed)""", "parsed")
    section = f"coalesce(section, {q(K.DEFAULT_SECTION)})"
    o["question_chain"] = with_views(
        f"""SELECT prompt_id, unnest(range(0, 6)) AS idx, unnest(CASE WHEN state = 'no_choices'
              THEN {_fallback_list(section, Q.NO_CHOICES_QUESTIONS)}
              WHEN state = 'ok' AND len(qs) >= 6 THEN qs[1:6] ELSE {_fallback_list(section, Q.SHORT_LIST_QUESTIONS)} END) AS question
            FROM (SELECT prompt_id, section, {STATE} AS state,
                  {question_list("json_extract_string(TRY_CAST(raw AS JSON), '$.choices[0].message.content')")} AS qs
                  FROM question_responses)""", "question_responses")
    o["question_limit"] = with_views(
        f"""SELECT conv_id, unnest(generate_series(0, len(fq) - 1)) AS idx, unnest(fq) AS question
            FROM (SELECT conv_id, (CASE WHEN coalesce(len(qs), 0) < 6 THEN {fallback} ELSE qs END)[1:6] AS fq
                  FROM parsed)""",
        "parsed")
    o["mark_extract"] = with_views("SELECT doc_id, marks FROM doc_marks", "doc_marks")
    o["mark_label"] = with_views(
        "SELECT doc_id, marks, digits || '/100' AS marks_label FROM doc_marks", "doc_marks")
    o["pass_status"] = with_views(
        f"SELECT doc_id, marks, {status('digits')} AS status FROM doc_marks", "doc_marks")
    o["marks_reparse"] = with_views(
        f"""SELECT label_id, marks_label,
            TRY_CAST(NULLIF(regexp_extract(marks_label, '([0-9]+)', 1), '') AS BIGINT) AS marks
            FROM (SELECT doc_id AS label_id, digits || '/100' AS marks_label FROM doc_marks
                  UNION ALL SELECT * FROM {values(C.LITERAL_LABELS, ['label_id', 'marks_label'])})""", "doc_marks")
    # D/H
    nonblank = f"{strip('answer')} <> ''"
    o["blank_answer_filter"] = with_views(
        f"SELECT session_id, idx, answer, ts, event_id FROM answer_log WHERE {nonblank}", "answer_log")
    last = ("QUALIFY row_number() OVER (PARTITION BY session_id, idx ORDER BY ts DESC, event_id DESC) = 1")
    o["answer_upsert"] = with_views(
        f"SELECT session_id, idx, answer FROM answer_log WHERE {nonblank} {last}", "answer_log")
    o["answers_stream"] = o["answer_upsert"]
    o["voice_upsert"] = with_views(
        f"""SELECT session_id, idx, answer FROM (SELECT session_id, idx, {transcription_case('raw')} AS answer,
            ts, event_id FROM voice_log) WHERE {nonblank} {last}""", "voice_log")
    answered = f"""SELECT session_id, count(DISTINCT CASE WHEN {nonblank} AND idx BETWEEN 0 AND 5 THEN idx END) AS answered
                   FROM answer_log GROUP BY session_id"""
    o["progress"] = with_views(
        f"""SELECT session_id, answered, CAST(trunc(answered / 6 * 100) AS INTEGER) AS progress_pct,
            answered >= 6 AS complete,
            CASE WHEN answered >= 6 THEN 'complete' ELSE 'Question ' || CAST(answered + 1 AS VARCHAR) || ' / 6' END
            AS label FROM ({answered})""", "answer_log")
    gate = f"""SELECT s.session_id, count(DISTINCT a.idx) AS answered FROM sessions s JOIN answer_log a
            ON a.session_id = s.session_id AND a.idx < s.n_questions AND {strip('a.answer')} <> ''
            WHERE s.mode = {q(K.MODE_EXAM)} GROUP BY s.session_id, s.n_questions
            HAVING count(DISTINCT a.idx) = s.n_questions"""
    resume = f"""SELECT s.session_id, min(r.range) AS resume_idx FROM sessions s
            JOIN range(0, {max(fx.QUESTION_COUNTS)}) r ON r.range < s.n_questions
            WHERE NOT EXISTS (SELECT 1 FROM answer_log a WHERE a.session_id = s.session_id
                              AND a.idx = r.range AND {strip('a.answer')} <> '')
            GROUP BY s.session_id"""
    active = f"""session_id NOT IN (SELECT session_id FROM session_proctor GROUP BY session_id
                 HAVING count(*) >= {K.VIOLATION_LIMIT})"""
    for key, sql in [("final_gate", gate), ("resume_point", resume)]:
        o[key] = with_views(sql, "answer_log", "sessions")
        o[f"active_{key}"] = with_views(f"SELECT * FROM ({sql}) WHERE {active}", "answer_log", "sessions", "session_proctor")
    o["strip"] = f"SELECT doc_id, {strip('text')} AS stripped FROM documents"
    o["saved_at_text"] = "SELECT CAST(event_id AS VARCHAR) AS record_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS saved_at_text FROM events"
    o["violations_terminate"] = with_views(
        f"""SELECT k.session_id, c.n_violations, k.terminated_at, k.terminating_event_id
            FROM (SELECT session_id, ts AS terminated_at, event_id AS terminating_event_id FROM proctor
                  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) = {K.VIOLATION_LIMIT}) k
            JOIN (SELECT session_id, count(*) AS n_violations FROM proctor GROUP BY session_id) c
              ON c.session_id = k.session_id""", "proctor")
    o["terminations_stream"] = o["violations_terminate"]
    o["violations_stream"] = with_views(
        f"""SELECT session_id, count(*) AS n_violations, count(*) >= {K.VIOLATION_LIMIT} AS must_end
            FROM proctor GROUP BY session_id""", "proctor")
    for key, same in SAME_ROWS.items():
        o[key] = o[same]
    return o


#: Queries over what is kept beside a store or a stream's table: the same rows as from the records.
SAME_ROWS = {"results_compacted": "result_build", "kpis_from_states": "overview_kpis", "status_from_states": "status_distribution",
             "department_from_states": "department_distribution", "marks_series_stored": "marks_series", "answers_merged": "answer_upsert",
             "terminations_merged": "violations_terminate", "report_text_kept": "report_text", "student_search_indexed": "student_search"}
ORACLE_SQL = _build()
