"""Model-response helpers on raw JSON text (Column -> Column).

Parsing uses the VARIANT type (``try_parse_json``), so malformed input gives
null instead of failing the job, and each row is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import TEXT_NO_SPEECH, TEXT_TRANSCRIPTION_FAILED
from .text import _c, ustrip

CONTENT_PATH = "$.choices[0].message.content"


def _kind(v: Column, raw: Column) -> Column:
    """Top-level JSON kind: object / array / string / scalar, null if unparsable.

    For a document that parsed, its first non-blank character decides the
    kind; that is a short anchored regex instead of walking the whole
    document to build its schema.
    """
    first = F.regexp_extract(raw, r"^[ \t\n\r]*(.)", 1)
    return (F.when(v.isNull(), F.lit(None))
            .when(first == "{", F.lit("object"))
            .when(first == "[", F.lit("array"))
            .when(first == '"', F.lit("string"))
            .otherwise(F.lit("scalar")))


def _array_has_string(v: Column, value: str) -> Column:
    return F.exists(F.try_variant_get(v, "$", "array<variant>"),
                    lambda x: F.try_variant_get(x, "$", "string") == F.lit(value))


def _has_key(v: Column, key: str) -> Column:
    """Key present in a JSON object (a JSON null value still counts).  A
    missing path is SQL NULL, a JSON null is a VARIANT null."""
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def completion_content(raw, v=None) -> Column:
    """``choices[0].message.content`` as text; null when absent or unreadable."""
    return F.try_variant_get(F.try_parse_json(_c(raw)) if v is None else _c(v), CONTENT_PATH, "string")


def parsed(raw) -> Column:
    """Parse once; pass the result as ``v=`` to the helpers below so the
    document is not parsed again in every branch."""
    return F.try_parse_json(_c(raw))


def document_kind(raw, v) -> Column:
    """Kind of the parsed document ``v``; computed once and passed as ``kind=``."""
    return _kind(_c(v), _c(raw))


def completion_state(raw, v=None, kind=None) -> Column:
    """Outcome of a question-generation response.

    * ``ok``          – content is a string at ``choices[0].message.content``
    * ``no_choices``  – parsed, but the ``in`` test for "choices" is false
                        (object without the key, array/string without it)
    * ``failed``      – unparsable, null, a number/bool/null document, or the
                        key is there but the path to a string content breaks
    """
    r = _c(raw)
    v = F.try_parse_json(r) if v is None else _c(v)
    kind = _kind(v, r) if kind is None else _c(kind)
    content_is_string = F.schema_of_variant(
        F.try_variant_get(v, CONTENT_PATH, "variant")) == F.lit("STRING")
    in_test = (F.when(kind == "object", _has_key(v, "choices"))
               .when(kind == "array", F.coalesce(_array_has_string(v, "choices"), F.lit(False)))
               .when(kind == "string",
                     F.instr(F.try_variant_get(v, "$", "string"), "choices") > 0))
    return (F.when(kind.isNull() | (kind == "scalar"), F.lit("failed"))
            .when(~in_test, F.lit("no_choices"))
            .when((kind == "object") & F.coalesce(content_is_string, F.lit(False)), F.lit("ok"))
            .otherwise(F.lit("failed")))


def transcription_text(raw, v=None) -> Column:
    """Normalise a speech-to-text response to answer text.

    object with string ``text``  -> stripped text, or the no-speech marker if empty
    object without ``text``      -> the raw JSON (the app shows the response itself)
    array / string without "text" -> raw JSON / the decoded string
    anything else                -> failure text
    """
    r = _c(raw)
    v = F.try_parse_json(r) if v is None else _c(v)
    kind = _kind(v, r)
    text_v = F.try_variant_get(v, "$.text", "variant")
    text_is_string = F.coalesce(F.schema_of_variant(text_v) == F.lit("STRING"), F.lit(False))
    stripped = ustrip(F.try_variant_get(v, "$.text", "string"))
    s_val = F.try_variant_get(v, "$", "string")
    return (F.when(kind.isNull() | (kind == "scalar"), F.lit(TEXT_TRANSCRIPTION_FAILED))
            .when(kind == "object",
                  F.when(~_has_key(v, "text"), r)
                  .when(text_is_string,
                        F.when(stripped == "", F.lit(TEXT_NO_SPEECH)).otherwise(stripped))
                  .otherwise(F.lit(TEXT_TRANSCRIPTION_FAILED)))
            .when(kind == "array",
                  F.when(F.coalesce(_array_has_string(v, "text"), F.lit(False)),
                         F.lit(TEXT_TRANSCRIPTION_FAILED)).otherwise(r))
            .otherwise(  # string document
                F.when(F.instr(s_val, "text") > 0, F.lit(TEXT_TRANSCRIPTION_FAILED)).otherwise(s_val)))


def transcription_failed(raw, v=None) -> Column:
    """Whether the response is unreadable, from its parsed form (an answer may say the same words)."""
    r = _c(raw)
    v = F.try_parse_json(r) if v is None else _c(v)
    kind = _kind(v, r)
    text_is_string = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == F.lit("STRING"), F.lit(False))
    return (F.when(kind.isNull() | (kind == "scalar"), F.lit(True))
            .when(kind == "object", _has_key(v, "text") & ~text_is_string)
            .when(kind == "array", F.coalesce(_array_has_string(v, "text"), F.lit(False)))
            .otherwise(F.instr(F.try_variant_get(v, "$", "string"), "text") > 0))
