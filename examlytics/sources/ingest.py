"""Project-upload ingestion: route files by type, decode text uploads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_SUFFIXES = [".txt", ".py", ".ipynb"]


@F.pandas_udf(T.StringType())
def _decode_utf8_ignore(content: pd.Series) -> pd.Series:
    # No built-in drops invalid bytes: decode() raises, make_valid_utf8
    # substitutes U+FFFD, try_validate_utf8 gives null.  Arrow batches keep
    # this vectorised per batch.
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))


def decode_text(content, accepted: Column | None = None) -> Column:
    """UTF-8 decode with invalid bytes dropped; null where not ``accepted``.

    Valid bytes are decoded on the JVM.  The Python stage sees every row of the
    plan, so rows that it has nothing to do for carry null into it."""
    c = F.col(content) if isinstance(content, str) else content
    c = c if accepted is None else F.when(accepted, c)
    valid = F.is_valid_utf8(c.cast("string"))
    return F.coalesce(F.when(valid, c.cast("string")), _decode_utf8_ignore(F.when(~valid, c)))


def text_ingest(uploads: DataFrame, key: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Bytes -> text for text-kind uploads."""
    return uploads.select(key, decode_text(content_col).alias("text"))


def route_kind(name, media_type) -> Column:
    """Reader choice: PDF by media type, then DOCX by suffix, then the text
    suffixes; anything else is unsupported.  Suffix tests ignore case (the
    uploader accepts ``.DOCX``; decoding a zip as text would be garbage)."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    mt = F.col(media_type) if isinstance(media_type, str) else media_type
    is_text = None
    for suf in TEXT_SUFFIXES:
        is_text = n.endswith(suf) if is_text is None else (is_text | n.endswith(suf))
    return (F.when(mt == "application/pdf", F.lit("pdf"))
            .when(n.endswith(".docx"), F.lit("docx"))
            .when(is_text, F.lit("text"))
            .otherwise(F.lit("unsupported")))


REJECT_REASON = {
    "pdf": "pdf text extraction is not built",
    "docx": "docx text extraction is not built",
    "unsupported": "file type not accepted",
}


def ingest_route(files: DataFrame, name_col: str = "name", media_col: str = "media_type") -> DataFrame:
    """(name, kind, accepted, reason) per file; rejects carry a reason instead
    of being decoded as garbage or silently swallowed."""
    kind = route_kind(name_col, media_col)
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in REJECT_REASON.items() for x in kv]), kind)
    return files.select(F.col(name_col).alias("name"), kind.alias("kind"),
                        (kind == "text").alias("accepted"), reason.alias("reason"))


def read_uploads(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Read uploaded files with the ``binaryFile`` source, route them, and
    decode the accepted ones.  Media type is guessed from the suffix."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    media = F.when(F.lower(name).endswith(".pdf"), F.lit("application/pdf")).otherwise(F.lit("application/octet-stream"))
    routed = files.select("path", name.alias("name"), media.alias("media_type"), "content")
    kind = route_kind("name", "media_type")
    return routed.select("path", "name", kind.alias("kind"),
                         decode_text("content", kind == "text").alias("text"))
