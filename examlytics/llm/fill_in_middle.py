r"""Fill-in-middle transformation of whole documents, cut at line boundaries.

A text's boundaries are the offsets (in code points) before its first line and after each of its
lines ``[^\n]*\n|[^\n]+``.  They are kept in a :class:`BoundarySet`; both cut offsets, after a and
after b lines, are its a-th and b-th values, found through the cumulative cardinalities of its
containers.  The draws come from SHA-256 of ``seed:id``, so a document is cut the same way in any
task, partitioning or retry.

Forms: ``psm`` is ``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` is ``<S>``suffix``<P>``prefix``<M>``middle
and ``plain`` the text itself.  A text that holds a marker stays plain; no other text can form a
marker across a cut, so :func:`restored` rebuilds the text from output and form alone.

One narrow pass: no shuffle.  A task holds a block of about 2 MB of texts, or one longer text.

Defined cases: null text is empty; an empty text has no lines and is plain.  A null id draws as
the empty string.  Equal ids are cut at the same draws, repeated rows come out repeated.  Cuts may
coincide (empty middle) or lie at either end.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boundary_set import BoundarySet
from .common import BLOCK_BYTES, blocks, map_batches, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7


def line_boundaries(raw: np.ndarray) -> BoundarySet:
    """Boundaries of the lines of UTF-8 bytes, in code points."""
    found, chars = [np.zeros(1, np.int64)], 0
    for at in range(0, len(raw), BLOCK_BYTES):
        some = raw[at:at + BLOCK_BYTES]
        upto = np.cumsum((some & 0xC0) != 0x80, dtype=np.int64) + chars
        found.append(upto[some == 10])
        chars = int(upto[-1])
    if len(raw) and raw[-1] != 10:
        found.append(np.array([chars], np.int64))
    return BoundarySet(np.concatenate(found))


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"__h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = 100,
                   spm_percent: int = 50) -> DataFrame:
    """One row per document: the id, n (lines), form, prefix_chars, middle_chars and output."""
    src = docs.select(F.col(id_col).alias("__id"), *draws(id_col, seed), F.col(text_col).alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()

    def form_of(text: str, h3: int, h4: int) -> str:
        if not text or h3 % 100 >= fim_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            return "plain"
        return "spm" if h4 % 100 < spm_percent else "psm"

    def cut(text: str, raw: np.ndarray, h: tuple) -> tuple:
        ends = line_boundaries(raw)
        n, form = len(ends) - 1, form_of(text, h[2], h[3])
        if form == "plain":
            return n, form, None, None, text
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        i, j = ends.select(a), ends.select(b)
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        if form == "psm":
            out = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
        else:
            out = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, form, i, j - i, out

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            raw, off = text_bytes(batch.column("__text"))
            for lo, hi in blocks(off):
                part = batch.slice(lo, hi - lo)
                texts = part.column("__text").fill_null("").to_pylist()
                hs = zip(*(part.column(f"__h{i}").to_pylist() for i in range(1, 5)))
                rows = [cut(t, raw[off[lo + k]:off[lo + k + 1]], h) for k, (t, h) in enumerate(zip(texts, hs))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                    names=["__id", "n", "form", "prefix_chars", "middle_chars", "output"])

    made = map_batches(src, transform, f"__id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("__id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from output and form alone."""
    out = F.col(output)
    m = F.locate(MIDDLE, out)

    def parts(second: str) -> tuple[Column, Column, Column]:
        at = F.locate(second, out)
        return out.substr(F.lit(4), at - 4), out.substr(at + 3, m - at - 3), out.substr(m + 3, F.length(out))

    prefix, suffix, middle = parts(SUFFIX)
    suffix2, prefix2, middle2 = parts(PREFIX)
    return (F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
            .otherwise(F.concat(prefix2, middle2, suffix2)))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                       F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
