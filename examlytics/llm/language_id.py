"""Language identification by multinomial naive Bayes over hashed character n-grams.

Features of a text are its lower-cased character n-grams of 1 to 3 characters, where every run of
characters that are not letters counts as one blank; each n-gram is hashed to one of ``bins``
bins.  Training adds up the bins of all labelled rows per language inside the tasks and sums the
(language, bin, count) cells in Spark; no row is left out.  The model is a matrix of log
probabilities, languages x bins, with additive smoothing and uniform priors.  Its size is bounded
by ``max_languages`` x ``bins`` x 4 bytes, checked before it is broadcast.

Scoring turns a block of texts into one sparse run of bins, looks up each language's row of the
matrix and sums the runs per text.  ``score`` is the posterior of the predicted language.

The posterior compares the learned languages with each other and says nothing of a text in none of
them, so ``drop_unknown`` also holds every text to its language's fit: ``strangeness`` is how far the mean log
probability of its n-grams lies below the mean of the language's training rows, in units that allow for the
spread of short texts.  A language's bound is the ``ORDINARY`` quantile over all its training rows plus ``MARGIN``.

Defined cases: a null text or one without a letter gets ``und`` and score 0.  Rows without a
label teach nothing.  Equal scores go to the language that sorts first.  Without any training
row every text is ``und``.  Very long texts are worked through in pieces.  Repeated rows and other
columns need no care: prediction is by row and reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import map_batches

BINS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
#: Bound of the model: more learned languages than this are refused.
MAX_LANGUAGES = 100
#: Characters worked through at a time.
PIECE = 1 << 18
UNKNOWN = "und"
#: Strangeness is in nats times the root of the n-grams of a text; beyond about EVEN n-grams, texts differ
#: by their subjects and no longer by their length.
EVEN = 100
#: Quantile of the training rows' strangeness that sets a language's bound, and what is allowed beyond it: on
#: sf0.01, rows that did not teach lie up to 6 beyond it, the foreign and noise texts of the tests over 20.
ORDINARY = 0.999
MARGIN = 10.0


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of the texts, each between blanks (0) of its own, the place of each text's first
    blank, and whether it has a letter."""
    raw = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = letter_table()[raw]
    lens = np.array([len(t) + 2 for t in texts], np.int64)
    end = np.cumsum(lens)
    seen = np.concatenate([[0], np.cumsum(folded > 0)])
    has = seen[end] > seen[end - lens]
    keep = (folded > 0) | np.concatenate([[True], folded[:-1] > 0])  # one blank for each run of non-letters
    keep[end - lens] = True
    place = np.cumsum(keep) - 1
    return folded[keep], place[end - lens], has


def ngram_bins(c: np.ndarray, bins: int) -> np.ndarray:
    """Bins of the n-grams that start at each place: one row an order.  Bin 0 takes lone blanks and what
    would run across a blank, so that no n-gram joins two texts; it weighs nothing."""
    out = np.zeros((len(ORDERS), len(c)), np.int64)
    h = np.zeros(len(c), np.uint64)
    word = c > 0
    for n in range(1, max(ORDERS) + 1):
        # h over c[i : i + n]; an n-gram may begin or end with a blank but not run across one
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:].astype(np.uint64) + np.uint64(n)
        fine = word[:m] | (np.uint64(n) > 1)
        for inside in range(1, n - 1):
            fine = fine & word[inside:inside + m]
        if n == 2:
            fine = fine & (word[:m] | word[1:])
        if n in ORDERS:
            x = h ^ (h >> np.uint64(29))
            x = x * np.uint64(0xBF58476D1CE4E5B9)
            out[ORDERS.index(n), :m] = np.where(fine, 1 + (x >> np.uint64(33)).astype(np.int64) % (bins - 1), 0)
    return out


def check_languages(n: int) -> None:
    if n > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")


def cuts(text: str, most: int = PIECE) -> Iterator[str]:
    """A text in parts of about ``most`` characters, each cut before a character that is not a letter.  No n-gram runs across such a
    character, and one that begins or ends there meets the blank of the part, so the parts have the n-grams of the whole text.
    A run of letters longer than ``most`` stays in one part."""
    at = 0
    while at < len(text):
        end = at + most
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts in runs of about PIECE characters; a longer text comes in several pieces."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        for part in cuts(t) if len(t) > PIECE else [t]:
            rows.append(i)
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def counted(rows: DataFrame, text_col: str = "text", label_col: str = "lang", bins: int = BINS) -> tuple[list[str], np.ndarray]:
    """Learned languages, sorted, and the n-grams of their rows [language, bin]."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.zeros((0, bins), np.int64)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            labels = [known.setdefault(x, len(known)) for x in batch.column("__label").to_pylist()]
            check_languages(len(known))
            table = np.concatenate([table, np.zeros((len(known) - len(table), bins), np.int64)])
            for at, held in pieces(texts):
                c, start, _ = codes(held)
                label = np.repeat([labels[i] for i in at], np.diff([*start.tolist(), len(c)]))
                for row in ngram_bins(c, bins):
                    table += np.bincount(label * bins + row, minlength=table.size).reshape(table.shape)
        for label, i in known.items():
            used = np.flatnonzero(table[i, 1:]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(table[i, used])],
                                             names=["__label", "__bin", "__count"])

    labelled = rows.select(F.col(text_col).alias("__text"), F.col(label_col).cast("string").alias("__label")).dropna()
    cells = (map_batches(labelled, count, "__label string, __bin int, __count bigint")
             .groupBy("__label", "__bin").agg(F.sum("__count").alias("n")))
    found = cells.toArrow()
    labels = sorted(set(found.column("__label").to_pylist()))
    check_languages(len(labels))
    counts = np.zeros((len(labels), bins))
    place = {x: i for i, x in enumerate(labels)}
    counts[[place[x] for x in found.column("__label").to_pylist()], found.column("__bin").to_numpy()] = found.column("n").to_numpy()
    return labels, counts


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    logp = np.log(counts + ALPHA) - np.log(total + ALPHA * (counts.shape[1] - 1))
    logp[:, 0] = 0.0
    return logp.astype(np.float32)


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang", bins: int = BINS) -> tuple[list[str], np.ndarray]:
    """Learned languages, sorted, and float32 log probabilities [language, bin]."""
    labels, counts = counted(rows, text_col, label_col, bins)
    return labels, log_probabilities(counts)


def totals(texts: list[str | None], labels: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of each text in each language, whether it has a letter, and its n-grams' number."""
    bins = logp.shape[1] if len(labels) else BINS
    total = np.zeros((len(texts), len(labels)))
    letters = np.zeros(len(texts), bool)
    size = np.zeros(len(texts), np.int64)
    for at, held in pieces([t or "" for t in texts]):
        c, start, has = codes(held)
        np.logical_or.at(letters, at, has)
        if not len(labels):
            continue
        where = ngram_bins(c, bins)
        np.add.at(size, at, np.add.reduceat((where > 0).sum(0), start))
        for k in range(len(labels)):
            per_place = logp[k][where[0]].astype(np.float64)
            for row in where[1:]:
                per_place += logp[k][row]
            np.add.at(total[:, k], at, np.add.reduceat(per_place, start))
    return total, letters, size


def score_texts(texts: list[str | None], labels: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    total, letters, _ = totals(texts, labels, logp)
    return named(total, letters, labels)


def named(total: np.ndarray, letters: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray]:
    """The predicted language of each text and its posterior."""
    if not len(labels):
        return [UNKNOWN] * len(total), np.zeros(len(total))
    best = total.argmax(1)
    top = total[np.arange(len(total)), best]
    posterior = 1.0 / np.exp(total - top[:, None]).sum(1)
    return [labels[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist())], np.where(letters, posterior, 0.0)


def strangeness(total: np.ndarray, size: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """How far texts of ``size`` n-grams and log probability ``total`` lie below the ``usual`` mean of their language."""
    n = np.maximum(size, 1)
    return (usual - total / n) * np.sqrt(n / (1 + n / EVEN))


def predict(rows: DataFrame, labels: list[str], logp: np.ndarray, text_col: str = "text",
            pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``rows`` with all their columns, the predicted language and its posterior (0 to 1); columns of these two names are replaced."""
    rows = rows.drop(pred_col, score_col)
    model = rows.sparkSession.sparkContext.broadcast((labels, logp))
    where = rows.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for batch in batches:
            found, score = score_texts(batch.column(where).to_pylist(), names, table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score)],
                                             names=[*batch.schema.names, pred_col, score_col])

    schema = StructType([*rows.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])
    return map_batches(rows, scored, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2 (a null id teaches)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def strange_bounds(rows: DataFrame, labels: list[str], logp: np.ndarray, usual: np.ndarray, text_col: str = "text",
                   label_col: str = "lang") -> np.ndarray:
    """The most strangeness that each language allows, from all rows that taught it."""
    model = rows.sparkSession.sparkContext.broadcast((labels, logp))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        place = {x: k for k, x in enumerate(names)}
        for batch in batches:
            total, letters, size = totals(batch.column("__text").to_pylist(), names, table)
            own = np.array([place.get(x, -1) for x in batch.column("__label").to_pylist()], np.int64)
            at = np.flatnonzero(letters & (own >= 0))
            own = own[at]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(strangeness(total[at, own], size[at], usual[own]))],
                                             names=["__own", "__far"])

    labelled = rows.select(F.col(text_col).alias("__text"), F.col(label_col).cast("string").alias("__label")).dropna()
    found = (map_batches(labelled, judged, "__own int, __far double").groupBy("__own")
             .agg(F.percentile_approx("__far", ORDINARY, 10_000).alias("__far")).collect())  # a row per language
    bounds = np.zeros(len(labels))
    for r in found:
        bounds[r["__own"]] = max(r["__far"], 0.0)
    return bounds + MARGIN


def drop_unknown(docs: DataFrame, min_score: float = 0.3, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Rows with a letter whose language is found with a posterior of ``min_score`` or more and that fit
    it as its training rows do."""
    teach = docs.filter(~held_out(id_col))
    labels, counts = counted(teach, text_col, label_col)
    logp = log_probabilities(counts)
    usual = (counts * logp).sum(1) / counts.sum(1)
    bounds = strange_bounds(teach, labels, logp, usual, text_col, label_col) if labels else usual
    model = docs.sparkSession.sparkContext.broadcast((labels, logp, usual, bounds))
    where = docs.columns.index(text_col)

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, mean, most = model.value
        for batch in batches:
            total, letters, size = totals(batch.column(where).to_pylist(), names, table)
            keep = letters & (len(names) > 0)
            if len(names):
                best = total.argmax(1)
                keep &= named(total, letters, names)[1] >= min_score
                keep &= strangeness(total[np.arange(len(best)), best], size, mean[best]) <= most[best]
            yield batch.filter(pa.array(keep))

    return map_batches(docs, fitting, docs.schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels, logp = train(docs.filter(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, labels, logp).select("doc_id", "held_out", "lang_pred", "score")
