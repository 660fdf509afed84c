"""Trigram index of student names beside the results store.

For each part of the store the index holds its distinct names under each of their trigrams, sorted by
trigram.  A search pattern is split into trigrams that every match must contain; names that have all of them
are verified by the pattern itself, and only the parts that hold such a name are scanned.  A pattern
without a required trigram scans the store as before.  The rows are the same for any pattern.

Folding: names are indexed in lower case, with the dotless i as i, the long s as s, and without the dot that
lower-casing leaves behind a dotted capital I, so every letter that matches an ASCII letter regardless of case is that letter.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_matches
from ..operators.dashboard import student_search, validate_pattern
from ..schemas import RESULT_COLUMNS
from . import ledger, results_store as store
from .literals import empty_frame

INDEX = "key string, name string, gram string"
_SPECIAL = set("\\^$.|?*+()[]{}")
#: Index rows that a task sorts, about.  A trigram that all names share is dealt over as many tasks as it needs.
TASK_ROWS = 1 << 20


def required_runs(pattern: str) -> list[str]:
    """Runs of characters (ASCII, lower case) that stand side by side in every match; fewer than there are where the pattern is not plain.

    Alternatives, group options and escapes of letters or digits other than classes and anchors give none at all; groups and
    character classes end a run, and what is in them is not looked at."""
    if "|" in pattern or "(?" in pattern or re.search(r"\\[^dDwWsSbBAzZ\W]", pattern) or "\\_" in pattern:
        return []
    runs, run, i, depth = [], "", 0, 0

    def close(start: str = "") -> str:
        runs.append(run)
        return start

    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "\\":
            if i == len(pattern):
                return []
            c, literal = pattern[i], not pattern[i].isalnum()
            i += 1
            if not literal:
                run = close()
                continue
        elif c == "[":
            end = pattern.find("]", i + (pattern[i:i + 1] == "]") + (pattern[i:i + 2] == "^]") * 2)
            if end < 0 or "[" in pattern[i:end] or "\\" in pattern[i:end] or "&&" in pattern[i:end]:
                return []
            i, run = end + 1, close()
            continue
        elif c in "()":
            depth += 1 if c == "(" else -1
            run = close()
            continue
        elif c in _SPECIAL:
            if c in "?*{":                             # what stands before may be absent
                run = run[:-1]
                if c == "{":
                    end = pattern.find("}", i)
                    if end < 0:
                        return []
                    i = end + 1
                run = close()
            else:
                run = close(run[-1:] if c == "+" else "")
            if c in "?*+{" and pattern[i:i + 1] in ("?", "+"):
                i += 1                                 # lazy or possessive
            continue
        if depth or not c.isascii():
            run = close()
        else:
            run += c.lower()
    runs.append(run)
    return [r for r in runs if len(r) >= 3] if depth == 0 else []


def required_grams(pattern: str) -> list[str]:
    return sorted({r[k:k + 3] for r in required_runs(pattern) for k in range(len(r) - 2)})


def folded(name: Column) -> Column:
    return F.translate(F.lower(name), "\u0131\u017f\u0307", "is")


def _grams(name: Column) -> Column:
    f = folded(name)
    places = F.sequence(F.lit(1), F.greatest(F.length(f) - 2, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda k: F.substring(f, k, F.lit(3))))


def refresh_index(spark: SparkSession, path: str) -> int:
    """Index the names of all parts that are not indexed yet; their number."""
    table = f"{path.rstrip('/')}/_names"
    live = set(store.live_keys(spark, path))
    covered = ledger.read_ledger(spark, table).entries
    missing, stale = sorted(live - covered.keys()), [k for k in covered if k not in live]
    if not missing and not stale:
        return 0
    change: dict = {"drop": stale, "put": {}}
    if missing:
        made = uuid.uuid4().hex
        key = F.concat(F.lit(f"{store.PARTITION_COL}="), F.coalesce(F.col(store.PARTITION_COL).cast("string"), F.lit(store.NO_DAY)),
                       F.lit(f"/{store.PART_COL}="), F.col(store.PART_COL))
        records = store.scan_keys(spark, path, missing).where("student_name is not null")
        most = records.agg(F.sum(F.greatest(F.length("student_name") - 2, F.lit(1)))).first()[0] or 0        # trigrams with repetitions
        names = records.select(key.alias("key"), F.col("student_name").alias("name")).distinct()
        rows = names.select("key", "name", F.explode(_grams(F.col("name"))).alias("gram"))
        (rows.repartitionByRange(max(1, -(-most // TASK_ROWS)), "gram", "name", "key").sortWithinPartitions("gram", "name")
         .write.parquet(f"{table}/refresh={made}"))
        change["put"] = {k: {"refresh": made} for k in missing}
    ledger.commit(spark, table, lambda state: change)
    return len(missing)


def matching_names(spark: SparkSession, path: str, pattern: str, grams: list[str]) -> DataFrame:
    """(key, name): the names with all ``grams`` that match the pattern, and the live parts that hold them."""
    table = f"{path.rstrip('/')}/_names"
    live = set(store.live_keys(spark, path))
    entries = {k: v for k, v in ledger.read_ledger(spark, table).entries.items() if k in live}
    if not entries:
        return empty_frame(spark, "key string, name string")
    rows = spark.read.schema(INDEX).parquet(*sorted({f"{table}/refresh={v['refresh']}" for v in entries.values()}))
    found = (rows.where(F.col("gram").isin(grams) & F.col("key").isin(sorted(entries))).groupBy("key", "name")
             .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)))
    return found.where(name_matches("name", pattern)).select("key", "name")


def indexed_search(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``dashboard.student_search`` over the store, through the index."""
    validate_pattern(spark, pattern)
    grams = required_grams(pattern)
    if not grams:
        return student_search(store.saved_results(spark, path), pattern)
    refresh_index(spark, path)
    names = matching_names(spark, path, pattern, grams)
    keys = sorted(r[0] for r in names.select("key").distinct().collect())        # directories of the store, as its file index lists them
    if not keys:
        return store.saved_results(spark, path).limit(0)
    rows = store.scan_keys(spark, path, keys).select(*RESULT_COLUMNS)
    return rows.join(names.select(F.col("name").alias("student_name")).distinct(), "student_name", "left_semi").select(*RESULT_COLUMNS)
