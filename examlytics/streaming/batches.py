"""Micro-batches as parts of a table that is read by its ledger, and merged under a running stream.

A micro-batch writes one directory ``batch_id=<order>/part=<id>`` and commits it to the table's
:mod:`ledger`.  A replayed micro-batch replaces its own part.  :func:`swap` rewrites everything that is
live into one part and swaps it in by one commit, while the stream goes on: later micro-batches stay
beside it, and a micro-batch that is replayed after it was merged is passed over (it is in the merged
part).  So readers scan the merged part and the tail, however many micro-batches there were.

Orders go on over restarts: the batch numbers of a stream with a new checkpoint begin where the table's
orders end.  A table whose rows replace each other has one stream at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import ledger
from ..sources.literals import empty_frame

ORDER = "batch_id"


def stream_name(checkpoint: str) -> str:
    """A stream's name: that of its checkpoint, which counts its micro-batches."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _order(state: ledger.State, name: str, batch: int) -> int:
    return state.facts.get(f"first {name}", state.facts.get("next", 0)) + batch


def _key(order: int) -> str:
    return f"{ORDER}={order}/part={uuid.uuid4().hex}"


def _order_of(key: str) -> int:
    return int(key.split("/")[0].split("=")[1])


def commit_batch(rows: DataFrame, table: str, name: str, batch: int) -> None:
    """Write micro-batch number ``batch`` of stream ``name``; again, if it is replayed, but not once it is merged."""
    spark = rows.sparkSession
    state = ledger.read_ledger(spark, table)
    key = _key(_order(state, name, batch))
    if batch <= state.facts.get(f"merged {name}", -1):
        return
    rows.write.parquet(f"{table.rstrip('/')}/{key}")

    def decide(now: ledger.State) -> dict | None:
        if batch <= now.facts.get(f"merged {name}", -1):
            return None
        mine = {"stream": name, "batch": batch}
        return {"drop": [k for k, v in now.entries.items() if v == mine], "put": {key: mine},
                "set": {f"first {name}": _order_of(key) - batch, "next": max(_order_of(key) + 1, now.facts.get("next", 0))}}

    ledger.commit(spark, table, decide)


def _read(spark: SparkSession, table: str, keys: list[str], schema: str | None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("basePath", table).parquet(*[f"{table.rstrip('/')}/{k}" for k in keys]).drop("part")


def live_batches(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """The merged part and the micro-batches since, with their order (``batch_id``).  A table without any reads as empty, with
    the columns of ``schema`` (which names batch_id too)."""
    keys = sorted(ledger.read_ledger(spark, table).entries, key=_order_of)
    if not keys:
        if schema is None:
            raise ValueError(f"{table} has no micro-batches, and no schema was given")
        return empty_frame(spark, schema)
    return _read(spark, table, keys, schema and f"{schema}, part string")


def swap(spark: SparkSession, table: str, merge: Callable[[DataFrame], DataFrame], schema: str | None = None, min_parts: int = 2) -> bool:
    """Replace all that is live by its merged form (``merge`` gets the rows with batch_id and returns them without it); whether it did.
    Nothing is done below ``min_parts`` parts, or if another swap came first."""
    entries = ledger.read_ledger(spark, table).entries
    keys = sorted(entries, key=_order_of)
    if len(keys) < max(1, min_parts):
        return False
    merged: dict[str, int] = {}
    for v in entries.values():
        if v:
            merged[f"merged {v['stream']}"] = max(v["batch"], merged.get(f"merged {v['stream']}", -1))
    upto = _order_of(keys[-1])
    made = _key(upto)
    merge(_read(spark, table, keys, schema and f"{schema}, part string")).write.parquet(f"{table.rstrip('/')}/{made}")

    def decide(state: ledger.State) -> dict | None:
        if any(k not in state.entries for k in keys):
            return None
        return {"drop": keys, "put": {made: {}}, "set": merged}

    return made in ledger.commit(spark, table, decide).entries


def vacuum(spark: SparkSession, table: str, retain_hours: float = 168.0) -> int:
    """Remove parts that are not live and older than ``retain_hours``; their number."""
    return ledger.sweep(spark, table, f"{ORDER}=*/part=*", lambda p: "/".join(p.rstrip("/").split("/")[-2:]), retain_hours)
