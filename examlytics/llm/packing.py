"""Best-fit packing of token sequences by bin completion with branch and bound.

A document is its token ids and one end id.  Longer ones than ``capacity`` are cut into pieces of
``capacity``; the first piece takes the rest.  Only piece lengths matter for packing, so the plan is made on the
histogram of lengths (at most ``capacity`` rows), whatever the number of documents.

The plan takes the largest remaining length and enumerates fillings of the space beside it.  A
filling is left out if it is dominated: something unused still fits, an item can be exchanged for a
larger unused one, or two items for one unused item that is at least as large.  Fillings are tried by least
waste, each for as many bins as the histogram allows and, on backtracking, for one bin.  A branch ends when its
bins and the least bins for the rest reach the incumbent.  Best-fit decreasing gives the first incumbent,
ceil(total / capacity) the bound at which the search stops; ``NODES`` bounds its work and
the best plan found is used.

Places are then dealt to rows by rank: rows of one length are interchangeable.  Ranks come from
counts per (length, hash bucket), so a length that holds a third of all rows is ranked in
``BUCKETS`` groups; each row finds its sequence and offset in the plan's slot table.

Defined cases: null and empty text is the end id alone (one piece of length 1).  Repeated rows
and null ids are packed like others.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
BUCKETS = 256
#: Work bounds of the search: bins filled, and fillings looked at for one bin.
NODES = 6_000
VISITS = 100
CHOICES = 4

#: A run of equal bins: how many, and the (length, count in a bin) that each holds.
Run = tuple[int, tuple[tuple[int, int], ...]]


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing on the histogram, bins of equal content at a time."""
    space: list[int] = []  # sorted distinct free spaces
    bins: dict[int, list[list]] = {}

    def put(free: int, n: int, held: tuple) -> None:
        if free not in bins:
            insort(space, free)
            bins[free] = []
        bins[free].append([n, held])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(space, length - 1)
            if at == len(space):
                each = min(capacity // length, left)
                n = left // each
                put(capacity - each * length, n, ((length, each),))
                left -= n * each
                continue
            free = space[at]
            n, held = bins[free].pop()
            if not bins[free]:
                del bins[free]
                space.pop(at)
            each = min(free // length, left)
            take = min(n, left // each)
            if n > take:
                put(free, n - take, held)
            put(free - each * length, take, (*held, (length, each)))
            left -= take * each
    return [(n, held) for group in bins.values() for n, held in group]


class Completion:
    """Bin completion over a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.counts = capacity, dict(counts)
        self.lengths = sorted(k for k, n in counts.items() if n)

    def take(self, length: int, n: int) -> None:
        now = self.counts.get(length, 0)
        self.counts[length] = now - n
        if now == n:
            self.lengths.pop(bisect_right(self.lengths, length) - 1)
        elif not now and n:
            insort(self.lengths, length)

    def undominated(self, items: list[int], waste: int) -> bool:
        used: dict[int, int] = {}
        for x in items:
            used[x] = used.get(x, 0) + 1

        def unused(lo: int, hi: int) -> bool:
            at = bisect_right(self.lengths, hi) - 1
            while at >= 0 and self.lengths[at] >= lo:
                if self.counts[self.lengths[at]] > used.get(self.lengths[at], 0):
                    return True
                at -= 1
            return False

        if unused(1, waste):
            return False
        if waste and any(unused(x + 1, x + waste) for x in used):
            return False
        small = items[-6:]
        return not any(unused(a + b, a + b + waste) for i, a in enumerate(small) for b in small[i + 1:])

    def fillings(self, first: int) -> list[list[int]]:
        """Undominated fillings beside ``first``, least waste first, larger items first."""
        room = self.capacity - first
        found: list[tuple[int, list[int]]] = []
        visits = 0
        stack: list[tuple[int, int, list[int]]] = [(room, first, [])]
        used: dict[int, int]
        while stack and visits < VISITS:
            visits += 1
            free, top, items = stack.pop()
            used = {}
            for x in (first, *items):
                used[x] = used.get(x, 0) + 1
            nexts = []
            at = bisect_right(self.lengths, min(free, top)) - 1
            while at >= 0 and len(nexts) < 6:
                x = self.lengths[at]
                if self.counts[x] > used.get(x, 0):
                    nexts.append(x)
                at -= 1
            if not nexts:
                found.append((free, items))
                if free == 0 and sum(w == 0 for w, _ in found) >= CHOICES:
                    break
                continue
            stack.extend((free - x, x, [*items, x]) for x in reversed(nexts))
        while stack and not found:  # no complete filling within the visits: finish the current one greedily
            free, top, items = stack.pop()
            while True:
                at = bisect_right(self.lengths, free) - 1
                while at >= 0 and self.counts[self.lengths[at]] <= (first, *items).count(self.lengths[at]):
                    at -= 1
                if at < 0:
                    break
                items = [*items, self.lengths[at]]
                free -= self.lengths[at]
            found.append((free, items))
        found.sort(key=lambda f: f[0])
        good = []
        for waste, items in found:
            if len(good) >= CHOICES:
                break
            if items not in good and (not good or self.undominated([first, *items], waste)):
                good.append(items)
        return good

    def moves(self) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
        first = self.lengths[-1]
        for turn in (0, 1):
            for items in self.fillings(first):
                held: dict[int, int] = {}
                for x in (first, *items):
                    held[x] = held.get(x, 0) + 1
                most = min(self.counts[x] // n for x, n in held.items())
                if turn == 0 or most > 1:
                    yield (most if turn == 0 else 1), tuple(held.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Run]:
    """Runs of bins that hold every item of the histogram, as few bins as the search finds."""
    counts = {k: n for k, n in counts.items() if n}
    total = sum(k * n for k, n in counts.items())
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    size = sum(n for n, _ in best)
    if size == least:
        return best
    state, path, bins, rest = Completion(counts, capacity), [], 0, total
    stack = [state.moves()]
    while stack and nodes > 0 and size > least:
        move = next(stack[-1], None)
        if move is None:
            stack.pop()
            if path:
                n, held = path.pop()
                bins -= n
                for x, k in held:
                    state.take(x, -n * k)
                    rest += n * k * x
            continue
        nodes -= 1
        n, held = move
        left = rest - n * sum(x * k for x, k in held)
        if bins + n + -(-left // capacity) >= size:
            continue
        for x, k in held:
            state.take(x, n * k)
        path.append(move)
        bins, rest = bins + n, left
        if not rest:
            best, size = list(path), bins
            n, held = path.pop()
            bins -= n
            for x, k in held:
                state.take(x, -n * k)
                rest += n * k * x
            continue
        stack.append(state.moves())
    return best


def slots(runs: list[Run]) -> np.ndarray:
    """(length, first rank, count in a bin, first sequence, offset in it), sorted by length and rank."""
    out, next_rank, bin_ = [], {}, 0
    for n, held in runs:
        offset = 0
        for length, k in held:
            rank = next_rank.get(length, 0)
            out.append((length, rank, k, bin_, offset))
            next_rank[length] = rank + n * k
            offset += length * k
        bin_ += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for at in range(0, len(texts), 2500):
                for i, ids in enumerate(enc.encode(texts[at:at + 2500]), at):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    head = len(ids) % capacity or capacity
                    cuts = [0, *range(head, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        piece.append(p)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(ids[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["__id", "piece", "start", "length", "ids_crc32"])

    return map_batches(src, tokenized, f"__id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, tokenizer, id_col, text_col, capacity))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))  # a few times capacity rows

    group = ["length", "__bucket"]
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = Window.partitionBy(*group).orderBy("__id", "piece", "ids_crc32")
    ranked = (rows.withColumn("__nth", F.row_number().over(nth)).join(counts, group)
              .withColumn("__rank", F.col("__before") + F.col("__nth") - 1).drop("__bucket", "__nth", "__before"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        wide = np.int64(1) << np.int64(48)
        keys = t[:, 0] * wide + t[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            slot = t[np.searchsorted(keys, length * wide + rank, "right") - 1]
            nth = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("__id", "piece", "start", "length", "ids_crc32")),
                 pa.array(slot[:, 3] + nth // slot[:, 2]), pa.array(slot[:, 4] + nth % slot[:, 2] * length)],
                names=["__id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = rows.schema["__id"].dataType.simpleString()
    out = map_batches(ranked.select("__id", "piece", "start", "length", "ids_crc32", F.col("__rank").cast("bigint")), placed,
                      f"__id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("__id", id_col)


def byte_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, byte_bpe())
