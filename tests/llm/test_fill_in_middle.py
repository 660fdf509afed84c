import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from examlytics.llm import fill_in_middle as m
from examlytics.llm.boundary_set import Array, Bitmap, BoundarySet, Runs


def line_units(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


@pytest.mark.parametrize("kind, values", [
    (Array, np.arange(0, 3000, 3)), (Bitmap, np.unique(np.random.default_rng(1).integers(0, 1 << 16, 30_000))), (Runs, np.arange(100, 60_000)),
    (Runs, np.concatenate([np.arange(i, i + 500) for i in range(0, 60_000, 1000)]))])
def test_each_container_selects(kind, values):
    s = BoundarySet(values)
    assert isinstance(s.containers[0], kind) and len(s) == len(values)
    assert [s.select(k) for k in range(0, len(values), 37)] == values[::37].tolist() and s.select(len(values) - 1) == values[-1]


def test_containers_of_all_kinds_together():
    rng = np.random.default_rng(2)
    values = np.concatenate([np.arange(0, 65_536), 65_536 * 3 + np.sort(rng.choice(65_536, 40_000, False)), 65_536 * 9 + np.array([0, 7, 65_535]), [1 << 40]])
    s = BoundarySet(values)
    assert [type(c) for c in s.containers] == [Runs, Bitmap, Array, Runs] or [type(c) for c in s.containers][:3] == [Runs, Bitmap, Array]
    for k in [0, 65_535, 65_536, 65_537, 105_535, 105_536, 105_538, 105_539]:
        assert s.select(k) == values[k]
    for bad in (-1, len(values)):
        with pytest.raises(IndexError):
            s.select(bad)
    assert len(BoundarySet(np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "\n\na", "é\nß😀\r\nx", "line\n" * 70_000 + "ü"])
def test_boundaries_are_the_lines(text, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_BYTES", 4097)
    s = m.line_boundaries(np.frombuffer(text.encode(), np.uint8))
    ends = [0, *np.cumsum([len(u) for u in line_units(text)])]
    assert len(s) == len(ends)
    for k in {0, len(ends) // 3, len(ends) // 2, len(ends) - 1}:
        assert s.select(k) == ends[k]


def expected(doc_id, text, fim=100, spm=50):
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
    u = line_units(text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or h[2] % 100 >= fim or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(u), "plain", None, None, text
    p, i, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return doc_id, len(u), "spm", len(p), len(i), f"<S>{s}<P>{p}<M>{i}"
    return doc_id, len(u), "psm", len(p), len(i), f"<P>{p}<S>{s}<M>{i}"


HARD = ["a\nb\nc", "<P>in\nside", "x<M>", "<S\n>P>\n<", "<\nP>\n<P", "\n" * 50, "é😀\n" * 40, "<<\n<S\n<M\n>\n", "one line", " \n\t\n", "\r\n\r\n"]


def test_rows_and_round_trip(spark, docs):
    rows = [(i, t) for i, t in enumerate(HARD * 6)] + [(None, HARD[0]), (3, None), (3, "")]
    for table in (docs, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)):
        got = m.fill_in_middle(table).withColumn("back", m.restored()).collect()
        want = [expected(r.doc_id, r.text) + (r.text or "",) for r in table.select("doc_id", "text").collect()]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_shares_of_forms(spark):
    table = spark.createDataFrame([(i, f"a{i}\nb\nc\n") for i in range(400)], "doc_id long, text string")
    none = {r.form for r in m.fill_in_middle(table, fim_percent=0).collect()}
    assert none == {"plain"}
    some = m.fill_in_middle(table, fim_percent=50, spm_percent=0).groupBy("form").agg(F.count("*").alias("n")).collect()
    assert {r.form for r in some} == {"plain", "psm"} and all(140 < r.n < 260 for r in some)
    other = {tuple(r) for r in m.fill_in_middle(table, seed=8).collect()}
    assert other != {tuple(r) for r in m.fill_in_middle(table).collect()}


def test_no_docs(no_docs):
    assert m.fill_in_middle(no_docs).count() == 0
