import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from examlytics.llm import exact_dedup as m


def test_hash_composes():
    rng = np.random.default_rng(1)
    b = rng.integers(0, 256, 1000, dtype=np.uint8)
    for f in (0, 1):
        table = m._power_table(f, 1000)
        whole = m.chunk_hash(b, f, table)
        slow = sum(int(x) * pow(m.FACTORS[f], i, m.PRIMES[f]) for i, x in enumerate(b)) % m.PRIMES[f]
        assert whole == slow
        for cuts in ([0, 1, 7, 1000], [0, 500, 1000], [0, 333, 334, 999, 1000]):
            parts = [(m.chunk_hash(b[i:j], f, table), j - i) for i, j in zip(cuts, cuts[1:])]
            assert m.combine(parts, f) == whole


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = Counter()
    for t, ids in groups.items():
        top = max(ids, key=lambda x: -1 if x is None else x)
        sha = hashlib.sha256(t.encode()).hexdigest()
        spare = 1
        for i in ids:
            kept = i == top and spare == 1
            spare -= kept
            out[(i, top, len(ids), kept, sha)] += 1
    return out


@pytest.mark.parametrize("chunk", [7, 65536])
def test_groups_match_brute_force(docs, chunk):
    got = Counter(tuple(r) for r in m.exact_groups(docs, chunk_bytes=chunk).drop("__key").collect())
    assert got == brute(docs.collect())


def test_equal_fingerprints_are_compared(docs, monkeypatch):
    """With one hash for all texts of one length, the chunkwise comparison still tells them apart."""
    monkeypatch.setattr(m, "PRIMES", (1, 1))
    prints = m.fingerprints(docs, chunk_bytes=16)
    flat = prints.selectExpr("__id", "__key", "__sha", "0L h1", "0L h2", "__n").toDF(*prints.columns)
    odd = {bytes(r[0]) for r in m.differing(docs, flat, chunk_bytes=16).collect()}
    rows = flat.collect()
    top = {}
    for r in rows:
        rank = (-1 if r["__id"] is None else r["__id"], bytes(r["__key"]))
        if r["__n"] not in top or rank > top[r["__n"]][0]:
            top[r["__n"]] = (rank, r["__sha"])
    assert odd == {bytes(r["__key"]) for r in rows if r["__sha"] != top[r["__n"]][1]}


def test_drop_copies_keeps_columns(docs):
    kept = m.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.text or "" for r in rows) == sorted({r.text or "" for r in docs.collect()})


def test_empty(no_docs):
    assert m.exact_groups(no_docs).count() == 0 and m.drop_copies(no_docs).count() == 0
