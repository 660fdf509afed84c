import re
from collections import Counter

import numpy as np

from examlytics.llm import minhash_dedup as m, near_links
from examlytics.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORDS.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def groups(sets):
    """Root of each set: union-find over all pairs."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def check(docs):
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]
    root = groups(sets)
    expected = Counter()
    for i, r in enumerate(rows):
        ids = [x.doc_id for x, y in zip(rows, root) if y == root[i] and x.doc_id is not None]
        comp = (min(ids) if ids else None) if sets[i] else r.doc_id
        expected[(r.doc_id, len(sets[i]), comp, r.doc_id == comp)] += 1
    got = Counter(tuple(r) for r in m.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == expected
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns
    left = Counter(i for i in root if sets[i])
    assert sum(bool(shingles(r.text)) for r in kept.collect()) == len(left)


def test_matches_brute_force(docs):
    check(docs)


def test_chain_in_small_tiles(spark, monkeypatch):
    """A chain of small edits: neighbours link, the ends do not; tiles of two classes lose none."""
    monkeypatch.setattr(near_links, "TILE_SETS", 2)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10_000, 150)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words[i * 5] = f"x{i}"
        if i % 7 == 0:
            words[i * 5 + 2:i * 5 + 4] = ["y", f"y{i}"]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_set_is_of_whole_text_in_any_block(texts, monkeypatch):
    import pyarrow as pa
    column = pa.array(texts, pa.string())
    whole = [x.tolist() for x in m.shingle_sets(column)]
    assert [len(x) for x in whole] == [len(shingles(t)) for t in texts]
    from examlytics.llm import common
    monkeypatch.setattr(common.blocks, "__defaults__", (100,))
    monkeypatch.setattr(common, "BLOCK_BYTES", 50)
    assert [x.tolist() for x in m.shingle_sets(column)] == whole


def test_signature_bound():
    """Pairs at the threshold pass signature verification."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        x = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
        y = np.concatenate([x[:368], rng.integers(0, 1 << 62, 32, dtype=np.uint64)])
        two = [(m.minima(s, m.SIGNATURE, 3) >> np.uint64(20)) & np.uint64(3) for s in (x, y)]
        assert (two[0] != two[1]).sum() <= m.most_unlike()


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(300 + i, 301 + i) for i in range(40)]

    def key(i):
        return bytearray(i.to_bytes(16, "big"))

    got = components(spark.createDataFrame([(key(a), key(b)) for a, b in edges], "u binary, v binary")).collect()
    found = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in got}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u binary, v binary")).count() == 0


def test_empty(no_docs):
    assert m.near_duplicates(no_docs).count() == 0 and m.keep_one(no_docs).count() == 0
