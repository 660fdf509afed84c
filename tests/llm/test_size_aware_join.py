import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from examlytics.llm import near_links, size_aware_join as j
from examlytics.llm.minhash_dedup import shingle_sets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORDS.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def roots(sets, percent):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            up[find(a)] = find(b)
    return [find(i) for i in range(len(sets))]


def check(docs, percent=80, **options):
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]
    root = roots(sets, percent)
    expected = Counter()
    for i, r in enumerate(rows):
        ids = [x.doc_id for x, y in zip(rows, root) if y == root[i] and x.doc_id is not None]
        expected[(r.doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else r.doc_id)] += 1
    assert Counter(tuple(r) for r in j.jaccard_join(docs, percent=percent, **options).collect()) == expected


def test_matches_brute_force(docs):
    check(docs)


def family(n, words, edits, seed):
    """Near copies of one text: each has a few words of its own."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 1000, words)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(words, edits, replace=False):
            w[at] = f"x{i}-{at}"
        out.append(" ".join(w))
    return out


def test_small_and_large_sets_near_the_threshold(spark):
    """Sets of every size from 1 to 60 around the boundary, with partners just over and under the threshold."""
    rng = np.random.default_rng(3)
    texts = []
    for n in range(1, 61):
        w = [f"v{i}" for i in rng.integers(0, 200, n + 4)]
        texts += [" ".join(w), " ".join(w[:-1]), " ".join(w + ["tail"]), " ".join(w[: max(5, len(w) * 4 // 5)]), " ".join([*w[:-1], "end"]),
                  " ".join(["other", *w[1:]])]
    texts += family(30, 60, 1, 1) + family(30, 60, 2, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check(docs)
    check(docs, 60)


def test_subsets_find_all_pairs_of_small_sets():
    """For every pair of sizes that can link, both enumerate subsets of the least number of elements that the threshold needs."""
    for s in range(1, 15):
        for r in range(s, 15):
            c = int(near_links.needed(s, r, 80))
            if any(100 * k >= 80 * (s + r - k) for k in range(s + 1)):
                assert 100 * c >= 80 * (s + r - c) and 100 * (c - 1) < 80 * (s + r - c + 1)
                assert c in j.shared_counts(s, 14, 80) and c in j.shared_counts(r, 14, 80)


def test_boundary_follows_cost():
    assert j.boundary({}, 80) == 0
    low = j.boundary({n: 1000 for n in range(1, 60)}, 80)
    assert 1 <= low <= 14
    assert j.boundary({**{n: 1000 for n in range(1, 60)}, low + 1: 0, low + 2: 0}, 80) >= low
    assert j.boundary({40: 1000}, 80) < 40          # far too many subsets


@pytest.mark.parametrize("most", [0, 7, 12])
def test_any_boundary_gives_the_same_links(spark, monkeypatch, most):
    monkeypatch.setattr(j, "boundary", lambda histogram, percent: most)
    rng = np.random.default_rng(8)
    texts = []
    for n in range(1, 18):
        w = [f"v{i}" for i in rng.integers(0, 300, n + 4)]
        texts += [" ".join(w), " ".join(w[:-1]), " ".join(w + ["tail"]), " ".join(w + ["tail", "end"]), " ".join([*w[:-1], "end"])]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_cells_decide_order_only(docs):
    check(docs, cells=j._CHUNK)


def test_no_docs(no_docs):
    assert j.jaccard_join(no_docs).count() == 0


def links_of(spark, n, edits):
    import pyarrow as pa
    sets = list(shingle_sets(pa.array(family(n, 120, edits, 5))))
    rows = [(i.to_bytes(16, "big"), [7, 9], bytearray(s.tobytes()), len(s)) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "class binary, keys array<bigint>, set binary, size bigint").cache()
    members = table.select(F.explode("keys").alias("bucket"), "class", "size").withColumn("root", F.col("class"))
    got = near_links.spanning_links(members, table, 80).collect()
    return sets, [(int.from_bytes(r.u, "big"), int.from_bytes(r.v, "big")) for r in got]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_links_grow_with_the_family_not_its_pairs(spark, monkeypatch, edits):
    """Families whose pairs lie over, around and under the threshold: at most one link a set and pair of tiles, and
    they join what all links join."""
    monkeypatch.setattr(near_links, "TILE_SETS", 256)
    for n in (300, 600, 1200):
        sets, links = links_of(spark, n, edits)
        assert len(links) <= 2 * n * (-(-n // 256))
        assert all(100 * near_links.overlap(sets[a], sets[b]) >= 80 * (len(sets[a]) + len(sets[b]) - near_links.overlap(sets[a], sets[b])) for a, b in links)
        if n == 300:
            want = roots([set(s.tolist()) for s in sets], 80)
            up = list(range(n))

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in links:
                up[find(a)] = find(b)
            got = [find(i) for i in range(n)]
            assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_lists_of_two_need_no_join_with_their_hubs(spark, monkeypatch):
    """Pairs of near copies only: every inverted list has two members."""
    joined = []
    join = j.salted_join
    monkeypatch.setattr(j, "salted_join", lambda left, right, *a, **k: ("lo" in right.columns and joined.append(right.count())) or join(left, right, *a, **k))
    texts = [" ".join(f"p{p}-{x if x != 10 * c else 'own'}" for x in range(120)) for p in range(6) for c in (1, 2)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert joined == [0]


def test_listed_elements_are_read_and_shuffled_once(spark, monkeypatch):
    """One pass over the texts makes the lists: copies post once a task, elements of one set end in it."""
    made = []
    post = j.postings
    monkeypatch.setattr(j, "postings", lambda *a, **k: made.append(post(*a, **k)) or made[-1])
    texts = [" ".join(f"p{p}-{x if x != 10 * c else 'own'}" for x in range(120)) for p in range(3) for c in (1, 2, 2, 2)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    assert len(made) == 1
    sizes = Counter(r.tag for r in made[0].collect())
    assert len(sizes) == 6 and set(sizes.values()) == {j.listed(116, 80)}


def test_shared_lists(spark):
    """Tags are 256 k + size code; a list of one set, however often, and sets too unlike in size go."""
    lists = {1: [(5, 9)], 2: [(5, 9), (5, 9)], 3: [(7, 9), (-4, 4), (7, 9)], 4: [(1, 9), (2, 9), (3, 9), (2, 9)], 5: [(1, 9), (2, 15)],
             6: [(1, 20), (2, 9), (3, 20), (4, 40), (5, 15), (6, 25)]}
    rows = [(b, 256 * k + code) for b, v in lists.items() for k, code in v]
    got = j.shared_lists(spark.createDataFrame(rows, "bucket long, tag long").repartition(3), 80).collect()
    assert sorted((r.bucket, r.tag // 256, r.hi and r.hi // 256, r.n) for r in got) == [
        (3, -4, 7, 2), (4, 1, 3, 3), (4, 2, None, 3), (4, 3, 3, 3), (6, 1, 6, 4), (6, 3, None, 4), (6, 5, None, 4), (6, 6, 6, 4)]


def test_size_codes_pass_every_pair_that_can_link():
    code = lambda n: j._tag(bytes(16), n) & 255
    for percent in (60, 80, 85, 100):
        for n in [*range(1, 2000), 10_000, 99_999, 250_000, 1_000_000]:
            assert code(100 * n // percent) - code(n) <= j.size_steps(percent)
    assert -(1 << 63) <= j._tag(b"\x80" * 16, 1) < j._tag(b"\x7f" * 16, 1) < 1 << 63


def test_only_copies_and_linked_rows_are_named_by_a_join(spark, monkeypatch):
    named = []
    join = j.salted_join
    monkeypatch.setattr(j, "salted_join", lambda left, right, keys, *a, **k: (keys == ["digest"] and named.append(right.count())) or join(left, right, keys, *a, **k))
    alone = [" ".join(f"d{i}-{x}" for x in range(40)) for i in range(30)]
    pair = [" ".join(f"p{x if x != 10 * c else 'own'}" for x in range(120)) for c in (1, 2)]
    rows = [*enumerate(alone + pair), (50, alone[0]), (None, alone[1]), (None, "only this"), (None, "no id"), (None, "no id"), (60, None), (None, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert named == [5]


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_a_family_of_several_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(j, "BLOCK", 8)
    monkeypatch.setattr(j, "FEW", few)
    texts = family(60, 80, 1, 4) + family(7, 90, 1, 6) + family(40, 100, 3, 7)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_lists_that_share_leading_bits_lose_nothing(spark, monkeypatch, docs):
    monkeypatch.setattr(j, "NAMED", 6)
    check(docs)
