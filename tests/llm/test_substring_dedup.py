import hashlib
import re
from collections import Counter

from examlytics.llm import substring_dedup as m

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    def rank(i):
        return (i is not None, i)

    words = [WORDS.findall(r.text or "") for r in rows]
    first = {}
    for r, w in zip(rows, words):
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            if key not in first or rank(r.doc_id) < rank(first[key]):
                first[key] = r.doc_id
    out = Counter()
    for r, w in zip(rows, words):
        drop = set()
        for k in range(len(w) - 49):
            if rank(first[tuple(w[k:k + 50])]) < rank(r.doc_id):
                drop.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in drop)
        out[(r.doc_id, len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    return out


def got(docs):
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    full = Counter(tuple(r) for r in m.substring_dedup(docs, with_text=True).select(*cols).collect())
    assert Counter(tuple(r) for r in m.substring_dedup(docs).collect()) == Counter(x[:4] for x in full.elements())
    return full


def test_cover():
    assert {(a - b) % m.PERIOD for a in m.COVER for b in m.COVER} == set(range(m.PERIOD))


def test_matches_brute_force(docs):
    expected = brute(docs.collect())
    assert sum(n for _, _, n, _, _ in expected) > 0
    assert got(docs) == expected


def test_passages_of_every_length_and_place(spark):
    """Passages of 48 to 120 words at shifting places; one differs in white space, one in case; one document repeats itself."""
    word = [f"w{i}" for i in range(3000)]
    shared = [f"s{i}" for i in range(120)]
    rows = []
    for i in range(70):
        n = 48 + i % 9 if i < 60 else 120
        own = word[i * 40:i * 40 + 40]
        rows.append((i, " ".join(own[:i % 33] + shared[i % 7:i % 7 + n] + own[i % 33:])))
    rows += [(200, "\n\t ".join(shared)), (201, " ".join(shared).upper()), (202, " ".join([*word[:60], "x", *word[:60]])), (5, " ".join(shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(docs) == brute(docs.collect())


def test_blocks_do_not_change_results(docs, texts):
    import numpy as np
    import pyarrow as pa
    from examlytics.llm import common
    b, off = common.text_bytes(pa.array(texts, pa.string()))
    (h,), starts, lens, rows = common.word_hashes(b, off)
    words = [w for t in texts for w in (t or "").encode().split()]
    assert [b[s:s + n].tobytes() for s, n in zip(starts, lens)] == words
    assert np.diff(rows).tolist() == [len((t or "").split()) for t in texts]
    assert len(set(h.tolist())) == len(set(words))
    by_word = {}
    assert all(by_word.setdefault(w, x) == x for w, x in zip(words, h.tolist()))


def test_empty(no_docs):
    assert m.substring_dedup(no_docs).count() == 0


def test_only_wanted_texts_are_shuffled_and_once(spark):
    """Repeated rows and a null id among them; the rows of the bit table's pass stay dealt for the join."""
    rows = [(i, i, f"text {i}") for i in range(300)] + [(None, 7, "text 7"), (7, 7, "text 7")]
    texts = spark.createDataFrame(rows, "__id long, __tag long, __text string")
    wanted = spark.createDataFrame([(None, 7, [1]), (7, 7, [2]), (9, 9, [3])], "__id long, __tag long, places array<int>")
    found = m.with_places(m.texts_of(texts, wanted), wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "__hash" in plan
    assert Counter((r[0], r[2], *r[3]) for r in found.collect()) == Counter([(None, "text 7", 1), (7, "text 7", 2), (9, "text 9", 3)])


def test_single_texts_are_not_joined_for_the_smallest_id(spark, monkeypatch):
    seen = []
    join = m.salted_join
    monkeypatch.setattr(m, "salted_join", lambda left, right, *a, **k: seen.append(right.count()) or join(left, right, *a, **k))
    docs = spark.createDataFrame([(i, f"{'w ' * 60}{max(i, 3)}") for i in range(40)] + [(None, "x"), (5, "x")], "doc_id long, text string")
    assert got(docs) == brute(docs.collect())
    assert set(seen) == {2}
