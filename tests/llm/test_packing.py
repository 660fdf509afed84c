import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from examlytics.llm import packing as m
from examlytics.llm.tokens import Encoder


def smallest(items, cap):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in set(bins):
            if b + items[i] <= cap:
                j = bins.index(b)
                place(i + 1, [*bins[:j], b + items[i], *bins[j + 1:]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def histogram(items):
    out = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return out


def test_small_plans_are_optimal():
    rng = random.Random(3)
    for _ in range(120):
        cap = rng.choice([10, 20, 31])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 10))]
        runs = m.plan(histogram(items), cap)
        assert all(sum(x * k for x, k in held) <= cap for _, held in runs)
        placed = defaultdict(int)
        for n, held in runs:
            for x, k in held:
                placed[x] += n * k
        assert placed == histogram(items)
        assert sum(n for n, _ in runs) == smallest(items, cap)


def test_completion_beats_best_fit():
    """An instance where best-fit decreasing needs a bin more."""
    counts = histogram([6, 5, 4, 4, 3, 3, 3, 2, 2, 2, 2, 2] * 1)
    best = sum(n for n, _ in m.plan(counts, 10))
    assert best == -(-sum(k * n for k, n in counts.items()) // 10) <= sum(n for n, _ in m.best_fit(counts, 10))


@pytest.fixture(scope="module")
def whole():
    return Encoder(m.byte_bpe())


def test_ids_are_those_of_the_tokenizer(whole):
    rng = random.Random(5)
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", "''", " ", "  ", "\n", "\t", " ", "\u0085", "\x1c", "é", "ß", "1", "²", "!", "Ab", "re", "s",
             "ª", "ɏ", "\r\n", "x", "́", "漢字", "<|endoftext|>", "🙂"]
    texts = ["".join(rng.choice(parts[:27] if i % 8 else parts) for _ in range(rng.randint(0, 14))) for i in range(4000)]
    got = whole.encode(texts)
    want = whole.whole.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_pack(docs, whole):
    cap = 64
    rows = m.pack(docs, m.byte_bpe(), capacity=cap).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():  # gapless from 0, within the capacity
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
    want = defaultdict(list)
    for d in docs.collect():
        ids = np.array([*whole.whole.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % cap or cap
        lo = 0
        for p, hi in enumerate([head, *range(head + cap, len(ids) + 1, cap)] if len(ids) > cap else [len(ids)]):
            want[d.doc_id].append((p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
            lo = hi
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    total = sum(r.length for r in rows)
    assert len(by_seq) <= -(-total // cap) + 1


def test_empty(no_docs):
    assert m.pack(no_docs, m.byte_bpe()).count() == 0 and m.plan({}) == []
