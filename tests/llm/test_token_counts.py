from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from examlytics.llm import token_counts as m
from examlytics.llm.common import text_bytes
from examlytics.llm.packing import byte_bpe

SMALL = [bytes([b]) for b in b"abcd "] + [b"ab", b"abcd", b"bcd", b"cda", b" a", b" ab", b" abca", b"aaaa", b" dd"]


def greedy(word, vocab):
    heads = {w for w in vocab if w[:1] == b" "}
    rest, left, n = (vocab - heads) | {b" "}, b" " + word, 0
    entries = heads
    while left:
        k = next(k for k in range(len(left), 0, -1) if left[:k] in entries)
        left, n, entries = left[k:], n + 1, rest
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=12), max_size=6))
def test_automaton_is_greedy(words):
    b, off = text_bytes(pa.array([" ".join(words)]))
    w, t = m.count_block(m.Automaton(SMALL), b, off)
    assert w.tolist() == [len(words)] and t.tolist() == [sum(greedy(x.encode(), set(SMALL)) for x in words)]


def test_public_vocabulary(docs):
    vocab = set(m.vocabulary(byte_bpe()))
    memo = {}
    want = Counter()
    for r in docs.collect():
        words = (r.text or "").encode().split()
        for w in words:
            if w not in memo:
                memo[w] = greedy(w, vocab)
        want[(r.doc_id, len(words), sum(memo[w] for w in words))] += 1
    assert Counter(tuple(r) for r in m.token_counts(docs, byte_bpe()).collect()) == want


def test_long_word_and_empty(no_docs):
    auto = m.Automaton(SMALL)
    b, off = text_bytes(pa.array(["abcd" * 5000, None, "", " \t\n"]))
    w, t = m.count_block(auto, b, off)
    assert w.tolist() == [1, 0, 0, 0] and t[0] == greedy(b"abcd" * 5000, set(SMALL)) and not np.any(t[1:])
    assert m.token_counts(no_docs, byte_bpe()).count() == 0
