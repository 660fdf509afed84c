"""Greedy word-piece token counts by a linear longest-match automaton.

The word pieces come from a byte-level vocabulary file: entries that begin with the space mark
start a word, the others continue one.  A word is matched as a space and its UTF-8 bytes, by the longest
entry again and again; every byte is an entry, so a match always exists.

The automaton is the trie of the vocabulary with two numbers a node: the failure link, the node that the matcher
reaches when the longest entry on its path is split off, and the number of
entries split off on the way.  Matching walks the trie; where no edge fits it adds the node's
popped count and follows its link.  Each step moves forward or up, so the work is linear in the
text, and no piece is ever built.  Words of a block are walked together in numpy, one byte
position at a time, and each distinct word of a block once.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; null, empty and blank texts have no words and no tokens.  Repeated
rows get a row each.  A very long word is walked like any other.  Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_batches, text_bytes, word_hashes
from .tokens import byte_alphabet

SPACE_MARK = "Ġ"


class Automaton:
    """Trie with failure links over (node, byte) edges kept in one sorted array."""

    def __init__(self, vocabulary: list[bytes]):
        heads = {w for w in vocabulary if w[:1] == b" "}
        tails = {w for w in vocabulary if w[:1] != b" "} | {b" "}
        edge: dict[int, int] = {}
        node_of: dict[tuple[bool, bytes], int] = {(True, b""): 0, (False, b""): 1}
        entry = [False, False]
        todo: list[tuple[bool, bytes]] = []
        for is_head, words in ((True, heads), (False, tails)):
            for w in sorted(words):
                for n in range(1, len(w) + 1):
                    key = (is_head, w[:n])
                    if key not in node_of:
                        node_of[key] = len(entry)
                        entry.append(False)
                        todo.append(key)
                        edge[node_of[(is_head, w[:n - 1])] * 256 + w[n - 1]] = node_of[key]
                entry[node_of[(is_head, w)]] = True
        link = np.full(len(entry), -1, np.int64)
        popped = np.zeros(len(entry), np.int64)
        # breadth first: a node's link comes from its parent's
        for is_head, path in sorted(todo, key=lambda k: len(k[1])):
            v, b = node_of[(is_head, path)], path[-1]
            if entry[v]:
                link[v], popped[v] = 1, 1  # the whole path is an entry: continue at the root of tails
                continue
            z, n = node_of[(is_head, path[:-1])], 0
            while True:
                n += int(popped[z])
                z = int(link[z])
                if z < 0:
                    break
                to = edge.get(z * 256 + b)
                if to is not None:
                    link[v], popped[v] = to, n
                    break
        self.keys = np.array(sorted(edge), np.int64)
        self.to = np.array([edge[k] for k in self.keys.tolist()], np.int64)
        self.link, self.popped = link, popped

    def count(self, b: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Entries of the greedy split of each word; words are byte ranges of ``b`` without the leading space."""
        total = np.zeros(len(starts), np.int64)
        order = np.argsort(-lens, kind="stable")
        state = self._step(np.zeros(len(starts), np.int64), np.full(len(starts), 32), total)
        alive = len(order)
        sorted_lens = -lens[order]
        for at in range(int(lens.max()) if len(lens) else 0):
            alive = int(np.searchsorted(sorted_lens, -at, "left"))  # words longer than ``at``
            w = order[:alive]
            count = np.zeros(alive, np.int64)
            state[w] = self._step(state[w], b[starts[w] + at].astype(np.int64), count)
            total[w] += count
        while True:  # the end: split off what is left
            left = np.flatnonzero(state != 1)
            if not len(left):
                return total
            total[left] += self.popped[state[left]]
            state[left] = self.link[state[left]]

    def _step(self, state: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = state.copy()
        wait = np.arange(len(state))
        while len(wait):
            key = out[wait] * 256 + byte[wait]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[at] == key
            out[wait[fits]] = self.to[at[fits]]
            wait = wait[~fits]
            count[wait] += self.popped[out[wait]]
            out[wait] = self.link[out[wait]]
        return out


def vocabulary(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = byte_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(back[c] for c in w) for w in spec["model"]["vocab"] if w not in special]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def count_block(auto: Automaton, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each row of a block of texts."""
    (h,), starts, lens, rows = word_hashes(b, off)
    if not len(h):
        return np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    ends = starts + lens
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)),
                                                                    pa.py_buffer(b[inside])]).dictionary_encode()
    code = packed.indices.to_numpy()
    one = np.zeros(len(packed.dictionary), np.int64)
    one[code] = np.arange(len(code))
    tokens = auto.count(b, starts[one], (ends - starts)[one])[code]
    total = np.concatenate([[0], np.cumsum(tokens)])
    return np.diff(rows), total[rows[1:]] - total[rows[:-1]]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, n_words, n_tokens."""
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = src.schema["__id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary_path)
        for batch in batches:
            b, off = text_bytes(batch.column("__text"))
            words, tokens = [], []
            for i, j in blocks(off):
                w, t = count_block(auto, b[off[i]:off[j]], off[i:j + 1] - off[i])
                words.append(w)
                tokens.append(t)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(np.concatenate(words or none)), pa.array(np.concatenate(tokens or none))],
                                             names=["__id", "n_words", "n_tokens"])

    return map_batches(src, counted, f"__id {kind}, n_words bigint, n_tokens bigint").withColumnRenamed("__id", id_col)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    from .packing import byte_bpe
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, byte_bpe())
