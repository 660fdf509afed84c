"""Token ids of whole texts, as the public ``tokenizers`` byte-level BPE file gives them.

``tokenizers`` takes most of its time to split texts and to merge words it has merged before.  Here
texts in Latin letters are split by numpy, every distinct pre-token is merged once a worker (a
bounded cache holds the results), and the ids are put together by gathering.  The merge itself is
``tiktoken`` on ranks read from the same JSON file; a text with any character outside that range,
or with one of the file's special strings, goes to ``tokenizers`` whole.  tests/llm holds both
ways against ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts below this code point are split here (Latin letters, digits, marks and punctuation).
PLAIN = 0x250
CACHE_WORDS = 400_000
#: Characters worked through at a time.
PIECE = 1 << 22

_WHITE = [*range(9, 14), 32, 0x85, 0xA0]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files, back to bytes: printable Latin-1 stands for
    itself, the others follow from U+0100 in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        back = byte_alphabet()
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.special = sorted(special)
        self.beyond = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
        self.merge = tiktoken.Encoding("pre-tokens", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._forget()
        kind = np.zeros(PLAIN, np.uint8)  # 0 other, 1 letter, 2 number, 3 white space, 4 the space itself
        for c in range(PLAIN):
            k = unicodedata.category(chr(c))[0]
            kind[c] = 1 if k == "L" else 2 if k == "N" else 0
        kind[_WHITE] = 3
        kind[32] = 4
        self.kind = kind

    def starts(self, c: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in the code points ``c`` of texts that begin at ``first`` and end at ``last``.

        A run of white space before a word leaves its last character: a space joins the word, any
        other stands alone.  An apostrophe that stands alone before s, t, m, d, re, ve or ll takes them."""
        k = self.kind[c]
        white = k >= 3
        group = np.where(white, 3, k)
        begin = np.ones(len(c), bool)
        begin[1:] = group[1:] != group[:-1]
        begin[first] = True
        end = np.zeros(len(c), bool)
        end[:-1] = begin[1:]
        end[-1:] = True
        final = np.zeros(len(c), bool)
        final[last - 1] = True
        tail = white & end & ~final  # the last white space before a word
        out = begin | tail
        joined = np.zeros(len(c), bool)  # words that a space precedes and joins
        joined[1:] = (tail & (k == 4))[:-1]
        out &= ~joined
        lone = np.flatnonzero((c == 39) & begin & end & ~joined & ~final)
        if len(lone):
            pad = np.concatenate([c, np.zeros(3, c.dtype)])
            text_end = last[np.searchsorted(last, lone, "right")]
            one, two = pad[lone + 1], pad[lone + 2]
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))) & (lone + 2 < text_end)
            take = np.where(short, 1, np.where(long, 2, 0))
            hit = take > 0
            out[lone[hit] + 1] = False
            after = (lone + 1 + take)[hit]
            out[after[after < text_end[hit]]] = True
        return out

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _known(self, names: pa.StringArray) -> np.ndarray:
        """Places of distinct pre-tokens among the remembered ones; new ones are merged first."""
        if len(self.words) > CACHE_WORDS:
            self._forget()
        place = pc.index_in(names, value_set=self.words)
        new = names.filter(pc.is_null(place))
        if len(new):
            ids = [self.merge.encode_ordinary(w) for w in new.to_pylist()]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))])
            self.words = pa.concat_arrays([self.words, new])
            place = place.to_numpy(zero_copy_only=False)
            missing = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
            out = np.where(missing, 0, place).astype(np.int64)
            out[missing] = len(self.words) - len(new) + np.arange(len(new))
            return out
        return place.to_numpy().astype(np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        raw = "".join(texts).encode("utf-8")
        b = np.frombuffer(raw, np.uint8)
        c = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        last = np.cumsum(size)
        at = np.flatnonzero(self.starts(c, (last - size), last))
        byte_at = np.flatnonzero((b & 0xC0) != 0x80)[at]
        offsets = np.concatenate([byte_at, [len(b)]]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        code = self._known(words.dictionary)[words.indices.to_numpy()]
        flat, begin, length = self.flat, self.begin, self.length
        n = length[code]
        done = np.cumsum(n)
        gathered = flat[np.repeat(begin[code] - (done - n), n) + np.arange(int(done[-1]))]
        cut = np.concatenate([[0], done])[np.searchsorted(at, np.concatenate([[0], last]))]
        return [gathered[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def _is_plain(self, t: str) -> bool:
        return (t.isascii() or not self.beyond.search(t)) and not any(s in t for s in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [np.zeros(0, np.uint32)] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self._is_plain(t)]
        done, i = set(plain), 0
        while i < len(plain):
            j, size = i, 0
            while j < len(plain) and (j == i or size + len(texts[plain[j]]) <= PIECE):
                size += len(texts[plain[j]])
                j += 1
            for k, ids in zip(plain[i:j], self._plain([texts[k] for k in plain[i:j]])):
                out[k] = ids
            i = j
        for k, t in enumerate(texts):
            if t and k not in done:
                out[k] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
