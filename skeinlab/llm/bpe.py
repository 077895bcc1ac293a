"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

A BPE result is fixed by its neighbouring tokens: a token sequence is the result for its text exactly if every pair of
neighbours is the result for the two together. So each prefix of a word has one last token, and a left-to-right machine
needs to remember only the places from which a token may still grow (nodes of the vocabulary's trie) with the tokens
not yet certain before each. Such a memory is a state; states and transitions are made when first met. Tokens come out
as soon as all places agree on them, at most one longest token after their end.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabularies, readable on every executor.
TOKENIZERS = "/opt/tokenizers"
#: Words kept with their tokens, and states kept, by one worker; beyond that they are made anew.
WORDS_KEPT = 300_000
STATES_KEPT = 100_000
#: Neighbouring tokens of which it is kept whether they can be.
PAIRS_KEPT = 500_000

# The public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)


def _printable_bytes() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Encoder of one vocabulary: encode(text) gives ids, token_bytes[id] the bytes of an id."""

    def __init__(self, vocab: dict[str, int], merges: list):
        of = _printable_bytes()
        self.token_bytes = {i: bytes(of[c] for c in t) for t, i in vocab.items() if all(c in of for c in t)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self._merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self._byte_id = {b: vocab[c] for c, b in of.items()}
        self._children: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]
        for i, data in self.token_bytes.items():
            node = 0
            for b in data:
                nxt = self._children[node].get(b)
                if nxt is None:
                    nxt = self._children[node][b] = len(self._token)
                    self._children.append({})
                    self._token.append(-1)
                node = nxt
            self._token[node] = i
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self._states = {(-1, ((0, ()),)): 0}
        self._what = [(-1, ((0, ()),))]
        self._next: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _merged(self, data: bytes) -> list[int]:
        """Tokens of a short byte string by the merges themselves, lowest rank first."""
        ids = [self._byte_id[b] for b in data]
        while len(ids) > 1:
            best = min(((self._merge.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:]))))
            if best[0] == 1 << 60:
                break
            rank, i = best
            ids[i : i + 2] = [self._merge[ids[i], ids[i + 1]][1]]
        return ids

    def _fits(self, before: int, token: int) -> bool:
        """Whether token may follow before (-1: nothing before)."""
        found = self._pairs.get((before, token))
        if found is None:
            head = self.token_bytes[before] if before >= 0 else b""
            found = self._merged(head + self.token_bytes[token]) == ([before, token] if before >= 0 else [token])
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            self._pairs[before, token] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, places = self._what[state]
        grown, ended = [], None
        for node, pending in places:
            node = self._children[node].get(byte)
            if node is None:
                continue
            grown.append((node, pending))
            token = self._token[node]
            if ended is None and token >= 0 and self._fits(pending[-1] if pending else last, token):
                ended = (*pending, token)
        if ended is None:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        grown = [(node, pending) for node, pending in grown if self._children[node]]
        grown.append((0, ended))
        sure = 0
        shortest = min(len(p) for _, p in grown)
        while sure < shortest and all(p[sure] == ended[sure] for _, p in grown):
            sure += 1
        out = ended[:sure]
        made = (out[-1] if out else last, tuple((node, p[sure:]) for node, p in grown))
        known = self._states.get(made)
        if known is None:
            known = self._states[made] = len(self._what)
            self._what.append(made)
            self._next.append({})
        return known, out

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        if len(self._what) > STATES_KEPT:
            self._reset()
        state, out = 0, []
        for byte in word:
            row = self._next[state]
            step = row.get(byte)
            if step is None:
                step = row[byte] = self._step(state, byte)
            state = step[0]
            if step[1]:
                out.extend(step[1])
        out.extend(self._what[state][1][-1][1])
        return tuple(out)

    def words(self, text: str) -> Iterator[tuple[str, tuple[int, ...]]]:
        """The pieces that the pattern splits text into, with their tokens."""
        known = self._words
        for word in _SPLIT.findall(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                ids = self.encode_word(word.encode("utf-8"))
                if len(word) <= 64:
                    known[word] = ids
            yield word, ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of text without special tokens; null and empty text give an empty list."""
        ids: list[int] = []
        for _, more in self.words(text or ""):
            ids.extend(more)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes certain, token by token; bytes that are no UTF-8 come out as U+FFFD."""
        machine = Utf8Machine()
        for i in ids:
            yield machine.feed(self.token_bytes[int(i)])
        yield machine.end()


class Utf8Machine:
    """Incremental UTF-8: the state is the bytes still due, what came so far, and the range the next byte must be in."""

    def __init__(self) -> None:
        self.due, self.point, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.point, self.due, self.low, self.high = self.point << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.due = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.point = b & (0x3F >> self.due)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.due = self.due, 0
        return "�" if left else ""


@lru_cache(maxsize=2)
def transducer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.json") -> Transducer:
    """One per worker process and vocabulary file."""
    with open(f"{folder}/{name}", encoding="utf-8") as f:
        model = json.load(f)["model"]
    return Transducer(model["vocab"], model["merges"])


def encode_column(text: str | Column, folder: str = TOKENIZERS) -> Column:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        machine = transducer(folder)
        return pd.Series([np.array(machine.encode(t), dtype=np.int32) for t in texts])

    return encode(text)


def token_count_column(text: str | Column, folder: str = TOKENIZERS) -> Column:
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        machine = transducer(folder)
        return pd.Series([sum(len(ids) for _, ids in machine.words(t or "")) for t in texts], dtype="int64")

    return count(text)


def decode_column(ids: str | Column, folder: str = TOKENIZERS) -> Column:
    @F.pandas_udf(T.StringType())
    def decode(rows: pd.Series) -> pd.Series:
        machine = transducer(folder)
        return pd.Series([None if r is None else machine.decode(r) for r in rows], dtype=object)

    return decode(ids)


def encode_documents(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids of every document, whole texts; null and empty texts give an empty list. Rows stay as many as
    they are, repeated ones too, and other columns aren't looked at. No shuffle."""
    return documents.select("doc_id", encode_column("text", folder).alias("ids"))
