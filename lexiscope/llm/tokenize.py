"""Problem 8: byte-pair encoding by a tokenization automaton.

The automaton reads tokens. Its states are sets of tokens that may come next; a text's encoding is the one path of arcs
whose labels spell the text. Merges are compiled in by gadgets, in order of rank. For a merge (u, v):

* all arcs labelled u end in one state q; a copy q' of q without the arc v takes them over (u may no longer be followed by v);
* every state with an arc u gets an arc uv that ends where q's arc v ended.

``MergeGadgets`` builds the whole table for a small vocabulary. For 50,000 merges the table of states by tokens has over
10^9 cells and a corpus touches few of them, so ``Automaton`` resolves an arc when it is first needed, by walking back
through the gadgets that made its two labels, and keeps it in a transition table. Both give the same arcs (tested).

Encoding a word is one pass over its bytes: at each reachable position the state (the last label) and the tokens that
start there give the next positions. A prefix has exactly one encoding, so a position has one state. Decoding emits labels.

Null and empty texts have the ids []. Special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: fixed value: the public pre-splitting pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: words and arcs that a worker keeps; beyond that it forgets them and resolves them again
KEPT_WORDS = 200_000
KEPT_ARCS = 2_000_000


def byte_letters() -> str:
    """The printable letter that stands for each byte in vocabularies of this kind: itself, or the next code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


def read_vocabulary(content: bytes) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Token ids and merges in order of rank."""
    model = json.loads(content)["model"]
    return model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


class MergeGadgets:
    """The full automaton, by successive gadgets; for small vocabularies and for testing."""

    def __init__(self, letters: str, merges: list[tuple[str, str]]):
        self.arcs: list[set[str]] = [set(letters)]
        self.target = dict.fromkeys(letters, 0)
        for u, v in merges:
            q = self.target.get(u)
            if q is None or v not in self.arcs[q]:
                continue
            ends = self.target[v]
            self.arcs.append(self.arcs[q] - {v})
            self.target[u] = len(self.arcs) - 1
            for arcs in self.arcs:  # the copy too: where u is v it has no arc u, which makes the leftmost pair win
                if u in arcs:
                    arcs.add(u + v)
            self.target[u + v] = ends

    def allows(self, left: str, right: str) -> bool:
        return right in self.arcs[self.target[left]]


class Automaton:
    """Arcs on demand, words by table-driven transitions."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], pattern: str = PATTERN):
        import regex

        self.pre_split = regex.compile(pattern).findall
        self.letters = byte_letters()
        self.ids = vocabulary
        self.parts = {u + v: (u, v, rank) for rank, (u, v) in reversed(list(enumerate(merges)))}
        self.rank = {pair: rank for rank, pair in enumerate(merges)}
        self.starts: set[str] = set()
        for token in [*self.letters, *self.parts]:
            for n in range(1, len(token) + 1):
                self.starts.add(token[:n])
        self.tokens = {*self.letters, *self.parts}
        self.arc: dict[tuple[str, str], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.labels: dict[int, bytes] | None = None

    def allows(self, left: str, right: str) -> bool:
        """Whether the state after ``left`` has the arc ``right``: no gadget that made the two labels removed it."""
        key = (left, right)
        known = self.arc.get(key)
        if known is None:
            if len(self.arc) >= KEPT_ARCS:
                self.arc.clear()
            known = self.arc[key] = self._resolve(left, right)
        return known

    def _resolve(self, left: str, right: str) -> bool:
        until = len(self.rank)
        while True:
            if self.rank.get((left, right), until) < until:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                until, left = a[2], a[1]
            else:
                until, right = b[2] + 1, b[0]  # of two equal merges the left one wins

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8").decode("latin-1").translate(self.letters) if not word.isascii() else word.translate(self.letters)
        if raw in self.tokens:
            return [self.ids[raw]]
        n = len(raw)
        state: list[str | None] = [None] * (n + 1)
        for i in range(n):
            last = state[i]
            if i and last is None:
                continue
            for j in range(i + 1, n + 1):
                piece = raw[i:j]
                if piece not in self.starts:
                    break
                if state[j] is None and piece in self.tokens and (not i or self.allows(last, piece)):
                    state[j] = piece
        out = []
        while n:
            out.append(self.ids[state[n]])
            n -= len(state[n])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self.words, []
        for word in self.pre_split(text):
            ids = words.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(words) >= KEPT_WORDS:
                    words.clear()
                words[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if self.labels is None:
            byte = {c: b for b, c in enumerate(self.letters)}
            self.labels = {i: bytes(byte[c] for c in t) for t, i in self.ids.items() if all(c in byte for c in t)}
        return b"".join(self.labels[i] for i in ids).decode("utf-8")


_loaded: dict[str, Automaton] = {}


def _packed(path: str) -> tuple[str, bytes]:
    """The vocabulary as it travels to the workers: a key and the compressed content."""
    content = Path(path).read_bytes()
    return hashlib.sha256(content).hexdigest(), zlib.compress(content, 6)


def _automaton_of(key: str, packed: bytes) -> Automaton:
    """One automaton per process and vocabulary."""
    if key not in _loaded:
        _loaded[key] = Automaton(*read_vocabulary(zlib.decompress(packed)))
    return _loaded[key]


def automaton(path: str = TOKENIZER) -> Automaton:
    return _automaton_of(*_packed(path))


def encode(text: Column | str, path: str = TOKENIZER) -> Column:
    """Ids of each text, [] for null and empty ones."""
    vocabulary = _packed(path)

    @F.pandas_udf(ArrayType(IntegerType(), containsNull=False))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _automaton_of(*vocabulary)
        for texts in batches:
            yield pd.Series([own.encode(t) for t in texts], dtype=object)

    return ids(F.col(text) if isinstance(text, str) else text)


def count_tokens(text: Column | str, path: str = TOKENIZER) -> Column:
    """Number of ids of each text, 0 for null and empty ones."""
    vocabulary = _packed(path)

    @F.pandas_udf(IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _automaton_of(*vocabulary)
        for texts in batches:
            yield pd.Series([len(own.encode(t)) for t in texts], dtype="int32")

    return count(F.col(text) if isinstance(text, str) else text)


def decode(ids: Column | str, path: str = TOKENIZER) -> Column:
    """The text of each list of ids, by the labels of its arcs; '' for no ids and null for null."""
    vocabulary = _packed(path)

    @F.pandas_udf(StringType())
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _automaton_of(*vocabulary)
        for lists in batches:
            yield pd.Series([None if x is None else own.decode(x) for x in lists], dtype=object)

    return labels(F.col(ids) if isinstance(ids, str) else ids)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id, ids) of every row. One narrow stage: no shuffle, and a row's cost follows its own length."""
    return docs.select(id_col, encode(F.col(text_col), path).alias("ids"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id, n_ids, same) of every row: whether decoding gives the text back; a null text comes back empty."""
    coded = docs.select(id_col, text_col, encode(F.col(text_col), path).alias("ids"))
    return coded.select(id_col, F.size("ids").alias("n_ids"), (decode("ids", path) == F.coalesce(F.col(text_col), F.lit(""))).alias("same"))
