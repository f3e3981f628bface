"""Operator 8: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so a pyahocorasick automaton finds
every token of a word in one pass. Encoding takes the longest token at each
place, keeps it if it is compatible with the token before it (memoised), else
tries the next shorter one, and steps back when none is left; places found
dead are marked, so the work is linear in the word. The result equals the
merge loop's. Words are the matches of the split pattern; the packed ids of
recent words, and of recent stretches between spaces, are kept in bounded memos.
An executor runs four workers here for two tasks (one that encodes and one that
decodes for each), so decoding keeps a table of bytes and no encoder, and
batches are worked off in pieces of PIECE_BYTES.

Ids are 32-bit unsigned, little-endian, packed in one binary value per row.

Edge cases: a null text encodes as empty; null ids decode to empty bytes;
an id outside the vocabulary raises; rows are handled one by one, so
repeated rows and null doc_ids come out as they went in; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import documents, give_back, map_batches
from shiftlake.llm.merges import Pairs, merge

WORDS_KEPT = 250_000
LONGEST_KEPT = 64
PIECE_BYTES = 2 << 20
PACKED = "<%dI"


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.words = regex.compile(pattern).findall
        self.gaps = regex.compile(r"\s\s").search
        self.rank = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.bytes = {i: b for b, i in ranks.items()}
        self.pairs = Pairs(self.rank)
        self.automaton = ahocorasick.Automaton()
        for t in self.rank:
            if len(t) == 1 or merge(t, self.rank) == [t]:
                self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.shorter = Shorter(self.automaton)
        self.memo: dict[str, bytes] = {}
        self.word_memo: dict[str, bytes] = {}

    def tokens(self, s: str) -> list[str]:
        """Tokens of one word (as Latin-1 characters)."""
        n = len(s)
        longest: list = [None] * n
        for end, t in self.automaton.iter(s):
            longest[end - len(t) + 1] = t  # ends ascend: the longest stays
        alive = [True] * (n + 1)
        out: list[str] = []
        at, t = 0, longest[0]
        while at < n:
            before = out[-1] if out else None
            while t is not None and not (alive[at + len(t)] and (before is None or self.pairs[before, t])):
                t = self.shorter[t]
            if t is not None:
                out.append(t)
                at += len(t)
                t = longest[at] if at < n else None
            elif out:  # nothing fits here: this place is dead
                alive[at] = False
                t = out.pop()
                at -= len(t)
            else:
                raise ValueError("the vocabulary does not cover every byte")
        return out

    def word(self, word: str) -> bytes:
        """Packed ids of one match of the pattern."""
        s = word.encode().decode("latin-1")
        whole = self.rank.get(s)
        ids = [whole] if whole is not None else [self.rank[t] for t in self.tokens(s)]
        return struct.pack(PACKED % len(ids), *ids)

    def stretch(self, text: str) -> bytes:
        memo = self.word_memo
        if len(memo) > WORDS_KEPT:
            memo.clear()
        out = []
        for w in self.words(text):
            ids = memo.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= LONGEST_KEPT:
                    memo[w] = ids
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        """Packed ids of a text. A space between two other characters always begins a word."""
        if self.gaps(text):
            return self.stretch(text)
        memo = self.memo
        if len(memo) > WORDS_KEPT:
            memo.clear()
        first, *rest = text.split(" ")
        out = [self.stretch(first)]
        for u in rest:
            ids = memo.get(u)
            if ids is None:
                ids = self.stretch(" " + u)
                if len(u) <= LONGEST_KEPT:
                    memo[u] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return decoded(ids, self.bytes)


class Shorter(dict):
    """The longest token that is a proper prefix of a token, or None."""

    def __init__(self, automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, t: str):
        got = next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.automaton), None)
        self[t] = got
        return got


def _ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def load(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(_ranks(ranks_path), pattern)


@lru_cache(maxsize=2)
def load_table(ranks_path: str) -> dict[int, bytes]:
    """The bytes of every id."""
    return {i: b for b, i in _ranks(ranks_path).items()}


def decoded(ids: bytes, table: dict[int, bytes]) -> bytes:
    return b"".join([table[i] for i in memoryview(ids).cast("I")])


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary) of every whole text."""
    docs = documents(df, id_col, text_col)

    def rows(ids, texts):
        encoder = load(ranks_path, pattern)
        for i, text in zip(ids, texts):
            packed = encoder(text) if text else b""
            yield i, len(packed) // 4, packed

    return map_batches(docs, rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary", PIECE_BYTES)


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The columns of ``encode`` and decoded (binary): the bytes that the ids stand for."""
    encoded = df.select("doc_id", "n_tokens", "ids")

    def rows(ids, counts, packed):
        if load.cache_info().currsize:  # this worker encoded in a task before
            load.cache_clear()
            give_back()
        table = load_table(ranks_path)
        for i, n, p in zip(ids, counts, packed):
            yield i, n, p, decoded(p, table) if p else b""

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded, rows, f"doc_id {kind}, n_tokens long, ids binary, decoded binary", PIECE_BYTES)


def round_trip_digest(df: DataFrame) -> DataFrame:
    """SHA-256 of the ids and of the decoded bytes, from what encode and decode returned."""
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                     F.sha2("decoded", 256).alias("decoded_sha256"))
