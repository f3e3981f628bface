"""Operator 1: token counts by a compiled finite-state transducer.

A sentencepiece BPE model becomes a deterministic transducer over characters.
Each transition is annotated with the tokens it emits: by how much the token
count of the text read so far changes (an annotation may be 0 or negative,
when a character lets two tokens merge). A state holds what later characters
can depend on: every open piece prefix that ends here, the token before it
and the count there. Where no piece can span two characters, the machine
falls back to its first state, so states are few; they are compiled when
first reached and kept (bounded) per Python worker. Before a space mark that
follows another character the machine is always back at its first state, so
the path over such a word is kept as one composite transition (bounded too).

Texts are cut into chunks. The map of a chunk (entry state -> exit state,
count) is kept as the head before its first reset, which must be run from
the entry state, and the exit state and count of the rest, which do not
depend on it. Maps compose associatively, so a text is the prefix scan
(pairwise, in log depth) of its chunks.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); rows are handled
one by one, so repeated rows and null ids come out as they went in; an empty
table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import documents, map_batches
from shiftlake.llm.merges import Pairs, merge

CHUNK_CHARS = 1 << 16
TRANSITIONS_KEPT = 500_000
WORDS_KEPT = 300_000
LONGEST_KEPT = 64
SPACE = "\u2581"


class State(dict):
    """Transitions out of a state: char -> (next state, emitted tokens)."""

    __slots__ = ("machine", "open", "last")

    def __init__(self, machine: "Transducer", open_: tuple, last: str | None):
        super().__init__()
        self.machine, self.open, self.last = machine, open_, last

    def __missing__(self, c: str):
        step = self[c] = self.machine.step(self, c)
        return step


class Transducer:
    def __init__(self, rank: dict[str, int]):
        pieces = {p for p in rank if len(p) == 1 or merge(p, rank) == [p]}
        self.pieces = pieces
        self.stems = {p[:i] for p in pieces for i in range(1, len(p))}
        self.inside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.pairs = Pairs(rank)
        by_words = all(SPACE not in p.lstrip(SPACE) for p in pieces)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if by_words else "(?s).+").findall
        self.reset()

    def reset(self) -> None:
        self.kept = 0
        self.states: dict = {}
        self.word_counts: dict[str, int] = {}
        self.start = self.state((), None)

    def state(self, open_: tuple, last: str | None) -> State:
        key = (open_, last)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = State(self, open_, last)
        return got

    def step(self, state: State, c: str):
        """The next state, and the change of the token count."""
        self.kept += 1
        emitted, token, grown, spanned = None, None, [], False
        for stem, before, count in state.open:  # longest first
            x = stem + c
            if x in self.pieces:
                spanned = True
                if emitted is None and (before is None or self.pairs[before, x]):
                    emitted, token = count + 1, x
            if x in self.stems:
                spanned = True
                grown.append((x, before, count))
        if emitted is None:
            emitted, token = 1 if c in self.pieces else len(c.encode("utf-8", "replace")), c
        if c in self.stems:
            grown.append((c, state.last if spanned else None, 0))
        if not grown:
            return self.start, emitted
        return self.state(tuple((x, b, n - emitted) for x, b, n in grown), token), emitted

    def run(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for c in text:
            state, emitted = state[c]
            n += emitted
        return state, n

    def run_words(self, text: str) -> tuple[State, int]:
        """``run`` from the first state, by composite transitions; the last word is run for its exit state."""
        *words, last = self.words(text)
        known, n = self.word_counts, 0
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in words:
            m = known.get(w)
            if m is None:
                m = self.run(self.start, w)[1]
                if len(w) <= LONGEST_KEPT:
                    known[w] = m
            n += m
        state, m = self.run(self.start, last)
        return state, n + m

    def chunk_map(self, chunk: str):
        """(head, exit state or None, count): without a reset inside, all of it is head."""
        for p in range(1, len(chunk)):
            if chunk[p - 1:p + 1] not in self.inside:
                return chunk[:p], *self.run_words(chunk[p:])
        return chunk, None, 0

    def compose(self, a, b):
        """The map of two neighbouring chunks."""
        (head, at, n), (head2, at2, n2) = a, b
        if at is None:
            return head + head2, at2, n2
        at, m = self.run(at, head2)
        return (head, at, n + m) if at2 is None else (head, at2, n + m + n2)

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        if self.kept > TRANSITIONS_KEPT:
            self.reset()
        if len(text) <= chunk_chars:
            return self.run_words(text)[1]
        maps = [self.chunk_map(text[i:i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, at, n = maps[0]
        return self.run(self.start, head)[1] + n


@lru_cache(maxsize=2)
def load(model_path: str):
    """The model's normaliser and its transducer."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    normal = [i for i in range(sp.get_piece_size())
              if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
    rank, last, r = {}, None, -1
    for i in order:
        if sp.get_score(i) != last:
            r, last = r + 1, sp.get_score(i)
        rank[sp.id_to_piece(i)] = r
    return sp, Transducer(rank)


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text."""
    docs = documents(df, id_col, text_col)

    def rows(ids, texts):
        sp, machine = load(model_path)
        for i, text in zip(ids, texts):
            text = text or ""
            yield i, len(text.encode()), machine.count(sp.normalize(text), chunk_chars) if text else 0

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return map_batches(docs, rows, schema).withColumn("over_limit", F.col("n_tokens") > limit)
