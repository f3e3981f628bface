"""Operator 2: benchmark decontamination by an exact filter and bit-parallel edit distance.

Texts and items are compared as characters (lower case, white space runs as
one space). A text holds an item if the exact edit distance of the item to the
best place in the text is at most (1 - similarity) of the item's length, k.

The filter loses nothing, whatever the edits and however they are spread. An
item is cut into k + 1 pieces; pairs of pieces are nested in groups of GROUP
and these in groups of WIDE. Fewer than k + 1 edits leave some wide group fewer
edits than it has pieces, in it some group likewise, in that some pair with one
edit at most, and in the pair a piece without any. So every piece is looked up
at every character of a text, its partner is then checked for one edit, its
groups by bit-parallel dynamic programming in numpy lanes, and the item itself
in the regions that are left. Characters are reduced to a byte in the filter,
which only adds candidates.

Words are no units: an item in a script without spaces is found inside a longer
sentence. Only items too short for an edit (k = 0) are looked up as whole words
(next to no other letter or digit, where both are of a script with spaces), as
"yes" is no part of "yesterday".

(The dealt method, a CGK walk with bit sampling over words, needs whole words
to agree; at 10 % changed characters it found a third of the items or less.)

Work is numpy in the scan's own tasks: no shuffle. Items are read in blocks of
ITEM_BYTES at most, so what is sent to tasks is bounded however many there are.

Edge cases: null or empty texts and items match nothing; items are told
apart by item_id and text; a null item_id stays null; rows are handled one
by one, so repeated rows repeat; no items or no documents give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import documents, map_arrow, map_batches

SIMILARITY = 0.8
ITEM_BYTES = 1 << 20
BLOCK_WORDS = 1 << 16  # words read together
GROUP, WIDE = 4, 12  # pieces
GROUP_CHARS = 64  # a group fits a lane
SEED_CHARS = 8  # of a piece are looked up
PARTNER_CHARS = 6  # a partner with a character on either side fits 64 bits
SLAB = 1 << 15  # characters looked up together
HITS = 1 << 18  # pieces checked together
LANES = 1 << 12
PAD = 128
MIX = np.uint64(0x9E3779B97F4A7C15)
ONE = np.uint64(1)
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint8)


def _packed(chars: np.ndarray) -> int:
    return int.from_bytes(chars.tobytes(), "little")


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float):
        self.items, self.always = [], []  # those that any text is similar to
        pieces, groups, wides, seeds, spans = [], [], [], {}, {}
        for item_id, text in items:
            joined = " ".join((text or "").lower().split())
            if not joined:
                continue
            most = int((1 - similarity) * len(joined) + 1e-9)
            k = len(self.items)
            self.items.append((item_id, joined, most))
            if most >= len(joined):
                self.always.append(k)
                continue
            chars = _bytes(joined)
            cuts = [len(joined) * i // (most + 1) for i in range(most + 2)]
            size, wide = (next((n for n in (most_of, GROUP, 1) if all(
                cuts[min(g + n, most + 1)] - cuts[g] <= GROUP_CHARS for g in range(0, most + 1, n))), 1) for most_of in (GROUP, WIDE))
            first = len(wides)
            for g in range(0, most + 1, wide):
                wides.append((*self._group(chars, cuts[g:g + wide + 1]), cuts[g]))
            spans[k] = first, len(wides) - first
            for g in range(0, most + 1, size):
                last = min(g + size, most + 1)
                groups.append(self._group(chars, cuts[g:last + 1]))
                for i in range(g, last):
                    own = chars[cuts[i]:cuts[i + 1]][:SEED_CHARS]
                    seeds.setdefault(len(own), {}).setdefault(_packed(own), []).append(len(pieces))
                    j = i + 1 - 2 * ((i - g) % 2)
                    pieces.append((k, cuts[i], len(groups) - 1, cuts[i] - cuts[g], first + i // wide, cuts[i] - cuts[i // wide * wide],
                                   *self._partner(chars, cuts, i, j if j < last else i)))
        cols = list(zip(*pieces)) or [()] * 13
        self.item, self.offset, group, inner, wide, inner_wide, self.rel = (np.array(c, np.int64) for c in cols[:7])
        self.rel += 8  # from the place where a slab's window begins
        self.fixed = [np.array(c, np.uint64) for c in cols[7:10]]  # shift, value, mask
        self.moved = [np.array(c, np.uint64) for c in cols[10:]]
        self.groups, self.wides = ((own, at, *(np.array([g[i] for g in rows], np.int64) for i in (0, 1)),
                                    np.array([g[2] for g in rows], np.uint64).ravel())
                                   for own, at, rows in ((group, inner, groups), (wide, inner_wide, wides)))
        self.wide_at = np.array([g[3] for g in wides], np.int64)
        self.wide_first, self.wide_count = (np.array([spans.get(k, (0, 0))[i] for k in range(len(self.items))], np.int64) for i in (0, 1))
        self.most = np.array([most for _, _, most in self.items], np.int64)
        self.seeds = []
        for n, found in sorted(seeds.items()):
            codes = sorted(found)
            count = np.array([len(found[c]) for c in codes])
            codes = np.array(codes, np.uint64)
            known = np.zeros(1 << 20, dtype=bool)
            known[(codes * MIX >> np.uint64(44)).astype(np.int64)] = True
            self.seeds.append((np.uint64((1 << 8 * n) - 1), codes, count, np.cumsum(count) - count,
                               np.array([k for c in codes.tolist() for k in found[c]]), known))

    @staticmethod
    def _group(chars, cuts) -> tuple[int, int, list[int]]:
        """Length, allowed edits and the places of each character (6 bits) of a group of pieces."""
        pattern = chars[cuts[0]:cuts[-1]][:GROUP_CHARS].tolist()
        row = [0] * 64
        for i, c in enumerate(pattern):
            row[c & 63] |= 1 << i
        return len(pattern), len(cuts) - 2, row

    @staticmethod
    def _partner(chars, cuts, i, j) -> tuple[int, ...]:
        """Where the 8 bytes around piece j start, seen from piece i, and two parts of j: with one edit at most, either the
        one next to piece i is in its place, or the other one is there or a character off."""
        length = cuts[j + 1] - cuts[j]
        if i == j or length > PARTNER_CHARS or length < 2 or cuts[i + 1] - cuts[i] > PARTNER_CHARS:
            return (0,) + (8, 0, 0) * 2
        h = length // 2
        parts = [(8 + 8 * at, _packed(chars[cuts[j] + at:cuts[j] + at + n]), (1 << 8 * n) - 1) for at, n in ((0, h), (h, length - h))]
        near, far = parts if j > i else parts[::-1]
        return (cuts[j] - 1 - cuts[i], *near, *far)

    def candidates(self, chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, where it would start, place of the piece) of the wide groups that are found."""
        c = np.concatenate([np.zeros(PAD, np.uint8), chars, np.zeros(2 * PAD, np.uint8)])
        places = c & 63  # of the characters in a group's table
        waiting, size = [], 0
        for found in self._pairs(c, len(chars)):
            waiting.append(self._held(places, self.groups, *found))
            size += len(waiting[-1][0])
            if size >= HITS:
                yield self._starts(places, waiting)
                waiting, size = [], 0
        if size:
            yield self._starts(places, waiting)

    def _starts(self, c, waiting):
        """Those whose wide groups, each in its best place, have not more edits together than the item may have."""
        p, k = self._held(c, self.wides, *map(np.concatenate, zip(*waiting)))
        item, start, keep = self.item[k], p - self.offset[k], np.zeros(len(p), dtype=bool)
        for a in range(0, len(p), LANES):
            own = item[a:a + LANES]
            n, most = self.wide_count[own], self.most[own]
            heads = np.cumsum(n) - n
            g = np.arange(int(n.sum())) + np.repeat(self.wide_first[own] - heads, n)
            margin = np.repeat(most, n)
            best = self._best(c, self.wides, g, np.repeat(start[a:a + LANES], n) + self.wide_at[g] - margin, 2 * margin)
            keep[a:a + LANES] = np.add.reduceat(best, heads) <= most
        return item[keep], start[keep], p[keep]

    def _pairs(self, c: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, piece) of the pieces that are found beside their partners."""
        for lo in range(0, n, SLAB):
            own = min(SLAB, n - lo)
            w = np.ndarray((own + 32,), "<u8", c.data, lo + PAD - 8, (1,)).copy()  # 8 bytes from every place
            for mask, codes, count, first, pieces, known in self.seeds:
                x = w[8:8 + own] & mask
                at = known.take((x * MIX >> np.uint64(44)).view(np.int64)).nonzero()[0]
                x = x[at]
                j = np.searchsorted(codes, x)
                j[j == len(codes)] = 0
                same = codes[j] == x
                at, j = at[same], j[same]
                ends = np.cumsum(count[j])
                a = 0
                while a < len(at):
                    done = ends[a - 1] if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, done + HITS, "right")))
                    each = count[j[a:b]]
                    start = first[j[a:b]] - (ends[a:b] - each - done)
                    piece = pieces[np.arange(int(each.sum())) + np.repeat(start, each)]
                    p, k = self._beside(w, np.repeat(at[a:b], each), piece)
                    yield p + lo, k
                    a = b

    def _beside(self, w, at, piece):
        y = w.take(at + self.rel.take(piece, mode="clip"), mode="clip")
        shift, value, mask = (x.take(piece, mode="clip") for x in self.fixed)
        good = ((y >> shift ^ value) & mask) == 0
        rest = (~good).nonzero()[0]
        y, own = y.take(rest), piece.take(rest)
        shift, value, mask = (x.take(own, mode="clip") for x in self.moved)
        near = y >> shift - np.uint64(8)  # the part with a character before it and one behind it
        found = ((near ^ value) & mask) == 0
        for _ in range(2):
            near >>= np.uint64(8)
            found |= ((near ^ value) & mask) == 0
        good[rest] = found
        return at[good], piece[good]

    def _held(self, c, kind, p, k) -> tuple[np.ndarray, np.ndarray]:
        """The pieces k at p whose group differs by its allowed edits at most from a place around."""
        group, inner, _, allowed, _ = kind
        keep = np.zeros(len(p), dtype=bool)
        for a in range(0, len(p), LANES):
            own = k[a:a + LANES]
            g = group[own]
            keep[a:a + LANES] = self._best(c, kind, g, p[a:a + LANES] - inner[own] - allowed[g], 2 * allowed[g]) <= allowed[g]
        return p[keep], k[keep]

    @staticmethod
    def _best(c, kind, g, at, more) -> np.ndarray:
        """Least edits of each group to a part of the text (as places in the tables) from ``at`` on, of its size and ``more`` (see ``edits``)."""
        sizes, eqs = kind[2], kind[4]
        at, row, size = at + PAD, g * 64, sizes[g]
        top = np.uint64(1) << (size - 1).astype(np.uint64)
        up, down = np.full(len(g), ~np.uint64(0)), np.zeros(len(g), np.uint64)
        now, best = size.copy(), size.copy()
        at.clip(0, len(c) - 1, out=at)
        end = len(c) - 1
        last = int(at.max(initial=0))
        place, eq, same, plus, minus, other = np.empty_like(row), *(np.empty_like(up) for _ in range(5))
        for i in range(int((size + more).max(initial=0))):
            if last + i > end:
                np.minimum(at, end, out=at)
            np.add(row, c.take(at), out=place)
            eqs.take(place, out=eq, mode="clip")
            at += 1
            np.bitwise_or(eq, down, out=other)
            np.bitwise_and(eq, up, out=same)
            same += up
            same ^= up
            same |= other
            np.bitwise_or(same, up, out=plus)
            np.invert(plus, out=plus)
            plus |= down
            np.bitwise_and(up, same, out=minus)
            now += (plus & top).view(np.int64) != 0
            now -= (minus & top).view(np.int64) != 0
            np.minimum(best, now, out=best)
            plus <<= ONE
            minus <<= ONE
            other |= plus
            np.invert(other, out=up)
            up |= minus
            # down = plus & (eq | old down); other holds that and plus
            np.bitwise_and(plus, eq | down, out=down)
        return best

    def match(self, texts: list[str | None]) -> Iterator[tuple[int, int | None, int, int]]:
        """(place of the text, item_id, edits, item length) of every item that a text holds."""
        if not self.items:
            return
        block, owners, size = [], [], 0
        for i, text in enumerate(texts):
            own = (text or "").lower().split()
            if own:
                block.append(" ".join(own))
                owners.append(i)
                size += len(own)
            if block and (size >= BLOCK_WORDS or i == len(texts) - 1):
                yield from self._match(block, owners)
                block, owners, size = [], [], 0

    def _match(self, block, owners):
        bounds = [0]
        for text in block:
            bounds.append(bounds[-1] + len(text) + 1)
        joined = "\n".join(block)
        starts = {(doc, k): {0} for doc in range(len(block)) for k in self.always}
        for items, places, seen in self.candidates(_bytes(joined)) if self.seeds else ():
            docs = np.searchsorted(bounds, seen, "right") - 1
            for doc, k, p in set(zip(docs.tolist(), items.tolist(), places.tolist())):
                starts.setdefault((doc, k), set()).add(p - bounds[doc])
        for (doc, k), own in sorted(starts.items()):
            item_id, item, most = self.items[k]
            text = block[doc]
            best, regions = most + 1, []
            for p in sorted(own):
                a, b = max(0, p - most), min(len(text), p + len(item) + most)
                if most >= len(item):
                    a, b = 0, len(text)
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = b
                else:
                    regions.append([a, b])
            for a, b in regions:
                best = min(best, edits(item, text[a:b]) if most or _whole(item, text, a, b) else 1)
            if best <= most:
                yield owners[doc], item_id, best, len(item)


def _whole(item: str, text: str, a: int, b: int) -> bool:
    """Whether text[a:b] holds the item as whole words."""
    def joined(x: str, y: str) -> bool:
        return x.isalnum() and y.isalnum() and not UNSPACED.match(x) and not UNSPACED.match(y)

    at = text.find(item, a, b)
    while at >= 0:
        end = at + len(item)
        if not (at and joined(text[at - 1], item[0]) or end < len(text) and joined(item[-1], text[end])):
            return True
        at = text.find(item, at + 1, b)
    return False


def edits(pattern: str, text: str) -> int:
    """Least edit distance of the whole pattern to any part of the text (bit-parallel)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << m - 1
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    up, down, now, best = full, 0, m, m
    for c in text:
        eq = at.get(c, 0)
        same = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(same | up) & full
        minus = up & same
        if plus & top:
            now += 1
        elif minus & top:
            now -= 1
            if now < best:
                best = now
        plus = plus << 1 & full  # a match may begin anywhere
        minus = minus << 1 & full
        up = minus | ~((eq | down) | plus) & full
        down = plus & (eq | down)
    return best


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else rows
        yield sorted({tuple(r) for r in part.collect()}, key=str)  # about ITEM_BYTES


@lru_cache(maxsize=2)
def _matcher(items: tuple, similarity: float) -> Matcher:
    return Matcher(list(items), similarity)


def find_items(df: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, similarity (1 - edits / item length): every item found in every whole text."""
    docs = documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, edits long, similarity double"
    out = df.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_col, item_text_col):
        shared = df.sparkSession.sparkContext.broadcast(tuple(block))

        def rows(ids, texts, shared=shared):
            for i, item_id, n, length in _matcher(shared.value, similarity).match(texts):
                yield ids[i], item_id, n, round(1 - n / length, 6)

        out = out.unionByName(map_batches(docs, rows, schema))
    return out


def drop_contaminated(df: DataFrame, items: DataFrame, similarity: float = SIMILARITY, item_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text holds no item; all columns."""
    at = df.columns.index("text")
    for block in _blocks(items, item_col, item_text_col):
        shared = df.sparkSession.sparkContext.broadcast(tuple(block))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = {i for i, *_ in _matcher(shared.value, similarity).match(b.column(at).to_pylist())}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], type=pa.bool_()))

        df = map_arrow(df, clean, df.schema)
    return df
