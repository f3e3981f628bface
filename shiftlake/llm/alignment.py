"""Operator 13: alignment of two tokenizers by inverted pair bitmaps.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece
model with byte fallback. Both tokenise one text (A with a space before it;
B adds its own). Byte offsets where tokens of both end cut the tokens into
groups; every occurrence of an A token is linked to every occurrence of a B
token of its group.

Counting. Documents are gathered in blocks of bounded size, numbered inside
the block. A block inverts its links: for each id pair, bitmaps of the
documents that hold it, one for each binary digit of the number of links (the
multiplicity planes). Bitmaps are merged by OR and kept compressed (sorted
16-bit numbers, or bits where those are shorter). The popcount of the OR of a
pair's planes is its document count in the block; the planes' popcounts times
their digits are its links. Blocks hold different documents, so Spark adds
the counts up by pair, finds the best pairs of every A id, and sends each
block the counts of its own pairs; there the postings return the scores to
their documents. What moves is a row per pair and block, and each block once.

Cost. A space between two characters that are no white space ends a token of
either tokenizer, so the stretches between such spaces are aligned once and
kept, as many as fit (UNITS_KEPT). New stretches are aligned together, as
arrays.

Edge cases: null and empty texts have no tokens (zeros and empty strings),
and so has a text whose joined bytes differ (it holds U+2581). Null ids and
repeated rows come out as they went in, each row a document of its own. A
text of any length is cut into stretches piece by piece. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import documents, map_arrow, ship, stored

SPACE = "▁"
BLOCK_BYTES = 8 << 20  # text of a block; a longer document is a block of its own
BLOCK_DOCS = 1 << 16  # document numbers have 16 bits
PIECE_CHARS = 1 << 19  # text that is cut into stretches at once
UNITS_KEPT = 400_000
LONGEST_KEPT = 64
BIG_GROUP = 1 << 14  # groups with more links are paired by different ids

BLOCK_SCHEMA = ("block long, doc_ids array<long>, totals binary, digests binary, pairs binary, n_docs binary, n_links binary, "
                "planes array<binary>")
DOC_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string")
cut = re.compile(r"(?<=\S) (?=\S)")


def byte_values() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones are themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_order(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For runs of ``count`` elements: value of the run plus the place in the run."""
    total = int(count.sum())
    return np.repeat(value - np.cumsum(count) + count, count) + np.arange(total)


class Units:
    """Aligned stretches: numbers of tokens, groups and links, the group text, and the links by pair."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.texts: list[bytes] = []  # "a1,a2|b1;" of every group
        self.facts = np.empty((5, 0), dtype=np.int64)  # A tokens, B tokens, groups, links, whether bytes are equal
        self.offsets = np.zeros(1, dtype=np.int64)
        self.pairs = np.empty(0, dtype=np.int64)
        self.links = np.empty(0, dtype=np.int64)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        values = byte_values()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [special[i] if i in special else bytes(values[c] for c in entries.get(i, ""))
                        for i in range(max(entries) + 1)]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        if len(self.len_a) * len(self.len_b) >= 1 << 46:
            raise ValueError("vocabularies too large for a pair number")
        alone = all(SPACE not in self.b.id_to_piece(i).lstrip(SPACE) for i in range(len(self.bytes_b)))
        self.split = cut.split if alone else lambda text: [text]
        self.units = Units()

    def index(self, stretches: list[str]) -> np.ndarray:
        """The places of these stretches in ``units``; new ones are aligned."""
        known = self.units.place
        new = [u for u in dict.fromkeys(stretches) if u not in known]
        if new:
            self.learn(new)
        return np.fromiter(map(known.__getitem__, stretches), np.int64, len(stretches))

    def renew(self) -> None:
        """Forget all when there is much; the next block learns what it meets."""
        if len(self.units.texts) > UNITS_KEPT:
            self.units = Units()

    def learn(self, new: list[str]) -> None:
        units, want = self.units, [(" " + u).encode() for u in new]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        fine = np.ones(len(new), dtype=bool)
        if self.joined(ids_a, self.bytes_a) != b"".join(want) or self.joined(ids_b, self.bytes_b) != b"".join(want):
            fine[:] = [self.joined([x], self.bytes_a) == w == self.joined([y], self.bytes_b)
                       for x, y, w in zip(ids_a, ids_b, want)]
            ids_a = [x if ok else [] for x, ok in zip(ids_a, fine)]
            ids_b = [x if ok else [] for x, ok in zip(ids_b, fine)]
        facts, texts, offsets, pairs, links = self.align(ids_a, ids_b)
        base = len(units.texts)
        units.place.update((u, base + i) for i, u in enumerate(new))
        units.texts += texts
        units.facts = np.concatenate([units.facts, np.vstack([facts, fine])], axis=1)
        units.offsets = np.concatenate([units.offsets, units.offsets[-1] + offsets])
        units.pairs = np.concatenate([units.pairs, pairs])
        units.links = np.concatenate([units.links, links])

    @staticmethod
    def joined(ids, values) -> bytes:
        return b"".join(map(values.__getitem__, chain.from_iterable(ids)))

    def align(self, ids_a: list[list[int]], ids_b: list[list[int]]):
        """Facts (4 rows), group texts, ends of the pairs, pairs and links of stretches whose tokens have equal bytes."""
        n_a, n_b = np.array(list(map(len, ids_a))), np.array(list(map(len, ids_b)))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        shared_a, shared_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = (np.cumsum(x) - x for x in (shared_a, shared_b))  # groups are numbered through all stretches
        n_groups = int(shared_a.sum())
        size_a, size_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        unit_a = np.repeat(np.arange(len(n_a)), n_a)
        unit = unit_a[first_a] if n_groups else np.empty(0, np.int64)
        n_links = np.bincount(unit, weights=size_a * size_b, minlength=len(n_a)).astype(np.int64)
        facts = np.vstack([n_a, n_b, np.bincount(unit, minlength=len(n_a)), n_links])

        small = size_a * size_b <= BIG_GROUP
        own = small[group_a]
        each = size_b[group_a[own]]
        pair = np.repeat(a[own], each) * len(self.len_b) + b[by_order(first_b[group_a[own]], each)]
        at, links = np.repeat(group_a[own], each), np.ones(len(pair), np.int64)
        for g in np.flatnonzero(~small):
            x, k = np.unique(a[first_a[g]:first_a[g] + size_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g]:first_b[g] + size_b[g]], return_counts=True)
            pair = np.concatenate([pair, (x[:, None] * len(self.len_b) + y).ravel()])
            links = np.concatenate([links, (k[:, None] * m).ravel()])
            at = np.concatenate([at, np.full(len(x) * len(y), g)])
        if not small.all():
            order = np.argsort(at, kind="stable")
            pair, links, at = pair[order], links[order], at[order]
        offsets = np.cumsum(np.bincount(unit[at], minlength=len(n_a)))

        # the group texts: A tokens of a group, then its B tokens
        words = np.empty(len(a) + len(b), dtype=object)
        words[np.arange(len(a)) + first_b[group_a]] = [f"{i}{'|' if last else ','}" for i, last in zip(a.tolist(), shared_a.tolist())]
        words[np.arange(len(b)) + (first_a + size_a)[group_b]] = [f"{i}{';' if last else ','}" for i, last in zip(b.tolist(), shared_b.tolist())]
        words, ends = words.tolist(), np.cumsum(n_a + n_b).tolist()
        texts = ["".join(words[i:j]).encode() for i, j in zip([0, *ends], ends)]
        return facts, texts, offsets, pair, links


class PairBitmaps:
    """Documents by pair, a bitmap for each binary digit of the link counts.

    A plane is the sorted array of (place of the pair << 16 | document); ``pack`` compresses it.
    """

    def __init__(self, pairs: np.ndarray, planes: list[np.ndarray]):
        self.pairs, self.planes = pairs, planes

    @classmethod
    def of(cls, pair: np.ndarray, doc: np.ndarray, links: np.ndarray) -> "PairBitmaps":
        """From postings; those of one pair and document are added up."""
        key = pair << 16 | doc
        order = np.argsort(key)
        key, first = np.unique(key[order], return_index=True)
        links = np.add.reduceat(links[order], first) if len(first) else links
        pairs, place = np.unique(key >> 16, return_inverse=True)
        key = place.astype(np.int64) << 16 | key & 0xFFFF
        digits = int(links.max()).bit_length() if len(links) else 0
        return cls(pairs, [key[links >> p & 1 == 1] for p in range(digits)])

    def merged(self) -> np.ndarray:
        """The OR of the planes: documents by pair."""
        out = np.sort(np.concatenate([np.empty(0, np.int64), *self.planes]), kind="stable")
        return out[np.append(True, out[1:] != out[:-1])] if len(out) else out

    def popcounts(self, plane: np.ndarray) -> np.ndarray:
        return np.bincount(plane >> 16, minlength=len(self.pairs))

    def doc_counts(self) -> np.ndarray:
        return self.popcounts(self.merged())

    def link_counts(self) -> np.ndarray:
        return sum((self.popcounts(x) << p for p, x in enumerate(self.planes)), np.zeros(len(self.pairs), np.int64))

    def returned(self, value: np.ndarray, n_docs: int) -> np.ndarray:
        """By document, the sum of its pairs' values over its links."""
        out = np.zeros(n_docs, dtype=np.int64)
        for p, plane in enumerate(self.planes):
            np.add.at(out, plane & 0xFFFF, value[plane >> 16] << p)
        return out

    def pack(self, n_docs: int) -> list[bytes]:
        """Every plane: bits of the pairs it holds, their popcounts, then each pair's documents in 16-bit numbers or in bits."""
        width = -(-n_docs // 8)
        out = []
        for plane in self.planes:
            counts = self.popcounts(plane)
            held = np.flatnonzero(counts)
            doc, dense = (plane & 0xFFFF).astype("<u2"), counts * 2 > width
            body = [doc[~dense[plane >> 16]].tobytes()]
            ends = np.cumsum(counts)
            for i in np.flatnonzero(dense):
                bits = np.zeros(8 * width, dtype=np.uint8)
                bits[doc[ends[i] - counts[i]:ends[i]]] = 1
                body.append(np.packbits(bits).tobytes())
            there = np.packbits(counts > 0).tobytes()
            out.append(b"".join([there, counts[held].astype("<u4").tobytes(), *body]))
        return out

    @classmethod
    def unpack(cls, pairs: np.ndarray, packed: list[bytes], n_docs: int) -> "PairBitmaps":
        width, planes = -(-n_docs // 8), []
        for data in packed:
            at = -(-len(pairs) // 8)
            held = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, at))[:len(pairs)])
            counts = np.frombuffer(data, "<u4", len(held), at).astype(np.int64)
            at += 4 * len(held)
            dense = counts * 2 > width
            few = int(counts[~dense].sum())
            doc = np.frombuffer(data, "<u2", few, at).astype(np.int64)
            at += 2 * few
            keys = [np.repeat(held[~dense], counts[~dense]) << 16 | doc]
            for i in held[dense]:
                bits = np.unpackbits(np.frombuffer(data, np.uint8, width, at))
                keys.append(np.flatnonzero(bits) | i << 16)
                at += width
            planes.append(np.sort(np.concatenate(keys)))
        return cls(pairs, planes)


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def pieces(text: str):
    """The text in parts that end where a stretch ends."""
    at = 0
    while len(text) - at > 2 * PIECE_CHARS:
        found = cut.search(text, at + PIECE_CHARS)
        if not found:
            break
        yield text[at:found.start()]
        at = found.end()
    yield text[at:]


class Block:
    """Documents with numbers from 0 on, and their postings."""

    def __init__(self, aligner: Aligner):
        aligner.renew()
        self.aligner, self.ids, self.size = aligner, [], 0
        self.totals: list[np.ndarray] = []  # by document: A tokens, B tokens, groups, links
        self.digests: list[bytes] = []
        self.postings: list[tuple] = []
        self.waiting: list[tuple[int, list[str]]] = []  # short documents, aligned together
        self.waiting_size = 0

    def add(self, doc_id, text: str) -> None:
        number = len(self.ids)
        self.ids.append(doc_id)
        self.totals.append(np.zeros(4, np.int64))
        self.digests.append(b"")
        self.size += len(text.encode())
        if not text:
            return
        if len(text) > PIECE_CHARS:
            self.add_long(number, text)
            return
        self.waiting.append((number, self.aligner.split(text)))
        self.waiting_size += len(text)
        if self.waiting_size > PIECE_CHARS:
            self.settle()

    def settle(self) -> None:
        """Align the waiting documents."""
        if not self.waiting:
            return
        units, lengths = self.aligner.units, [len(s) for _, s in self.waiting]
        at = self.aligner.index(list(chain.from_iterable(s for _, s in self.waiting)))
        ends = np.cumsum(lengths)
        facts = np.add.reduceat(units.facts[:, at], ends - lengths, axis=1)
        fine = facts[4] == lengths
        places = at.tolist()
        for k, (number, _) in enumerate(self.waiting):
            if fine[k]:
                self.totals[number] = facts[:4, k]
                groups = b"".join(map(units.texts.__getitem__, places[ends[k] - lengths[k]:ends[k]]))
                self.digests[number] = sha256(groups[:-1]).digest()
        self.post(np.repeat([n for n, _ in self.waiting], lengths), at, np.repeat(fine, lengths))
        self.waiting, self.waiting_size = [], 0

    def add_long(self, number: int, text: str) -> None:
        self.settle()
        digest, held, before = sha256(), b"", len(self.postings)
        for piece in pieces(text):
            units = self.aligner.units
            at = self.aligner.index(self.aligner.split(piece))
            facts = units.facts[:, at].sum(axis=1)
            if facts[4] != len(at):
                self.totals[number] = np.zeros(4, np.int64)
                del self.postings[before:]
                return
            self.totals[number] = self.totals[number] + facts[:4]
            groups = held + b"".join(map(units.texts.__getitem__, at.tolist()))
            digest.update(groups[:-1])
            held = groups[-1:]
            self.post(np.full(len(at), number), at, np.ones(len(at), dtype=bool))
        self.digests[number] = digest.digest()

    def post(self, doc: np.ndarray, unit: np.ndarray, fine: np.ndarray) -> None:
        """Postings of these occurrences of stretches."""
        units = self.aligner.units
        seen, times = np.unique(doc[fine] << 32 | unit[fine], return_counts=True)
        doc, unit = seen >> 32, seen & 0xFFFFFFFF
        each = units.offsets[unit + 1] - units.offsets[unit]
        at = by_order(units.offsets[unit], each)
        own = PairBitmaps.of(units.pairs[at], np.repeat(doc, each), units.links[at] * np.repeat(times, each))
        self.postings.append((own.pairs, own.planes))

    def row(self, block: int) -> tuple:
        self.settle()
        n = len(self.ids)
        pair, doc, links = [], [], []
        for pairs, planes in self.postings:  # a long document's pieces may share pairs: links add up
            for p, plane in enumerate(planes):
                pair.append(pairs[plane >> 16])
                doc.append(plane & 0xFFFF)
                links.append(np.full(len(plane), 1 << p, np.int64))
        none = [np.empty(0, np.int64)]
        maps = PairBitmaps.of(*(np.concatenate(x or none) for x in (pair, doc, links)))
        totals = np.array(self.totals, dtype="<i8").reshape(n, 4)
        return (block, self.ids, totals.tobytes(), b"".join(x or bytes(32) for x in self.digests), maps.pairs.astype("<i8").tobytes(),
                maps.doc_counts().astype("<i4").tobytes(), maps.link_counts().astype("<i8").tobytes(), maps.pack(n))


def blocks(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted blocks, written to the shared folder."""
    docs = documents(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches):
        from pyspark import TaskContext

        aligner, number = load(path_a, path_b), TaskContext.get().partitionId() << 32
        block = Block(aligner)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.add(doc_id.as_py(), text.as_py() or "")
                if block.size >= BLOCK_BYTES or len(block.ids) >= BLOCK_DOCS:
                    yield _batch(block.row(number))
                    number, block = number + 1, Block(aligner)
        if block.ids:
            yield _batch(block.row(number))

    return stored(map_arrow(docs, run, BLOCK_SCHEMA), "alignment")


_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("totals", pa.binary()), ("digests", pa.binary()),
                    ("pairs", pa.binary()), ("n_docs", pa.binary()), ("n_links", pa.binary()), ("planes", pa.list_(pa.binary()))])


def _batch(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW)], schema=_ARROW)


def block_pairs(table: DataFrame, n_b: int) -> DataFrame:
    """block, a, b, n_docs, n_links of every pair of every block."""

    def run(batches):
        for batch in batches:
            for block, pairs, docs, links in zip(*(batch.column(i) for i in range(4))):
                pair = np.frombuffer(pairs.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), block.as_py())), pa.array(pair // n_b), pa.array(pair % n_b),
                     pa.array(np.frombuffer(docs.as_buffer(), "<i4").astype(np.int64)), pa.array(np.frombuffer(links.as_buffer(), "<i8"))],
                    names=["block", "a", "b", "n_docs", "n_links"])

    return map_arrow(table.select("block", "pairs", "n_docs", "n_links"), run, "block long, a long, b long, n_docs long, n_links long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links over all documents, and whether n_docs is the highest of its A id (``best``)."""
    sums = pairs.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    top = sums.groupBy(F.col("a").alias("a_top")).agg(F.max("n_docs").alias("top"))
    return sums.join(top, F.col("a") == F.col("a_top")).select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("best"))


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    table = blocks(df, path_a, path_b, id_col, text_col)
    pairs = block_pairs(table, n_b)
    counts = stored(pair_counts(pairs), "pair_counts")
    scored = (pairs.select("block", "a", "b").join(counts.select("a", "b", "n_docs", "best"), ["a", "b"])
              .select("block", (F.col("a") * n_b + F.col("b")).alias("pair"), "n_docs", "best"))
    ship(df.sparkSession)
    return table.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(_returned, DOC_SCHEMA)


def _returned(blocks_: pa.Table, scored: pa.Table) -> pa.Table:
    """The documents of one block, with the scores that its postings return."""
    (row,) = blocks_.drop_columns(["doc_ids"]).to_pylist()
    ids = blocks_.column("doc_ids").combine_chunks().flatten()
    n = len(ids)
    pairs = np.frombuffer(row["pairs"], "<i8")
    order = np.argsort(scored.column("pair").to_numpy())
    if len(order) != len(pairs):
        raise ValueError("a block's pairs and their counts differ")
    count = scored.column("n_docs").to_numpy()[order]
    best = scored.column("best").to_numpy()[order].astype(np.int64)
    maps = PairBitmaps.unpack(pairs, row["planes"], n)
    totals = np.frombuffer(row["totals"], "<i8").reshape(n, 4)
    digests = [row["digests"][32 * i:32 * i + 32].hex() if totals[i, 0] else "" for i in range(n)]
    return pa.table([ids, *(pa.array(totals[:, k].copy()) for k in range(4)), pa.array(maps.returned(best, n)),
                     pa.array(maps.returned(count, n)), pa.array(digests, pa.string())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
