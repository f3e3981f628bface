"""Operator 6: token ids as length-delimited binary records with an offset index.

File format (little-endian), records one after the other, no header:

    u64  length of the payload
    u32  masked crc32 of those 8 bytes
    ...  payload: u8 flags (1: the id is present, 2: ids are 4 bytes wide, else 2),
         i64 doc_id (0 if null), then the token ids
    u32  masked crc32 of the payload
    u8   10 (record end)

masked(c) = rotate c right by 15 bits, plus 0xA282EAD8, modulo 2^32.
Files hold records in ascending (doc_id, text hash) order and follow each
other in the order of their number. The index is a separate Parquet table
(file, record, offset, length, doc_id, n_tokens), one row per record, for
shuffled reads by byte range.

The raw texts are range-partitioned by doc_id before they are encoded, so
each text is encoded once, in the task that writes it. Files are written
through Spark's commit protocol (the text writer passes bytes through
unchanged), so they may live in any store Spark reaches and a lost executor
leaves no partial file behind.

Edge cases: a null text is an empty one (only the end id); null doc_ids come
first; repeated rows each get a record; an empty table gives no record and
an empty result; other columns are ignored. A damaged record raises on read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlake.llm.common import documents, map_arrow, map_batches
from shiftlake.session import scratch_path

HEAD = struct.Struct("<QI")
IDENT = struct.Struct("<Bq")
TAIL = struct.Struct("<I")
END = b"\n"
FILE_BYTES = 16 << 20
WORDS_KEPT = 400_000
LONGEST_KEPT = 64
TEXT_BYTES = 8 << 20  # of texts encoded together
JOINED = 4096  # new stretches
ID = attrgetter("id")
LATIN, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ",.;:!?"  # letters of every Unicode version
SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
SPACE = "\u0120"  # how byte-level vocabularies write a space
SPACES = "[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # Python's and more than the library's

INDEX_SCHEMA = "file long, record long, offset long, length long, doc_id long, n_tokens long"


def parts(ends: np.ndarray, most: int):
    """(from, to) of rows together not above ``most``, one at least; ``ends`` are the running sums of their sizes."""
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = IDENT.pack((doc_id is not None) | 2 * wide, doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join([size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload)), END])


def unframe(data, at: int):
    """(doc_id, ids as an array, place of the next record)."""
    size, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at:at + 8])) != check:
        raise ValueError(f"record at {at}: the length's checksum differs")
    begin, end = at + HEAD.size, at + HEAD.size + size
    payload = bytes(data[begin:end])
    if TAIL.unpack_from(data, end)[0] != masked(payload):
        raise ValueError(f"record at {at}: the payload's checksum differs")
    flags, doc_id = IDENT.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=IDENT.size)
    return doc_id if flags & 1 else None, ids, end + TAIL.size + len(END)


def _shown(c: str) -> str:
    """A letter's bytes as byte-level vocabularies write them: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = {b: 0x100 + n for n, b in enumerate(sorted(set(range(256)).difference(plain)))}
    return "".join(chr(others.get(b, b)) for b in c.encode())


class BatchEncoder:
    """Ids of texts by the tokenizers library, which sees each stretch between spaces once while it is kept.

    Only for tokenizers whose split pattern begins a word at a space between
    two other characters (byte-level ones); texts with neighbouring white
    space or a special string go to the library whole. Arrow cuts the texts and
    numbers their different stretches. New ones that are one word of Latin letters
    (a mark may follow) go straight to the library's merges, as the split pattern
    leaves them whole; the others go to the library joined, as a text of their own,
    and the ids that begin with a space part them again.
    Stretches are kept in two generations: when the young one is full it becomes
    the old one, and what is seen again moves back to the young one, so frequent
    words stay.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = "|".join([SPACES + "{2}", *map(re.escape, special)])
        self.joins = not any(c.isspace() for t in special for c in t)  # else stretches of two texts could make one
        vocab = self.library.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.begins[[i for t, i in vocab.items() if SPACE in t]] = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = rules.get("pre_tokenizer") or {}
        # words go to the model itself only where nothing but the usual split lies before it
        self.straight = (self.library.model.tokenize if rules.get("normalizer") is None and rules["model"]["type"] == "BPE"
                         and not rules["model"].get("dropout") and SPLIT.items() <= split.items() else None)
        del rules
        self.marks = {c: e.ids for c, e in zip(MARKS, self.library.encode_batch_fast([*MARKS], add_special_tokens=False))}
        self.word = re.compile(f"([{LATIN}]+)([{MARKS}]?)").fullmatch
        self.letters = str.maketrans({c.encode().decode("latin-1")[k]: x for c in map(chr, range(0xC0, 0x100)) for k, x in enumerate(_shown(c))})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, units: list[str], out: list[bytes]) -> list[int]:
        """Puts the ids of single words, each with the space before it, to their places; returns the places of the others."""
        rest, places, ids, ends = [], [], [], [0]
        for i, u in enumerate(units):
            m = self.word(u)
            if m is None:
                rest.append(i)
                continue
            word, mark = m.groups()
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids.extend(map(ID, self.straight(SPACE + shown)))
            if mark:
                ids += self.marks[mark]
            places.append(i)
            ends.append(len(ids))
        data, size = self.pack(ids), self.kind.itemsize
        for i, a, b in zip(places, ends, ends[1:]):
            out[i] = data[a * size:b * size]
        return rest

    def _fresh(self, units: list[str]) -> list[bytes]:
        """Ids of stretches, each with the space before it; a text's first one has none and is marked by a space behind it."""
        out: list[bytes] = [b""] * len(units)
        rest = self._words(units, out) if self.straight else range(len(units))
        plain = [i for i in rest if self.joins and units[i] and units[i].strip() == units[i]]
        alone = sorted(set(rest).difference(plain)) if len(plain) < len(rest) else []
        for at in range(0, len(plain), JOINED):
            part = plain[at:at + JOINED]
            (encoded,) = self.library.encode_batch_fast([" " + " ".join([units[i] for i in part])], add_special_tokens=False)
            ids = np.array(encoded.ids, dtype=self.kind)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(part):
                alone += part
                continue
            data, bounds = ids.tobytes(), [*(starts * self.kind.itemsize).tolist(), ids.nbytes]
            for i, a, b in zip(part, bounds, bounds[1:]):
                out[i] = data[a:b]
        for at in range(0, len(alone), JOINED):
            part = alone[at:at + JOINED]
            for i, packed in zip(part, self.encode([units[i][:-1] if units[i].endswith(" ") else " " + units[i] for i in part])):
                out[i] = packed
        return out

    def _kept(self, units: list[str]) -> list[bytes]:
        out = list(map(self.young.get, units))
        places = [i for i, got in enumerate(out) if got is None]
        lost = [units[i] for i in places]
        again = list(map(self.old.get, lost))
        self.young.update((u, got) for u, got in zip(lost, again) if got is not None)
        new = [u for u, got in zip(lost, again) if got is None]
        made = self._fresh(new)
        self.young.update((u, got) for u, got in zip(new, made) if len(u) <= LONGEST_KEPT)
        if len(self.young) > WORDS_KEPT // 2:
            self.old, self.young = self.young, {}
        fill = iter(made)
        for i, got in zip(places, again):
            out[i] = next(fill) if got is None else got
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of each of the texts (strings without nulls)."""
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        heads, flat = cut.offsets.to_numpy(), cut.flatten()
        units = flat.dictionary_encode()
        known, first = units.dictionary.to_pylist(), heads[:-1]
        packed = self._kept(known + [u + " " for u in flat.take(pa.array(first)).to_pylist()])
        place = units.indices.to_numpy().astype(np.int64)
        place[first] = len(known) + np.arange(len(first))
        ids = pa.array(packed, pa.large_binary()).take(pa.array(place))
        _, offsets, data = ids.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(ids) + 1)[heads].tolist()
        data = data.to_pybytes() if data else b""
        own = iter([data[a:b] for a, b in zip(bounds, bounds[1:])])
        others = iter(self.encode(texts.filter(pa.array(whole)).to_pylist()))
        return [next(others if w else own) for w in whole.tolist()]


@lru_cache(maxsize=2)
def load(path: str) -> BatchEncoder:
    return BatchEncoder(path)


def write_records(df: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id",
                  text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text, append ``end_id``, write the record files to ``out``/records and the index to ``out``/index."""
    docs = documents(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = (docs.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
               .repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", "tie", "row")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))

    def run(batches):
        encoder = load(tokenizer_path)
        end = encoder.pack([end_id])
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            size = np.cumsum(pc.binary_length(texts).to_numpy())
            for at, to in parts(size, TEXT_BYTES):
                ids = batch.column(0).slice(at, to - at).to_pylist()
                records = [frame(doc_id, packed + end, encoder.wide)[:-1]  # the writer adds the record end
                           for doc_id, packed in zip(ids, encoder(texts.slice(at, to - at)))]
                yield pa.record_batch([pa.array(records, pa.binary())], ["record"])

    (map_arrow(ordered, run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.text(f"{out}/records", lineSep=END.decode()))
    scanned(df.sparkSession, out).write.parquet(f"{out}/index")


def files(spark: SparkSession, out: str) -> DataFrame:
    """file (its number) and content of every record file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/records")
    return found.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), "content")


def scanned(spark: SparkSession, out: str) -> DataFrame:
    """The index, from the record files."""

    def rows(numbers, contents):
        for number, data in zip(numbers, contents):
            at, k = 0, 0
            while at < len(data):
                doc_id, ids, after = unframe(data, at)
                yield number, k, at, after - at, doc_id, len(ids)
                at, k = after, k + 1

    return map_batches(files(spark, out), rows, INDEX_SCHEMA)


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """file, record, doc_id, start_in_file, n_tokens, ids (packed u32) of every record, in file order."""

    def rows(numbers, contents):
        for number, data in zip(numbers, contents):
            at, k, start = 0, 0, 0
            while at < len(data):
                doc_id, ids, at = unframe(data, at)
                yield number, k, doc_id, start, len(ids), ids.astype("<u4").tobytes()
                k, start = k + 1, start + len(ids)

    return map_batches(files(spark, out), rows,
                       "file long, record long, doc_id long, start_in_file long, n_tokens long, ids binary")


def fetch(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (packed u32) of the records that rows of the index name, cut out by byte range."""
    cut = (files(spark, out).join(wanted.select("file", "offset", "length"), "file")
           .select(F.expr("substring(content, int(offset) + 1, int(length))").alias("record")))

    def rows(records):
        for data in records:
            doc_id, ids, _ = unframe(data, 0)
            yield doc_id, ids.astype("<u4").tobytes()

    return map_batches(cut, rows, "doc_id long, ids binary")


def record_digest(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as the files have them; file bases come from the index (a row per file)."""
    totals = spark.read.parquet(f"{out}/index").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (read_records(spark, out).withColumn("ids_crc32", F.crc32("ids")).drop("ids").join(bases, "file")
            .select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"))


def written(df: DataFrame, tokenizer_path: str, end_id: int = 0) -> str:
    """``write_records`` into a fresh folder of the shared one; returns the folder."""
    out = scratch_path(df.sparkSession, "llm", "records")
    write_records(df, out, tokenizer_path, end_id)
    return out
