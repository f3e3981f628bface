"""Operator 11: what five text filters remove, alone and in every order.

A document fails filter

    A: with fewer than MIN_WORDS words,
    B: with fewer than 80 different words per 100 words,
    C: with more than 10 capitals A-Z per 100 code points,
    D: with any of ``# $ % & * |``,
    E: if a smaller doc_id has the identical text, removed or not.

One pass of a table-driven byte transducer over the UTF-8 text decides A to
D. Two tables hold the machine: for each byte what it emits (code point,
capital, symbol: packed counters) and its value in the word hash, which is 0
for separators; the state (in a word or between words) follows from the last
byte. Word spans go into an open-addressing hash table that compares the
bytes themselves before it takes two words for the same. Long texts pass
block by block through one such table; short ones share a table, with the
document as part of the key.

Which filters a document fails is a mask of five bits; masks are counted by
part and label, and every order of the filters is derived from those counts
(32 a part). Identical texts are found by their 128-bit BLAKE2b digest: rows
are first added up by (digest, part, labels), so a text with any number of
copies is a few rows when the smallest doc_id is looked up.

Edge cases: a null text is an empty one (fails A only, 0 of 0 words); a null
part is the empty string; a null doc_id is neither smaller nor larger than
another, so it neither fails E nor makes others fail it; of rows with the
same doc_id and text none is smaller; every row counts. Label rows without a
doc_id match nothing; of several for a doc_id one that says so is enough. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import map_arrow

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT = 80  # per 100 words
MAX_CAPITALS = 10  # per 100 code points
SYMBOLS = b"#$%&*|"
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])

BLOCK = 1 << 18  # bytes that pass through the machine at once
LONG_WORD = 1 << 12  # longer words are hashed and compared by themselves

# What a byte emits, as counters packed in one number: code points, capitals, symbols (21 bits each).
FIELD = 21
EMITS = np.array([(b & 0xC0 != 0x80) | (65 <= b <= 90) << FIELD | (b in SYMBOLS) << 2 * FIELD for b in range(256)], np.uint64)
IN_WORD = np.array([b not in SEPARATORS for b in range(256)])
# A byte's value in the word hash: 0 for separators, else a fixed mixed number.
VALUES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x5851F42D4C957F2D)) * IN_WORD
BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of BASE and of its inverse, grown when a block is longer."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, 2 * n), _powers(pow(BASE, -1, 1 << 64), 2 * n)
        return self.up, self.down


POWERS = Powers()
MIX = np.uint64(0x9E3779B97F4A7C15)
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans from a and from b hold the same bytes; ``data`` ends with 8 spare bytes."""
    eight = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    left, at = np.arange(len(a)), 0
    while len(left):
        differ = (eight[a[left] + at] ^ eight[b[left] + at]) & LOW[np.minimum(length[left] - at, 8)]
        same[left[differ != 0]] = False
        at += 8
        left = left[(differ == 0) & (length[left] > at)]
        if at >= LONG_WORD:
            for i in left:
                same[i] = np.array_equal(data[a[i] + at:a[i] + length[i]], data[b[i] + at:b[i] + length[i]])
            break
    return same


class Spans:
    """A hash table of the different spans of ``data`` by owner: open addressing, bytes compared before spans count as one."""

    def __init__(self, data: np.ndarray, expected: int):
        self.data = data
        self.entries = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)]
        self.grow(expected)

    def grow(self, n: int) -> None:
        self.bits = max(4, int(2 * n - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        if n_old := len(self.entries[0]):  # they are known to differ
            place, left = self.first(self.entries[2]), np.arange(n_old)
            while len(left):
                free = left[self.slots[place[left]] < 0]
                self.slots[place[free]] = free
                left = left[self.slots[place[left]] != left]
                place[left] = (place[left] + 1) & (len(self.slots) - 1)

    def first(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, start: np.ndarray, length: np.ndarray, key: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Insert spans; tells which were not there before (the first or another one of equal new spans)."""
        base = len(self.entries[0])
        if 2 * (base + len(start)) > len(self.slots):
            self.grow(2 * (base + len(start)))
        starts, lengths, keys, owners = (np.concatenate(x) for x in zip(self.entries, (start, length, key, owner)))
        new = np.zeros(len(start), dtype=bool)
        place, left = self.first(key), np.arange(len(start))
        while len(left):
            free = left[self.slots[place[left]] < 0]
            self.slots[place[free]] = base + free  # of several that want a slot one gets it
            held = self.slots[place[left]]
            own = held == base + left
            new[left[own]] = True
            left, held = left[~own], held[~own]
            alike = (keys[held] == key[left]) & (owners[held] == owner[left]) & (lengths[held] == length[left])
            alike[alike] = _same(self.data, starts[held[alike]], start[left[alike]], length[left[alike]])
            left = left[~alike]
            place[left] = (place[left] + 1) & (len(self.slots) - 1)
        fresh = base + np.flatnonzero(new)
        self.slots[place[new]] = base + np.arange(len(fresh))
        kept = np.concatenate([np.arange(base), fresh])
        self.entries = [x[kept] for x in (starts, lengths, keys, owners)]
        return new


def _words(data: np.ndarray, bounds: np.ndarray):
    """Spans, hashes and owners of the words of texts that lie one after the other: text i is bounds[i] to bounds[i + 1]."""
    inside = IN_WORD[data]
    filled = np.flatnonzero(np.diff(bounds))
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[filled]] = after[bounds[filled + 1] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(start):
        return start, end, np.empty(0, np.uint64), start
    up, down = POWERS.get(len(data))
    key = np.add.reduceat(VALUES[data] * up[:len(data)], start) * down[start]
    return start, end - start, key, np.searchsorted(bounds, start, side="right") - 1


def _mixed(key: np.ndarray, length: np.ndarray, owner: np.ndarray) -> np.ndarray:
    key = key ^ (length.astype(np.uint64) << np.uint64(48)) ^ (owner.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    return key ^ key >> np.uint64(29)


def _long_keys(data: np.ndarray, start: np.ndarray, length: np.ndarray, key: np.ndarray) -> None:
    """Words beyond LONG_WORD get a hash that does not depend on how the text was cut."""
    for i in np.flatnonzero(length > LONG_WORD):
        digest = blake2b(data[start[i]:start[i] + length[i]], digest_size=8).digest()
        key[i] = np.uint64(int.from_bytes(digest, "little"))


def scan_short(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(words, different words, code points, capitals, symbols) by text of one block; ``data`` ends with 8 spare bytes."""
    body, n = data[:bounds[-1]], len(bounds) - 1
    out = np.zeros((5, n), dtype=np.int64)
    if not len(body):
        return out
    filled = np.flatnonzero(np.diff(bounds))
    packed = np.add.reduceat(EMITS[body], bounds[filled])
    for k in range(3):
        out[2 + k, filled] = (packed >> np.uint64(k * FIELD) & np.uint64((1 << FIELD) - 1)).astype(np.int64)
    start, length, key, owner = _words(body, bounds)
    _long_keys(data, start, length, key)
    new = Spans(data, len(start)).add(start, length, _mixed(key, length, owner), owner)
    out[0] = np.bincount(owner, minlength=n)
    out[1] = np.bincount(owner[new], minlength=n)
    return out


def scan_long(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The same for one text of any length, block by block; a word that goes on into the next block is read there."""
    size, at, out = len(data) - 8, 0, np.zeros(5, dtype=np.int64)
    table = Spans(data, block // 4)
    while at < size:
        end, open_word = min(size, at + block), False
        if end < size and IN_WORD[data[end]]:  # cut behind the last separator, or let a word over a block long go on alone
            gaps = np.flatnonzero(~IN_WORD[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                open_word = True
        if open_word:
            while end < size:
                gaps = np.flatnonzero(~IN_WORD[data[end:end + block]])
                if len(gaps):
                    end += int(gaps[0])
                    break
                end = min(size, end + block)
            start, length = np.array([at]), np.array([end - at])
            key = np.zeros(1, np.uint64)
        else:
            start, length, key, _ = _words(data[at:end], np.array([0, end - at]))
            start = start + at
        for part in range(at, end, block):
            packed = int(EMITS[data[part:min(end, part + block)]].sum())
            out[2:] += [packed >> k * FIELD & (1 << FIELD) - 1 for k in range(3)]
        _long_keys(data, start, length, key)
        owner = np.zeros(len(start), np.int64)
        out[0] += len(start)
        out[1] += int(table.add(start, length, _mixed(key, length, owner), owner).sum())
        at = end
    return out


def failures(counts: np.ndarray) -> np.ndarray:
    """Mask of the filters A to D that fail, from the five counts by text."""
    words, distinct, points, capitals, symbols = counts
    return ((words < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * words) << 1
            | (100 * capitals > MAX_CAPITALS * points) << 2 | (symbols > 0) << 3)


def scan(texts: pa.Array, block: int = BLOCK) -> np.ndarray:
    """The five counts of every text of an Arrow string array without nulls."""
    wide = pa.types.is_large_string(texts.type)
    _, places, content = texts.buffers()
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content else np.empty(0, np.uint8)
    out, i = np.zeros((5, len(texts)), dtype=np.int64), 0
    spare = np.zeros(8, np.uint8)
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + block, side="right")) - 1)
        own = np.concatenate([data[bounds[i]:bounds[j]], spare])
        if j == i + 1 and len(own) > block:
            out[:, i] = scan_long(own, block)
        else:
            out[:, i:j] = scan_short(own, bounds[i:j + 1] - bounds[i])
        i = j
    return out


def failed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask (A to D), digest (of the text), counts of every row."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    names = ("n_words", "n_distinct", "n_points", "n_capitals", "n_symbols")

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            counts = scan(texts)
            digests = [blake2b(t.as_buffer(), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(failures(counts), pa.int32()), pa.array(digests, pa.binary()),
                 *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", "part", "mask", "digest", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, part string, mask int, digest binary, {', '.join(f'{n} long' for n in names)}")


def mask_counts(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "lang") -> DataFrame:
    """part, mask (bit i: fails filter i of A to E), n, good, toxic: rows by part and mask."""
    rows = (failed(df, id_col, text_col, part_col).select("doc_id", "part", "mask", "digest")
            .groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")))
    marks = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
             .where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    # rows without an id match no label; a second key spreads them over the tasks
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest").bitwiseOR(F.lit(1).cast("long"))).otherwise(0))
    marks = marks.select(F.col("doc_id").alias("marked"), F.lit(0).cast("long").alias("unsalted"), "good", "toxic")
    known = (salted.join(marks, (F.col("doc_id") == F.col("marked")) & (F.col("salt") == F.col("unsalted")), "left")
             .withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False))))
    has_id = F.col("doc_id").isNotNull()
    sums = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("with_id"),
        F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    least = F.expr("min(first) over (partition by digest)")  # a row per part and label of one text
    apart = sums.withColumn("copies", F.col("with_id") - F.when(F.col("first") == least, F.col("n_first")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
                             F.struct(F.col("mask").bitwiseOR(16).alias("mask"), F.col("copies").alias("n"))))
    split = apart.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return (split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")))


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step, with what the step's filter removes there."""
    masks = mask_counts(df, labels, id_col, text_col, part_col)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = (masks.withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])))
             .withColumn("own", F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - ascii('A'))"))
             .withColumn("earlier", F.expr("aggregate(filter(split(substr(filter_order, 1, step - 1), ''), c -> c <> ''), 0, "
                                           "(m, c) -> m | shiftleft(1, ascii(c) - ascii('A')))")))
    fails, gone = F.expr("mask & own") != 0, F.expr("mask & earlier") != 0
    here = fails & ~gone

    def total(name: str, where):
        return F.sum(F.when(where, F.col(name)).otherwise(0))

    # a document that fails m filters is removed by each of them in 1 / m of all orders
    n_orders = F.lit(len(list(permutations(FILTERS))))
    shares = F.sum(F.when(fails, F.col("n") * (n_orders / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")).otherwise(0))
    return (steps.groupBy("part", "filter_order", "step").agg(
        total("n", ~gone & ~fails).alias("kept"), total("n", here).alias("removed"), total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("own")).alias("unique_fails"), total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"), shares.alias("shapley")))


def audit_sql() -> str:
    """DuckDB SQL of ``audit`` over ``documents`` and ``labels``."""
    space, symbols = r"[^\x20\x09-\x0D]+", "[#$%&*|]"
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(FILTERS))
    return f"""
WITH letters(c, bit) AS (VALUES {letters}),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '{space}') AS w FROM texts),
least AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < {MIN_WORDS} AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(words.text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(words.text) AS INTEGER)
    + 8 * CAST(regexp_matches(words.text, '{symbols}') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS mask
  FROM words JOIN least ON words.text = least.text LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0) AS earlier
  FROM orders, range(1, 6) r(s)
), tried AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & own = 0 AND mask & CAST(earlier AS INTEGER) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & CAST(earlier AS INTEGER) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & CAST(earlier AS INTEGER) <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & own <> 0 AND mask & CAST(earlier AS INTEGER) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & CAST(earlier AS INTEGER) = 0), 0) AS toxic_lost
  FROM counted CROSS JOIN steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM tried"""
