"""Operator 4: SimHash near-duplicates by a byte-position inverted index.

Fingerprints of 64 bits come from word shingles (numpy in the tasks). Two
fingerprints with at most ``max_bits`` differing bits share at least
8 - max_bits of their eight positional bytes. That guaranteed minimum is the
count filter: the index posts every distinct fingerprint under each set of
8 - max_bits positional bytes, so exactly the pairs whose tally of shared
bytes reaches the minimum meet in a posting list, and the rest never become
pairs. Pairs that meet are verified by their differing bits.

A posting list fixes all but ``max_bits`` bytes, so it holds at most
256^max_bits different fingerprints at any input size; lists of two are
checked by an aggregate alone, longer ones are searched by flipping their free
bits, and hand on one link per member, never all pairs. Components are a
distributed union-find over fingerprints; copies collapse to their
fingerprint before anything is compared.

Edge cases: a null text has no words; no words give fingerprint zero, which
links like any other; fewer words than a shingle give one shingle of all;
null doc_ids keep their fingerprint, and a component of null ids only has a
null component_id; repeated rows come out as often as they went in; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import documents, map_batches, stored
from shiftlake.llm.graph import components

SEED = 42
BLOCK = 1 << 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits; bit i is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_digest

    words = (text or "").encode().translate(LOWER).split()  # at 20 and 09-0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at:min(n, at + BLOCK)], ends[at + shingle - 1:] if len(words) >= shingle else ends[-1:])
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (64-bit hash of the text) and fp (the fingerprint as a signed long) of every whole text."""
    docs = documents(df, id_col, text_col).withColumn("h", F.xxhash64("text"))

    def rows(ids, texts, hashes):
        for i, text, h in zip(ids, texts, hashes):
            yield i, h, signed(fingerprint(text, shingle))

    return map_batches(docs, rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, fp long")


def near(values: list[int], free: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the values (unsigned, equal outside ``free``) within max_bits of each other: one a member at most."""
    values = sorted(set(values))
    place = {v: i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)

    bits = [1 << b for b in range(64) if free >> b & 1]
    flips = [sum(c) for n in range(1, max_bits + 1) for c in combinations(bits, n)]
    if len(values) <= len(flips):
        for j, w in enumerate(values):
            for i in range(j):
                if (values[i] ^ w).bit_count() <= max_bits:
                    join(i, j)
    else:
        for i, v in enumerate(values):
            for flip in flips:
                j = place.get(v ^ flip)
                if j is not None and j > i:
                    join(i, j)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (column fp) of at most max_bits differing bits."""
    frees = [sum(0xFF << 8 * p for p in c) for c in combinations(range(8), max_bits)]
    posts = F.array(*[F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(signed(~free & (1 << 64) - 1))).alias("key"))
                      for i, free in enumerate(frees)])
    index = fps.select("fp", F.explode(posts).alias("p")).select("p.list", "p.key", "fp")
    lists = stored(index.groupBy("list", "key").agg(F.count("fp").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                   .where("n > 1"), "postings")
    pairs = lists.where(f"n = 2 and bit_count(a ^ b) <= {max_bits}").select("a", "b")
    longer = (index.join(lists.where("n > 2").select("list", "key"), ["list", "key"])
              .groupBy("list", "key").agg(F.collect_list("fp").alias("fps")))  # 256^max_bits values at most

    def rows(numbers, keys, groups):
        for i, group in zip(numbers, groups):
            for a, b in near([v & (1 << 64) - 1 for v in group], frees[i], max_bits):
                yield signed(a), signed(b)

    return pairs.unionByName(map_batches(longer, rows, "a long, b long"))


def _prints_and_owners(df: DataFrame, shingle: int, max_bits: int, id_col: str = "doc_id",
                       text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of every row; (fp, root, component_id) of every distinct fingerprint, root being the smallest one that links reach."""
    prints = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    roots = components(links(fps.select("fp"), max_bits)).select(F.col("node").alias("fp"), "root")
    linked = fps.join(roots, "fp")
    own = linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints, fps.join(own, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(df: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) of every row."""
    prints, owners = _prints_and_owners(df, shingle, max_bits, id_col, text_col)
    return prints.join(owners.drop("root"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``df`` for each component: the one with the smallest (doc_id, text hash), null ids last; all columns.

    Rows that share a doc_id or have none are told apart by their text hash;
    of rows equal in both any one stays.
    """
    prints, owners = _prints_and_owners(df, shingle, max_bits)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    kept = (prints.join(owners, "fp").groupBy("root").agg(F.min(place).alias("m"))
            .select(*_key("m.none", "m.id"), F.col("m.h").alias("__h")))
    rows = df.select("*", *_key(F.col("doc_id").isNull(), "doc_id"), F.xxhash64(F.col("text").cast("string")).alias("__h"))
    key = ["__none", "__id", "__h"]  # plain keys for both, so that texts are shuffled once
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select(*[f"`{n}`" for n in df.columns])


def _key(none, doc_id) -> list:
    """A doc_id as two columns without nulls."""
    none, doc_id = (F.col(c) if isinstance(c, str) else c for c in (none, doc_id))
    return [none.alias("__none"), F.when(~none, doc_id.cast("string")).otherwise("").alias("__id")]
