"""Operator 3: language identification by multinomial naive Bayes.

Features are hashed character n-grams (1 to 3 characters, lower case).
Training counts them over all labelled rows: every task adds up dense counts
per language and hands on the non-zero ones, Spark sums them; what reaches
the driver is buckets x languages at most. The log-probability matrix is
broadcast, and batches of documents are scored as sparse sums of its rows.

Edge cases: a text that is null or has no letter gets ``und`` with score 0,
also in training (it teaches nothing); without any labelled text everything
is ``und``; equal scores go to the alphabetically first language; rows are
handled one by one; an empty table gives an empty result. A null id counts
as the empty text in the fold, so it is held out. More than MAX_LANGUAGES
different labels raise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from shiftlake.llm.common import map_arrow, map_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 1000
UNKNOWN = "und"
BLOCK_CHARS = 1 << 18
ROWS_READ = 1 << 12  # rows of the matrix gathered together: memory does not grow with a text's length
LANGUAGES_HELD = 64  # dense counts a task holds before it hands them on
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


def features(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, a block at a time; n-grams across blocks are whole."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    reach = max(ORDERS) - 1
    for at in range(0, len(c), BLOCK_CHARS):
        block = c[at:at + BLOCK_CHARS + reach]
        own = min(BLOCK_CHARS, len(c) - at)
        h = np.zeros(len(block), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if n > len(block):
                break
            h = h[:len(block) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + block[n - 1:] + np.uint64(n)
            if n in ORDERS:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (mixed[:own] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


class Model:
    """Languages in alphabetical order; logs: buckets x languages; priors by language."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=0, keepdims=True)
        self.logs = np.log(counts + SMOOTHING) - np.log(total + SMOOTHING * len(counts))
        self.priors = np.log(docs / max(1, docs.sum())) if languages else docs

    def _sum(self, f: np.ndarray) -> np.ndarray:
        """The sum of the matrix rows of the buckets ``f``: repeated ones are read once, times their number."""
        if len(f) <= ROWS_READ:
            return self.logs[f].sum(axis=0)
        count = np.bincount(f, minlength=len(self.logs))
        used = count.nonzero()[0]
        return sum(count[part] @ self.logs[part] for part in np.split(used, range(ROWS_READ, len(used), ROWS_READ)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        rows, sums = [], []
        for k, text in enumerate(texts):
            if has_letter(text):
                rows.append(k)
                sums.append(sum(map(self._sum, features(text))))
        if rows:
            s = np.array(sums) + self.priors
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            p /= p.sum(axis=1, keepdims=True)
            best = s.argmax(axis=1)
            for i, k in enumerate(rows):
                out[k] = self.languages[best[i]], round(float(p[i, best[i]]), 6)
        return out


def train(labelled: DataFrame) -> Model:
    """From rows (text, lang); rows with a null in either are passed over."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                at = own.nonzero()[0]
                buckets, n = np.append(at, -1), np.append(own[at], docs[lang])  # bucket -1: documents
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(n), "bucket": buckets.astype(np.int32), "n": n})
            counts.clear()
            docs.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not has_letter(text):
                    continue
                if len(counts) >= LANGUAGES_HELD and lang not in counts:
                    yield from handed()
                own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for f in features(text):
                    if len(f) > BUCKETS // 8:
                        own += np.bincount(f, minlength=BUCKETS)
                    else:
                        np.add.at(own, f, 1)
        yield from handed()

    found = (map_arrow(rows, counted, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = found.persist(StorageLevel.DISK_ONLY)
    if found.where("bucket < 0").limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = found.toArrow()
    found.unpersist()
    languages = sorted(set(table.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(languages)}
    counts, docs = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    if languages:
        col = np.array([place[x] for x in table.column("lang").to_pylist()])
        bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
        counts[bucket[bucket >= 0], col[bucket >= 0]] = n[bucket >= 0]
        docs[col[bucket < 0]] = n[bucket < 0]
    return Model(languages, counts, docs)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    picked = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def rows(ids, texts):
        for at in range(0, len(ids), 256):
            for i, (lang, score) in zip(ids[at:at + 256], shared.value.predict(texts[at:at + 256])):
                yield i, lang, score

    kind = picked.schema["doc_id"].dataType.simpleString()
    return map_batches(picked, rows, f"doc_id {kind}, lang_pred string, score double")


def keep_known(df: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """All columns of the rows whose text has a language (and at least ``min_score``).

    With a ``min_score`` of 0 this is a letter test: every text with a letter
    has some language. So it is where the model knows none: nothing was
    learned, so nothing with a letter is dropped.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    at = names.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            texts = b.column(at).to_pylist()
            for i in range(0, len(texts), 256):
                if not shared.value.languages:
                    found += [has_letter(text) for text in texts[i:i + 256]]
                    continue
                found += [lang != UNKNOWN and score >= min_score for lang, score in shared.value.predict(texts[i:i + 256])]
            yield b.filter(pa.array(found, type=pa.bool_()))

    return map_arrow(df, kept, df.schema)
