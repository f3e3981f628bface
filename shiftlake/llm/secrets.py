"""Operator 9: secret scans.

Base patterns find assigned values, access keys and long hexadecimal runs.
Values in a wider credential context are then judged by guess cost: the
cheapest way to compose the value from dictionary words, dates, repeats,
keyboard walks and brute-force characters, by dynamic programming over its
length. A value that takes MIN_GUESSES_LOG10 or more is added as kind
``guess`` (its span is the value), whether or not a base span covers it.
Base spans always stay.

Dictionary words are the COMMON ones and, by rank, the words of the documents
themselves: Spark counts in how many documents each word stands by itself
(letters only, small but for the first, so no part of an assigned value), and
the DICTIONARY_MOST most frequent of at least MIN_DOCS go to the tasks, at
most LONGEST letters each, so the broadcast has a fixed bound. An ordinary
word after ``token:`` is then a cheap guess.

Spans are (kind, start, end) in code points, end exclusive, ordered by start,
then kind in the order of KINDS. For ``assign`` the span is the whole match.

Edge cases: a null text is an empty one; a text without secrets has an empty
span list; rows are handled one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import documents, map_batches, stored

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs [0-9a-f]+ of at least 24
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|signing)[_-]?key)"""
    r"""["']?\x20*[:=]\x20*(?:bearer\x20+)?["']?([^\s"'<>,;]{6,})""", re.A | re.I)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")
MIN_GUESSES_LOG10 = 10.0
DICTIONARY_MOST, MIN_DOCS, LONGEST = 50_000, 3, 24

# Words that guessers try first, the most common first.
COMMON = """password passwd pass secret token admin administrator root user username login welcome letmein qwerty
monkey dragon master sunshine princess football baseball shadow superman batman trustno hello freedom whatever
iloveyou michael jordan access system server service database default example sample test testing changeme change
placeholder dummy demo guest public private key api apikey auth none null true false undefined your my the this that
here value string xxxx redacted hidden spring summer autumn winter january february march april may june july august
september october november december monday tuesday friday love money computer internet office company secure
security temp temporary backup prod production dev development staging local localhost""".split()
WORDS = {w: rank for rank, w in enumerate(COMMON, 1)}
LEET = str.maketrans("@430157$!", "aaeoistsi"[:9])
COLUMNS = ("1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik,", "9ol.", "0p;/")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(a, b) for row in ROWS + COLUMNS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?"
                  r"|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,8}?)\1{2,}")
SEGMENT = math.log10(2)  # each further part: where it begins


def brute(c: str) -> float:
    """log10 of the guesses for one character by its class."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33)


def dictionary(docs: DataFrame) -> list[str]:
    """The most frequent words of the texts, the most frequent first (ties: alphabetical), at most DICTIONARY_MOST.

    A word comes in if all that are as frequent do, so the least count is
    read off the histogram of counts and only the words above it leave Spark.
    """
    words = docs.select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).where(
        F.col("w").rlike(f"^[A-Za-z][a-z]{{2,{LONGEST - 1}}}[.,;:!?]?$"))
    counts = stored(words.groupBy(F.lower(F.regexp_extract("w", "^[A-Za-z]+", 0)).alias("word")).agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") >= MIN_DOCS), "words")
    least, total = None, 0
    for n, same in sorted(map(tuple, counts.groupBy("n").agg(F.count("word").alias("same")).collect()), reverse=True):
        total += same
        if total > DICTIONARY_MOST:
            break
        least = n
    if least is None:
        return []
    return [r.word for r in sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.word))]


def ranks(frequent: list[str]) -> dict[str, int]:
    """The rank of every word: the better one of its places in COMMON and among the frequent words."""
    out = {w: r for r, w in enumerate(frequent, 1)}
    return out | {w: min(r, out.get(w, r)) for w, r in WORDS.items()}


def guess_cost(value: str, words: dict[str, int] = WORDS) -> float:
    """log10 of the guesses of the cheapest segmentation."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    parts: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = words.get(low[i:j])
            extra = 0.0
            if rank is None:
                rank, extra = words.get(plain[i:j]), math.log10(4)
            if rank is not None:
                upper = math.log10(2) if value[i:j] != low[i:j] else 0.0
                parts.setdefault(j, []).append((i, math.log10(rank + 1) + upper + extra))
    for m in DATE.finditer(value):
        parts.setdefault(m.end(), []).append((m.start(), math.log10(365 * 120 if m.end() - m.start() > 4 else 120)))
    for m in REPEAT.finditer(value):
        unit = sum(map(brute, m[1]))
        parts.setdefault(m.end(), []).append((m.start(), unit + math.log10((m.end() - m.start()) / len(m[1]))))
    i = 0
    while i < n - 1:
        j = i + 1
        while j < n and (low[j - 1], low[j]) in NEXT:
            j += 1
        if j - i >= 4:
            parts.setdefault(j, []).append((i, math.log10(len(NEXT)) + math.log10(j - i)))
        i = max(j - 1, i + 1)
    cost = [0.0] * (n + 1)
    for j in range(1, n + 1):
        cost[j] = min([cost[j - 1] + brute(value[j - 1]), *[cost[i] + c + SEGMENT for i, c in parts.get(j, ())]])
    return cost[n]


def spans_of(text: str, words: dict[str, int] = WORDS) -> list[dict]:
    low = text.lower()
    found = []
    if any(h in low for h in CONTEXT_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        found += [("guess", *m.span(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], words) >= MIN_GUESSES_LOG10]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [{"kind": k, "start": a, "end": b} for k, a, b in found]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every whole text, judged by the words of all of them."""
    docs = documents(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(ranks(dictionary(docs)))

    def rows(ids, texts):
        words = shared.value
        for i, text in zip(ids, texts):
            yield i, spans_of(text, words) if text else []

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, rows, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans, and all spans as text."""
    listed = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.kind != 'guess')"
    return found.select(
        "doc_id", *[F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.expr(listed.format(base)), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"))
