"""Filter interaction audit and URL filters."""

import random
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL

from shiftlake.llm import filter_audit, url_filter
from shiftlake.llm.queries import LLM_ORACLE, URL_RULES, op11_filter_audit, op12_url_filter

SPACES = " \t\n\x0b\x0c\r"


def plain_counts(text):
    words, word = [], ""
    for c in text + " ":
        if c in SPACES:
            words += [word] if word else []
            word = ""
        else:
            word += c
    return (len(words), len(set(words)), len(text), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text))


def plain_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    masks = []
    for doc_id, text, lang in rows:
        text = text or ""
        n, d, p, c, s = plain_counts(text)
        fails = {"A": n < 100, "B": 100 * d < 80 * n, "C": 100 * c > 10 * p, "D": s > 0,
                 "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)}
        marks = [x for x in labels if x[0] == doc_id and doc_id is not None]
        masks.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out, shapley = {}, {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [m for m in own if f in m[1] and not m[1] & set(order[:k])]
                out[part, order, k + 1] = [
                    sum(not m[1] & set(order[:k + 1]) for m in own), len(here), sum(f in m[1] and bool(m[1] & set(order[:k])) for m in own),
                    sum(m[1] == {f} for m in own), sum(m[2] for m in here), sum(m[3] for m in here)]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def random_text(rnd):
    alphabet = rnd.choice(["ab \n", "aé\U0001F600 \t", "ABc  ", "x#| y", "a"])
    return "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 5, 40, 300])))


@pytest.mark.parametrize("block", [7, 64, filter_audit.BLOCK])
def test_transducer_counts(block):
    rnd = random.Random(block)
    texts = [random_text(rnd) for _ in range(300)] + ["y" * 9000 + " " + "y" * 9000 + " z" * 50 + " " + "y" * 8999, " lead", "trail ", "\x85 \u00a0"]
    got = filter_audit.scan(pa.array(texts), block)
    assert [tuple(x) for x in got.T.tolist()] == [plain_counts(t) for t in texts]
    assert (filter_audit.scan(pa.array(texts)[17:], block) == got[:, 17:]).all()


def test_equal_hashes_are_told_apart_by_their_bytes():
    words = np.frombuffer(b"aaa bbb aaa ccc bbb aaa" + bytes(8), np.uint8)
    start = np.arange(0, 23, 4)
    table = filter_audit.Spans(words, 2)
    same = np.zeros(6, np.uint64)  # every hash alike, so all share a slot
    new = table.add(start, np.full(6, 3), same, np.zeros(6, np.int64))
    assert new.sum() == 3
    assert table.add(start, np.full(6, 3), same, np.zeros(6, np.int64)).sum() == 0
    assert table.add(start, np.full(6, 3), same, np.ones(6, np.int64)).sum() == 3


def test_audit_matches_plain_orders(spark, odd, none):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["alpha", "Beta", "GAMMA", f"w{i}", f"v{rnd.randint(0, 300)}"]) for i in range(rnd.choice([3, 99, 100, 140])))
             + rnd.choice(["", " #"]) for _ in range(40)]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None])) for i in range(90)]
    rows += [(7, rows[7][1], "en"), (None, rows[3][1], "de"), (None, rows[3][1], "de"), (200, None, "fr"), (201, "", "fr"), (200, None, "fr")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, mask string, n int, good int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(filter_audit.audit(df, marks)) == plain_audit(rows, labels)
    assert filter_audit.audit(none, marks).count() == 0
    assert filter_audit.audit(odd, marks.limit(0)).count() == 600 * len({r.lang for r in odd.collect()})


def same_as_sql(spark, query, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = query(spark, SF_SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({LLM_ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(cols).collect())


def test_op11_matches_sql(spark):
    same_as_sql(spark, op11_filter_audit, "op11_filter_audit", ["documents", "labels"])


def test_op12_matches_sql(spark):
    same_as_sql(spark, op12_url_filter, "op12_url_filter", ["pages"])


URLS = [
    ("http://a.net", "a.net", "", None, "allow"), ("http://a.NET/x", "a.net", "/x", "net/", "block"), ("http://net/", "net", "/", "net/", "block"),
    ("http://www.Example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/en", "example.net", "/en", "net/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("https://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"), ("https://x.org/casino", "x.org", "/casino", None, "block"),
    ("https://x.org/casinos-royale", "x.org", "/casinos-royale", None, "block"), ("https://x.org/casinox", "x.org", "/casinox", None, "allow"),
    ("https://x.org/free/free", "x.org", "/free/free", None, "allow"), ("https://x.org/Free?y=BETS", "x.org", "/Free", None, "block"),
    ("https://x.org/a%20casino%2F", "x.org", "/a%20casino%2F", None, "block"), ("https://x.org/écasino", "x.org", "/écasino", None, "block"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"), ("://", "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("http://?x", "", "", None, "allow"), ("http://h#/de/", "h", "", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)], "page_id int, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, URL_RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0
    long = spark.createDataFrame([(None, "http://x/" + "casino" * 50000), (None, "http://x/" + "a/" * 100000 + "casino")], "page_id int, url string")
    assert [r.verdict for r in url_filter.judge(long, ()).collect()] == ["allow", "block"]


def test_longest_rule_wins_and_weights(spark):
    rules = [("a.b", "/", "allow"), ("b", "/long/path", "block"), ("a.b", "/long/", "allow")]
    df = spark.createDataFrame([(1, "http://a.b/long/path"), (2, "http://a.b/longer"), (3, "http://c.b/x")], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, rules, strict=("x",), soft=()).collect()}
    assert got == {1: ("b/long/path", "block"), 2: ("a.b/", "allow"), 3: (None, "block")}
    assert {r.verdict for r in url_filter.judge(df, (), strict=(), soft=()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.Rules([("h", "/", "maybe")])
