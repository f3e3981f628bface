"""Near duplicates, line dedup, top-k and the pipeline against brute force."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from conftest import SF_SMALL

from llm.conftest import ODD
from shiftlake.llm import graph, lines, simhash, topk
from shiftlake.llm.queries import LLM_ORACLE, op10_exact_top_k, op4_simhash_dedup, op5_line_dedup


def unite(pairs, nodes=()):
    parent = {n: n for n in nodes}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in list(parent)}


@pytest.mark.parametrize("pairs", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(9, 3), (3, 9), (7, 8)],
    [(random.Random(5).randrange(60) * k % 97, k) for k in range(80)]])
def test_components(spark, pairs):
    links = spark.createDataFrame([*pairs, (None, 4)], "a long, b long")
    want = unite([p for p in pairs if p[0] != p[1]])
    assert {tuple(r) for r in graph.components(links).collect()} == set(want.items())


def print_brute(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_brute(prints, bits=2):
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= bits]
    return unite(pairs, ids)


def test_simhash_whole_table_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    prints = {i: print_brute(t) for i, t in docs.items()}
    want = groups_brute(prints)
    got = op4_simhash_dedup(spark, SF_SMALL).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", want[i]) for i, p in prints.items()}
    assert len(got) == len(docs)


def test_links_of_dense_and_chained_fingerprints(spark):
    rnd = random.Random(6)
    base = rnd.getrandbits(64)
    values = {base}
    for _ in range(400):  # many within one posting list, chains, and strangers
        values.add(base ^ rnd.getrandbits(16) & rnd.getrandbits(16))
        values.add(rnd.choice(sorted(values)) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
        values.add(rnd.getrandbits(64))
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(fps)).collect()}
    want = groups_brute({simhash.signed(v): v for v in values})
    sizes = defaultdict(set)
    for v, r in want.items():
        sizes[r].add(v)
    assert {n: r for n, r in roots.items()} == {v: r for v, r in want.items() if len(sizes[r]) > 1}


def test_simhash_odd_rows(odd, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    zero = "0" * 16
    assert {(5, zero, 3), (4, zero, 3), (3, zero, 3)} <= set(got)
    assert sum(g[0] == 2 for g in got) == 2 and len({g[2] for g in got if g[0] == 2}) == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {2, 3, 7, 8, None} <= set(ids) and 5 not in ids and 4 not in ids
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one_keeps_a_row_of_every_component(make):
    text = lambda n: " ".join(random.Random(n).choice("abcdefgh") * 3 + str(random.Random(n * 50 + k).randrange(10 ** 6)) for k in range(30))
    rows = [(None, text(n)) for n in range(6)] + [(1, text(10)), (1, text(11)), (1, text(11)), (None, text(10)), (4, text(0)), (3, text(0))]
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one(make(rows)).collect()))
    assert kept == sorted([(0, text(n)) for n in range(1, 6)] + [(3, text(0)), (1, text(10)), (1, text(11))])


def grams(line, k=lines.SHINGLE):
    u = line.encode("utf-16-be")
    return {u[2 * i:2 * i + 2 * k] for i in range(max(0, len(u) // 2 - k + 1))}


def dedup_brute(rows, similarity=lines.SIMILARITY):
    """(doc_id, text) -> deduplicated texts in order of the rows."""
    spots = sorted((d, p, x) for d, t in rows for p, x in enumerate((t or "").split("\n")) if x.strip(" "))
    texts = sorted({x for _, _, x in spots})
    sets = {x: grams(x) for x in texts}
    pairs = []
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                pairs.append((a, b))
    root = unite(pairs, texts)
    keep = {}
    for d, p, x in spots:
        keep.setdefault(root[x], (d, p))
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or keep[root[x]] == (d, p))
            for d, t in rows}


def test_line_dedup_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()}
    want = dedup_brute(docs)
    differ = [i for i in want if got[i] != want[i]]
    assert len(differ) <= 0.01 * len(want)
    assert sum(got[i] != t for i, t in docs) > 10


def test_line_dedup_large_groups_lose_no_link(make):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(160))
    def change(s, n):
        for _ in range(n):
            i = rnd.randrange(len(s))
            s = s[:i] + rnd.choice("XYZ") + s[i + 1:]
        return s
    rows = [(i, "\n".join([change(base, i % 2), "own line number %d of this text" % (i * 7919), "hot line that everyone has"])) for i in range(120)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(make(rows)).collect()}
    want = dedup_brute(rows)
    assert sum(got[i] != want[i] for i in want) <= 2
    assert sum("hot line" in t for t in got.values()) == 1


def test_line_dedup_of_short_lines_is_exact(make):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2)) + "q7"
    pairs = [("Contact us now", "Contact us now."), ("----------", "-" * 33), ("=" * 12, "=" * 13), ("abcdefgh", "abcdefghi")]
    pairs += [(w, end(w)) for n in range(8, 30) for w in [word(n)] for end in [lambda w: w + ".", lambda w: "#" + w]]
    pairs += [(w, w[:n // 2] + "X" + w[n // 2 + 1:]) for n in (50, 60, 78, 90) for w in [word(n)]]
    rows = [(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(make(rows)).collect()}
    assert got == dedup_brute(rows)
    assert [got[1], got[3], got[5], got[rows[-1][0]]] == [""] * 4 and got[7] == ""


def test_line_dedup_odd_rows(odd, none, make):
    got = lines.without_repeats(odd)
    assert got.columns == odd.columns and got.count() == len(ODD)
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert texts[5] == (None, None) and texts[4] == ("", 0) and texts[8][0] == ODD[7][1]
    assert lines.without_repeats(none).count() == 0
    rows = [(1, "\n\nsame\n"), (2, "same\nsame"), (3, None), (None, "same")]
    texts = {r.doc_id: r.text for r in lines.without_repeats(make(rows)).collect()}
    assert texts == {1: "\n\nsame\n", 2: "", 3: None, None: ""}


def test_line_dedup_of_null_ids_and_repeated_rows(make, spark):
    rows = [(None, "one line"), (None, "one line"), (None, "one line\n\nother line"), (1, "text of one"), (1, "text of one"), (2, "text of one")]
    out = lines.without_repeats(make(rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted([(0, "one line"), (0, ""), (0, "\nother line"), (1, "text of one"), (1, ""), (2, "")])
    clash = spark.createDataFrame([(1, "a line\na line", "p", "q", 5), (1, "a line\na line", "p", "r", 6)],
                                  "doc_id long, text string, __lines string, `drop.x` string, first int")
    got = lines.without_repeats(clash)
    assert got.columns == clash.columns
    assert {(r["__lines"], r["drop.x"], r["first"]) for r in got.collect()} == {("p", "q", 5), ("p", "r", 6)}
    assert sorted(r.text for r in got.collect()) == ["", "a line"]


def test_band_recall_at_the_least_similarity():
    """Pairs of a similarity of 0.8 to 0.82: at least 95 of 100 share a band and agree in enough places, at every length."""
    rnd = np.random.default_rng(9)
    odd = np.array([random.Random(k).getrandbits(32) | 1 for k in range(lines.BINS)], dtype=np.uint32)
    for length in (12, 25, 40, 60, 120, 400, 2000):
        met = tried = 0
        while tried < 150:
            a = "".join(rnd.choice(list("abcdefghijklmnop "), length))
            cut = int(rnd.integers(0, length))
            new = "".join(rnd.choice(list("QRSTUV"), max(1, round(length * 0.105))))
            b = a[:cut] + new + a[cut + len(new):]
            x, y = grams(a), grams(b)
            if not 0.8 <= len(x & y) / len(x | y) <= 0.82 + 1 / length:
                b = a[:-max(1, round(length * 0.19))]  # the same beginning
                x, y = grams(a), grams(b)
                if not 0.78 <= len(x & y) / len(x | y) <= 0.85:
                    break
            tried += 1
            which, kind, least = lines.signatures([a, b], lines.SHINGLE, odd)
            for k in (0, 1):
                s, t = least[(which == 0) & (kind == k)], least[(which == 1) & (kind == k)]
                if len(s) and len(t):
                    same = (s == t).reshape(lines.BANDS, lines.ROWS)
                    bits = s[0, :lines.PLACES] * np.uint32(0x9E3779B1) >> 30 == t[0, :lines.PLACES] * np.uint32(0x9E3779B1) >> 30
                    if same.all(axis=1).any() and bits.sum() >= lines.AGREE:
                        met += 1
                        break
        assert met >= 0.95 * tried, (length, met, tried)


@pytest.mark.parametrize("size", [2, 5, 6, 7, 40])
@pytest.mark.parametrize("split", [1, 3, 100])
def test_lists_that_cross_batches_and_ranges(size, split):
    """Equal signatures: every member of a list is linked or told as a member, wherever batches and ranges end."""
    import pyarrow as pa
    rows = [(k, 7, 100 * k + i) for k in range(4) for i in range(size if k == 2 else 1)]
    names = ["key", "bits", "h"]
    for cut in range(0, len(rows) + 1, max(1, split)):
        pairs, members, edges = set(), set(), defaultdict(set)
        for part in (rows[:cut], rows[cut:]):
            batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*part[i:i + split])], names=names) for i in range(0, len(part), split)]
            for out in lines._meet(iter(batches)):
                for r in out.to_pylist():
                    if r["kind"] == lines.PAIR:
                        pairs.add((r["a"], r["b"]))
                    elif r["kind"] == lines.MEMBER:
                        members.add((r["key"], r["a"]))
                    else:
                        edges[r["key"]].add(r["a"])
        pairs |= {(min(x), v) for x in edges.values() for v in x if v != min(x)}
        own = {200 + i for i in range(size)}
        assert all(a in own and b in own for a, b in pairs)
        assert len({unite(pairs, own)[n] for n in own}) == 1
        if size <= lines.NEIGHBOURS + 1 and cut in (0, len(rows)):
            assert {(a, b) for a in own for b in own if a < b} <= pairs
        if size > lines.NEIGHBOURS + 1:
            assert {(2, n) for n in own} <= members


def test_op5_counts(spark):
    rows = op5_line_dedup(spark, SF_SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(0 <= r.n_kept <= r.n_lines for r in rows) and any(r.n_kept < r.n_lines for r in rows)


def top_brute(rows, k, is_query):
    """All results in order, by row: a query meets every row but its own."""
    q = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
         if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for m, (a, v) in enumerate(q):
        if is_query(a):
            scored = sorted((-sum(x * y for x, y in zip(v, w)), b, n) for n, (b, w) in enumerate(q) if n != m and len(w) == len(v))
            out += [(a, r + 1, b, -s) for r, (s, b, _) in enumerate(scored[:k])]
    return sorted(out)


def test_op10_matches_its_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_SMALL}/embeddings.parquet')")
    got = sorted(tuple(r) for r in op10_exact_top_k(spark, SF_SMALL).collect())
    assert got == sorted(con.execute(LLM_ORACLE["op10_exact_top_k"]).fetchall())
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert got == top_brute(rows, 5, lambda i: i % 50 == 0)


def test_top_k_is_the_same_in_blocks_and_squares_of_any_size(spark, monkeypatch):
    from pyspark.sql import functions as F
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").repartition(3)
    want = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 7 == 0).collect())
    n = df.where("vec_id % 7 = 0").count()
    monkeypatch.setattr(topk, "SCORED_AT_ONCE", 5)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", -(-n // 2))
    assert want and sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 7 == 0, query_bytes=1 << 30).collect()) == want


@pytest.mark.parametrize("block", [topk.QUERY_BYTES, 40])
def test_top_k_odd_rows(spark, block):
    from pyspark.sql import functions as F
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, 0.25]) for i in range(1, 60)] + [(100, [1.0, -1.0]), (101, None), (102, [1.0, None]), (103, [nan, 1.0]),
            (104, [inf, 0.0]), (105, []), (None, [9.0, 9.0]), (150, [900000.5, -3.0]), (200, [1.0, 2.0, 3.0]), (250, [0.0, 0.0])]
    rows += [(100, [1.0, -1.0]), (100, [0.5, 0.5]), (7, [0.5, 0.25]), (7, [0.5, 0.25])]  # repeated rows, and another with a query's id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    old, topk.QUERY_BYTES = topk.QUERY_BYTES, block
    try:
        got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    finally:
        topk.QUERY_BYTES = old
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(got) == top_brute(plain, 5, lambda i: i % 50 == 0)
    con = duckdb.connect()
    con.register("plain", __import__("pyarrow").table({"vec_id": [i for i, _ in plain], "embedding": [v for _, v in plain]}))
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM plain")
    assert sorted(con.execute(LLM_ORACLE["op10_exact_top_k"]).fetchall()) == sorted(got)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_keep_one_shuffles_texts_once(spark, make):
    from shiftlake.llm.simhash import keep_one

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y z u v w"), (None, "x y z u v w"), (2, None), (0, "k l m n o p")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = keep_one(make(rows))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.index("SortMergeJoin") < plan.index("Exchange")  # no shuffle of whole rows behind the join
        assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(
            [(1, "a b c d e f"), (None, "x y z u v w"), (2, None), (0, "k l m n o p")], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_removes_its_shuffle_files(spark):
    import glob
    import tempfile
    import time

    files = lambda: {f for d in tops for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    tops = (spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()).split(",")
    tops = [f for d in tops for f in glob.glob(f"{d}/blockmgr-*")]
    before = files()
    frame = spark.range(100, numPartitions=3).selectExpr("id % 7 as k").groupBy("k").count()
    frame.collect()
    assert files() - before  # they are seen while nothing removes them
    before = files()
    assert lines.stored(frame, "line_wanted").count() == 7
    shuffles = lambda: {f.rpartition("/")[2].split("_")[1] for f in files() - before}
    for _ in range(50):
        if len(shuffles()) <= 1:  # the count has one of its own
            break
        time.sleep(0.1)
    assert len(shuffles()) <= 1


def test_line_dedup_leaves_no_steps_on_disk(spark, make):
    import glob
    from shiftlake.session import shared_dir

    at = f"{shared_dir(spark).removeprefix('file://')}/shiftlake/llm"
    rnd = random.Random(11)
    rows = [(i, "\n".join("".join(rnd.choice("abcdefgh ") for _ in range(60)) for _ in range(3)) + "\nthe line of all, number %d" % (i // 2)) for i in range(40)]
    steps = lambda: {p for p in glob.glob(f"{at}/*/*") if not p.split("/")[-2].startswith(("links", "line_repeated", "line_copies"))}
    before = steps()
    got = lines.dedup_lines(make(rows))
    assert steps() == before
    assert {r.doc_id: r.text for r in got.collect()} == dedup_brute(rows)


def test_only_postings_under_shared_keys_are_dealt(spark, monkeypatch):
    from pyspark.sql import functions as F

    rnd = random.Random(12)
    rows = [(h * 0x9E3779B97F4A7C15 % 2 ** 63, [rnd.getrandbits(63) if k or h % 10 else 77 for k in range(lines.BANDS)], h) for h in range(1, 3000)]
    rows += rows[:500]  # the same line again is no second line
    signed = spark.createDataFrame(rows, "h long, keys array<long>, bits long").repartition(4)
    for told in (lines.TOLD, 50):  # runs of any length
        monkeypatch.setattr(lines, "TOLD", told)
        posts = lines._posts(signed).distinct().collect()
        assert {r.h for r in posts if r.key == 77} == {r[0] for r in rows if r[2] % 10 == 0}
        assert len(posts) < 299 + 0.02 * 3000 * lines.BANDS
    assert lines._posts(signed.limit(0)).count() == 0


def test_lines_across_components_meet_in_groups_of_any_size(spark, monkeypatch):
    """Small groups meet as they are, larger ones through the prefix filter: no similar pair of different roots is lost in either."""
    rnd = random.Random(13)
    base = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200))
    texts = {n: base[:n] + "".join(rnd.choice("XYZ") for _ in range(n % 7)) + base[n + n % 7:] for n in range(1, 60)}
    few = spark.createDataFrame(list(texts.items()), "h long, line string")
    apart = spark.createDataFrame([(n, n // 3, 0) for n in texts], "h long, root long, largest long")
    sets = {n: grams(t) for n, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and a // 3 != b // 3 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for group in (lines.GROUP, 5):
        monkeypatch.setattr(lines, "GROUP", group)
        got = lines._verified(lines._rest(apart, few, lines.SHINGLE, lines.SIMILARITY), few, lines.SHINGLE, lines.SIMILARITY)
        assert want and {tuple(r) for r in got.collect()} == want
