"""Cross-tokenizer alignment against a plain count over all documents."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from conftest import SF_SMALL

from llm.conftest import ODD
from shiftlake.llm import alignment
from shiftlake.llm.queries import op13_tokenizer_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain}
    chars.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)})
    names = {i: t for t, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return a, b, lambda i: bytes(chars[c] for c in names[i]), lambda i: (
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode())


def plain(rows, tools):
    a, b, of_a, of_b = tools
    docs, held = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            want = (" " + text).encode()
            if b"".join(map(of_a, ids_a)) == want == b"".join(map(of_b, ids_b)):
                ends = []
                for ids, of in ((ids_a, of_a), (ids_b, of_b)):
                    at, own = 0, []
                    for i in ids:
                        at += len(of(i))
                        own.append((at, i))
                    ends.append(own)
                shared = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
                before = 0
                for e in shared:
                    groups.append([[i for at, i in own if before < at <= e] for own in ends])
                    before = e
        pairs = Counter()
        for x, y in groups:
            for i in x:
                for j in y:
                    pairs[i, j] += 1
        docs.append((doc_id, groups, pairs))
        held.update(pairs.keys())
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for doc_id, groups, pairs in docs:
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(pairs.values()),
                    sum(n for (i, j), n in pairs.items() if held[i, j] == top[i]), sum(n * held[p] for p, n in pairs.items()),
                    sha256(line.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_texts(spark, make, none, tools):
    rnd = random.Random(13)
    words = ["the", "naïve", "\U0001F600\U0001F600", "x\u2581y", "don't", "aaaaaaaaaaaa", "12345678", "\t\t", "", "日本語のテキスト", "<s>", "<|endoftext|>", "\u00a0", "\x1c", "\x00"]
    rows = [(r[0], r[1]) for r in ODD if len(r[1] or "") < 100000]
    rows += [(100 + i, rnd.choice([" ", "  ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(150)]
    rows += [(i, " ") for i in (300, 301)] + [(302, "\u2581"), (303, " \u2581 a"), (304, "a \u2581")]
    assert tuples(alignment.align(make(rows), A, B)) == plain(rows, tools)
    assert alignment.align(none, A, B).count() == 0


def test_small_blocks_and_pieces(spark, make, tools, monkeypatch):
    """The same result whatever the size of blocks, pieces and the memo, and with links of large groups by different ids."""
    rnd = random.Random(14)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "aaaaaaaaaaaaaaaaaaaaaaa", "\u3042\u3044", "q\u2581"][:4 + (i % 9 == 0)]) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    want = plain(rows, tools)
    aligner = alignment.Aligner(A, B)
    for name, value in (("PIECE_CHARS", 20), ("UNITS_KEPT", 3), ("BIG_GROUP", 2)):
        monkeypatch.setattr(alignment, name, value)
    got, held = [], Counter()
    rows_of_blocks = []
    for at in range(0, 80, 17):
        block = alignment.Block(aligner)
        for r in rows[at:at + 17]:
            block.add(*r)
        rows_of_blocks.append(block.row(at))
        pairs = np.frombuffer(rows_of_blocks[-1][4], "<i8")
        held.update(dict(zip(pairs.tolist(), np.frombuffer(rows_of_blocks[-1][5], "<i4").tolist())))
    n_b, top = len(aligner.len_b), defaultdict(int)
    for p, n in held.items():
        top[p // n_b] = max(top[p // n_b], n)
    import pyarrow as pa
    for row in rows_of_blocks:
        pairs = np.frombuffer(row[4], "<i8").tolist()
        scored = pa.table({"block": [row[0]] * len(pairs), "pair": pairs[::-1], "n_docs": [held[p] for p in pairs[::-1]],
                           "best": [held[p] == top[p // n_b] for p in pairs[::-1]]})
        got += [tuple(x.values()) for x in alignment._returned(pa.Table.from_batches([alignment._batch(row)]), scored).to_pylist()]
    assert sorted(got, key=repr) == want


def test_bitmaps_round_trip():
    rnd = np.random.default_rng(5)
    pair, doc, links = rnd.integers(0, 50, 5000) ** 2, rnd.integers(0, 700, 5000), rnd.integers(1, 20, 5000)
    pair[:700], doc[:700] = 7, np.arange(700)  # one in every document
    maps = alignment.PairBitmaps.of(pair, doc, links)
    again = alignment.PairBitmaps.unpack(maps.pairs, maps.pack(700), 700)
    assert len(maps.planes) == len(again.planes) and all((x == y).all() for x, y in zip(maps.planes, again.planes))
    docs, total = defaultdict(set), Counter()
    for p, d, n in zip(pair.tolist(), doc.tolist(), links.tolist()):
        docs[p].add(d)
        total[p] += n
    assert dict(zip(maps.pairs.tolist(), again.doc_counts().tolist())) == {p: len(x) for p, x in docs.items()}
    assert dict(zip(maps.pairs.tolist(), again.link_counts().tolist())) == dict(total)


def test_op13_whole_table(spark, tools):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert tuples(op13_tokenizer_alignment(spark, SF_SMALL)) == plain(rows, tools)
