"""Token counts, records and byte BPE against the public tokenizer libraries."""

import base64
import hashlib
import random
import struct
import zlib

import public_tokenizers as P
import pytest

from conftest import SF_SMALL

from llm.conftest import ODD
from shiftlake.llm import bpe, records, token_counts
from shiftlake.llm.queries import op1_token_counts, op6_token_records, op8_byte_bpe
from shiftlake.session import scratch_path

PIECES, RANKS, JSON = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def spm():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(JSON)


def fuzz(n=1500):
    rnd = random.Random(1)
    alphabet = " \n\t  aabeéèthson's'll12³½\U0001F600一二▁<s>　\x85\x00"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + [
        "a" * 3000, " " * 200, "ab" * 2000, "aaaa  bbbb " * 300]


@pytest.mark.parametrize("chunk", [1 << 16, 7, 1])
def test_transducer_counts_like_the_library(spm, chunk):
    sp, machine = token_counts.load(PIECES)
    texts = fuzz(1500 if chunk > 1 else 300)
    assert [machine.count(sp.normalize(t), chunk) if t else 0 for t in texts] == [len(x) for x in spm.encode(texts)]


def test_chunk_maps_compose_in_any_order(spm):
    sp, machine = token_counts.load(PIECES)
    text = sp.normalize("aaaaaaaaaaaaaaaa the thing\n" * 30)
    maps = [machine.chunk_map(text[i:i + 5]) for i in range(0, len(text), 5)]
    left = right = None
    for m in maps:
        left = m if left is None else machine.compose(left, m)
    for m in reversed(maps):
        right = m if right is None else machine.compose(m, right)
    assert left[0] == right[0] and left[2] == right[2] and left[1] is right[1]


def test_token_counts_odd_rows(odd, none, spm):
    got = sorted(map(tuple, token_counts.count_tokens(odd, PIECES, limit=20).collect()), key=str)
    want = []
    for doc_id, text, *_ in ODD:
        n = len(spm.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 20))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_op1_whole_table(spark, spm):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in op1_token_counts(spark, SF_SMALL).collect():
        assert r.n_tokens == len(spm.encode(docs[r.doc_id])) and r.over_limit == (r.n_tokens > 4096)


def test_encoder_merges_like_the_library(tik):
    encoder = bpe.load(RANKS, P.PATTERN)
    for t in fuzz():
        ids = encoder(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tik.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_compatible_pairs_are_merge_results():
    encoder = bpe.load(RANKS, P.PATTERN)
    for word in ("internationalisation", "aaaaaaaaaaaaaaaaaaaa", "zzqxzzqx"):
        from shiftlake.llm.merges import merge
        assert encoder.tokens(word) == merge(word, encoder.rank)


def test_byte_bpe_odd_rows(odd, none, tik):
    encoded = bpe.encode(odd, RANKS, P.PATTERN)
    got = sorted(map(tuple, bpe.round_trip_digest(bpe.decode(encoded, RANKS, P.PATTERN)).collect()), key=str)
    want = []
    for doc_id, text, *_ in ODD:
        ids = tik.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0


def test_op8_whole_table(spark, tik):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = op8_byte_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tik.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def _ids(hf, text):
    return hf.encode(text or "", add_special_tokens=False).ids + [0]


def test_records_round_trip_odd_rows(spark, odd, none, hf):
    out = records.written(odd, JSON)
    got = sorted(map(tuple, records.record_digest(spark, out).collect()), key=lambda r: r[1])
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for doc_id, text, *_ in order:
        ids = _ids(hf, text)
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    assert records.record_digest(spark, records.written(none, JSON)).count() == 0


def test_index_fetches_single_records(spark, odd, hf):
    out = scratch_path(spark, "records_test")
    records.write_records(odd, out, JSON, file_bytes=1 << 10)
    index = spark.read.parquet(f"{out}/index")
    assert index.count() == len(ODD) and index.select("file").distinct().count() > 1
    (row,) = records.fetch(spark, out, index.where("doc_id = 7")).collect()
    ids = _ids(hf, dict((r[0], r[1]) for r in ODD)[7])
    assert row.doc_id == 7 and row.ids == struct.pack(f"<{len(ids)}I", *ids)


def test_damaged_record_raises():
    frame = bytearray(records.frame(3, b"\x01\x00\x02\x00", False))
    assert records.unframe(frame, 0)[1].tolist() == [1, 2]
    for at in (0, 9, 15, len(frame) - 3):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            records.unframe(bad, 0)


def test_op6_whole_table(spark, hf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in op6_token_records(spark, SF_SMALL).collect()}
    start = 0
    for doc_id, text in docs:
        ids = _ids(hf, text)
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_a_worker_keeps_the_caches_of_one_operator(monkeypatch):
    from functools import lru_cache

    from shiftlake.llm import bpe, common, token_counts

    for module in (bpe, token_counts):
        monkeypatch.setattr(module, "load", lru_cache(lambda: [0]))
        module.load()
    common.release("shiftlake.llm.bpe")
    assert bpe.load.cache_info().currsize == 1 and token_counts.load.cache_info().currsize == 0


def test_records_encoder_parts_joined_stretches(hf, monkeypatch):
    texts = ["", " ", "a", " a", "a ", "a b", "\n a", "a\nb c\n", "\na b", "x  y", "x y z", "it's 's s' 12 3", "Ġ Ġa bĠ", "a Ġ",
             "\x1c b", "b\x1c c", "　 b c", "c <|endoftext|> d", "<|endoftext|>", "é\U0001F600 ü x", "a  b c", "a" * 100 + " b"]
    encoder = records.BatchEncoder(JSON)
    monkeypatch.setattr(records, "JOINED", 3)
    calls = []
    monkeypatch.setattr(encoder, "library", type("Counted", (), {"encode_batch_fast": staticmethod(
        lambda t, **k: calls.extend(t) or hf.encode_batch_fast(t, **k))}))
    for _ in range(2):  # as new ones, then as kept ones
        got = encoder(records.pa.array(texts))
        assert [records.np.frombuffer(g, encoder.kind).tolist() for g in got] == [hf.encode(t, add_special_tokens=False).ids for t in texts]
    before = len(calls)
    encoder(records.pa.array([f"w {i} {i + 1}" for i in range(1000, 1009, 2)]))
    assert len(calls) - before < 10  # 10 new stretches in joined calls, not one by one


def test_parts_are_bounded_and_whole():
    sizes = records.np.cumsum([5, 1, 1, 20, 0, 3, 3])
    assert list(records.parts(sizes, 6)) == [(0, 2), (2, 3), (3, 4), (4, 7)] and list(records.parts(sizes[:0], 6)) == []


def test_decoding_keeps_no_encoder(odd, monkeypatch):
    encoded = bpe.encode(odd, RANKS, P.PATTERN)
    ids = bpe.load(RANKS, P.PATTERN)("to and fro")
    monkeypatch.setattr(bpe, "map_batches", lambda df, rows, schema, piece_bytes: (rows, piece_bytes))
    rows, piece_bytes = bpe.decode(encoded, RANKS, P.PATTERN)
    assert list(rows([1, 2], [len(ids) // 4, 0], [ids, None])) == [(1, len(ids) // 4, ids, b"to and fro"), (2, 0, None, b"")]
    assert bpe.load.cache_info().currsize == 0 and piece_bytes == bpe.PIECE_BYTES


def test_batches_are_worked_off_in_pieces(odd, monkeypatch):
    from shiftlake.llm import common
    batch = records.pa.record_batch([records.pa.array(range(100)), records.pa.array(["x" * 1000] * 99 + ["y" * 50000])], ["a", "b"])
    parts = list(common.pieces(batch, 10000))
    assert records.pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch) and max(p.num_rows for p in parts) < 10
    assert [p.num_rows for p in common.pieces(batch, 1)] == [1] * 100 and list(common.pieces(batch.slice(0, 0), 10)) == []
    seen = []
    monkeypatch.setattr(common, "map_arrow", lambda df, run, schema, owner: run)
    run = common.map_batches(odd, lambda a, b: seen.append(len(a)) or zip(a, b), "a long, b string", 10000)
    assert records.pa.Table.from_batches(run(iter([batch, batch.slice(0, 0)]))).column("a").to_pylist() == list(range(100)) and max(seen) < 10


def test_records_encoder_merges_plain_words_itself(hf, monkeypatch):
    rnd = random.Random(3)
    letters = [c for c in map(chr, range(0x100)) if c.isalpha()]
    words = ["".join(rnd.choices(letters, k=rnd.randint(1, 12))) + rnd.choice(["", ",", ".", "?", "!", ":", ";"]) for _ in range(3000)]
    words += [c + "x" for c in letters if c not in "\u00aa\u00b5\u00ba"] + ["quan\u00b5t", "it's", "a,b", "a,,", ",", "\u0131x", "\u4e00"]
    texts = ["a " + " ".join(words[i:i + 7]) for i in range(0, len(words), 7)]
    encoder = records.BatchEncoder(JSON)
    calls = []
    monkeypatch.setattr(encoder, "library", type("Counted", (), {"encode_batch_fast": staticmethod(
        lambda t, **k: calls.extend(t) or hf.encode_batch_fast(t, **k))}))
    got = encoder(records.pa.array(texts))
    assert [records.np.frombuffer(g, encoder.kind).tolist() for g in got] == [hf.encode(t, add_special_tokens=False).ids for t in texts]
    plain = {w for w in words if encoder.word(w)} - {"a"}  # the first word of each text goes the other way
    assert len(plain) > 2000 and not plain.intersection(" ".join(calls).split())
