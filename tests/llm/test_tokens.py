import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratakit.llm import packing, pieces, tokenfile, tokens

TEXTS = [None, "", " ", "a\n\nb  c", "<|endoftext|> x", "x<|endoftext|>y", " Σίσυφος É ́a b", "don't\tI'll 's it's", "É Ça “quoted” naïve", "x" * 3000, "1,234.5 (a)b", "word " * 5000, "日本語 テキスト", "a b c\x1cd", "<| |>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def table(spark, texts):
    return spark.createDataFrame([(7 * k % 101, t, 1, "z") for k, t in enumerate(texts)], "doc_id long, text string, part int, ids string")


def test_encoder_equals_library(library):
    e = tokens.WordEncoder(tokens.default_path())
    assert e.exact and e.plain
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(TEXTS)] == [ids_of(library, t) for t in TEXTS]
    other = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.exact
    assert np.frombuffer(other.encode([" a b"])[0], "<u4").tolist() == other.tokenizer.encode(" a b", add_special_tokens=False).ids


def test_short_way_is_for_files_it_knows(library, tmp_path):
    """Another normaliser or split pattern: ids still are the library's."""
    import json
    import random

    with open(tokens.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcXYZ'019é.-ß") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    text = " ".join(words)
    other = json.loads(json.dumps(spec))
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+".replace("\\\\", "\\")
    cased = json.loads(json.dumps(spec))
    cased["normalizer"]["normalizers"] = cased["normalizer"]["normalizers"][:2]
    for k, s in enumerate((spec, other, cased)):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(s), encoding="utf-8")
        e = tokens.WordEncoder(str(path))
        assert e.plain == (k < 2)
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_token_files(spark, library, tmp_path):
    df = table(spark, TEXTS)
    got = sorted(map(tuple, tokenfile.token_digests(df).collect()))
    want, at = [], 0
    for r in sorted(df.collect(), key=lambda r: r.doc_id):
        ids = np.array([*ids_of(library, r.text), 1], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_in_parts_and_small_shards(spark, library, tmp_path):
    rows = [(k * 37 % 1009, f"text number {k} " * (k % 9)) for k in range(1009)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokenfile.write_tokens(df, str(tmp_path / "t"), shard_bytes=2000, part_bytes=8000)
    shards = spark.read.parquet(str(tmp_path / "t" / "shards")).orderBy("part", "shard").collect()
    assert len(shards) > 20 and [s.first_doc for s in shards] == sorted(s.first_doc for s in shards)
    got = sorted(map(tuple, tokenfile.read_tokens(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens").collect()))
    at = 0
    for (k, text), row in zip(sorted(rows), got, strict=True):
        n = len(ids_of(library, text)) + 1
        assert row == (k, at, n)
        at += n
    dictionary = bytes(spark.read.parquet(str(tmp_path / "t" / "dictionary")).first().dictionary)
    assert dictionary
    shard = tokenfile.Shard(bytes(shards[3].content), dictionary)
    doc = int(shard.doc_ids[0])
    assert shard.find(doc).tolist() == [*ids_of(library, dict(rows)[doc]), 1] and shard.find(-5) is None
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfile.Shard(bytes(shards[3].content), b"x")


def test_lookup_reads_few_shards(spark, library, tmp_path):
    rows = [(k * 3, f"document number {k} " * (1 + k % 5)) for k in range(800)] + [(30, "another text of one id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = str(tmp_path / "t")
    tokenfile.write_tokens(df, path, shard_bytes=1500, part_bytes=6000)
    whole = {(r.doc_id, r.start): (r.n_tokens, bytes(r.ids)) for r in tokenfile.read_tokens(spark, path).collect()}
    found = tokenfile.lookup(spark, path, [30, 1500, 31, None, 10**9])
    got = {(r.doc_id, r.start): (r.n_tokens, bytes(r.ids)) for r in found.collect()}
    assert got == {k: v for k, v in whole.items() if k[0] in (30, 1500, None)} and len(got) == 4
    assert np.frombuffer(next(v[1] for k, v in got.items() if k[0] == 1500), "<u4").tolist() == [*ids_of(library, rows[500][1]), 1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "first_doc" in plan.split("PushedFilters")[1]
    assert tokenfile.lookup(spark, path, []).count() == 0


def test_one_id_in_a_third_of_the_rows(spark, tmp_path):
    rows = [(5, f"copy {k} of one id") for k in range(400)] + [(5, "same row")] * 200 + [(k, f"other {k}") for k in range(10, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokenfile.write_tokens(df, str(tmp_path / "t"), part_bytes=2000)
    parts = spark.read.parquet(str(tmp_path / "t" / "shards")).groupBy("part").agg({"n_docs": "sum", "first_doc": "min", "last_doc": "max"}).orderBy("part").collect()
    assert sum(r["min(first_doc)"] == 5 for r in parts) >= 3 and max(r["sum(n_docs)"] for r in parts) < 500
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.read_tokens(spark, str(tmp_path / "t")).collect())
    assert [d for _, d, _ in got] == sorted(k for k, _ in rows) and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))


def test_token_files_null_ids_ties_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (None, None)], "doc_id long, text string")
    got = tokenfile.token_digests(df).collect()
    assert sorted(r.start for r in got) and {r.doc_id for r in got} == {None, 3} and sum(r.n_tokens for r in got) == 7
    assert min(r.start for r in got if r.doc_id == 3) == sum(r.n_tokens for r in got if r.doc_id is None)
    assert tokenfile.token_digests(df.where("doc_id = 99")).count() == 0


def check_pieces(rows, library, texts):
    windows, by_doc = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at and n > 0
            at += n
        assert at <= 4096
    assert set(by_doc) == set(texts)
    for k, text in texts.items():
        ids, at = np.array([*ids_of(library, text), 2], "<u4"), 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing(spark, library):
    texts = {k: t for k, t in enumerate([*TEXTS, *["some words here " * (k * 13 % 400) for k in range(120)], "long " * 9000, *["p " * 4095, "q " * 4094]])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6).selectExpr("*", "1 as start", "2 as offset", "3 as part")
    rows = packing.pack_documents(df, open_windows=4, merge_parts=3).collect()
    check_pieces(rows, library, texts)
    stats = packing.padding(packing.pack_documents(df)).first()
    assert stats.padding <= 4096 + 0.01 * stats.ids
    assert packing.pack_documents(df.where("doc_id < 0")).count() == 0


def test_packing_null_ids_keep_large_ids(spark):
    big = 2**53 + 1
    rows = packing.pack_documents(spark.createDataFrame([(None, "a"), (big, "b"), (big, "b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, big, big] and len({r.sequence_id for r in rows}) == 1


def test_whole_tables(spark, library):
    from stratakit.llm import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    check_pieces(queries.op6_packing(spark, d).collect(), library, texts)
    want, at = [], 0
    for k in sorted(texts):
        ids = np.array([*ids_of(library, texts[k]), 1], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op1_token_files(spark, d).collect())) == want
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for r in queries.op3_sentencepiece(spark, d).collect():
        ids = np.array(model.encode(texts[r.doc_id]), "<u4")
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) and r.round_trip


def test_pieces(spark):
    codec = pieces.PieceCodec(pieces.default_path())
    codec.verify([t or "" for t in TEXTS])
    codec.cuts = False
    codec.verify([t or "" for t in TEXTS])
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(df)).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    assert pieces.piece_digests(df.where("doc_id < 0")).count() == 0


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(*fields):
    """Protobuf of (number, value): int, float or bytes."""
    import struct

    out = b""
    for k, v in fields:
        out += varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(k << 3 | 2) + varint(len(v)) + v
    return out


def test_unigram_model_has_parity(tmp_path):
    """A unigram model with byte fallback and white-space folding, written by hand as a protobuf."""
    words = [("▁the", -2.0), ("▁", -3.0), ("th", -4.0), ("e", -4.5), ("a", -4.0), ("t", -4.2), ("h", -4.3), ("▁a", -3.1), ("at", -3.9), ("▁hat", -5.0)]
    parts = [(1, message((1, b"<unk>"), (2, 0.0), (3, 2))), (1, message((1, b"<s>"), (2, 0.0), (3, 3))), (1, message((1, b"</s>"), (2, 0.0), (3, 3)))]
    parts += [(1, message((1, f"<0x{b:02X}>".encode()), (2, 0.0), (3, 6))) for b in range(256)]
    parts += [(1, message((1, t.encode()), (2, s))) for t, s in words]
    parts += [(2, message((3, 1), (35, 1), (40, 0))), (3, message((1, b"identity"), (3, 1), (4, 1)))]
    path = tmp_path / "u.model"
    path.write_bytes(message(*parts))
    codec = pieces.PieceCodec.__new__(pieces.PieceCodec)
    try:
        codec.__init__(str(path))
    except ValueError as e:
        pytest.fail(str(e))
    assert codec.file.unigram
