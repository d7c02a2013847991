"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model's protobuf.

The protobuf is parsed here (wire format, four message kinds). The normaliser becomes the library's precompiled map,
white-space folding, the dummy prefix and the metaspace marker; a unigram model keeps its scores, a BPE model gets its
merges from the order of the scores; bytes stand in for characters outside the vocabulary. Batches are encoded by the
library's threads. No piece holds the marker behind another character, so a text's ids are those of its
blank-separated chunks (and of its line feeds, where no piece holds one); each distinct chunk is encoded once per
worker. Whether that holds is read from the vocabulary, and whole texts are encoded where it does not.

A unigram text that spells the name of a control or byte piece (``<s>``, ``<0x0A>``) is encoded by the sentencepiece
library itself, because the tokenizers lattice would take it for that piece.

``PieceCodec.verify`` compares ids and decoded texts with the sentencepiece library; the codec does so on sample
strings when it is built on a worker and raises on a difference.

Defined cases: null text counts as empty and has no pieces; repeated rows are coded each; an empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

#: Threads of the tokenizers library in a worker: a task has a core or two, and idle threads of a wide pool spin.
os.environ.setdefault("RAYON_NUM_THREADS", "2")

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from stratakit.llm.tokens import LONGEST, MOST

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_SAMPLE = ["", " ", "a", "Hello world", "  two  blanks ", "line\nfeed\n\n x", "tab\there", "naïve café Ångström", "日本語 text", "\U0001f600 ok", "x" * 300, "áb", "<s> </s> <unk> <0x0A>", "3.14159 + 2,71", "ﬁne ① ｆｕｌｌ", "end \n"]


def wire(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


class ModelFile:
    """Pieces (text, score, type) and the settings that matter for coding."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.unigram, self.byte_fallback, self.unk_id = True, False, 0
        self.dummy_prefix, self.fold_spaces, self.escape, self.suffix, self.charsmap = True, True, True, False, b""
        for field, value in wire(raw):
            if field == 1:
                part = dict(wire(value))
                score = part.get(2, b"\0\0\0\0")
                self.pieces.append((part.get(1, b"").decode(), struct.unpack("<f", score)[0], part.get(3, NORMAL)))
            elif field == 2:
                part = dict(wire(value))
                self.unigram = part.get(3, 1) == 1
                if part.get(3, 1) not in (1, 2):
                    raise ValueError("only unigram and BPE models are supported")
                self.byte_fallback, self.suffix = bool(part.get(35, 0)), bool(part.get(24, 0))
                self.unk_id = part.get(40, 0)
            elif field == 3:
                part = dict(wire(value))
                self.charsmap = part.get(2, b"")
                self.dummy_prefix, self.fold_spaces, self.escape = (bool(part.get(k, 1)) for k in (3, 4, 5))
        if self.suffix:
            raise ValueError("white space as a suffix is not supported")

    def merges(self) -> list[tuple[str, str]]:
        """Pairs by falling score of what they make."""
        known = {text: k for k, (text, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        pairs = []
        for text, score, kind in self.pieces:
            if kind == NORMAL:
                pairs += [(-score, known[text], cut, text) for cut in range(1, len(text)) if text[:cut] in known and text[cut:] in known]
        return [(text[:cut], text[cut:]) for _, _, cut, text in sorted(pairs)]

    def tokenizer(self) -> Tokenizer:
        if self.unigram:
            model = models.Unigram([(t, s) for t, s, _ in self.pieces], self.unk_id, self.byte_fallback)
        else:
            vocab = {t: k for k, (t, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.fold_spaces:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out


class PieceCodec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.file = ModelFile(f.read())
        self.path = path
        self.whole = self.file.tokenizer()
        usable = [t for t, _, kind in self.file.pieces if kind in (NORMAL, USER)]
        f = self.file
        self.cuts = f.escape and not f.charsmap and not f.fold_spaces and not f.unigram and not any(MARK in t.lstrip(MARK) for t in usable)
        feeds = any("\n" in t for t in usable)
        self.pattern = re.compile(r" *[^ ]+| +" if feeds else r"\n| *[^ \n]+| +")
        self.part = Tokenizer(self.whole.model)
        self.part.normalizer = normalizers.Replace(" ", MARK)
        self.ids: dict[str, bytes] = {}
        # the library's unigram lattice would match the names of control and byte pieces in a text
        names = [t for t, _, kind in f.pieces if kind in (CONTROL, UNKNOWN, BYTE)] if f.unigram else []
        self.named = re.compile("|".join(map(re.escape, names))) if names else None
        self.verify(_SAMPLE)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        texts = [t or "" for t in texts]
        if not self.cuts:
            odd = [k for k, t in enumerate(texts) if self.named and self.named.search(t)]
            if odd:
                theirs = sentencepiece.SentencePieceProcessor(model_file=self.path)
                plain = self.encode(["" if k in set(odd) else t for k, t in enumerate(texts)])
                for k in odd:
                    plain[k] = array("I", theirs.encode(texts[k])).tobytes()
                return plain
            return [array("I", e.ids).tobytes() if t else b"" for t, e in zip(texts, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
        prefix, out = " " if self.file.dummy_prefix else "", []
        chunks = [self.pattern.findall(prefix + t) if t else [] for t in texts]
        ids = self.ids
        new = list({c for row in chunks for c in row if c not in ids})
        if len(ids) + len(new) > MOST:
            ids.clear()
            new = list({c for row in chunks for c in row})
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            ids.update(zip(some, [array("I", e.ids).tobytes() for e in self.part.encode_batch_fast(some, add_special_tokens=False)], strict=True))
        out = [b"".join([ids[c] for c in row]) for row in chunks]
        for c in new:
            if len(c) > LONGEST:
                del ids[c]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.whole.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)

    def verify(self, texts: list[str]) -> None:
        """Raise where ids or decoded texts differ from the sentencepiece library's."""
        theirs = sentencepiece.SentencePieceProcessor(model_file=self.path)
        ours = self.encode(texts)
        for text, ids, back, other in zip(texts, ours, self.decode(ours), theirs.encode(texts, num_threads=1), strict=True):
            if np.frombuffer(ids, "<u4").tolist() != other:
                raise ValueError(f"ids differ from the sentencepiece library's for {text[:80]!r}")
            if back != theirs.decode(other):
                raise ValueError(f"decoded text differs from the sentencepiece library's for {text[:80]!r}")


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int)."""
    file = path or default_path()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [np.frombuffer(x, "<i4") for x in codec(file).encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    file = path or default_path()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [np.array(x or [], "<u4").tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec(file).decode(rows), pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), text_crc32 of the decoded text, round_trip."""
    file = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = codec(file).encode(texts)
                back = codec(file).decode(ids)
                cols = [[len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], [zlib.crc32(t.encode()) for t in back], [a == b for a, b in zip(texts, back, strict=True)]]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, round_trip boolean")
