"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

``word_bpe_49k.json`` drops white space and never merges across it, so a text's ids are the ids of its blank-separated
chunks end to end. Chunks are encoded in batches by the library and kept as little-endian 32-bit ids in a table per
Python worker, which is emptied when it holds ``MOST`` chunks. ``WordEncoder.exact`` tells by the file whether chunks
may be encoded apart; where they may not, whole texts are encoded. Chunks of ASCII and Latin-1 letters go
to the library's merge model directly, piece by piece, which spares its normaliser and splitter. That short way is taken
only for a file whose normaliser composes, folds white space and lowers case, and whose splitter is a pattern, which is
read from the file; the encoder compares both ways on sample words when it is built and falls back if they ever differ.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
MOST = 500_000
#: Longer chunks are encoded each time rather than kept.
LONGEST = 64


def default_path() -> str:
    return public_tokenizers.path(WORD_BPE)


_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_SAMPLE = ["don't", "I'LL", "'sea", "a'b'c", "x1y22", "+1", "(555)", "***$$", "http://a.example/b?c=1", "a@b.c", "|", "--", "É'D9", "'", "''s", "won't've", "the", "Word", "strasse.", "Straße", "êtes", "NIÑO,", "Ciónmente;", "über?!", "ZZZ!!", "a", "É", "ÿ.", "thereof..."]
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level spelling: printable bytes stand for themselves, the others for the code points from 256 on.
_SPELL = {b: chr(b) for b in _PRINTED} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


def _spelled(piece: str) -> str:
    return piece if piece.isascii() else "".join([_SPELL[b] for b in piece.encode()])


def _latin_pattern(pattern: str) -> re.Pattern | None:
    """A split pattern for lower-case text of the characters in ``_PLAIN``: letters and numbers become ranges; None for other properties."""
    classes, out, inside, i = {r"\p{L}": "a-zß-öø-ÿ", r"\p{N}": "0-9"}, [], False, 0
    while i < len(pattern):
        ranges = classes.get(pattern[i : i + 5])
        if ranges:
            out.append(ranges if inside else f"[{ranges}]")
            i += 5
        elif pattern[i] == "\\":
            if pattern[i + 1 : i + 2] in ("p", "P", "X"):
                return None
            out.append(pattern[i : i + 2])
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out))


class _Chunks(dict):
    """Ids by chunk; a chunk not held is encoded and, unless very long, kept."""

    def __init__(self, owner: WordEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        ids = self.owner.encode_chunk(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= MOST:
                self.clear()
            self[chunk] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.exact = self._splits_at_blanks(spec)
        self.chunks = _Chunks(self)
        self.pieces: dict[str, bytes] = {}
        self.split = self._splitter(spec)
        self.plain = self.exact and self.split is not None
        self.plain = self.plain and [self.encode_chunk(x) for x in _SAMPLE] == self._encode(_SAMPLE)

    @staticmethod
    def _splits_at_blanks(spec: dict) -> bool:
        """True if blanks vanish before the merges and no added token holds or strips one."""
        split = json.dumps(spec.get("pre_tokenizer") or {})
        model = spec.get("model") or {}
        added = spec.get("added_tokens") or []
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in added)
        return plain and '"Removed"' in split and "[^\\\\s" in split and '"add_prefix_space": false' in split and model.get("end_of_word_suffix") == "</w>" and spec.get("post_processor") is None

    @staticmethod
    def _splitter(spec: dict) -> re.Pattern | None:
        """The file's split pattern, if its normaliser and splitter are of the form that the short way stands for."""
        normal = (spec.get("normalizer") or {}).get("normalizers") or []
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
            return None
        blank, (split, level) = normal[1], parts
        if blank["pattern"] != {"Regex": r"\s+"} or blank["content"] != " " or "Regex" not in split["pattern"]:
            return None
        if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
            return None
        model = spec.get("model") or {}
        if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
            return None
        return _latin_pattern(split["pattern"]["Regex"])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= MOST:
                self.pieces.clear()
            found = array("I", [t.id for t in self.model.tokenize(_spelled(piece))]).tobytes()
            if len(piece) <= LONGEST:
                self.pieces[piece] = found
        return found

    def encode_chunk(self, chunk: str) -> bytes:
        if not self.plain or "<|" in chunk or not _PLAIN.fullmatch(chunk):
            return self._encode([chunk])[0]
        pieces = self.split.findall(chunk.lower())
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join([self._piece(p) for p in pieces])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null counts as empty."""
        if not self.exact:
            return self._encode([t or "" for t in texts])
        chunks = self.chunks
        # blanks and line feeds alone: white space to every splitter, and a subset of what the tokenizer drops
        return [b"".join([chunks[w] for w in t.replace("\n", " ").split(" ")]) if t else b"" for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder per file and Python worker."""
    return WordEncoder(path)
