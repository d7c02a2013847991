"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased (ASCII by table, the rest by n-grams of their UTF-8 bytes), every run of bytes that cannot be
part of a letter counts as one space, and the n-grams of 1 to 4 bytes are hashed into ``2 ** bits`` features. Training
takes the ``max_rows`` rows of smallest hash among the labelled rows given (the documented bound); counts are summed
by label and feature in Spark, and the driver gets one row per language. The log-probability matrix (languages x
features, float32) is broadcast: ``bits`` falls where the languages are so many that it would exceed ``model_bytes``.
Whole texts are scored in batches with sparse feature counts in numpy, very long ones piece by piece, with pieces that
overlap by the longest n-gram less one, so no n-gram is lost or counted twice.

``fit`` is the mean log-probability of a text's n-grams in the language found, less what the language's own n-grams
have on average: near 0 for ordinary text, far below for text of no learned language.

Defined cases: null text, text without a letter, or a model without languages gives ``und``, score 0 and a null fit.
Equal scores go to the smallest name. Repeated rows weigh as often as they come. An empty table gives no rows. The input's
columns travel in one struct ``row``, so no name of theirs can clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from stratakit.llm.common import spans, utf8_view

LONGEST = 4
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 20
#: ASCII letters in lower case, bytes of multi-byte characters as they are, all else a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def fold(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in lower case with single spaces, end to end, and the text number of each byte."""
    folded = _FOLD[body]
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (owner[1:] != owner[:-1])
    return folded[keep], owner[keep]


def grams(folded: np.ndarray, owner: np.ndarray, bits: int, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of folded texts and the text number of each; no n-gram spans two texts. ``starts``: only those that start in the first so many bytes."""
    folded = folded.astype(np.uint32)
    most = len(folded) if starts is None else starts
    out, owners, key = [], [], np.zeros(len(folded), np.uint32)
    for n in range(1, LONGEST + 1):
        if n > 1:
            key = key[:-1]
        if len(folded) < n:
            break
        key = key * np.uint32(257) + folded[n - 1 :]
        k = min(most, len(key))
        same = owner[n - 1 : n - 1 + k] == owner[:k]
        mixed = (key[:k] ^ (key[:k] >> np.uint32(15))) * _PRIMES[n - 1]
        out.append((mixed >> np.uint32(32 - bits))[same])
        owners.append(owner[:k][same])
    return (np.concatenate(out), np.concatenate(owners)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def gram_blocks(body: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, n-grams, text number from the first) of blocks of bounded size; a long text comes in several."""
    for i, j in spans(offsets, _BLOCK):
        folded, owner = fold(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if j > i + 1 or len(folded) <= 2 * _BLOCK:
            yield i, j - i, *grams(folded, owner, bits)
            continue
        for a in range(0, len(folded), _BLOCK):
            some = slice(a, a + _BLOCK + LONGEST - 1)
            yield i, 1, *grams(folded[some], owner[some], bits, _BLOCK)


class Model:
    """Sorted language names and the log-probability matrix, one column per language."""

    def __init__(self, names: list[str], logs: np.ndarray, priors: np.ndarray, usual: np.ndarray, bits: int):
        self.names, self.logs, self.priors, self.usual, self.bits = names, logs, priors, usual, bits

    @classmethod
    def from_counts(cls, counts: dict[str, tuple[int, np.ndarray]], bits: int, alpha: float = 0.5) -> Model:
        names = sorted(counts)
        table = np.array([counts[n][1] for n in names], np.float64).reshape(len(names), 1 << bits) + alpha
        docs = np.array([counts[n][0] for n in names], np.float64)
        share = table / table.sum(1, keepdims=True)
        logs = np.log(share)
        return cls(names, np.ascontiguousarray(logs.T.astype(np.float32)), np.log(docs / docs.sum()) if names else docs, (share * logs).sum(1), bits)

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of the n-grams, texts x languages, and the number of n-grams of each text."""
        out, size = np.zeros((len(offsets) - 1, len(self.names))), np.zeros(len(offsets) - 1, np.int64)
        for i, n, found, owner in gram_blocks(body, offsets, self.bits):
            size[i : i + n] += np.bincount(owner, minlength=n)
            for k in range(len(self.names)):
                out[i : i + n, k] += np.bincount(owner, self.logs[found, k], minlength=n)
        return out, size

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and fit (nan where there is none) of each text."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lettered = np.array([t is not None and bool(_LETTER.search(t)) for t in column.to_pylist()], bool)
        if not self.names or not len(column):
            return ["und"] * len(column), np.zeros(len(column)), np.full(len(column), np.nan)
        own, size = self.scores(*utf8_view(column))
        joint = own + self.priors
        best = joint.argmax(1)
        share = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
        fit = own[np.arange(len(own)), best] / np.maximum(size, 1) - self.usual[best]
        return [self.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0), np.where(lettered, fit, np.nan)


def train(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", bits: int = 15, max_rows: int = 20_000, model_bytes: int = 256 << 20) -> Model:
    """Fit on the ``max_rows`` labelled rows of smallest hash, so the choice is repeatable; copies of a chosen row all count."""
    chosen = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label"), F.col(key).alias("key"))
    rank = F.xxhash64("key", "label", "text")
    picked = chosen.select("label", rank.alias("rank")).orderBy("rank").limit(max_rows)
    edge = picked.agg(F.max("rank").alias("edge"), F.count("*").alias("n"), F.count_distinct("label").alias("labels")).first()
    if not edge["n"]:
        return Model.from_counts({}, bits)
    bits = min(bits, int(math.log2(max(2, model_bytes // 4 // edge["labels"]))))
    chosen = chosen.where(rank <= edge["edge"]).select("text", "label")

    def count(batches):
        """label, feature and its count; the number of documents is feature -1."""
        for batch in batches:
            texts, labels = batch.column(0), np.array(batch.column(1).to_pylist(), object)
            use = np.array([bool(_LETTER.search(t)) for t in texts.to_pylist()], bool)
            for name in sorted(set(labels[use])):
                body, offsets = utf8_view(texts.filter(pa.array(use & (labels == name))))
                held = np.zeros(1 << bits, np.int64)
                for _, _, found, _ in gram_blocks(body, offsets, bits):
                    held += np.bincount(found, minlength=1 << bits)
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_pydict({"label": [name] * (len(at) + 1), "feature": np.r_[-1, at].astype(np.int32), "n": np.r_[len(offsets) - 1, held[at]]}, pa.schema([("label", pa.string()), ("feature", pa.int32()), ("n", pa.int64())]))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << bits, np.int64)
        some = pdf[pdf.feature >= 0]
        held[some.feature.to_numpy()] = some.n.to_numpy()
        return pd.DataFrame({"label": pdf.label[:1], "docs": [int(pdf.n[pdf.feature < 0].sum())], "counts": [held.tobytes()]})

    sums = chosen.mapInArrow(count, "label string, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    # a label has at most 2 ** bits + 1 sums
    total = sums.groupBy("label").applyInPandas(table, "label string, docs long, counts binary").toLocalIterator()
    return Model.from_counts({r.label: (r.docs, np.frombuffer(r.counts, np.int64)) for r in total}, bits)


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """row (the columns ``keep``, all if None), lang_pred, score and fit."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    keep = tuple(df.columns) if keep is None else keep
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *([] if text in keep else [F.col(f"`{text}`").alias("text")]))
    at = keep.index(text) if text in keep else None

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            names, share, fit = sent.value.predict(batch.column(1) if at is None else row.field(at))
            yield pa.RecordBatch.from_arrays([row, pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(fit, pa.float64(), mask=np.isnan(fit))], ["row", "lang_pred", "score", "fit"])

    return base.mapInArrow(run, StructType([base.schema["row"], *(StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("fit", DoubleType())))]))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def predict_documents(docs: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and fit, learned from the rows that are not held out."""
    model = train(docs.where(~held_out()), max_rows=max_rows)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model, keep=("doc_id", "held_out")).select("row.*", "lang_pred", "score", "fit")


def in_a_language(docs: DataFrame, model: Model, label: str = "lang", least_fit: float = -1.8, min_chars: int = 100) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and fits a learned language.

    A row with a letter stays, too, where nothing can be told: its text has under ``min_chars`` characters, its label
    names a language that the model did not learn, or the model has none.
    """
    fits = F.col("lang_pred") != "und"
    if not model.names:
        letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return docs.where(letter)
    good = F.coalesce(F.col("fit") >= least_fit, F.lit(False)) | (F.length("row.text") < min_chars)
    if label in docs.columns:
        good = good | F.coalesce(~F.col(f"row.`{label}`").isin(model.names), F.lit(False))
    return identify(docs, model).where(fits & good).select("row.*")
