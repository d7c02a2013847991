"""Packing token ids into windows of at most 4096: bounded-space online best fit, one pass and a merge of leftovers.

Each partition keeps a fixed number of open windows. A document's ids first fill whole windows of their own; the rest
goes to the open window it fills best. When it fits none, the fullest window is emitted: if its gap is at least
``cut`` ids the rest's head fills it exactly, else it is emitted as it is; the remaining ids try again. Open windows
left at a partition's end are merged in groups of partitions by best fit over whole windows, largest first, again
cutting to fill; each group of ``merge_parts`` partitions has one partly filled window at the end. Memory is the open
windows; the state of a merge is ``merge_parts`` x ``open_windows`` windows, whatever the corpus size.

Which pieces share a window depends on how the rows are partitioned and ordered (the pieces themselves always cover each
document once); the same partitions give the same windows, so a task that runs again repeats its part.

Defined cases: null text counts as empty and has its end id alone; a very long text fills windows of its own; repeated
rows are packed each by itself; of windows of equal fill the one opened last is filled first; rows without doc_id give
pieces without it; an empty table gives no pieces. Only doc_id and text are read, so other columns do no harm.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm.common import staged
from stratakit.llm.tokens import default_path, encoder

WINDOW = 4096
#: A piece is (doc_id, start, length, crc32, doc_tokens); a window is its length and pieces. Pieces in open windows keep their ids, as they may be cut.
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, slot int, ids binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


class Packer:
    """Open windows by fill. ``pieces`` gives closed windows as lists of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, open_windows: int = 64, cut: int = 32):
        self.window, self.most, self.cut = window, open_windows, cut
        self.fills: list[tuple[int, int]] = []  # (length, key) in order
        self.open: dict[int, list] = {}
        self.count = 0

    def _take(self, k: int) -> list:
        return self.open.pop(self.fills.pop(k)[1])

    def _put(self, length: int, pieces: list) -> None:
        self.count += 1
        self.open[self.count] = pieces
        bisect.insort(self.fills, (length, self.count))

    def add(self, doc, start: int, ids: bytes, doc_tokens: int) -> Iterator[list]:
        """Place a document's ids; yields the windows that this closes."""
        n, at, full = len(ids) // 4, 0, self.window
        while n - at >= full:
            yield [(doc, start + at, ids[4 * at : 4 * (at + full)], doc_tokens)]
            at += full
        while at < n:
            rest = n - at
            # the fullest window that still has room
            k = bisect.bisect_right(self.fills, (full - rest, self.count + 1)) - 1
            if k >= 0:
                length = self.fills[k][0]
                pieces = self._take(k)
                pieces.append((doc, start + at, ids[4 * at :], doc_tokens))
                if length + rest == full:
                    yield pieces
                else:
                    self._put(length + rest, pieces)
                return
            if len(self.fills) < self.most:
                self._put(rest, [(doc, start + at, ids[4 * at :], doc_tokens)])
                return
            length = self.fills[-1][0]
            pieces = self._take(len(self.fills) - 1)
            gap = full - length
            if gap >= self.cut:
                pieces.append((doc, start + at, ids[4 * at : 4 * (at + gap)], doc_tokens))
                at += gap
            yield pieces

    def rest(self) -> list[list]:
        """The open windows, fullest first; none stays."""
        out = [self.open[k] for _, k in reversed(self.fills)]
        self.fills, self.open = [], {}
        return out


def merge(windows: list[list], window: int = WINDOW, cut: int = 32) -> list[list]:
    """Windows of at most ``window`` ids from partly filled ones: best fit, largest first; the last ones fill gaps by cutting."""
    length = lambda w: sum(len(p[2]) // 4 for p in w)
    todo = sorted(windows, key=lambda w: (-length(w), [(p[0] is not None, p[0] or 0, p[1]) for p in w]))
    bins: list[tuple[int, int]] = []
    held: list[list] = []
    for w in todo:
        n = length(w)
        k = bisect.bisect_right(bins, (window - n, len(held))) - 1
        if k >= 0:
            fill, at = bins.pop(k)
            held[at].extend(w)
            bisect.insort(bins, (fill + n, at))
        else:
            held.append(list(w))
            bisect.insort(bins, (n, len(held) - 1))
    # empty the emptiest windows into the gaps of the fullest
    order = [at for _, at in bins]
    lo, hi = 0, len(order) - 1
    while lo < hi:
        source, target = held[order[lo]], held[order[hi]]
        gap = window - length(target)
        if gap < cut:
            hi -= 1
            continue
        doc, start, ids, total = source.pop()
        n = len(ids) // 4
        keep = max(0, n - gap)
        target.append((doc, start + keep, ids[4 * keep :], total))
        if keep:
            source.append((doc, start, ids[: 4 * keep], total))
        if not source:
            lo += 1
    return [w for w in held if w]


def _rows(pieces: list, sequence: int, part: int, slot: int, keep_ids: bool) -> list[tuple]:
    out, at = [], 0
    for doc, start, ids, total in pieces:
        n = len(ids) // 4
        out.append((doc, start, n, zlib.crc32(ids), total, sequence, at, part, slot, ids if keep_ids else None))
        at += n
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW, open_windows: int = 64, cut: int = 32, merge_parts: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    file, tail = tokenizer or default_path(), struct.pack("<I", end_id)
    types = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)

    def run(batches):
        part, packer, closed, out = TaskContext.get().partitionId(), Packer(window, open_windows, cut), 0, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                for doc, ids in zip(some.column(0).to_pylist(), encoder(file).encode(some.column(1).to_pylist()), strict=True):
                    ids += tail
                    for pieces in packer.add(doc, 0, ids, len(ids) // 4):
                        out += _rows(pieces, part << 32 | closed, part, -1, False)
                        closed += 1
                if len(out) > 5000:
                    yield table(out)
                    out = []
        for slot, pieces in enumerate(packer.rest()):
            out += _rows(pieces, -1, part, slot, True)
        if out:
            yield table(out)

    first, _ = staged(docs.select("doc_id", "text").mapInArrow(run, _SCHEMA), "packed")

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "slot", "offset"])
        windows: dict[tuple[int, int], list] = {}
        for doc, start, ids, total, part, slot in zip(pdf.doc_id, pdf.start, pdf.ids, pdf.doc_tokens, pdf.part, pdf.slot, strict=True):
            windows.setdefault((part, slot), []).append((None if pd.isna(doc) else int(doc), int(start), bytes(ids), int(total)))
        group = int(pdf.group.iloc[0])
        rows = [r for k, w in enumerate(merge(list(windows.values()), window, cut)) for r in _rows(w, 1 << 62 | group << 32 | k, 0, 0, False)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
        return pd.DataFrame({n: pd.array(list(c), "Int64") for n, c in zip(_NAMES[:7], cols, strict=False)})

    # doc_id travels as text: a long column with nulls would lose digits in pandas
    left = first.where("slot >= 0").withColumns({"group": F.floor(F.col("part") / merge_parts).cast("int"), "doc_id": F.col("doc_id").cast("string")})
    merged = left.groupBy("group").applyInPandas(join_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return first.where("slot < 0").select(*_NAMES[:7]).unionByName(merged)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows, ids and padding ids: each sequence is padded to the window, except at a power of two."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return sizes.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(power, 0).otherwise(window - F.col("n"))).alias("padding"))
