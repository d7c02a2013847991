"""WARC 1.1 archives: one gzip member per record, and a sequential reader that checks framing and digests.

Writing: records of equal payload (at least ``min_bytes`` long) become one ``response``, that with the smallest
page_id, and ``revisit`` records that name it. The smallest id per digest is an aggregate with partial sums; only
digests that occur twice enter the join, and both sides of the join are salted, so one payload that a third of all
pages share is spread over tasks. The files are raw archives: Spark's text writer puts a row's bytes followed by a
separator, and every gzip member ends in a zero byte (the high byte of its length; an empty member is added behind a
member of 16 MB or more), so rows are members without their last byte and the separator is that byte. The files are
thereby written by Spark's commit protocol to any store Spark knows. A task begins a new file (its rows get the next
``roll``, a folder of the path) when the last one holds ``file_bytes`` or ``records_per_file``, so a file exceeds that by
one record at most, however large pages are.

Reading: ``binaryFile`` rows are parsed from the first to the last member with an incremental decompressor; the
content-length frames each block, and block and payload digests are verified; any mismatch raises.

Defined cases: null html is an empty payload; null url is ``about:blank``; null page_id is written as an id without
number and read back as null (it never is a referred page unless all equal payloads have null ids, where all are
responses). Rows that share page_id and payload are all responses if that id is the smallest. Very long payloads are one
record each, unpacked step by step; a file is in memory once, as a row. Only page_id, url and html are read, so other
columns do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm.common import work_path

_HEAD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(raw: bytes, level: int = 4) -> bytes:
    """One gzip member that ends in a zero byte."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(raw) + pack.flush()
    return out if out[-1] == 0 else out + _EMPTY


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record whose block holds the response head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\s]+", "%20", url) if url else "about:blank"),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To", page_urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The decompressed members of an archive, in order; raises on damage or a cut-off member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a gzip member")
            chunk = view[at : at + step]
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower case) and the block of one record; checks version, framing and the block's digest."""
    if not raw.startswith(b"WARC/1."):
        raise ValueError("no WARC version line")
    end = raw.index(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, v in _HEAD.findall(raw, raw.index(b"\r\n") + 2, end + 2)}
    size = int(fields["content-length"])
    block, tail = raw[end + 4 : end + 4 + size], raw[end + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("the block does not fill its content-length")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + digest(block):
        raise ValueError(f"block digest mismatch in {fields.get('warc-record-id')}")
    return fields, block


def read_record(raw: bytes) -> dict:
    """A row of ``read_archives``; a response's payload is checked against its digest."""
    fields, block = parse(raw)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^content-length:\s*(\d+)", head)[1])
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"payload digest mismatch in {fields.get('warc-record-id')}")
    number = lambda urn: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")) else None
    return {"page_id": number(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": named, "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "url": fields["warc-target-uri"], "payload": payload if kind == "response" else None}


def with_first(pages: DataFrame, min_bytes: int = 0, salts: int = 16) -> DataFrame:
    """page_id, url, html and ``refers_to``: the smallest page_id of an equal payload, null for that page itself."""
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1 and first is not null").select(F.col("sha").alias("sha_"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt_"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = rows.join(firsts, (F.col("sha") == F.col("sha_")) & (F.col("salt") == F.col("salt_")), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 50_000, file_bytes: int = 64 << 20) -> None:
    """Archives under ``path`` with one gzip member per page."""

    def pack(frames):
        roll, held, count = 0, 0, 0
        for pdf in frames:
            raw, rolls = [], []
            for p, u, h, r in zip(pdf.page_id, pdf.url, pdf.html, pdf.refers_to, strict=True):
                if held >= file_bytes or count >= records_per_file:
                    roll, held, count = roll + 1, 0, 0
                raw.append(member(record(None if pd.isna(p) else int(p), u, (h or "").encode(), None if pd.isna(r) else int(r)))[:-1])
                rolls.append(roll)
                held, count = held + len(raw[-1]) + 1, count + 1
            yield pd.DataFrame({"raw": raw, "roll": rolls})

    # Int64 columns with nulls would turn to doubles on the way to pandas, so ids travel as text
    rows = with_first(pages, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    packed = rows.mapInPandas(pack, "raw binary, roll int").select(F.col("raw").cast("string").alias("value"), "roll")
    packed.write.partitionBy("roll").option("lineSep", "\x00").option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record. ``payloads`` adds url and payload (null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payloads
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    held = 256 if payloads else 4096

    def unpack(frames):
        for pdf in frames:
            for content in pdf.content:
                batch = []
                for raw in members(content):
                    if raw:
                        batch.append(read_record(raw))
                    if len(batch) == held:
                        yield table(batch)
                        batch = []
                if batch:
                    yield table(batch)

    def table(batch):
        # ids as nullable integers from the start: by way of doubles they would lose digits
        return pd.DataFrame({n: pd.array([r[n] for r in batch], "Int64") if n in ("page_id", "refers_to") else [r[n] for r in batch] for n in names})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInPandas(unpack, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives in the shared folder and read them back."""
    path = work_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)

