"""URL filtering: suffix and path rules, then a Bloom filter cascade for exact list membership without joins.

A list names domains; a URL is listed if its host or a parent domain of it is. A cascade alternates levels: the first
encodes the listed keys, the second the unlisted keys that pass the first by mistake, the third the listed keys that pass
the second by mistake, and so on until a level has no mistakes. Over the universe it was built from (every host of the
table and every parent domain) the answer is exact. The distinct keys are marked by one equi-join with the list and cut
into shards by hash; each shard's cascade is built in one bounded task and staged. Cascades take some 10 bits per listed
key that occurs. They are broadcast in batches of at most ``batch_bytes``; where all together exceed that, the table takes
one staged pass per batch and each broadcast is freed before the next, so none grows with the corpus.

Defined cases: null url, or one without ``://``, has an empty host and path, no rule, and verdict ``allow`` (an empty
host is never listed). Names of over 253 characters or 127 labels are no domains: they are never listed, nor are such
parents, but shorter parents of a long host are. List entries match in lower case; null and repeated ones do nothing.
Repeated rows give repeated results; of rules of equal length the first in order of name wins. Only ``page_id`` and
``url`` are read, so other columns with clashing names do no harm. An empty table gives an empty result, an empty list
lists nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm.common import discard, staged

#: Host suffix, path prefix, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The production list: these names under these domains, and ``GENERATED`` numbered names by rule. Fixed values.
LISTED_NAMES = ("spam-farm", "casino-win", "ads-track", "free-bets", "adult-zone", "malware-drop")
LISTED_UNDER = ("example.com", "example.net", "example.org")
GENERATED = 200_000
MOST_LABELS, MOST_CHARS = 127, 253


def production_list(spark: SparkSession) -> DataFrame:
    """domain: the listed names, and d0.ads.example to d199999.ads.example."""
    names = spark.createDataFrame([(f"{n}.{u}",) for n in LISTED_NAMES for u in LISTED_UNDER], "domain string")
    return names.unionByName(spark.range(GENERATED).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".ads.example")).alias("domain")))


#: A host that the production list covers, as a regular expression.
LISTED_PATTERN = rf"(^|\.)(({'|'.join(LISTED_NAMES)})\.example\.(com|net|org)|d(0|[1-9][0-9]{{0,4}}|1[0-9]{{5}})\.ads\.example)$"


def domains_of(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    tail = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (MOST_LABELS - 1)), MOST_LABELS)
    names = F.transform(F.sequence(F.lit(1), F.size(tail)), lambda i: F.array_join(F.slice(tail, i, F.lit(MOST_LABELS)), "."))
    return F.filter(names, lambda x: (x != "") & (F.length(x) <= MOST_CHARS))


def domain_names(host: str) -> list[str]:
    """domains_of() for one host."""
    labels = host.split(".")[-MOST_LABELS:]
    names = [".".join(labels[i:]) for i in range(len(labels))]
    return [x for x in names if x and len(x) <= MOST_CHARS]


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (``net/`` style) and its verdict, both null where none fits."""
    rule = verdict = None
    for suffix, prefix, decision in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name = suffix + prefix
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return rule, verdict


def _hashes(keys: list[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.array([xxhash.xxh3_64_intdigest(k.encode(), seed=level) for k in keys], dtype=np.uint64)
    return raw & np.uint64(0xFFFFFFFF), (raw >> np.uint64(32)) | np.uint64(1)


def _slots(keys: list[str], level: int, bits: int, probes: int) -> np.ndarray:
    a, b = _hashes(keys, level)
    return (a[:, None] + b[:, None] * np.arange(probes, dtype=np.uint64)[None, :]) % np.uint64(bits)


@dataclass
class Cascade:
    """Levels of (bits, probes, packed bit array); exact over the keys it was built from."""

    levels: list[tuple[int, int, np.ndarray]]

    @classmethod
    def build(cls, listed: list[str], unlisted: list[str], rate: float = 0.1) -> Cascade:
        inside, outside, levels = sorted(set(listed)), sorted(set(unlisted)), []
        while inside:
            bits = max(64, math.ceil(-len(inside) * math.log(rate) / math.log(2) ** 2))
            probes = max(1, round(bits / len(inside) * math.log(2)))
            level = len(levels)
            flags = np.zeros(bits, bool)
            flags[_slots(inside, level, bits, min(probes, 16)).ravel()] = True
            levels.append((bits, min(probes, 16), np.packbits(flags)))
            wrong = [k for k, hit in zip(outside, cls._hit(levels[-1], level, outside)) if hit] if outside else []
            inside, outside = wrong, inside
        return cls(levels)

    @staticmethod
    def _hit(level: tuple[int, int, np.ndarray], number: int, keys: list[str]) -> np.ndarray:
        bits, probes, packed = level
        at = _slots(keys, number, bits, probes)
        return ((packed[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).astype(bool).all(1)

    def contains(self, keys: list[str]) -> np.ndarray:
        """Listed or not: a key that leaves the cascade before an odd level is unlisted, before an even one listed."""
        out = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            if not len(open_):
                break
            hit = self._hit(level, number, [keys[i] for i in open_])
            out[open_[~hit]] = number % 2 == 1
            open_ = open_[hit]
        out[open_] = len(self.levels) % 2 == 1
        return out

    def to_bytes(self) -> bytes:
        head = np.array([x for bits, probes, _ in self.levels for x in (bits, probes)], np.int64)
        return np.int64(len(self.levels)).tobytes() + head.tobytes() + b"".join(p.tobytes() for _, _, p in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Cascade:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head, at, levels = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
        for bits, probes in head.reshape(n, 2).tolist():
            size = (bits + 7) // 8
            levels.append((bits, probes, np.frombuffer(raw, np.uint8, size, at)))
            at += size
        return cls(levels)


def build_cascades(keys: DataFrame, shards: int, rate: float = 0.1) -> DataFrame:
    """keys: distinct (key string, listed boolean). One row per shard: shard int, cascade binary."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        built = Cascade.build(pdf.key[pdf.listed].tolist(), pdf.key[~pdf.listed].tolist(), rate)
        return pd.DataFrame({"shard": pdf.shard[:1], "cascade": [built.to_bytes()]})

    return keys.withColumn("shard", (F.crc32("key") % shards).cast("int")).groupBy("shard").applyInPandas(make, "shard int, cascade binary")


def batches(cascades: DataFrame, batch_bytes: int) -> Iterator[dict[int, bytes]]:
    """Shards' cascades, as many at a time as ``batch_bytes`` hold; cascades that list nothing are left out."""
    batch, size = {}, 0
    for row in cascades.where(F.octet_length("cascade") > 8).toLocalIterator():
        if batch and size + len(row.cascade) > batch_bytes:
            yield batch
            batch, size = {}, 0
        batch[row.shard] = bytes(row.cascade)
        size += len(row.cascade)
    if batch:
        yield batch


def listed_hosts(hosts: list[str], cascades: dict[int, Cascade], shards: int) -> np.ndarray:
    """Whether one of the cascades lists the host or a parent domain."""
    names = [domain_names(h) for h in hosts]
    of = np.repeat(np.arange(len(hosts)), [len(x) for x in names])
    flat = [x for y in names for x in y]
    shard = np.array([zlib.crc32(x.encode()) % shards for x in flat], np.int64)
    out = np.zeros(len(hosts), bool)
    for k in np.unique(shard).tolist():
        if k in cascades:
            at = np.flatnonzero(shard == k)
            out[of[at[cascades[k].contains([flat[i] for i in at])]]] = True
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, shard_keys: int = 200_000, batch_bytes: int = 32 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, in_list; ``listed`` has a column ``domain``."""
    spark = pages.sparkSession
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    universe = parts.where("host <> ''").select("host").distinct().select(F.explode(domains_of(F.col("host"))).alias("key")).distinct()
    marks = listed.select(F.lower("domain").alias("key")).where("key is not null").distinct().withColumn("listed", F.lit(True))
    keys, keys_path = staged(universe.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    shards = max(1, math.ceil(keys.count() / shard_keys))
    cascades, cascades_path = staged(build_cascades(keys, shards), "cascades")
    discard(spark, keys_path)
    out = parts.withColumn("in_list", F.lit(False))
    schema, path, sent = out.schema, None, None
    for batch in batches(cascades, batch_bytes):
        if sent is not None:  # another batch follows: finish the one before and free it
            done, (out, path) = path, staged(out, "judged")
            if done:
                discard(spark, done)
            sent.destroy()
        sent = spark.sparkContext.broadcast(batch)

        def probe(frames, sent=sent):
            held = {k: Cascade.from_bytes(v) for k, v in sent.value.items()}
            for pdf in frames:
                codes, hosts = pd.factorize(pdf.host)
                pdf["in_list"] = pdf.in_list.to_numpy(bool) | listed_hosts(list(hosts), held, shards)[codes]
                yield pdf

        out = _mapped(out, probe, schema)
    discard(spark, cascades_path)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("in_list"), "block").otherwise("allow")).alias("verdict"), "in_list")


def _mapped(df: DataFrame, probe, schema) -> DataFrame:
    """``df`` through ``probe``; page_id travels beside it as text, as a long column with nulls would lose digits in pandas."""
    kind = schema["page_id"].dataType
    text = df.withColumn("page_id", F.col("page_id").cast("string"))
    return text.mapInPandas(probe, text.schema).withColumn("page_id", F.col("page_id").cast(kind)).select(*schema.names)
