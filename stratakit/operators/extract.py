"""Reads of qualified taxa as FASTA or FASTQ records, and the stand-alone search by taxon text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions import exprs as X


@dataclass(frozen=True)
class Selector:
    """``ids[:limit[:format]]``: ids are a comma list, ``@file`` or ``all``; limit 0 takes all reads."""

    taxa: tuple[str, ...] | None
    limit: int = 0
    fmt: str = "fasta"
    file: str | None = None

    @classmethod
    def parse(cls, text: str) -> Selector:
        head, *rest = text.split(":")
        limit = rest[0] if rest else "0"
        if limit not in ("all", "") and not limit.isdigit():
            raise ValueError(f"no number of reads: {limit!r}")
        fmt = rest[1] if len(rest) > 1 else "fasta"
        if fmt not in ("fasta", "fastq"):
            raise ValueError(f"no such format: {fmt!r}")
        number = int(limit) if limit.isdigit() else 0
        if head.startswith("@"):
            return cls((), number, fmt, head[1:])
        return cls(None if head == "all" else tuple(x.strip() for x in head.split(",") if x.strip()), number, fmt)


def taxa_of(full: DataFrame, taxa: tuple[str, ...] | DataFrame | None) -> DataFrame:
    """taxid, level, name of the report rows that are not filtered out and are asked for by id or name (None: all)."""
    rows = full.where(F.col("TAXID").isNotNull())
    if "NOTE" in full.columns:
        rows = rows.where(~F.coalesce(F.col("NOTE"), F.lit("")).contains("Filtered out"))
    if isinstance(taxa, DataFrame):
        ids = taxa.select(F.col(taxa.columns[0]).cast("string").alias("ask_")).distinct()
        by_id, by_name = rows.join(ids, rows.TAXID == ids.ask_, "left_semi"), rows.join(ids, rows.NAME == ids.ask_, "left_semi")
        rows = by_id.unionByName(by_name).distinct()
    elif taxa is not None:
        rows = rows.where(F.col("TAXID").isin(*taxa) | F.col("NAME").isin(*taxa))
    clean = lambda c: F.replace(F.coalesce(F.col(c), F.lit("unknown")), F.lit(" "), F.lit("_"))
    return rows.select(F.col("TAXID").cast("string").alias("tax"), clean("LEVEL").alias("level"), clean("NAME").alias("tax_name")).where("tax <> '0'").distinct()


def closure(walked: DataFrame) -> DataFrame:
    """(taxid, ancestor) of a walk, each id its own ancestor."""
    return walked.select(F.col("query").alias("taxid"), F.explode(F.transform("path", lambda x: x["tid"])).alias("ancestor")).distinct()


def reads_by_taxon(alignments: DataFrame, taxa: DataFrame, ancestors: DataFrame, limit: int = 0) -> DataFrame:
    """One row per read and selected taxon above its fragment's taxon; the first ``limit`` in file order for each taxon.

    Reads that cannot be reversed are left out first, so they take no place under the limit. The join is on (fragment taxid) through the closure of the taxids present; ``row_number <= limit`` is pruned per
    task by Spark's window group limit before the shuffle, so a taxon with a third of all reads ships little.
    """
    wanted = ancestors.join(taxa, ancestors.ancestor == taxa.tax).select("taxid", "tax", "level", "tax_name")
    turned = F.col("flag").bitwiseAND(16) > 0
    seq = F.when(turned, X.revcomp(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(turned, F.reverse("qual")).otherwise(F.col("qual"))
    reads = alignments.select("taxid", "line_no", "qname", "flag", "rname", "region_start", "region_end", seq.alias("out_seq"), qual.alias("out_qual")).where("out_seq is not null")
    rows = reads.join(wanted, "taxid").drop("taxid")
    if limit:
        w = Window.partitionBy("tax").orderBy("line_no")
        rows = rows.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= limit).drop("rn_")
    return rows


def record(fmt: str) -> Column:
    head = F.concat(F.col("qname"), X.mate_suffix(F.col("flag")), F.lit("|"), F.col("rname"), F.lit(":"), F.col("region_start").cast("string"), F.lit(".."), F.col("region_end").cast("string"), F.lit(" LEVEL="), F.col("level"), F.lit(" NAME="), F.col("tax_name"), F.lit(" TAXID="), F.col("tax"))
    if fmt == "fastq":
        return F.concat(F.lit("@"), head, F.lit("\n"), F.col("out_seq"), F.lit("\n+\n"), F.col("out_qual"))
    return F.concat(F.lit(">"), head, F.lit("\n"), F.col("out_seq"))


def in_file_order(reads: DataFrame, fmt: str = "fasta") -> DataFrame:
    """Records, taxa in order of their first read, reads in file order."""
    firsts = reads.groupBy("tax").agg(F.min("line_no").alias("first_"))
    return reads.join(firsts, "tax").orderBy("first_", "tax", "line_no").select(record(fmt).alias("value"))


def text_search(lines: DataFrame, taxa: list[str]) -> DataFrame:
    """Lines of 11 fields or more that hold one of the patterns anywhere, with their read as columns."""
    f = F.split("value", "\t")
    hit = F.col("value").rlike("(" + "|".join(taxa) + ")")
    return lines.where(hit & ~F.col("value").startswith("@") & (F.size(f) >= 11)).select("line_no", f[0].alias("qname"), f[1].alias("flag"), f[2].alias("rname"), f[5].alias("cigar"), f[9].alias("seq"), f[10].alias("qual"))


def search_records(found: DataFrame, table: bool = False) -> DataFrame:
    """Found reads as two-line records, or as rows of a table, in line order."""
    head = F.concat(F.lit("@"), "qname", F.lit(" "), "rname", F.lit(" "), "cigar")
    return found.orderBy("line_no").select(F.concat(head, F.lit("\t" if table else "\n"), "seq").alias("value"))


def literal(taxon: str) -> str:
    """A taxon id as a pattern that matches itself."""
    return re.escape(taxon)
