"""Roll strains up through the major ranks: one explode and one aggregate for all ranks, then shares and notes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions import exprs as X
from stratakit.operators.taxonomy import RANKS

NUMBER = {r: k + 1 for k, r in enumerate(RANKS)}
_SUMS = ("total_bp_mapped", "read_count", "total_bp_mismatch", "total_bp_indel", "total_read_len", "covered_sig_len", "mapped_sig_len", "total_sig_len", "depth", "genomic_content_est", "genome_size", "genome_count")
#: Columns of the full report, in order; the first ten are the summary. Fixed values.
REPORT = (
    "LEVEL", "NAME", "TAXID", "READ_COUNT", "TOTAL_BP_MAPPED", "ANI_CI95", "COVERED_SIG_LEN", "BEST_SIG_COV", "DEPTH", "REL_ABUNDANCE",
    "PARENT_NAME", "PARENT_TAXID", "TOTAL_READ_LEN", "READ_IDT", "TOTAL_BP_MISMATCH", "TOTAL_BP_INDEL", "ANI_NAIVE", "ANI_CI95_LH", "SIG_COV", "MAPPED_SIG_LEN",
    "TOTAL_SIG_LEN", "COVERED_SIG_DEPTH", "COVERED_MAPPED_SIG_COV", "ZSCORE", "GENOMIC_CONTENT_EST", "ABUNDANCE", "REL_ABUNDANCE_DEPTH", "REL_ABUNDANCE_GC", "SIG_LEVEL", "GENOME_COUNT", "GENOME_SIZE", "NOTE",
)
SUMMARY = REPORT[:10]


@dataclass(frozen=True)
class Cutoffs:
    min_cov: float = 0.0
    min_reads: int = 0
    min_len: int = 0
    max_zscore: float = 0.0
    ani_species: float = 0.95
    ani_strain: float = 0.99


def by_rank(strains: DataFrame, group_by: str = "name") -> DataFrame:
    """strains with ``lineage`` (eight structs). One row per rank and name (or taxid), merged over all strains."""
    at = F.transform("lineage", lambda x, i: F.struct((i + 1).alias("level_no"), x["rank"].alias("level"), x["name"].alias("name"), x["taxid"].alias("lvl_taxid"), F.when(i == 0, F.lit("root")).otherwise(F.get("lineage", i - 1)["name"]).alias("parent_name"), F.when(i == 0, F.lit("1")).otherwise(F.get("lineage", i - 1)["taxid"]).alias("parent_taxid")))
    rows = strains.withColumn("x", F.explode(at)).select("*", "x.*").drop("x", "lineage").withColumn("sig_no", F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("db_level")).cast("int"))
    key = "name" if group_by == "name" else "lvl_taxid"
    # strains are rows of their own, as are groups of any other rank
    rows = rows.withColumn("own_", F.when(F.col("level") == "strain", F.col("taxid")))
    keys = ["level_no", "level", key, "own_"]
    names = [c for c in ("name", "lvl_taxid", "parent_name", "parent_taxid") if c != key]
    # one row per group and distinct note first, so that no group gathers the notes of all its strains
    first = F.struct(-F.col("ani_ci95"), F.col("taxid"))
    parts = rows.groupBy(*keys, "note").agg(
        F.min("taxid").alias("t_"), *[F.min_by(c, "taxid").alias(c) for c in names], *[F.sum(c).alias(c) for c in _SUMS], F.max("best_sig_cov").alias("best_sig_cov"), F.max("sig_no").alias("sig_no"),
        F.max("ani_ci95").alias("ani_ci95"), F.min("zscore").alias("zscore"), F.min_by(F.struct("ani_naive", "ani_low", "ani_high"), first).alias("ani"), F.min(first).alias("first_"),
    )
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_", "note"))), lambda x: x["note"]), "; ")
    out = parts.groupBy(*keys).agg(
        *[F.min_by(c, "t_").alias(c) for c in names], *[F.sum(c).alias(c) for c in _SUMS], F.max("best_sig_cov").alias("best_sig_cov"), F.max("sig_no").alias("sig_no"),
        F.max("ani_ci95").alias("ani_ci95"), F.min("zscore").alias("zscore"), F.min_by("ani", "first_").alias("ani"), notes.alias("note"),
    )
    return out.withColumns({"ani_naive": F.col("ani.ani_naive"), "ani_low": F.col("ani.ani_low"), "ani_high": F.col("ani.ani_high")}).drop("ani", "own_")


def note(cut: Cutoffs) -> Column:
    """Database note, then the reasons that keep a row off the summary."""
    said = lambda c, text: F.when(c, text).otherwise(F.lit(""))
    col = F.col
    parts = [F.when(col("note") != "", F.concat(col("note"), F.lit("; "))).otherwise(F.lit("")), said(col("sig_no") < col("level_no"), F.concat(F.lit("Not shown ("), col("level"), F.lit("-result could be biased); ")))]
    for level, limit in (("strain", cut.ani_strain), ("species", cut.ani_species)):
        parts.append(said((col("level") == level) & (col("ani_ci95") < limit), F.concat(F.lit(f"Filtered out ({level} ANI > "), X.py_float(col("ani_ci95")), F.lit("); "))))
    parts.append(said(col("best_sig_cov") < cut.min_cov, F.concat(F.lit("Filtered out (minCov > "), X.py_float(X.round6(col("best_sig_cov"))), F.lit("); "))))
    parts.append(said(col("read_count") < cut.min_reads, F.concat(F.lit("Filtered out (minReads > "), col("read_count").cast("string"), F.lit("); "))))
    parts.append(said(col("covered_sig_len") < cut.min_len, F.concat(F.lit("Filtered out (minLen > "), col("covered_sig_len").cast("string"), F.lit("); "))))
    if cut.max_zscore > 0:
        parts.append(said(col("zscore") > cut.max_zscore, F.concat(F.lit("Filtered out (maxZscore < "), X.py_float(X.round6(col("zscore"))), F.lit("); "))))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def report(strains: DataFrame, cut: Cutoffs = Cutoffs(), abundance: str = "depth", group_by: str = "name") -> DataFrame:
    """The full report; ``abundance`` is depth, read_count or genomic_content_est."""
    df = by_rank(strains, group_by)
    level = Window.partitionBy("level")
    # every strain is one row of the strain level, so that level's sum is the total: one number, read by a scalar subquery
    total = strains.agg(F.sum(abundance).alias("total_abundance"))
    df = df.withColumn("total_abundance", total.scalar())
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b) if isinstance(b, str) else b)
    depth_sum = F.sum("depth").over(level)
    df = df.withColumns({
        "abundance": F.col(abundance).cast("double"), "rel_abundance": d(abundance, "total_abundance"), "rel_abundance_depth": F.when(depth_sum > 0, F.try_divide(F.col("depth"), depth_sum)).otherwise(0.0),
        "rel_abundance_gc": d("genomic_content_est", F.sum("genomic_content_est").over(level)), "sig_cov": d("covered_sig_len", "total_sig_len"),
        "read_idt": F.try_divide((F.col("total_bp_mapped") - F.col("total_bp_mismatch")).cast("double"), F.col("total_read_len")), "covered_mapped_sig_cov": d("covered_sig_len", "mapped_sig_len"),
        "covered_sig_depth": d("total_bp_mapped", "covered_sig_len"), "ani_ci95_lh": F.concat(F.lit("["), X.py_float(F.col("ani_low")), F.lit("-"), X.py_float(F.col("ani_high")), F.lit("]")),
        "note_": note(cut), "sig_level": F.get(F.array(*[F.lit(r) for r in RANKS]), F.col("sig_no") - 1),
    })
    named = {c: c.lower() for c in REPORT} | {"TAXID": "lvl_taxid", "NOTE": "note_"}
    return df.select("level_no", *[F.col(named[c]).alias(c) for c in REPORT])


def qualified(full: DataFrame) -> DataFrame:
    return full.where(~F.col("NOTE").contains("Filtered out") & ~F.col("NOTE").contains("Not shown"))


def ordered(full: DataFrame) -> DataFrame:
    """Ranks from the top, the most abundant first, names in order among equals."""
    return full.orderBy("level_no", F.col("ABUNDANCE").desc(), "NAME", "TAXID").drop("level_no")
