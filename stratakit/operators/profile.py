"""From alignments to strains: best hits, fragments, covered lengths, strain statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions import exprs as X


def best_hits(parsed: DataFrame) -> DataFrame:
    """The primary line of best score for each read (mates apart), the earliest among equals."""
    df = parsed.where("is_primary").withColumn("qkey", X.mate_key(F.col("qname"), F.col("flag")))
    w = Window.partitionBy("qkey").orderBy(F.col("as_score").desc_nulls_last(), "line_no")
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def intervals(alignments: DataFrame) -> DataFrame:
    """Distinct intervals with their sums: the window below then sorts distinct intervals alone, however deep a fragment is."""
    return alignments.groupBy("rname", "region_start", "region_end").agg(
        F.sum(F.col("region_end") - F.col("region_start") + 1).alias("mb"), F.count("*").alias("mr"), F.sum("nm").alias("nm"), F.sum(F.col("ins_len") + F.col("del_len")).alias("id"), F.sum("read_len").alias("rl")
    )


def _reach(rows: DataFrame) -> DataFrame:
    """Adds ``before``: the furthest end of earlier intervals of the fragment."""
    w = Window.partitionBy("rname").orderBy("region_start", "region_end").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.max("region_end").over(w))


def merged_regions(alignments: DataFrame) -> DataFrame:
    """rname, start, end of the merged regions; regions that touch are one."""
    rows = _reach(alignments.select("rname", "region_start", "region_end").distinct())
    opens = F.when(F.col("before").isNull() | (F.col("region_start") > F.col("before") + 1), 1).otherwise(0)
    w = Window.partitionBy("rname").orderBy("region_start", "region_end").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("opens", opens).withColumn("island", F.sum("opens").over(w))
    return rows.groupBy("rname", "island").agg(F.min("region_start").alias("start"), F.max("region_end").alias("end")).drop("island")


def fragments(alignments: DataFrame) -> DataFrame:
    """rname, mb, mr, nm, id, rl and sc (length covered without gaps)."""
    fresh = F.greatest(F.lit(0).cast("long"), F.col("region_end") - F.greatest(F.col("region_start") - 1, F.coalesce("before", F.col("region_start") - 1)))
    return _reach(intervals(alignments)).groupBy("rname").agg(*[F.sum(c).alias(c) for c in ("mb", "mr", "nm", "id", "rl")], F.sum(fresh).alias("sc"))


def strains(frags: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per taxid of the fragments, with database statistics and derived values.

    A total length of zero raises; a taxid without statistics keeps nulls.
    """
    p = F.split("rname", r"\|")
    keyed = frags.select(F.get(p, F.lit(3)).alias("taxid"), (F.get(p, F.lit(2)).cast("long") - F.get(p, F.lit(1)).cast("long") + 1).alias("slen"), "mb", "mr", "nm", "id", "rl", "sc")
    sums = keyed.groupBy("taxid").agg(
        F.sum("mb").alias("total_bp_mapped"), F.sum("mr").alias("read_count"), F.sum("nm").alias("total_bp_mismatch"), F.sum("id").alias("total_bp_indel"),
        F.sum("rl").alias("total_read_len"), F.sum("sc").alias("covered_sig_len"), F.sum("slen").alias("mapped_sig_len"),
    )
    df = sums.join(stats.select("taxid", "db_level", "total_length", "genome_size", "note"), "taxid", "left")
    total = F.when(F.col("total_length") == 0, F.raise_error(F.lit("a total signature length is zero")).cast("long")).otherwise(F.col("total_length"))
    df = df.withColumn("total_sig_len", total)
    df = df.withColumns({
        "best_sig_cov": F.try_divide(F.col("covered_sig_len").cast("double"), "total_sig_len"), "depth": F.try_divide(F.col("total_bp_mapped").cast("double"), "total_sig_len"),
        "zscore": X.zscore(F.col("total_bp_mapped"), F.col("total_sig_len"), F.col("covered_sig_len")), "note": F.coalesce("note", F.lit("")), "genome_count": F.lit(1),
    })
    df = df.withColumns({"genomic_content_est": F.col("depth") * F.col("genome_size"), "sig_cov": F.col("best_sig_cov")})
    return df.withColumns(X.ani_columns(F.col("total_bp_mapped"), F.col("total_bp_mismatch"), F.col("covered_sig_len"), F.col("sig_cov"))).drop("total_length")
