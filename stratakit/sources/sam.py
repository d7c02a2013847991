"""SAM text as a DataFrame. Line order is (file, block, row), so 'first in the file' has a meaning on a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.functions import exprs as X


def file_order() -> Column:
    """A key that sorts the rows of a text scan in file order.

    Row numbers grow within a split, whatever the order of splits, so no rank of splits and no join is needed.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """value and line_no (a key that sorts in file order) of every line that is no header."""
    return spark.read.text(path).select("value", file_order().alias("line_no")).where(~F.col("value").startswith("@"))


def parse_sam(lines: DataFrame, match_factor: float = 0.0, excluded: DataFrame | None = None) -> DataFrame:
    """Alignment columns of (value, line_no). Lines with fewer than 11 fields or a name without 4 parts get ``malformed``.

    ``excluded``: one column ``acc``; it joins as a flag, so counts see excluded lines.
    """
    f = F.split("value", "\t")
    df = lines.where(~F.col("value").startswith("@")).select(
        "line_no", F.col("value"), F.size(f).alias("n_fields"), F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).try_cast("int").alias("flag"), X.normalize_rname(F.get(f, F.lit(2))).alias("rname"),
        F.get(f, F.lit(3)).try_cast("long").alias("pos"), F.get(f, F.lit(5)).alias("cigar"), F.get(f, F.lit(6)).alias("rnext"), F.get(f, F.lit(9)).alias("seq"), F.get(f, F.lit(10)).alias("qual"),
        X.tag_int(F.col("value"), "AS").alias("as_score"), F.coalesce(X.tag_int(F.col("value"), "NM"), F.lit(0)).alias("nm"),
    )
    parts = F.split("rname", r"\|")
    df = df.withColumns({
        "mapped_len": X.cigar_sum(F.col("cigar"), "M"), "ins_len": X.cigar_sum(F.col("cigar"), "I"), "del_len": X.cigar_sum(F.col("cigar"), "D"), "read_len": F.length("seq"), "n_parts": F.size(parts),
        "acc": F.get(parts, F.lit(0)), "rstart": F.get(parts, F.lit(1)).try_cast("long"), "rend": F.get(parts, F.lit(2)).try_cast("long"), "taxid": F.get(parts, F.lit(3)),
    })
    df = df.withColumns({
        "region_start": F.col("pos"), "region_end": F.col("pos") + F.col("mapped_len") + F.col("del_len") - 1, "is_primary": X.is_primary(F.col("flag")),
        "malformed": F.coalesce((F.col("n_fields") < 11) | (F.col("n_parts") != 4) | F.col("rstart").isNull() | F.col("rend").isNull() | F.col("flag").isNull() | F.col("pos").isNull(), F.lit(True)),
        "valid_match": F.coalesce(X.valid_match(X.match_identity(F.col("mapped_len"), F.col("rend") - F.col("rstart") + 1, F.col("read_len")), match_factor), F.lit(False)),
    })
    if excluded is None:
        df = df.withColumn("valid_acc", F.lit(True))
    else:
        # an exclusion list may be any size: the optimizer broadcasts it if its statistics allow
        marks = excluded.select(F.col("acc").alias("acc_")).distinct().withColumn("hit", F.lit(True))
        df = df.join(marks, df.acc == marks.acc_, "left").withColumn("valid_acc", F.col("hit").isNull()).drop("acc_", "hit")
    return df.drop("n_fields", "n_parts")


def counted(parsed: DataFrame) -> DataFrame:
    """Rows that go into profiles: primary, well matched, not excluded."""
    return parsed.where(~F.col("malformed") & F.col("is_primary") & F.col("valid_match") & F.col("valid_acc"))


def counter_columns() -> list[Column]:
    """All alignments, invalid matches and excluded accessions (each over every line), malformed, mapped reads."""
    ok = F.col("is_primary") & F.col("valid_match") & F.col("valid_acc")
    good = ~F.col("malformed")
    return [F.count(F.lit(1)).alias("alignments"), F.count_if(good & ~F.col("valid_match")).alias("invalid_match"), F.count_if(good & ~F.col("valid_acc")).alias("excluded_acc"), F.count_if(F.col("malformed")).alias("malformed"), F.count_if(good & ok).alias("mapped_reads")]


def counters(parsed: DataFrame) -> DataFrame:
    """One row of ``counter_columns``."""
    return parsed.agg(*counter_columns())
