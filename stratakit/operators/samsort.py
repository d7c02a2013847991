"""Headers and coordinate order of SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def references(lines: DataFrame) -> DataFrame:
    """rname, length: distinct names of columns 3 and 7 (not ``*`` or ``=``), length from the name's start and end."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@"))
    names = rows.select(F.get(f, F.lit(2)).alias("rname")).unionByName(rows.select(F.get(f, F.lit(6)).alias("rname"))).where("rname is not null and rname not in ('*', '=')").distinct()
    p = F.split("rname", r"\|")
    return names.select("rname", (F.get(p, F.lit(2)).try_cast("long") - F.get(p, F.lit(1)).try_cast("long") + 1).alias("length"))


def header(refs: DataFrame) -> DataFrame:
    """Header lines with their order."""
    hd = refs.sparkSession.createDataFrame([("@HD\tVN:1.6\tSO:coordinate", "")], "value string, rname string")
    return hd.unionByName(refs.select(F.concat(F.lit("@SQ\tSN:"), "rname", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"), "rname"))


def coordinate_sorted(lines: DataFrame) -> DataFrame:
    """Lines by reference name, position and line number."""
    return _keyed(lines).orderBy("rname", "pos", "line_no")


def _keyed(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.where(~F.col("value").startswith("@")).withColumns({"rname": F.get(f, F.lit(2)), "pos": F.get(f, F.lit(3)).try_cast("long")})


def sorted_file(lines: DataFrame) -> DataFrame:
    """``value``: header lines, then the lines in coordinate order, by one range sort."""
    top = header(references(lines).where("length is not null")).select("value", F.lit(0).alias("part_"), "rname", F.lit(None).cast("long").alias("pos"), F.lit(None).cast(lines.schema["line_no"].dataType).alias("line_no"))
    rows = _keyed(lines).select("value", F.lit(1).alias("part_"), "rname", "pos", "line_no")
    return top.unionByName(rows).orderBy("part_", "rname", "pos", "line_no").select("value")
