"""Small inputs: database statistics, exclusion and taxon lists, accession maps, rank names, report re-reads."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Major ranks from the top and their abbreviations. Fixed values.
MAJOR_RANKS = {"superkingdom": "sk", "phylum": "p", "class": "c", "order": "o", "family": "f", "genus": "g", "species": "s", "strain": "n"}


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """db_level, taxid, total_length, genome_size (0 when missing), note ('' when missing); 9 columns have no note and no size.

    A header row (taxid 'Taxid') is dropped; a total length that is no number raises when it is read.
    """
    f = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(F.trim("value") != "").select(f.alias("f"))
    g = lambda k: F.get("f", F.lit(k))
    wide = F.size("f") >= 10
    rows = rows.where(g(2) != "Taxid")
    return rows.select(
        g(0).alias("db_level"), g(2).alias("taxid"), g(7).cast("double").cast("long").alias("total_length"),
        F.when(wide, F.coalesce(g(8).try_cast("double").cast("long"), F.lit(0))).otherwise(0).cast("long").alias("genome_size"),
        F.when(wide, F.coalesce(g(9), F.lit(""))).otherwise(F.lit("")).alias("note"),
    )


def read_list(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """One id per line, trimmed; blank lines and, if ``comments``, lines that start with '#' are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("acc")).where("acc <> ''")
    return (rows.where(~F.col("acc").startswith("#")) if comments else rows).distinct()


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """read_list(); warns where the list is empty."""
    out = read_list(spark, path, comments=False)
    if out.isEmpty():
        warnings.warn(f"no accession in {path}: nothing is excluded", stacklevel=2)
    return out


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_acc2taxid(spark: SparkSession, paths: list[str]) -> DataFrame:
    """accession (without version), taxid, priority; the first file has priority 0, and files that are missing are skipped."""
    out = spark.createDataFrame([], "accession string, taxid string, priority int")
    for k, path in enumerate(paths):
        if _there(spark, path):
            out = out.unionByName(spark.read.option("header", True).option("sep", "\t").csv(path).select(F.split("accession", r"\.")[0].alias("accession"), F.col("taxid").cast("string").alias("taxid"), F.lit(k).alias("priority")))
    return out


def read_full_report(spark: SparkSession, path: str) -> DataFrame:
    """A full report; all columns are strings, so taxids keep their form. Rows that do not fit are dropped."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").option("mode", "DROPMALFORMED").csv(path)


def rank_abbreviations(path: str | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    """Major ranks and their abbreviations: those of a JSON file, read by Spark where a session is given, or the usual ones."""
    if path is None:
        return dict(MAJOR_RANKS)
    if spark is not None:
        return json.loads(spark.read.option("wholetext", True).text(path).first().value)
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of largest ``order`` for each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_", order)
