"""Taxonomy loaders. All give nodes(tid, parent, rank, name) with string ids; dumps also give merged(old, new).

``load`` puts together what a folder and a custom file hold, as ``resolve`` finds them from the command line's words.
Paths may be of any store that Spark reads.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.session import staged
from stratakit.sources.sam import file_order
from stratakit.sources.tables import MAJOR_RANKS, last_wins, rank_abbreviations

NODE_COLUMNS = ["tid", "parent", "rank", "name"]
_RANK_OF = {abbr: rank for rank, abbr in MAJOR_RANKS.items()} | {"d": "superkingdom", "k": "superkingdom", "x": "strain", "t": "strain"}


def _field(k: int) -> Column:
    return F.trim(F.get("f", F.lit(k)), F.lit("\t |"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """tid, depth, parent, rank, name; later rows of the file win."""
    rows = spark.read.text(path).select("value", file_order().alias("seq")).where(F.trim("value") != "").select(F.split("value", "\t").alias("f"), "seq")
    nodes = rows.select(F.get("f", F.lit(0)).alias("tid"), F.get("f", F.lit(2)).alias("parent"), F.get("f", F.lit(3)).alias("rank"), F.get("f", F.lit(4)).alias("name"), "seq")
    return last_wins(nodes, "tid", "seq")


def _dump(files: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """nodes and merged of the dump files' lines (a column ``value``), by file name."""
    cut = lambda name: files[name].select(F.split("value", r"\t\|\t").alias("f"))
    names = cut("names.dmp").where(_field(3).startswith("scientific name")).select(_field(0).alias("tid"), _field(1).alias("name"))
    nodes = cut("nodes.dmp").select(_field(0).alias("tid"), _field(1).alias("parent"), _field(2).alias("rank"))
    merged = cut("merged.dmp").select(_field(0).alias("old"), _field(1).alias("new"))
    joined = nodes.join(names, "tid", "left").select("tid", "parent", F.when(F.col("tid") == "1", "root").otherwise(F.col("rank")).alias("rank"), F.coalesce("name", F.lit("")).alias("name"))
    return joined, merged


def _names(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.split("value", r"\t\|\t").alias("f"))
    return rows.select(_field(0).alias("tid"), _field(1).alias("name"), _field(3).alias("kind"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(target) and files.getFileStatus(target).isDirectory()


def _dump_files(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    empty = spark.createDataFrame([], "value string")
    return {n: spark.read.text(f"{folder}/{n}") if n != "merged.dmp" or _exists(spark, f"{folder}/{n}") else empty for n in ("names.dmp", "nodes.dmp", "merged.dmp")}


def read_dump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """names.dmp (scientific names), nodes.dmp and, if it is there, merged.dmp."""
    return _dump(_dump_files(spark, folder))


def _archive_files(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The dump files' lines from a tar archive: one task unpacks it, and the lines are staged in the shared folder."""
    wanted = ("names.dmp", "nodes.dmp", "merged.dmp")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf.content:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        name = member.name.rsplit("/", 1)[-1]
                        if name not in wanted or not member.isfile():
                            continue
                        with io.TextIOWrapper(tar.extractfile(member), encoding="utf-8", newline="\n") as lines:
                            held = []
                            for line in lines:
                                held.append(line.rstrip("\r\n"))
                                if len(held) == 50_000:
                                    yield pd.DataFrame({"file": name, "value": held})
                                    held = []
                            yield pd.DataFrame({"file": name, "value": held})

    lines, _ = staged(spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "file string, value string"), "taxdump")
    return {n: lines.where(F.col("file") == n).select("value") for n in wanted}


def read_dump_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from a tar archive of any compression."""
    return _dump(_archive_files(spark, path))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, kind: names of every kind, from a folder of dump files or an archive of them."""
    files = _dump_files(spark, path) if _is_folder(spark, path) else _archive_files(spark, path)
    return _names(files["names.dmp"])


def lineage_nodes(lineages: DataFrame) -> DataFrame:
    """Nodes from a column ``lineage`` of ``sk__A;p__B;...``: ids are names, an empty name becomes a placeholder after its parent."""
    parts = F.filter(F.split("lineage", ";"), lambda x: x.rlike("^[a-z]+__"))
    steps = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^([a-z]+)__", 1).alias("abbr"), F.trim(F.regexp_replace(x, "^[a-z]+__", "")).alias("name")))
    filled = F.aggregate(
        steps,
        F.array().cast("array<struct<abbr:string,name:string>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(x["abbr"].alias("abbr"), F.when(x["name"] != "", x["name"]).otherwise(F.concat(F.coalesce(F.element_at(acc, -1)["name"], F.lit("root")), F.lit(" - no_"), x["abbr"], F.lit("_rank"))).alias("name")))),
    )
    rows = lineages.select(F.posexplode(filled).alias("k", "x"), filled.alias("all"))
    parent = F.when(F.col("k") == 0, F.lit("1")).otherwise(F.col("all")[F.col("k") - 1]["name"])
    rank = reduce(lambda w, ar: w.when(F.col("x.abbr") == ar[0], ar[1]), _RANK_OF.items(), F.when(F.lit(False), "")).otherwise(F.col("x.abbr"))
    nodes = rows.select(F.col("x.name").alias("tid"), parent.alias("parent"), rank.alias("rank"), F.col("x.name").alias("name"))
    # one parent a name: the least, so that the choice does not depend on order
    nodes = nodes.where("tid <> parent").groupBy("tid", "rank", "name").agg(F.min("parent").alias("parent"))
    root = nodes.sparkSession.createDataFrame([("1", "1", "root", "root")], "tid string, parent string, rank string, name string")
    return root.unionByName(nodes.select(*NODE_COLUMNS)).dropDuplicates(["tid"])


def read_mgnify(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold an ``sk__`` lineage; comments are skipped."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").contains("sk__"))
    return lineage_nodes(rows.select(F.regexp_extract("value", r"(sk__[^\t]*)", 1).alias("lineage")))


def read_gtdb(spark: SparkSession, path: str, metadata: bool = False) -> DataFrame:
    """Taxonomy files (accession, lineage) or metadata files (lineage in column 17, organism name in column 63); a strain level is added."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f.alias("f"))
    if metadata:
        rows = rows.where(F.get("f", F.lit(0)) != "accession").select(F.get("f", F.lit(16)).alias("l"), F.get("f", F.lit(62)).alias("leaf"))
    else:
        rows = rows.select(F.get("f", F.lit(1)).alias("l"), F.get("f", F.lit(0)).alias("leaf"))
    return lineage_nodes(rows.where(F.col("l").contains("d__")).select(F.concat_ws(";x__", "l", "leaf").alias("lineage")))


def overlay(*layers: DataFrame) -> DataFrame:
    """Later layers replace nodes of earlier ones; at least one layer is needed."""
    if not layers:
        raise ValueError("no taxonomy found")
    rows = reduce(DataFrame.unionByName, [df.select(*NODE_COLUMNS, F.lit(k).alias("layer")) for k, df in enumerate(layers)])
    return last_wins(rows, "tid", "layer")


FORMATS = ("tsv", "lineage", "gtdb", "gtdb-metadata")


def read_custom(spark: SparkSession, path: str, fmt: str = "tsv") -> DataFrame:
    """A custom taxonomy file in one of ``FORMATS``."""
    if fmt not in FORMATS:
        raise ValueError(f"no such taxonomy format: {fmt}")
    if fmt == "tsv":
        return read_tsv(spark, path).select(*NODE_COLUMNS)
    return read_mgnify(spark, path) if fmt == "lineage" else read_gtdb(spark, path, fmt == "gtdb-metadata")


def load(spark: SparkSession, folder: str | None = None, custom: str | None = None, fmt: str = "tsv") -> tuple[DataFrame, DataFrame | None, dict[str, str]]:
    """nodes, merged ids (None without a dump) and rank abbreviations.

    Of ``folder``: dump files, or else ``taxdump.tar.gz``; over them ``taxonomy.tsv``, and over that the custom file
    (``taxonomy.custom.tsv`` of the folder if None). ``major_level_to_abbr.json`` names the ranks. Raises where there is
    nothing to load.
    """
    layers, merged = [], None
    at = lambda name: f"{folder}/{name}" if folder and _exists(spark, f"{folder}/{name}") else None
    if at("nodes.dmp") and at("names.dmp"):
        nodes, merged = read_dump(spark, folder)
        layers.append(nodes)
    elif at("taxdump.tar.gz"):
        nodes, merged = read_dump_archive(spark, at("taxdump.tar.gz"))
        layers.append(nodes)
    if at("taxonomy.tsv"):
        layers.append(read_custom(spark, at("taxonomy.tsv")))
    own = custom or at("taxonomy.custom.tsv")
    if own:
        if not _exists(spark, own):
            raise ValueError(f"no such taxonomy file: {own}")
        layers.append(read_custom(spark, own, fmt))
    abbreviations = rank_abbreviations(at("major_level_to_abbr.json"), spark)
    return overlay(*layers), merged, abbreviations


def resolve(spark: SparkSession, given: str | None, database: str, default: str | None = None) -> tuple[str | None, str | None]:
    """(folder, custom file): what the command line gives, else the database's own file, else the default folder."""
    if given and _is_folder(spark, given):
        return given, None
    if given and _exists(spark, given):
        return None, given
    if given:
        raise ValueError(f"no such taxonomy: {given}")
    if _exists(spark, f"{database}.tax.tsv"):
        return None, f"{database}.tax.tsv"
    return default, None
