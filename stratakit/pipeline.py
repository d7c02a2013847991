"""Profile and extraction runs from files to files."""

from __future__ import annotations

import os
import shlex
import shutil
import subprocess
from collections.abc import Callable
from typing import TextIO

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratakit.config import ProfileConfig
from stratakit.operators import extract, profile, rollup, taxonomy
from stratakit.session import staged
from stratakit.sinks import reports
from stratakit.sources import sam, tables


def align(config: ProfileConfig, target: str, threads: int = 1) -> str:
    """Align reads with minimap2, if it is installed, to a SAM file without header."""
    if shutil.which("minimap2") is None:
        raise RuntimeError("reads need minimap2 on the path; give a SAM file instead")
    extra = shlex.split(config.aligner_options) if config.preset == "sr" else []
    command = ["minimap2", "-x", config.preset, *extra, "-a", "-N20", "--secondary=no", "--sam-hit-only", "-t", str(threads), f"{config.database}.mmi", *config.reads]
    with open(target, "wb") as out, subprocess.Popen(command, stdout=subprocess.PIPE) as run:
        for line in run.stdout:
            if not line.startswith(b"@"):
                out.write(line)
    if run.returncode:
        raise RuntimeError(f"minimap2 ended with {run.returncode}")
    return target


def strain_lineages(strains: DataFrame, nodes: DataFrame, merged: DataFrame | None = None, ranks: dict[str, str] | None = None) -> DataFrame:
    """(taxid, lineage) of the strains; raises with the ids that do not resolve to all eight ranks."""
    walked = taxonomy.walk(strains.select(F.col("taxid").alias("query")).distinct(), nodes, merged)
    out = taxonomy.major_lineage(walked, ranks=ranks).select(F.col("query").alias("taxid"), "lineage")
    lost = [r.taxid for r in out.where(F.col("lineage").isNull() | F.exists("lineage", lambda x: x["name"].isNull())).select("taxid").limit(20).collect()]
    if lost:
        raise ValueError(f"no full lineage for taxids {lost}: the taxonomy does not fit the database")
    return out


def run_profile(spark: SparkSession, config: ProfileConfig, nodes: DataFrame, folder: str = ".", merged: DataFrame | None = None, excluded: DataFrame | None = None, log: Callable[[str], None] = lambda text: None, out: TextIO | None = None, ranks: dict[str, str] | None = None) -> dict:
    """Write full and summary reports, lineage file or BIOM under ``folder``, or the summary or BIOM to ``out``; gives counters and the full report."""
    config = config.resolved()
    if out is None or config.reads:
        os.makedirs(folder, exist_ok=True)
    base = os.path.join(folder, config.prefix)
    path = config.sam or align(config, f"{base}.sam", config.threads)
    stats = tables.read_stats(spark, f"{config.database}.stats")
    twice = [r.taxid for r in stats.groupBy("taxid").count().where("count > 1").limit(20).collect()]
    if twice:
        raise ValueError(f"taxids occur twice in the statistics: {twice}")
    parsed = sam.parse_sam(sam.read_sam(spark, path), config.match_factor, excluded)
    if config.remove_multiple == "yes":
        # the best hits are the alignments from here on: their lines are kept as a SAM folder, in file order
        kept = f"{base}.{config.db_level}.sam"
        profile.best_hits(parsed).orderBy("line_no").select("value").write.mode("overwrite").text(kept)
        log(f"best hits saved to {kept}")
        parsed = sam.parse_sam(sam.read_sam(spark, kept), config.match_factor, excluded)
    # one pass over the lines gives the fragments and the counters
    seen = Observation("alignments")
    strains, _ = staged(profile.strains(profile.fragments(sam.counted(parsed.observe(seen, *sam.counter_columns()))), stats), "strains")
    try:
        counts = seen.get
    except Py4JJavaError:  # without any line the optimizer drops the plan, and nothing is observed
        counts = sam.counters(parsed).first().asDict()
    for name, text in (("alignments", "alignments read"), ("invalid_match", "below the match factor"), ("excluded_acc", "on excluded accessions"), ("mapped_reads", "counted")):
        log(f"{counts[name]} {text}")
    if not counts["mapped_reads"]:
        log("no mapped reads: nothing to report")
        return {"counters": counts, "report": None}
    lineages, _ = staged(strain_lineages(strains, nodes, merged, ranks), "lineages")
    full, _ = staged(rollup.report(strains.join(lineages, "taxid"), config.cutoffs, config.abundance), "report")
    names = lineages.select(F.col("taxid").alias("TAXID"), F.transform("lineage", lambda x: x["name"]).alias("names"))
    if config.fmt == "biom":
        text = reports.biom(full, names, config.prefix, config.db_level)
        if out is not None:
            out.write(text + "\n")
        else:
            with open(f"{base}.biom", "w", encoding="utf-8") as f:
                f.write(text)
    elif out is not None:
        reports.print_report(full, out, config.fmt)
    else:
        reports.write_report(full, f"{base}.full.tsv", f"{base}.{config.fmt}", config.fmt)
    if out is None:
        reports.write_lineage(reports.lineage_rows(full, names, config.db_level), f"{base}.lineage.tsv")
    found = rollup.qualified(full).where(F.col("LEVEL") == config.db_level).count()
    log(f"{found} qualified taxa of level {config.db_level}")
    return {"counters": counts, "report": full, "alignments": parsed}


def report_of(sam_path: str) -> str:
    """The full report that belongs to a SAM file: its path less the last two parts of the name."""
    return ".".join(os.path.abspath(sam_path).split(".")[:-2]) + ".full.tsv"


def run_extract_only(spark: SparkSession, config: ProfileConfig, nodes: DataFrame, selector: str, report: str, path: str | None = None, excluded: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Extraction from an existing full report, without a new profile."""
    config = config.resolved()
    parsed = sam.parse_sam(sam.read_sam(spark, config.sam), config.match_factor, excluded)
    return run_extract(spark, parsed, tables.read_full_report(spark, report), nodes, selector, path)


def run_extract(spark: SparkSession, parsed: DataFrame, full: DataFrame, nodes: DataFrame, selector: str, path: str | None = None) -> tuple[DataFrame, int]:
    """Records of the selected taxa (also written to the folder ``path``) and how many."""
    chosen = extract.Selector.parse(selector)
    asked = tables.read_list(spark, chosen.file) if chosen.file else chosen.taxa
    # the lines are parsed once, for the ids and for the reads
    counted, _ = staged(sam.counted(parsed).select("taxid", "line_no", "qname", "flag", "rname", "region_start", "region_end", "seq", "qual"), "alignments")
    ids = counted.select(F.col("taxid").alias("query")).distinct()
    reads, _ = staged(extract.reads_by_taxon(counted, extract.taxa_of(full, asked), extract.closure(taxonomy.walk(ids, nodes)), chosen.limit), "reads")
    records = extract.in_file_order(reads, chosen.fmt)
    if path:
        reports.write_text(records, path)
    return records, reads.count()
