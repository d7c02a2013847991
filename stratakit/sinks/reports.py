"""Report sinks: full and summary tables, lineage file, BIOM JSON, text files of reads."""

from __future__ import annotations

import csv
import json
import shutil
import subprocess
import sys
import time
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.operators import samsort
from stratakit.operators.rollup import SUMMARY, ordered, qualified
from stratakit.sources.sam import file_order


def _shown(value) -> str:
    return "" if value is None else f"{value:.6f}" if isinstance(value, float) else str(value)


def _rows(rows: Iterable, columns: list[str], f: TextIO, fmt: str) -> None:
    if fmt == "csv":
        out = csv.writer(f, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n")
        out.writerow(columns)
        out.writerows([float(_shown(v)) if isinstance(v, float) else "" if v is None else v for v in row] for row in rows)
    else:
        out = csv.writer(f, delimiter="\t", quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
        out.writerow(columns)
        out.writerows([_shown(v) for v in row] for row in rows)


def _write(rows: Iterable, columns: list[str], path: str, fmt: str) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        _rows(rows, columns, f, fmt)


def write_report(full: DataFrame, full_path: str, summary_path: str, fmt: str = "tsv") -> None:
    """Both tables on the driver's disk, row by row: a report has at most a row per taxon and rank."""
    rows = ordered(full)
    _write(rows.toLocalIterator(), rows.columns, full_path, fmt)
    short = ordered(qualified(full)).select(*SUMMARY)
    _write(short.toLocalIterator(), short.columns, summary_path, fmt)


def lineage_rows(full: DataFrame, lineages: DataFrame, level: str = "strain") -> DataFrame:
    """Abundance (four digits) and the names from superkingdom down, for qualified rows of one level.

    ``lineages``: TAXID, names (array of string).
    """
    rows = qualified(full).where(F.col("LEVEL") == level).join(lineages, "TAXID")
    return rows.select(F.call_function("format_number", F.col("ABUNDANCE"), F.lit("0.0000")).alias("abundance"), "names", "TAXID")


def write_lineage(rows: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        for r in rows.orderBy(F.col("abundance").cast("double").desc(), "TAXID").toLocalIterator():
            f.write("\t".join([r.abundance, *r.names]) + "\n")


def biom(full: DataFrame, lineages: DataFrame, sample: str, level: str = "strain", table_id: str = "profile") -> str:
    """BIOM 1.0 JSON of one level's abundances, filtered rows included."""
    rows = full.where(F.col("LEVEL") == level).join(lineages, "TAXID", "left").orderBy("TAXID").select("TAXID", "ABUNDANCE", "names")
    taxa, data = [], []
    for k, r in enumerate(rows.toLocalIterator()):
        taxa.append({"id": r.TAXID, "metadata": {"taxonomy": r.names or []}})
        data.append([k, 0, r.ABUNDANCE])
    return json.dumps({
        "id": table_id, "format": "Biological Observation Matrix 1.0.0", "format_url": "http://biom-format.org", "type": "Taxon table", "generated_by": "stratakit", "date": "1970-01-01T00:00:00",
        "matrix_type": "sparse", "matrix_element_type": "float", "shape": [len(taxa), 1], "rows": taxa, "columns": [{"id": sample, "metadata": None}], "data": data,
    })


def write_text(records: DataFrame, path: str, compress: bool = False) -> None:
    """A folder of text files in the frame's order."""
    out = records.select("value").write
    (out.option("compression", "gzip") if compress else out).text(path)


def write_sorted_sam(lines: DataFrame, path: str, bam: str | None = None) -> None:
    """A folder of text files that together, by name, are the header and the coordinate-sorted lines; one range a file.

    ``lines``: value, line_no. ``bam``: a BAM file and its index too, piped through samtools if that is installed.
    """
    samsort.sorted_file(lines).write.text(path)
    if bam:
        write_bam(lines.sparkSession, path, bam)


def write_bam(spark, path: str, bam: str) -> None:
    """The sorted text under ``path`` as BAM with an index; lines go through a pipe, one partition at a time."""
    if shutil.which("samtools") is None:
        raise RuntimeError("BAM files need samtools on the path")
    rows = spark.read.text(path).select("value", file_order().alias("at")).orderBy("at").select("value")
    with subprocess.Popen(["samtools", "view", "-b", "-o", bam, "-"], stdin=subprocess.PIPE) as run:
        for r in rows.toLocalIterator():
            run.stdin.write(f"{r.value}\n".encode())
    if run.returncode:
        raise RuntimeError(f"samtools ended with {run.returncode}")
    subprocess.run(["samtools", "index", bam], check=True)


def print_report(full: DataFrame, out: TextIO, fmt: str = "tsv") -> None:
    """The summary on a stream."""
    short = ordered(qualified(full)).select(*SUMMARY)
    _rows(short.toLocalIterator(), short.columns, out, fmt)


def print_text(records: DataFrame, out: TextIO) -> None:
    for r in records.select("value").toLocalIterator():
        out.write(f"{r.value}\n")


class Log:
    """Lines with the time since the start, appended to a file and shown on standard error unless ``silent``."""

    def __init__(self, path: str | None, silent: bool = False):
        self.path, self.silent, self.start = path, silent, time.monotonic()
        if path:
            with open(path, "w", encoding="utf-8"):
                pass

    def __call__(self, text: str) -> None:
        passed = int(time.monotonic() - self.start)
        line = f"[{passed // 3600:02d}:{passed // 60 % 60:02d}:{passed % 60:02d}] {text}\n"
        if self.path:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(line)
        if not self.silent:
            sys.stderr.write(line)
