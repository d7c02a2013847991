"""Command line: ``python -m stratakit.cli profile|extract|names|search|sort|pull|version``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace

from stratakit.config import ProfileConfig, ani_limits
from stratakit.operators.rollup import Cutoffs
from stratakit.sources import external, taxonomy

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratakit")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    fetch = sub.add_parser("pull", help="fetch and unpack a database or taxonomy archive")
    fetch.add_argument("url")
    fetch.add_argument("-o", "--outdir", default=".")
    search = sub.add_parser("search", help="reads whose line holds one of the taxa")
    search.add_argument("-s", "--sam", required=True)
    search.add_argument("-t", "--taxa", required=True, help="comma list, or a file of one id per line")
    search.add_argument("-o", "--output", required=True, help="prefix of the output folders")
    order = sub.add_parser("sort", help="header and coordinate order")
    order.add_argument("-s", "--sam", required=True)
    order.add_argument("-o", "--output", required=True)
    order.add_argument("--bam")
    for name in ("profile", "extract"):
        p = sub.add_parser(name)
        source = p.add_mutually_exclusive_group(required=True)
        source.add_argument("-i", "--input", nargs="+", default=[])
        source.add_argument("-s", "--sam", help="SAM or BAM file, or - for standard input")
        p.add_argument("-d", "--database", required=True)
        p.add_argument("-l", "--db-level")
        p.add_argument("-p", "--prefix")
        p.add_argument("-o", "--outdir", default=".")
        p.add_argument("--taxonomy", help="folder of taxonomy files (dumps, taxdump.tar.gz, taxonomy.tsv) or one file; else <database>.tax.tsv, else the folder 'taxonomy_db'")
        p.add_argument("--taxonomy-format", choices=taxonomy.FORMATS, default="tsv", help="format of a single file")
        p.add_argument("-c", "--stdout", action="store_true", help="print the summary and the extracted reads, write no report")
        p.add_argument("-t", "--threads", type=int, default=1, help="threads of the aligner")
        p.add_argument("--silent", action="store_true", help="messages to the log file alone")
        p.add_argument("--exclude", help="file of accessions")
        p.add_argument("-mc", "--min-cov", type=float, default=0.0)
        p.add_argument("-mr", "--min-reads", type=int, default=0)
        p.add_argument("-ml", "--min-len", type=int, default=0)
        p.add_argument("-mz", "--max-zscore", type=float, default=0.0)
        p.add_argument("-mf", "--match-factor", type=float, default=0.0)
        p.add_argument("--ani", default="0.95,0.99")
        p.add_argument("-nc", "--no-cutoffs", action="store_true")
        p.add_argument("-rm", "--remove-multiple", choices=("auto", "yes", "no"), default="auto")
        p.add_argument("-r", "--abundance", default="depth")
        p.add_argument("-f", "--format", choices=("tsv", "csv", "biom"), default="tsv")
        p.add_argument("-x", "--preset", default="sr")
        if name == "extract":
            p.add_argument("-e", "--select", default="all:20:fasta")
            p.add_argument("-eo", "--extract-only", action="store_true", help="from an existing full report")
            p.add_argument("--report", help="that report; else <outdir>/<prefix>.full.tsv, else the one beside the SAM file")
    names = sub.add_parser("names", help="taxon ids of names")
    names.add_argument("names", nargs="+")
    names.add_argument("--taxonomy", required=True)
    names.add_argument("--taxonomy-format", choices=taxonomy.FORMATS, default="tsv")
    names.add_argument("--rank")
    names.add_argument("--superkingdom")
    names.add_argument("--exact", action="store_true")
    names.add_argument("--scientific", action="store_true", help="names that hold the text, scientific ones only")
    names.add_argument("--cutoff", type=float, default=0.7)
    names.add_argument("--most", type=int, default=3)
    return top


def config_of(a: argparse.Namespace) -> ProfileConfig:
    species, strain = ani_limits(a.ani)
    cut = Cutoffs(a.min_cov, a.min_reads, a.min_len, a.max_zscore, species, strain)
    return ProfileConfig(a.database, a.sam, tuple(a.input or ()), a.db_level, a.prefix, a.preset, "auto", a.remove_multiple, a.match_factor, cut, a.abundance, a.format, a.no_cutoffs, a.threads).resolved()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "pull":
        print(*external.pull(a.url, a.outdir), sep="\n")
        return 0
    from stratakit.session import local_session, ship

    spark = ship(local_session())
    return {"search": _search, "sort": _sort, "names": _names}.get(a.command, _run)(spark, a)


def _search(spark, a) -> int:
    from stratakit.operators import extract
    from stratakit.sinks import reports
    from stratakit.sources import sam, tables

    taxa = [r.acc for r in tables.read_list(spark, a.taxa, comments=False).collect()] if os.path.exists(a.taxa) else [x.strip() for x in a.taxa.split(",") if x.strip()]
    found = extract.text_search(sam.read_sam(spark, external.local_sam(a.sam, f"{a.output}.input.sam")), [extract.literal(t) for t in taxa])
    reports.write_text(extract.search_records(found), f"{a.output}.fasta", compress=True)
    reports.write_text(extract.search_records(found, table=True), f"{a.output}.tsv")
    print(f"{found.count()} reads")
    return 0


def _sort(spark, a) -> int:
    from stratakit.sinks import reports
    from stratakit.sources import sam

    reports.write_sorted_sam(sam.read_sam(spark, external.local_sam(a.sam, f"{a.output}.input.sam")), a.output, a.bam)
    return 0


def _taxonomy(spark, a, database: str):
    folder, custom = taxonomy.resolve(spark, a.taxonomy, database, "taxonomy_db")
    return folder, *taxonomy.load(spark, folder, custom, a.taxonomy_format)


def _names(spark, a) -> int:
    from stratakit.operators.taxonomy import name_to_taxid

    folder, nodes, merged, _ = _taxonomy(spark, a, "")
    every = None
    if folder and not a.scientific and merged is not None:
        held = folder if os.path.exists(f"{folder}/names.dmp") else f"{folder}/taxdump.tar.gz"
        every = taxonomy.read_names(spark, held)
    found = name_to_taxid(a.names, nodes, every, merged, a.rank, a.superkingdom, not a.exact, a.cutoff, a.most, not a.scientific)
    for r in found.orderBy("query", "place").toLocalIterator():
        print(r.query, r.tid, r.name, sep="\t")
    return 0


def _run(spark, a) -> int:
    from stratakit import pipeline
    from stratakit.sinks import reports
    from stratakit.sources import tables

    config = config_of(a)
    os.makedirs(a.outdir, exist_ok=True)
    base = os.path.join(a.outdir, config.prefix)
    log = reports.Log(f"{base}.log", a.silent)
    log(f"settings: {config}")
    if config.sam:
        config = replace(config, sam=external.local_sam(config.sam, f"{base}.input.sam"))
    _, nodes, merged, ranks = _taxonomy(spark, a, config.database)
    excluded = tables.read_exclusions(spark, a.exclude) if a.exclude else None
    out = sys.stdout if a.stdout else None
    only = a.command == "extract" and a.extract_only
    if only:
        report = a.report or next((x for x in (f"{base}.full.tsv", pipeline.report_of(config.sam or "")) if os.path.exists(x)), None)
        if report is None or config.sam is None:
            raise SystemExit("extraction alone needs a SAM file and an existing full report")
        log(f"reading {report}")
        records, n = pipeline.run_extract_only(spark, config, nodes, a.select, report, None if a.stdout else f"{base}.extract", excluded)
    else:
        done = pipeline.run_profile(spark, config, nodes, a.outdir, merged, excluded, log, out, ranks)
        print(json.dumps(done["counters"]), file=sys.stderr if a.stdout else sys.stdout)
        if a.command == "profile" or done["report"] is None:
            return 0
        records, n = pipeline.run_extract(spark, done["alignments"], done["report"], nodes, a.select, None if a.stdout else f"{base}.extract")
    if a.stdout:
        reports.print_text(records, sys.stdout)
    log(f"{n} reads extracted")
    if not a.stdout:
        print(f"{n} reads")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
