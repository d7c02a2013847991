import gzip
import json
import re

import pytest

from stratakit import cli, pipeline
from stratakit.config import ProfileConfig, ani_limits
from stratakit.operators import extract, rollup, samsort
from stratakit.operators.rollup import REPORT, SUMMARY, Cutoffs
from stratakit.sinks import reports
from stratakit.sources import sam, tables, taxonomy
from tests.test_expressions import READS, line, lines

RANKS = ["superkingdom", "phylum", "class", "order", "family", "genus", "species"]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    (d / "reads.sam").write_text("\n".join(["@HD\tVN:1.6", *READS]) + "\n")
    stats = (("901", 400, ""), ("902", 50, "draft genome"), ("903", 70, ""))
    (d / "db.strain.stats").write_text("".join(f"strain\tsignature {t}\t{t}\tArchaea\t3\t220\t60\t{n}\t{n * 9000}\t{note}\n" for t, n, note in stats))
    rows = ["1\t0\t1\troot\troot"] + [f"{k}\t{k}\t{k - 1 if k > 10 else 1}\t{r}\t{r} x" for k, r in enumerate(RANKS, 10)] + [f"{t}\t9\t16\tstrain\tstrain {t}" for t, _, _ in stats]
    (d / "tax.tsv").write_text("\n".join(rows) + "\n")
    return d


def text_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part*")))


def test_stats_loader(spark, tmp_path):
    p = tmp_path / "s.stats"
    p.write_text("DB_level\tName\tTaxid\tSk\tn\tmax\tmin\tTotalLength\tGenomeSize\tNote\nspecies\tone\t71\tArchaea\t2\t90\t40\t130\t2600000\t\nstrain\ttwo\t72\tArchaea\t2\t90\t40\t260\tunknown\tcheck\n")
    got = {r.taxid: (r.total_length, r.genome_size, r.note) for r in tables.read_stats(spark, str(p)).collect()}
    assert got == {"71": (130, 2600000, ""), "72": (260, 0, "check")}
    p.write_text("species\tone\t71\tArchaea\t2\t90\t40\t130\tunknown\n")
    assert tables.read_stats(spark, str(p)).first().genome_size == 0
    p.write_text("species\tone\t71\tArchaea\t2\t90\t40\tmany\t1\t\n")
    with pytest.raises(Exception, match="many"):
        tables.read_stats(spark, str(p)).collect()


def test_profile_extract_and_extract_only(spark, inputs, capsys):
    base = ["-s", str(inputs / "reads.sam"), "-d", str(inputs / "db.strain"), "--taxonomy", str(inputs / "tax.tsv"), "-o", str(inputs)]
    assert cli.main(["extract", *base, "-mf", "0.5", "-nc", "-e", "901,strain 902:2:fastq"]) == 0
    full = (inputs / "reads.full.tsv").read_text().splitlines()
    assert full[0].split("\t") == list(REPORT) and len(full) == 1 + 7 + 2
    short = (inputs / "reads.tsv").read_text().splitlines()
    assert short[0].split("\t") == list(SUMMARY)
    strain = {r.split("\t")[2]: r.split("\t") for r in full if r.startswith("strain\t")}
    # 33 + 12 bases on two fragments of 80 and 120, of which 30 + 12 are covered
    assert strain["901"][3:5] == ["3", "45"] and strain["901"][6] == "42" and strain["901"][7] == "0.105000" and strain["901"][19] == "200"
    assert sum(float(r.split("\t")[9]) for r in full if r.startswith("genus\t")) == pytest.approx(1)
    lineage = (inputs / "reads.lineage.tsv").read_text().splitlines()
    assert lineage[0].split("\t")[1:3] == ["superkingdom x", "phylum x"]
    records = text_of(inputs / "reads.extract").splitlines()
    assert [r.split("|")[0] for r in records[::4]] == ["@m1", "@m2", "@m4"] and records[4:8][1] == "GATTACAGATTACAGGTT"
    log = (inputs / "reads.log").read_text()
    assert re.search(r"^\[00:0\d:\d\d\] 4 alignments read$", log, re.M) and "3 reads extracted" in log
    err = capsys.readouterr().err
    assert "4 alignments read" in err
    # from the report alone: another selection, no new profile
    (inputs / "reads.tsv").unlink()
    for p in (inputs / "reads.extract").iterdir():
        p.unlink()
    (inputs / "reads.extract").rmdir()
    assert cli.main(["extract", *base, "-eo", "--silent", "-e", "902"]) == 0
    assert [r.split("|")[0] for r in text_of(inputs / "reads.extract").splitlines()[::2]] == [">m4"] and not (inputs / "reads.tsv").exists()
    assert capsys.readouterr().err.count("]") == 0
    assert pipeline.report_of("/x/y/run.strain.sam") == "/x/y/run.full.tsv"
    with pytest.raises(SystemExit, match="existing full report"):
        cli.main(["extract", *base, "-eo", "-p", "absent", "--silent"])


def test_stdout(spark, inputs, capsys, tmp_path):
    assert cli.main(["extract", "-s", str(inputs / "reads.sam"), "-d", str(inputs / "db.strain"), "--taxonomy", str(inputs / "tax.tsv"), "-o", str(tmp_path / "o"), "-nc", "-c", "--silent", "-e", "901:1"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].split("\t") == list(SUMMARY) and out[-2].startswith(">m1|S1|1|80|901:5..20 LEVEL=strain NAME=strain_901 TAXID=901")
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["reads.log"]


def test_best_hits_are_written(spark, inputs, tmp_path):
    again = line("m1", "T7|1|60|902", 3, "18M", "TTACCGGATTACAGGCAT", score=36)
    (tmp_path / "multi.sam").write_text("\n".join([*READS, again]) + "\n")
    config = ProfileConfig(str(inputs / "db.strain"), str(tmp_path / "multi.sam"), remove_multiple="yes", no_cutoffs=True)
    done = pipeline.run_profile(spark, config, taxonomy.read_tsv(spark, str(inputs / "tax.tsv")), str(tmp_path / "o"))
    kept = text_of(tmp_path / "o" / "multi.strain.sam").splitlines()
    assert kept == [*READS[1:], again] and done["counters"]["alignments"] == 4
    assert {r.TAXID: r.READ_COUNT for r in done["report"].where("LEVEL = 'strain'").collect()} == {"901": 2, "902": 2}


def test_limit_counts_reads_that_can_be_written(spark, inputs):
    """Reads that do not reverse (a letter outside the code) take no place under the limit."""
    bad = [line(f"b{k}", "S1|1|80|901", 5, "4M", "AC*T", flag=16) for k in range(3)]
    good = [line(f"g{k}", "S1|1|80|901", 5, "4M", "ACGT", flag=16 * (k % 2)) for k in range(3)]
    parsed = sam.parse_sam(lines(spark, [*bad, *good]))
    full = spark.createDataFrame([("strain", "strain 901", "901", "")], "LEVEL string, NAME string, TAXID string, NOTE string")
    nodes = taxonomy.read_tsv(spark, str(inputs / "tax.tsv"))
    for limit, names in (("2", ["g0", "g1"]), ("all", ["g0", "g1", "g2"]), ("5", ["g0", "g1", "g2"])):
        records, n = pipeline.run_extract(spark, parsed, full, nodes, f"901:{limit}")
        assert n == len(names) and [r.value.split("|")[0][1:] for r in records.collect()] == names


def test_biom_and_gzip(spark, inputs):
    config = ProfileConfig(str(inputs / "db.strain"), str(inputs / "reads.sam"), match_factor=0.5, fmt="biom", cutoffs=Cutoffs(), prefix="b")
    done = pipeline.run_profile(spark, config, taxonomy.read_tsv(spark, str(inputs / "tax.tsv")), str(inputs))
    table = json.loads((inputs / "b.biom").read_text())
    assert table["shape"] == [2, 1] and len(table["rows"][0]["metadata"]["taxonomy"]) == 8
    records, n = pipeline.run_extract(spark, done["alignments"], done["report"], taxonomy.read_tsv(spark, str(inputs / "tax.tsv")), "all:3")
    assert n == records.count()
    reports.write_text(records, str(inputs / "z"), True)
    for p in (inputs / "z").glob("part*.gz"):
        gzip.decompress(p.read_bytes())


def test_no_full_lineage_names_the_taxon(spark, inputs):
    nodes = taxonomy.read_tsv(spark, str(inputs / "tax.tsv")).where("tid <> '902'")
    with pytest.raises(ValueError, match="902"):
        pipeline.run_profile(spark, ProfileConfig(str(inputs / "db.strain"), str(inputs / "reads.sam"), match_factor=0.5), nodes, str(inputs))


def test_zero_total_length_raises(spark, inputs, tmp_path):
    (tmp_path / "db.strain.stats").write_text("strain\tx\t901\tArchaea\t3\t220\t60\t0\t1\t\n")
    with pytest.raises(Exception, match="total signature length is zero"):
        pipeline.run_profile(spark, ProfileConfig(str(tmp_path / "db.strain"), str(inputs / "reads.sam")), taxonomy.read_tsv(spark, str(inputs / "tax.tsv")), str(tmp_path))


def test_no_mapped_reads(spark, inputs, tmp_path):
    (tmp_path / "none.sam").write_text("@HD\tVN:1.6\n")
    done = pipeline.run_profile(spark, ProfileConfig(str(inputs / "db.strain"), str(tmp_path / "none.sam")), taxonomy.read_tsv(spark, str(inputs / "tax.tsv")), str(tmp_path))
    assert done["report"] is None and done["counters"]["alignments"] == 0


def test_notes_join_in_order_of_taxid(spark):
    """Distinct notes, empty ones too, by the least taxid that has them."""
    at = [(k, r, f"{r} x", f"{k}") for k, r in enumerate([*RANKS, "strain"])]
    rows = [(t, note, 0.9, [(r, f"{k}", n) if r != "strain" else (r, t, f"s{t}") for k, r, n, _ in at]) for t, note in (("5", "b"), ("3", ""), ("9", "a"), ("4", "b"), ("7", ""))]
    sums = ", ".join(f"1 as {c}" for c in ("total_bp_mapped", "read_count", "total_bp_mismatch", "total_bp_indel", "total_read_len", "covered_sig_len", "mapped_sig_len", "total_sig_len", "depth", "genomic_content_est", "genome_size", "genome_count"))
    df = spark.createDataFrame(rows, "taxid string, note string, ani_ci95 double, lineage array<struct<rank:string,taxid:string,name:string>>")
    df = df.selectExpr("*", sums.split(", ")[0], *sums.split(", ")[1:], "0.5 as best_sig_cov", "0.1 as zscore", "'strain' as db_level", "cast(taxid as double) as ani_naive", "0.1 as ani_low", "0.9 as ani_high")
    found = {r.level: r for r in rollup.by_rank(df).where("level <> 'strain'").collect()}
    assert len(found) == 7 and {(r.note, r.genome_count, r.ani_naive) for r in found.values()} == {("; b; a", 5, 3.0)}


def test_file_order_over_splits(spark, tmp_path):
    p = tmp_path / "big.sam"
    p.write_text("".join(f"r{k}\t{'x' * 40}\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = sam.read_sam(spark, str(p)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value.split("\t")[0] for r in rows] == [f"r{k}" for k in range(3000)]


def test_selector_and_settings(spark, tmp_path):
    s = extract.Selector.parse
    assert s("71,one name").taxa == ("71", "one name") and s("all").taxa is None and s("@f.txt:10:fasta").file == "f.txt"
    assert (s("1:5").limit, s("1:5").fmt, s("1:all:fastq").limit) == (5, "fasta", 0)
    for bad in ("1:x", "1:2:bam"):
        with pytest.raises(ValueError):
            s(bad)
    assert ani_limits("0.9") == (0.9, 0.99) and ani_limits("0.9,0.95") == (0.9, 0.95)
    c = ProfileConfig("x/db.species.mmi", reads=("a/b.fastq.gz",), no_cutoffs=True).resolved()
    assert (c.database, c.db_level, c.prefix, c.remove_multiple, c.aligner_options) == ("x/db.species", "species", "b", "yes", "-s60")
    with pytest.raises(ValueError):
        ProfileConfig("x/db.species").resolved()
    with pytest.raises(ValueError):
        ProfileConfig("x/db", sam="s.sam").resolved()
    (tmp_path / "ex.txt").write_text("\n\n")
    with pytest.warns(UserWarning, match="nothing is excluded"):
        assert tables.read_exclusions(spark, str(tmp_path / "ex.txt")).count() == 0


def test_aligner_is_called_if_there(monkeypatch, tmp_path):
    """A stand-in for the aligner: header lines go, options follow the preset."""
    tool = tmp_path / "bin" / "minimap2"
    tool.parent.mkdir()
    tool.write_text(f"#!/bin/sh\necho \"$@\" > {tmp_path}/args\nprintf '@HD\\tVN:1\\n{READS[0]}\\n'\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tool.parent}:/usr/bin:/bin")
    config = ProfileConfig("x/db.species", reads=("a.fq", "b.fq"), threads=3).resolved()
    assert pipeline.align(config, str(tmp_path / "o.sam"), config.threads)
    assert (tmp_path / "o.sam").read_text() == READS[0] + "\n"
    assert (tmp_path / "args").read_text().split() == "-x sr -s60 -a -N20 --secondary=no --sam-hit-only -t 3 x/db.species.mmi a.fq b.fq".split()
    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(RuntimeError, match="minimap2"):
        pipeline.align(config, str(tmp_path / "o.sam"))


def test_other_inputs(monkeypatch, tmp_path, capsys):
    """Standard input, a BAM file through a stand-in for samtools, and an archive by URL."""
    import io
    import sys
    import tarfile
    from types import SimpleNamespace

    from stratakit.sources import external

    assert external.local_sam("x.sam", "t") == "x.sam"
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(b"line\n")))
    target = str(tmp_path / "in.sam")
    assert external.local_sam("-", target) == target and (tmp_path / "in.sam").read_text() == "line\n"
    tool = tmp_path / "bin" / "samtools"
    tool.parent.mkdir()
    tool.write_text('#!/bin/sh\necho "$@"\n')
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tool.parent}:/usr/bin:/bin")
    assert external.local_sam("a.bam", target) == target and (tmp_path / "in.sam").read_text() == "view -h a.bam\n"
    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(RuntimeError, match="samtools"):
        external.local_sam("a.bam", target)
    with tarfile.open(tmp_path / "db.tar.gz", "w:gz") as tar:
        tar.add(target, "db/part.txt")
    assert cli.main(["pull", (tmp_path / "db.tar.gz").as_uri(), "-o", str(tmp_path / "got")]) == 0
    assert capsys.readouterr().out.split() == ["db/part.txt"] and (tmp_path / "got" / "db" / "part.txt").exists()
    assert ProfileConfig("x/db.strain", sam="-").resolved().prefix == "stdin" and ProfileConfig("x/db.strain", sam="a/b.bam").resolved().prefix == "b"


def test_search_and_headers(spark):
    rows = lines(spark, ["@SQ\tSN:901", *READS, "short\t901"])
    assert extract.text_search(rows, [extract.literal("901")]).count() == 3
    refs = samsort.references(rows)
    assert {r.rname: r.length for r in refs.where("length is not null").collect()}["S1|1|80|901"] == 80
    assert samsort.header(refs).where("value like '@HD%'").count() == 1
    order = [(r.rname, r.pos) for r in samsort.coordinate_sorted(rows).collect()]
    assert order == [(None, None), ("S1|101|220|901|", 150), ("S1|1|80|901", 5), ("S1|1|80|901", 18), ("T7|1|60|902.0", 40)]


def test_search_sort_and_names_commands(inputs, capsys):
    assert cli.main(["search", "-s", str(inputs / "reads.sam"), "-t", "902,nothing", "-o", str(inputs / "found")]) == 0
    assert text_of(inputs / "found.tsv").splitlines() == ["@m4 T7|1|60|902.0 10M2S\tAACCGGTTAANN"]
    packed = "".join(gzip.decompress(p.read_bytes()).decode() for p in sorted((inputs / "found.fasta").glob("part*.gz")))
    assert packed.count("@m4") == 1
    assert cli.main(["sort", "-s", str(inputs / "reads.sam"), "-o", str(inputs / "sorted.sam")]) == 0
    out = text_of(inputs / "sorted.sam").splitlines()
    assert out[0].startswith("@HD") and sum(x.startswith("@SQ") for x in out) == 3 and [x.split("\t")[0] for x in out[4:]] == ["m3", "m1", "m2", "m4"]
    capsys.readouterr()
    assert cli.main(["names", "strain 90", "--taxonomy", str(inputs / "tax.tsv"), "--scientific", "--rank", "strain", "--most", "2"]) == 0
    assert capsys.readouterr().out.splitlines() == ["strain 90\t901\tstrain 901", "strain 90\t902\tstrain 902"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from stratakit import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        session.work_path(Spark(), "t")
