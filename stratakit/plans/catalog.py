"""Registered queries of the profiler and their SQL twins, over the whole of every table they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.functions import exprs as X
from stratakit.operators import extract, profile, rollup, samsort, taxonomy
from stratakit.operators.rollup import Cutoffs
from stratakit.plans import adapters, oracles
from stratakit.session import staged, work_path
from stratakit.sources import sam, tables
from stratakit.sources.tables import last_wins
from stratakit.sources.taxonomy import lineage_nodes, overlay, read_custom, read_dump

#: Match factor and cutoffs of the registered queries.
MATCH_FACTOR = 0.05
CUTOFFS = Cutoffs(min_cov=0.3, min_reads=150, min_len=9000, max_zscore=1.0, ani_species=0.93, ani_strain=0.935)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FLAGSHIP = "rank_report"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _parsed(spark, d, match_factor=MATCH_FACTOR, exclude=True) -> DataFrame:
    return sam.parse_sam(adapters.lines(spark, d), match_factor, adapters.view(spark, d, adapters.EXCLUDED_SQL) if exclude else None)


def _counted(spark, d) -> DataFrame:
    return sam.counted(_parsed(spark, d))


def _strains(spark, d) -> DataFrame:
    return profile.strains(profile.fragments(_counted(spark, d)), adapters.view(spark, d, adapters.STATS_SQL))


def _walk(spark, d) -> DataFrame:
    return taxonomy.walk(adapters.view(spark, d, adapters.IDS_SQL), adapters.nodes(spark, d), adapters.view(spark, d, adapters.MERGED_SQL))


def _report(spark, d, strains: DataFrame | None = None, lineages: DataFrame | None = None) -> DataFrame:
    # a row per strain, read three times: by the walk, the roll-up and the total
    strains = staged(_strains(spark, d), "strains")[0] if strains is None else strains
    return rollup.report(strains.join(_lineages(spark, d, strains) if lineages is None else lineages, "taxid"), CUTOFFS)


def _lineages(spark, d, ids: DataFrame) -> DataFrame:
    walked = taxonomy.walk(ids.select(F.col("taxid").alias("query")).distinct(), adapters.nodes(spark, d))
    return taxonomy.major_lineage(walked).select(F.col("query").alias("taxid"), "lineage", "path")


def _lower(full: DataFrame, columns) -> DataFrame:
    """Ratios with many digits are rounded, as two engines may differ in the last."""
    kinds = dict(full.dtypes)
    digits = lambda c: 3 if c == "GENOMIC_CONTENT_EST" else 9  # noqa: E731  a number in the millions
    return full.select(*[(F.round(F.col(c), digits(c)) if kinds[c] == "double" else F.col(c)).alias(c.lower()) for c in columns])


@query
def sam_parse(spark, d):
    return _parsed(spark, d).select("line_no", "qname", "flag", "rname", "pos", "cigar", "as_score", "nm", "mapped_len", "ins_len", "del_len", "read_len", "region_start", "region_end", "acc", "rstart", "rend", "taxid", "is_primary", "valid_match", "valid_acc")


@query
def alignment_counters(spark, d):
    return sam.counters(_parsed(spark, d))


@query
def match_filter(spark, d):
    rows = _parsed(spark, d, 0.06, False).where("is_primary and valid_match")
    return rows.select("line_no", "rname", F.round(X.match_identity(F.col("mapped_len"), F.col("rend") - F.col("rstart") + 1, F.col("read_len")), 9).alias("identity"))


@query
def excluded_anti(spark, d):
    return _parsed(spark, d).where("valid_acc").groupBy("acc").agg(F.count("*").alias("lines"))


@query
def best_hit(spark, d):
    return profile.best_hits(_parsed(spark, d, 0.0, False)).select("qkey", "line_no", "as_score", "rname")


@query
def region_merge(spark, d):
    return profile.merged_regions(_counted(spark, d)).select("rname", "start", "end")


@query
def covered_length(spark, d):
    return profile.fragments(_counted(spark, d)).select("rname", "sc")


@query
def fragment_agg(spark, d):
    return profile.fragments(_counted(spark, d))


@query
def strain_agg(spark, d):
    rows = _strains(spark, d).drop("ani_naive", "ani_ci95", "ani_low", "ani_high", "sig_cov", "genome_count")
    return rows.withColumns({c: F.round(c, 3 if c == "genomic_content_est" else 9) for c in ("best_sig_cov", "depth", "zscore", "genomic_content_est")})


@query
def zscore(spark, d):
    return _strains(spark, d).select("taxid", F.round("zscore", 9).alias("zscore"))


@query
def ani_interval(spark, d):
    text = F.concat(F.lit("["), X.py_float(F.col("ani_low")), F.lit("-"), X.py_float(F.col("ani_high")), F.lit("]"))
    return _strains(spark, d).select("taxid", "ani_naive", "ani_ci95", text.alias("ani_ci95_lh"))


@query
def rank_report(spark, d):
    return _lower(_report(spark, d), rollup.REPORT)


@query
def summary_report(spark, d):
    return _lower(rollup.qualified(_report(spark, d)), rollup.SUMMARY)


@query
def rank_rollup(spark, d):
    return _lower(_report(spark, d), ("LEVEL", "NAME", "TAXID", "READ_COUNT", "TOTAL_BP_MAPPED", "COVERED_SIG_LEN", "GENOME_COUNT", "GENOME_SIZE"))


@query
def relative_abundance(spark, d):
    return _lower(_report(spark, d), ("LEVEL", "NAME", "REL_ABUNDANCE", "REL_ABUNDANCE_DEPTH", "REL_ABUNDANCE_GC"))


@query
def filter_notes(spark, d):
    return _lower(_report(spark, d), ("LEVEL", "NAME", "NOTE"))


@query
def lineage_table(spark, d):
    """Qualified strains with abundance and the names of their lineage."""
    names = taxonomy.major_lineage(_walk(spark, d)).select(F.col("query").alias("TAXID"), F.array_join(F.transform("lineage", lambda x: x["name"]), "\t").alias("names"))
    rows = rollup.qualified(_report(spark, d)).where("LEVEL = 'strain'").join(names, "TAXID")
    return rows.select(F.col("TAXID").alias("taxid"), F.round("ABUNDANCE", 6).alias("abundance"), "names")


@query
def taxon_lookup(spark, d):
    """Rank, name, depth, parents, type and nearest major ancestor of every id."""
    w = _walk(spark, d)
    return w.select(
        "query", taxonomy.rank().alias("rank"), taxonomy.rank(False).alias("rank_as_is"), taxonomy.name().alias("name"), taxonomy.depth().cast("int").alias("depth"), taxonomy.parent().alias("parent"),
        taxonomy.parent(True).alias("parent_any"), taxonomy.taxon_type().alias("taxon_type"), taxonomy.nearest_major().alias("nearest_major"), "is_leaf",
    )


@query
def taxon_on_rank(spark, d):
    w = _walk(spark, d)
    return w.select("query", *[f(r).alias(f"{r}_{n}") for r in ("phylum", "order", "species", "strain") for n, f in (("name", taxonomy.name_on_rank), ("taxid", taxonomy.taxid_on_rank))])


@query
def full_lineage(spark, d):
    return _walk(spark, d).select("query", taxonomy.full_lineage().alias("lineage"), taxonomy.full_lineage(";", True, False).alias("lineage_abbr"))


@query
def lineage_links(spark, d):
    w = _walk(spark, d)
    return w.select("query", F.explode(taxonomy.link_map()).alias("parent", "child"))


@query
def major_lineage(spark, d):
    """Major ranks with placeholders for missing ones."""
    return taxonomy.major_lineage(_walk(spark, d)).select("query", taxonomy.lineage_text("|", True).alias("lineage"), taxonomy.lineage_text(";").alias("lineage_abbr"))


@query
def lowest_common_ancestor(spark, d):
    """Of the strains that each read's lines hit."""
    hits, _ = staged(_parsed(spark, d, 0.0, False).select("qname", "taxid").distinct(), "hits")
    return taxonomy.lca(hits, _lineages(spark, d, hits), "qname")


@query
def descendants(spark, d):
    nodes = adapters.nodes(spark, d)
    return taxonomy.descendants(nodes.where("rank in ('superkingdom', 'class')").select(F.col("tid").alias("query")), nodes, "species")


@query
def children(spark, d):
    nodes = adapters.nodes(spark, d)
    return taxonomy.descendants(nodes.select(F.col("tid").alias("query")), nodes)


@query
def child_counts(spark, d):
    return taxonomy.child_counts(adapters.nodes(spark, d))


@query
def merged_overlay(spark, d):
    """Two layers of nodes, the later one winning."""
    nodes = adapters.nodes(spark, d)
    newer = nodes.where("rank in ('genus', 'phylum')").withColumn("name", F.concat("name", F.lit(" (custom)")))
    return overlay(nodes, newer)


@query
def lineage_loader(spark, d):
    """Nodes from lineage text with empty levels."""
    rows = adapters.view(spark, d, oracles.LINEAGE_SQL)
    return lineage_nodes(rows.select("lineage")).select("tid", "parent", "rank", "name")


@query
def acc2taxid(spark, d):
    return taxonomy.acc2taxid(adapters.view(spark, d, oracles.ACC_SQL), adapters.view(spark, d, oracles.ACC_TABLE_SQL))


@query
def name_lookup(spark, d):
    """Names that contain a nation's key text, the first three of each."""
    asked = adapters.view(spark, d, "select concat('NATION_', cast(n_nationkey as string)) as query from nation")
    return taxonomy.names_like(asked, adapters.nodes(spark, d)).select("query", "tid", "name", "rn")


@query
def name_fuzzy(spark, d):
    return taxonomy.names_fuzzy(["realm AFRCA", "genus NATION_1", "species 300505"], adapters.nodes(spark, d), 0.8)


@query
def extract_reads(spark, d):
    """FASTA records of at most 20 reads of each taxon that is not filtered out."""
    reads = _extracted(spark, d)
    return reads.select("line_no", "tax", extract.record("fasta").alias("record"))


@query
def extract_reads_fastq(spark, d):
    reads = _extracted(spark, d)
    return reads.select("line_no", "tax", extract.record("fastq").alias("record"))


def _extracted(spark, d):
    # the lines are parsed once: strains, their walk and the reads all come from the staged columns
    wanted = ("line_no", "qname", "flag", "rname", "taxid", "region_start", "region_end", "seq", "qual", "nm", "ins_len", "del_len", "read_len")
    counted, _ = staged(_counted(spark, d).select(*wanted), "alignments")
    strains, _ = staged(profile.strains(profile.fragments(counted), adapters.view(spark, d, adapters.STATS_SQL)), "strains")
    lineages, _ = staged(_lineages(spark, d, strains), "lineages")
    ancestors = extract.closure(lineages.select(F.col("taxid").alias("query"), "path"))
    return extract.reads_by_taxon(counted, extract.taxa_of(_report(spark, d, strains, lineages), None), ancestors, 20)


@query
def text_search(spark, d):
    return extract.text_search(adapters.lines(spark, d), [r"\|101\b", r"\|10[35]\b"])


@query
def reverse_complement(spark, d):
    rows = _parsed(spark, d, 0.0, False)
    return rows.select("line_no", X.revcomp(F.col("seq")).alias("revcomp"), F.reverse("qual").alias("qual_reversed"), X.mate_suffix(F.col("flag")).alias("mate"), X.mate_key(F.col("qname"), F.col("flag")).alias("qkey"))


@query
def distinct_refs(spark, d):
    return samsort.references(adapters.lines(spark, d))


@query
def coordinate_sort(spark, d):
    """Each line's number in coordinate order, from the files that the sorted SAM is written to."""
    from stratakit.sinks import reports

    path = work_path(spark, "sorted")
    reports.write_sorted_sam(adapters.lines(spark, d), path)
    rows = _numbered(sam.read_sam(spark, path)).select(F.split("value", "\t").alias("f"), "place")
    return rows.select(F.get("f", F.lit(0)).alias("qname"), F.get("f", F.lit(2)).alias("rname"), F.get("f", F.lit(3)).cast("long").alias("pos"), "place")


def _numbered(rows: DataFrame) -> DataFrame:
    """Lines of a folder of files with their place in it."""
    before = rows.groupBy("line_no.file").agg(F.count("*").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    joined = rows.join(before, F.col("line_no.file") == F.col("file"))
    return joined.withColumn("place", F.col("base") + F.row_number().over(Window.partitionBy("file").orderBy("line_no")))


def _file(df: DataFrame, name: str) -> str:
    """``df`` (one text column) as a folder of text files in the shared folder."""
    path = work_path(df.sparkSession, name)
    df.write.text(path)
    return path


@query
def sam_file(spark, d):
    """Alignments written as SAM text with header lines, scanned and parsed."""
    header = spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:P1|1|1000|101\tLN:1000",)], "value string")
    path = _file(header.unionByName(adapters.lines(spark, d).select("value")), "sam")
    rows = sam.parse_sam(sam.read_sam(spark, path), MATCH_FACTOR)
    return rows.select("qname", "flag", "rname", "pos", "as_score", "nm", "mapped_len", "read_len", "region_start", "region_end", "is_primary", "valid_match", "malformed")


@query
def stats_file(spark, d):
    rows = adapters.view(spark, d, adapters.STATS_SQL).select(F.concat_ws("\t", "db_level", F.lit("name"), "taxid", F.lit("Archaea"), F.lit("1"), F.lit("2"), F.lit("3"), F.col("total_length").cast("string"), F.when(F.col("id") % 3 == 0, "none").otherwise(F.col("genome_size").cast("string")), "note").alias("value"))
    header = spark.createDataFrame([("DB_level\tName\tTaxid\tSuperkingdom\tN\tMax\tMin\tTotalLength\tGenomeSize\tNote",)], "value string")
    return tables.read_stats(spark, _file(header.unionByName(rows), "stats"))


@query
def list_file(spark, d):
    """Accessions of an exclusion list with comments, blanks and repeats."""
    rows = adapters.view(spark, d, "select concat(case when p_partkey % 5 = 0 then '#' else ' ' end, 'P', cast(p_partkey % 200 as string), ' ') as value from part union all select '' from part")
    return tables.read_list(spark, _file(rows, "list"))


@query
def dump_files(spark, d):
    """Nodes from dump files with names of several kinds."""
    nodes = adapters.nodes(spark, d)
    folder = work_path(spark, "dump")
    cells = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|")).alias("value")
    names = nodes.select(cells("tid", "name", F.lit(""), F.lit("scientific name"))).unionByName(nodes.select(cells("tid", F.concat(F.lit("old "), "name"), F.lit(""), F.lit("synonym"))))
    names.write.text(f"{folder}/names.dmp")
    nodes.select(cells("tid", "parent", "rank", F.lit("XX"))).write.text(f"{folder}/nodes.dmp")
    adapters.view(spark, d, adapters.MERGED_SQL).select(cells("old", "new")).write.text(f"{folder}/merged.dmp")
    found, merged = read_dump(spark, folder)
    return found.unionByName(merged.select(F.col("old").alias("tid"), F.col("new").alias("parent"), F.lit("merged").alias("rank"), F.lit("").alias("name")))


@query
def taxonomy_file(spark, d):
    """Nodes of a table with older rows before newer ones."""
    nodes = adapters.nodes(spark, d)
    line = lambda name: F.concat_ws("\t", "tid", F.lit("0"), "parent", "rank", name).alias("value")
    rows = nodes.select(line(F.lit("older")), F.lit(0).alias("k")).unionByName(nodes.select(line(F.col("name")), F.lit(1).alias("k")))
    return read_custom(spark, _file(rows.orderBy("k").select("value"), "taxonomy"))


@query
def gtdb_file(spark, d):
    """Nodes of a genome taxonomy with a strain level added."""
    rows = adapters.view(spark, d, oracles.GTDB_SQL)
    return read_custom(spark, _file(rows.select("value"), "gtdb"), "gtdb")


@query
def acc2taxid_files(spark, d):
    """Accession maps of three files, one of them missing."""
    table = adapters.view(spark, d, oracles.ACC_TABLE_SQL)
    paths = []
    for k in range(3):
        header = spark.createDataFrame([("accession\taccession.version\ttaxid\tgi",)], "value string")
        rows = table.where(F.col("priority") == k).select(F.concat_ws("\t", "accession", F.concat("accession", F.lit(".1")), "taxid", F.lit("0")).alias("value"))
        # the header is the first line of its file
        paths += [_file(header.unionByName(rows).coalesce(1), f"acc-{k}"), work_path(spark, "missing")]
    return tables.read_acc2taxid(spark, paths).select("accession", "taxid", (F.col("priority") / 2).cast("int").alias("priority"))


@query
def extract_file(spark, d):
    """Heads of the extracted records with their place in the written files: taxa by their first read, reads in file order."""
    from stratakit.sinks import reports

    path = work_path(spark, "extract")
    reports.write_text(extract.in_file_order(_extracted(spark, d)), path)
    rows = spark.read.text(path).select("value", sam.file_order().alias("line_no")).where(F.col("value").startswith(">"))
    return _numbered(rows).select(F.col("value").alias("head"), "place")


@query
def report_order(spark, d):
    """Rows of the report in the order they are written (shares equal to nine digits are ties)."""
    full, _ = staged(_report(spark, d), "report")
    at = Window.orderBy("level_no", F.round("ABUNDANCE", 9).desc(), "NAME", "TAXID")
    return full.select(F.col("LEVEL").alias("level"), F.col("NAME").alias("name"), F.col("TAXID").alias("taxid"), F.row_number().over(at).alias("place"))


@query
def lineage_types(spark, d):
    """The group or subtype below species of every id."""
    found = taxonomy.major_lineage(_walk(spark, d), guess_type=True)
    return found.where("type is not null").select("query", F.col("type.taxid").alias("type_taxid"), F.col("type.name").alias("type_name"))


@query
def name_filters(spark, d):
    """Scientific names that hold a nation's key text, of one rank and superkingdom."""
    asked = [f"NATION_{k}" for k in range(25)]
    found = taxonomy.name_to_taxid(asked, adapters.nodes(spark, d), rank_is="family", superkingdom="realm ASIA", first=2, expand=False)
    return found.select("query", "tid", "name", "place")


@query
def last_row_wins(spark, d):
    rows = adapters.view(spark, d, "select cast(o_custkey as string) as tid, o_orderkey as seq, o_orderpriority as name from orders")
    return last_wins(rows, "tid", "seq")


ORACLE_SQL = oracles.build(MATCH_FACTOR, CUTOFFS)
