import json
import tarfile

import pytest

from stratakit.operators import taxonomy as T
from stratakit.sources import tables
from stratakit.sources import taxonomy as S

TREE = [
    ("1", "1", "root", "root"), ("20", "1", "superkingdom", "Archaea"), ("31", "20", "phylum", "Methanobacteriota"), ("42", "31", "class", "Halobacteria"), ("53", "42", "order", "Haloferacales"), ("64", "53", "family", "Haloferacaceae"),
    ("75", "64", "genus", "Haloferax"), ("86", "75", "species", "Haloferax volcanii"), ("87", "75", "species", "Haloferax gibbonsii"), ("97", "86", "no rank", "group DS"), ("98", "97", "no rank", "Haloferax volcanii DS2"),
]
NODES = "tid string, parent string, rank string, name string"


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    d = tmp_path_factory.mktemp("dump")
    (d / "names.dmp").write_text("".join(f"{t}\t|\t{n}\t|\t\t|\tscientific name\t|\n{t}\t|\tformerly {n[:4]}\t|\t\t|\tsynonym\t|\n" for t, _, _, n in TREE))
    (d / "nodes.dmp").write_text("".join(f"{t}\t|\t{p}\t|\t{r}\t|\tQ\t|\n" for t, p, r, _ in TREE))
    (d / "merged.dmp").write_text("30\t|\t31\t|\n")
    return d


@pytest.fixture(scope="module")
def walked(spark, dump):
    nodes, merged = S.read_dump(spark, str(dump))
    ids = spark.createDataFrame([(x,) for x in ("1", "20", "31", "86", "97", "98", "30", "75", "4040", "87")], "query string")
    return T.walk(ids, nodes, merged).cache()


def ask(walked, column):
    return {r[0]: r[1] for r in walked.select("query", column).collect()}


def test_ranks_names_parents(walked):
    rank = ask(walked, T.rank())
    assert [rank[x] for x in ("1", "20", "31", "86", "97", "98", "30", "4040")] == ["root", "superkingdom", "phylum", "species", "species - others", "strain", "phylum", "unknown"]
    name = ask(walked, T.name())
    assert (name["86"], name["30"], name["4040"]) == ("Haloferax volcanii", "Methanobacteriota", "unknown")
    skipped, plain = ask(walked, T.parent()), ask(walked, T.parent(True))
    assert (skipped["86"], skipped["98"], skipped["4040"]) == ("75", "86", "unknown") and (plain["98"], plain["97"]) == ("97", "86")
    leaf = ask(walked, "is_leaf")
    assert (leaf["98"], leaf["97"], leaf["4040"]) == (True, False, False)
    depth = ask(walked, T.depth())
    assert (depth["1"], depth["98"], depth["4040"]) == (0, 9, None)


def test_on_rank_and_lineages(walked):
    assert [ask(walked, T.name_on_rank(r))["98"] for r in ("species", "Genus", "family", "tribe", "strain")] == ["Haloferax volcanii", "Haloferax", "Haloferacaceae", None, "Haloferax volcanii DS2"]
    assert [ask(walked, T.taxid_on_rank(r))["98"] for r in ("species", "genus", "tribe", "root", "strain")] == ["86", "75", None, "1", "98"]
    assert ask(walked, T.full_lineage())["86"].endswith("species|86|Haloferax_volcanii")
    assert "phylum__Methanobacteriota" in ask(walked, T.full_lineage(";"))["86"]
    assert "p|31|Methanobacteriota" in ask(walked, T.full_lineage("|", True))["86"]
    assert "PH|31|Methanobacteriota" in ask(walked, T.full_lineage("|", True, ranks=tables.MAJOR_RANKS | {"phylum": "PH"}))["86"]
    major = T.major_lineage(walked)
    text = {r[0]: r[1] for r in major.select("query", T.lineage_text()).collect()}
    assert text["86"].startswith("superkingdom|20|Archaea|phylum|31|Methanobacteriota") and text["4040"] == ""
    strain = {r[0]: r[1] for r in major.select("query", T.lineage_text("|", True)).collect()}
    assert strain["98"].endswith("strain|98|Haloferax volcanii DS2")
    assert ask(walked, T.link_map())["86"]["75"] == "86"


def test_type_of_a_lineage(walked):
    found = {r.query: r.type for r in T.major_lineage(walked, guess_type=True).select("query", "type").collect()}
    assert tuple(found["98"]) == ("97", "group DS")
    assert found["97"] is None and found["86"] is None and found["4040"] is None


def test_lca_and_descendants(spark, dump, walked):
    nodes, _ = S.read_dump(spark, str(dump))
    groups = spark.createDataFrame([("a", "98"), ("a", "86"), ("b", "86"), ("b", "87"), ("c", "86"), ("d", "1"), ("d", "86")], "g string, taxid string")
    lineages = T.major_lineage(walked).withColumnRenamed("query", "taxid")
    assert {r.g: r.lca for r in T.lca(groups, lineages, "g").collect()} == {"a": "86", "b": "75", "c": "86", "d": "1"}
    down = T.descendants(spark.createDataFrame([("20",)], "query string"), nodes, "species")
    assert sorted(r.tid for r in down.collect()) == ["86", "87"]


def test_placeholders(spark):
    nodes = spark.createDataFrame([("1", "1", "root", "root"), ("k", "1", "superkingdom", "K"), ("f", "k", "family", "F"), ("s", "f", "species", "S")], NODES)
    walked = T.walk(spark.createDataFrame([("s",)], "query string"), nodes)
    row = T.major_lineage(walked).select(T.lineage_text(";")).first()[0]
    assert row == "sk__K;p__F - no_o_rank - no_c_rank - no_p_rank;c__F - no_o_rank - no_c_rank;o__F - no_o_rank;f__F;g__S - no_g_rank;s__S"
    ranks = tables.MAJOR_RANKS | {"order": "ord"}
    assert "ord__F - no_ord_rank" in T.major_lineage(walked, ranks=ranks).select(T.lineage_text(";", ranks=ranks)).first()[0]


def test_loaders(spark, dump, tmp_path):
    tar = tmp_path / "taxdump.tar.gz"
    with tarfile.open(tar, "w:gz") as t:
        for name in ("names.dmp", "nodes.dmp", "merged.dmp"):
            t.add(dump / name, name)
    nodes, merged = S.read_dump_archive(spark, str(tar))
    assert nodes.count() == len(TREE) and merged.count() == 1
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, S.read_dump(spark, str(dump))[0].collect()))
    assert S.read_names(spark, str(tar)).count() == S.read_names(spark, str(dump)).where("kind is not null").count() == 2 * len(TREE)
    tsv = tmp_path / "tax.tsv"
    tsv.write_text("9\t1\t1\tgenus\told\n\n9\t1\t1\tgenus\tnew\n")
    assert [r.name for r in S.read_tsv(spark, str(tsv)).collect()] == ["new"]
    assert {r.tid: r.name for r in S.overlay(nodes, spark.createDataFrame([("20", "1", "superkingdom", "A2")], NODES)).collect()}["20"] == "A2"
    m = tmp_path / "m.txt"
    m.write_text("#x\nsk__A;p__;c__C\nnothing\n")
    got = {r.tid: (r.parent, r.rank) for r in S.read_mgnify(spark, str(m)).collect()}
    assert got == {"1": ("1", "root"), "A": ("1", "superkingdom"), "A - no_p_rank": ("A", "phylum"), "C": ("A - no_p_rank", "class")}
    g = tmp_path / "g.tsv"
    g.write_text("GB_1\td__Bac;p__P;s__S x\n")
    got = {r.tid: (r.parent, r.rank) for r in S.read_gtdb(spark, str(g)).collect()}
    assert got["Bac"] == ("1", "superkingdom") and got["GB_1"] == ("S x", "strain")
    meta = tmp_path / "gm.tsv"
    meta.write_text("\t".join(["GB_1", *["x"] * 15, "d__Bac;p__P", *["y"] * 45, "Org name"]) + "\n")
    assert {r.tid for r in S.read_gtdb(spark, str(meta), True).collect()} == {"1", "Bac", "P", "Org name"}


def test_later_rows_of_a_file_win_over_splits(spark, tmp_path):
    """The last row of an id counts though the scan orders its splits by size."""
    tsv = tmp_path / "tax.tsv"
    tsv.write_text("".join(f"{k % 50}\t1\t1\tgenus\tn{k}\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = {r.tid: r.name for r in S.read_tsv(spark, str(tsv)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {str(k): f"n{2950 + k}" for k in range(50)}


def test_dispatch_and_resolution(spark, dump, tmp_path):
    folder = tmp_path / "tax"
    folder.mkdir()
    with pytest.raises(ValueError, match="no taxonomy"):
        S.load(spark, str(folder))
    with tarfile.open(folder / "taxdump.tar.gz", "w:gz") as t:
        for name in ("names.dmp", "nodes.dmp", "merged.dmp"):
            t.add(dump / name, name)
    (folder / "taxonomy.tsv").write_text("75\t7\t64\tgenus\tfrom the table\n87\t8\t75\tspecies\tfrom the table\n")
    (folder / "taxonomy.custom.tsv").write_text("87\t8\t75\tspecies\tcustom\n")
    (folder / "major_level_to_abbr.json").write_text(json.dumps(tables.MAJOR_RANKS | {"genus": "gen"}))
    nodes, merged, ranks = S.load(spark, str(folder))
    names = {r.tid: r.name for r in nodes.collect()}
    assert (names["75"], names["87"], names["86"]) == ("from the table", "custom", "Haloferax volcanii") and merged.count() == 1 and ranks["genus"] == "gen"
    (tmp_path / "l.txt").write_text("sk__A;p__B\n")
    nodes, merged, ranks = S.load(spark, None, str(tmp_path / "l.txt"), "lineage")
    assert {r.tid for r in nodes.collect()} == {"1", "A", "B"} and merged is None and ranks == tables.MAJOR_RANKS
    with pytest.raises(ValueError, match="format"):
        S.load(spark, None, str(tmp_path / "l.txt"), "newick")
    (tmp_path / "db.strain.tax.tsv").write_text("1\t0\t1\troot\troot\n")
    db = str(tmp_path / "db.strain")
    assert S.resolve(spark, str(folder), db) == (str(folder), None) and S.resolve(spark, str(tmp_path / "l.txt"), db) == (None, str(tmp_path / "l.txt"))
    assert S.resolve(spark, None, db) == (None, f"{db}.tax.tsv") and S.resolve(spark, None, str(tmp_path / "other"), "default") == ("default", None)
    with pytest.raises(ValueError, match="no such taxonomy"):
        S.resolve(spark, str(tmp_path / "gone"), db)


def test_acc2taxid_and_names(spark, tmp_path):
    for k, rows in enumerate((["AX_7\tAX_7.3\t86\t0"], ["AX_7\tAX_7.3\t9\t0", "BY_2\tBY_2.1\t7\t0"])):
        (tmp_path / f"{k}.tsv").write_text("accession\taccession.version\ttaxid\tgi\n" + "\n".join(rows) + "\n")
    table = tables.read_acc2taxid(spark, [str(tmp_path / n) for n in ("missing.tsv", "0.tsv", "1.tsv")])
    got = {r.acc: r.taxid for r in T.acc2taxid(spark.createDataFrame([("AX_7.3",), ("BY_2",), ("no",)], "acc string"), table).collect()}
    assert got == {"AX_7.3": "86", "BY_2": "7", "no": None}
    nodes = spark.createDataFrame([(t, n) for t, _, _, n in TREE], "tid string, name string")
    close = T.names_fuzzy(["Haloferax volcani"], nodes, 0.9).collect()
    assert [r.tid for r in close] == ["86"]
    exact = T.names_like(spark.createDataFrame([("Archaea",), ("Haloferax",), ("Halo",)], "query string"), nodes, expand=False).collect()
    assert sorted((r.query, r.tid) for r in exact) == [("Archaea", "20"), ("Haloferax", "75")]
    asked = ["Halo", "vol", "DS", "a", "", "Halobacteria", "zzz", "Haloferax volcanii DS2 and more", "group DS"]
    got = {(r.query, r.tid) for r in T.names_like(spark.createDataFrame([(q,) for q in asked], "query string"), nodes, first=None).collect()}
    assert got == {(q, t) for q in asked if q for t, _, _, n in TREE if q in n}
    plan = T.names_like(spark.createDataFrame([("Halo",)], "query string"), nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Contains" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert T.names_like(spark.createDataFrame([], "query string"), nodes).count() == 0


def test_name_filters(spark, dump):
    nodes, merged = S.read_dump(spark, str(dump))
    every = S.read_names(spark, str(dump))
    find = lambda *a, **b: [(r.query, r.tid) for r in T.name_to_taxid(*a, **b).orderBy("query", "place").collect()]
    assert find(["Haloferax volcanii"], nodes, every, merged, cutoff=0.8)[0] == ("Haloferax volcanii", "86")
    assert find(["Haloferax volcanii"], nodes, every, merged, rank_is="strain", cutoff=0.7) == [("Haloferax volcanii", "98")]
    assert find(["formerly Arch"], nodes, every, fuzzy=False) == [("formerly Arch", "20")] and find(["Formerly Arch"], nodes, every, fuzzy=False) == []
    assert find(["Haloferax"], nodes, expand=False, first=2) == [("Haloferax", "75"), ("Haloferax", "86")]
    assert find(["Haloferax"], nodes, rank_is="species", superkingdom="Archaea", expand=False) == [("Haloferax", "86"), ("Haloferax", "87")]
    assert find(["Haloferax"], nodes, superkingdom="Bacteria", expand=False) == [] and find(["Haloferax"], nodes, fuzzy=False, expand=False) == [("Haloferax", "75")]


def test_fuzzy_query_against_difflib(spark):
    import difflib

    from stratakit.plans import adapters
    from stratakit.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    nodes = adapters.nodes(spark, sf).select("tid", "name").collect()
    want = []
    for query in ("realm AFRCA", "genus NATION_1", "species 300505"):
        matcher = difflib.SequenceMatcher()
        matcher.set_seq2(query)
        scored = []
        for r in nodes:
            matcher.set_seq1(r.name)
            if (score := matcher.ratio()) >= 0.8:
                scored.append((-score, r.name, r.tid))
        want += [(query, t, n, -s) for s, n, t in sorted(scored)[:3]]
    got = [(r.query, r.tid, r.name, r.score) for r in QUERIES["name_fuzzy"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
