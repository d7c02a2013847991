"""Taxonomy lookups on ancestor paths.

``walk`` gives each id the array of its ancestors from itself to the root, in blocks of ten joins on the parent id;
every lookup is then an expression on that array, so one walk answers all of them. Ids are strings; ids replaced by a
merge are resolved first (one hop); ids that are not in the taxonomy have a null path and answer ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.session import staged
from stratakit.sources.tables import MAJOR_RANKS

_STEP = 10
RANKS = list(MAJOR_RANKS)


def walk(ids: DataFrame, nodes: DataFrame, merged: DataFrame | None = None, max_depth: int = 256) -> DataFrame:
    """ids: a column ``query``. Adds tid (merged ids resolved), path (array of tid, rank, name; self first) and is_leaf."""
    df = ids
    if merged is not None:
        df = df.join(merged.select(F.col("old").alias("query"), "new"), "query", "left").withColumn("tid", F.coalesce("new", "query")).drop("new")
    else:
        df = df.withColumn("tid", F.col("query"))
    at = nodes.select(F.col("tid").alias("t_"), "parent", F.struct("tid", "rank", "name").alias("node_"))
    df = df.join(at, df.tid == at.t_, "left").withColumns({"path": F.when(F.col("t_").isNotNull(), F.array("node_")), "next_": F.when(F.col("parent") != F.col("tid"), F.col("parent"))}).drop("t_", "parent", "node_")
    steps = 0
    while True:
        for _ in range(_STEP):
            df = df.join(at, df.next_ == at.t_, "left").withColumns({"path": F.when(F.col("t_").isNotNull(), F.array_append("path", F.col("node_"))).otherwise(F.col("path")), "next_": F.when(F.col("parent") != F.col("t_"), F.col("parent"))}).drop("t_", "parent", "node_")
        steps += _STEP
        df, _ = staged(df, "walk")
        if df.where("next_ is not null").isEmpty():
            break
        if steps >= max_depth:
            raise ValueError("the taxonomy is deeper than max_depth or has a cycle")
    inner = nodes.where("parent <> tid").select(F.col("parent").alias("p_")).distinct()
    return df.drop("next_").join(inner, df.tid == inner.p_, "left").withColumn("is_leaf", F.col("p_").isNull() & F.col("path").isNotNull()).drop("p_")


def _known(x: Column, unknown: Column | None = None) -> Column:
    return F.when(F.col("path").isNull(), F.lit("unknown") if unknown is None else unknown).otherwise(x)


def _own(field: str) -> Column:
    return F.element_at("path", 1)[field]


def _above() -> Column:
    return F.slice("path", F.lit(2), F.greatest(F.lit(0), F.size("path") - 1))


def _first(items: Column, field: str, condition) -> Column:
    return F.get(F.filter(items, condition), F.lit(0))[field]


def _is_root(x: Column) -> Column:
    return x["tid"] == "1"


def nearest_major() -> Column:
    """Nearest strict ancestor in a major rank, else 1."""
    return _known(F.coalesce(_first(_above(), "tid", lambda x: ~_is_root(x) & x["rank"].isin(RANKS)), F.lit("1")))


def rank(guess_strain: bool = True) -> Column:
    own = _own("rank")
    near = F.coalesce(_first(_above(), "rank", lambda x: ~_is_root(x) & x["rank"].isin(RANKS)), F.lit(""))
    guessed = F.when(F.col("is_leaf"), "strain").when(near == "species", "species - others").otherwise("others")
    return _known(F.when(_own("tid") == "1", "root").when((own == "no rank") & F.lit(guess_strain), guessed).otherwise(own))


def name() -> Column:
    return _known(_own("name"))


def depth() -> Column:
    """Distance from the root; null for unknown ids."""
    return F.when(F.col("path").isNotNull(), F.size("path") - 1)


def parent(norank: bool = False) -> Column:
    """The parent; ``norank=False`` skips parents without rank. The root's parent is itself."""
    up = _above()
    picked = F.get(up, F.lit(0))["tid"] if norank else _first(up, "tid", lambda x: _is_root(x) | (x["rank"] != "no rank"))
    return _known(F.coalesce(picked, F.lit("1")))


def taxon_type() -> Column:
    """The ancestor just below species; '0' if there is none or it is the taxon itself."""
    at = F.array_position(F.transform(_above(), lambda x: x["rank"] == "species"), True)
    below = F.get("path", (at - 1).cast("int"))["tid"]
    return _known(F.when((at > 1), below).otherwise("0"))


def name_on_rank(target: str) -> Column:
    hit = _first(F.col("path"), "name", lambda x: F.lower(x["rank"]) == target.lower())
    value = F.lit("root") if target == "root" else F.when(F.col("is_leaf"), _own("name")).otherwise(hit) if target == "strain" else hit
    return _known(value)


def taxid_on_rank(target: str) -> Column:
    hit = _first(F.col("path"), "tid", lambda x: F.lower(x["rank"]) == target.lower())
    if target == "root":
        return _known(F.lit("1"))
    return _known(F.when(_own("rank") == "no rank", _own("tid")).otherwise(hit) if target == "strain" else hit)


def _underscored(x: Column, on: bool) -> Column:
    return F.replace(x, F.lit(" "), F.lit("_")) if on else x


def _abbr(r: Column, ranks: dict[str, str] | None = None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in (ranks or MAJOR_RANKS).items() for v in kv])[r], r)


def full_lineage(sep: str = "|", abbreviate: bool = False, underscore: bool = True, ranks: dict[str, str] | None = None) -> Column:
    """All ranks below the root, from the top; empty for unknown ids."""
    items = F.reverse(F.filter("path", lambda x: ~_is_root(x)))
    shown = (lambda r: _abbr(r, ranks)) if abbreviate else (lambda r: r)
    texts = F.transform(items, (lambda x: F.concat(shown(x["rank"]), F.lit("__"), x["name"])) if sep == ";" else (lambda x: F.concat_ws("|", shown(x["rank"]), x["tid"], x["name"])))
    return F.coalesce(_underscored(F.array_join(texts, sep), underscore), F.lit(""))


def link_map() -> Column:
    """{parent: child} along the path; empty for unknown ids."""
    pairs = F.zip_with(_above(), F.slice("path", F.lit(1), F.greatest(F.lit(0), F.size("path") - 1)), lambda up, down: F.struct(up["tid"].alias("key"), down["tid"].alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def lineage_type() -> Column:
    """Struct (taxid, name) of the ancestor just below species, the taxon's group or subtype; null where there is none."""
    tid = taxon_type()
    hit = F.get(F.filter("path", lambda x: x["tid"] == tid), F.lit(0))
    return F.when(F.col("path").isNotNull() & (tid != "0"), F.struct(hit["tid"].alias("taxid"), hit["name"].alias("name")))


def major_lineage(df: DataFrame, underscore: bool = False, guess_type: bool = False, ranks: dict[str, str] | None = None) -> DataFrame:
    """Adds ``lineage``: one struct (rank, taxid, name) for each major rank from superkingdom down; ``guess_type`` adds ``type``.

    Missing ranks above the taxon's own get the name ``<next lower name> - no_<abbr>_rank`` and taxid '0'; ranks below
    it, and any missing rank of a taxon without major rank, are null.
    """
    df = df.withColumns({"rank_": rank(), "own_": _own("name")})
    hits = {r: F.get(F.filter("path", _rank_is(r)), F.lit(0)) for r in RANKS}
    own = lambda r, field: F.when(F.col("rank_") == r, _own(field)).otherwise(hits[r][field])
    df = df.withColumns({f"at_{r}": F.struct(own(r, "tid").alias("taxid"), own(r, "name").alias("name")) for r in RANKS})
    level = F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.col("rank_")).cast("int")
    df = df.withColumn("level_", level)
    last = F.col("own_")
    for k in reversed(range(len(RANKS))):
        r = RANKS[k]
        here = F.col(f"at_{r}")
        fill = (F.col("level_") > 0) & (F.lit(k + 1) <= F.col("level_"))
        label = F.concat(last, F.lit(f" - no_{(ranks or MAJOR_RANKS)[r]}_rank"))
        value = F.when(here["name"].isNotNull(), F.struct(F.lit(r).alias("rank"), here["taxid"].alias("taxid"), here["name"].alias("name"))).when(fill, F.struct(F.lit(r).alias("rank"), F.lit("0").alias("taxid"), label.alias("name")))
        df = df.withColumn(f"m_{r}", value)
        df = df.withColumn(f"last_{r}", F.when(fill, F.col(f"m_{r}")["name"]).otherwise(last))
        last = F.col(f"last_{r}")
    shown = lambda c: c.withField("name", _underscored(c["name"], underscore))
    lineage = F.when(F.col("path").isNotNull(), F.array(*[shown(F.col(f"m_{r}")) for r in RANKS]))
    keep = [c for c in df.columns if not c.startswith(("at_", "m_", "last_")) and c not in ("rank_", "own_", "level_")]
    return df.select(*keep, lineage.alias("lineage"), *([lineage_type().alias("type")] if guess_type else []))


def _rank_is(r: str):
    return lambda x: x["rank"] == r


def lineage_text(sep: str = "|", strain: bool = False, ranks: dict[str, str] | None = None) -> Column:
    """The ``lineage`` column as text; empty for unknown ids."""
    items = F.filter("lineage", lambda x: x["name"].isNotNull() & (F.lit(strain) | (x["rank"] != "strain")))
    texts = F.transform(items, (lambda x: F.concat(_abbr(x["rank"], ranks), F.lit("__"), x["name"])) if sep == ";" else (lambda x: F.concat_ws("|", x["rank"], x["taxid"], x["name"])))
    return F.coalesce(F.array_join(texts, sep), F.lit(""))


def lca(hits: DataFrame, lineages: DataFrame, group: str) -> DataFrame:
    """(group, lca): deepest major rank at which all ``taxid`` of a group have one real id; else 1.

    hits: the group column and taxid; lineages: taxid and ``lineage``. Ids are compared as 64-bit hashes, so the groups
    are aggregated over longs; the id itself is looked up behind that.
    """
    real = lambda k: F.coalesce(F.nullif(F.get("lineage", F.lit(k))["taxid"], F.lit("0")), F.lit("0"))
    keyed = lineages.select("taxid", F.xxhash64("taxid").alias("any_"), *[F.xxhash64(real(k)).alias(f"r{k}") for k in range(len(RANKS))])
    ends = [f(f"r{k}").alias(f"{n}{k}") for k in range(len(RANKS)) for n, f in (("lo", F.min), ("hi", F.max))]
    out = hits.join(keyed, "taxid").groupBy(group).agg(F.min("any_").alias("any_"), *ends)
    none = F.xxhash64(F.lit("0"))
    level = F.coalesce(*[F.when((F.col(f"lo{k}") == F.col(f"hi{k}")) & (F.col(f"lo{k}") != none), F.lit(k)) for k in reversed(range(len(RANKS)))])
    # any one of the group's taxids tells the id at that rank
    named = lineages.select(F.xxhash64("taxid").alias("any_"), "lineage")
    return out.select(group, "any_", level.alias("level_")).join(named, "any_").select(group, F.coalesce(F.get("lineage", F.col("level_"))["taxid"], F.lit("1")).alias("lca"))


def descendants(ids: DataFrame, nodes: DataFrame, target: str | None = None, max_depth: int = 256) -> DataFrame:
    """(query, tid): direct children, or the first nodes of rank ``target`` down each branch."""
    children = nodes.where("parent <> tid").select(F.col("parent").alias("up_"), F.col("tid").alias("down_"), F.col("rank").alias("rank_"))
    step = lambda df: df.select("query", "at_").join(children, F.col("at_") == F.col("up_")).select("query", F.col("down_").alias("at_"), "rank_")
    front = step(ids.select("query", F.col("query").alias("at_")))
    if target is None:
        return front.select("query", F.col("at_").alias("tid"))
    found, (out, _) = None, staged(front, "front")
    for _ in range(max_depth):
        hit = out.where(F.col("rank_") == target).select("query", F.col("at_").alias("tid"))
        found = hit if found is None else found.unionByName(hit)
        rest = out.where(F.col("rank_") != target)
        if rest.isEmpty():
            return found
        out, _ = staged(step(rest), "front")
    raise ValueError("the taxonomy is deeper than max_depth or has a cycle")


def child_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent <> tid").groupBy("parent").agg(F.count("*").alias("children"))


def acc2taxid(accessions: DataFrame, table: DataFrame) -> DataFrame:
    """(acc, taxid): versions are ignored and the first file wins; null where no file has the accession."""
    keyed = accessions.withColumn("accession", F.split("acc", r"\.")[0])
    best = table.join(keyed.select("accession").distinct(), "accession", "left_semi").groupBy("accession").agg(F.min_by("taxid", F.struct("priority", "taxid")).alias("taxid"))
    return keyed.join(best, "accession", "left").select("acc", "taxid")


def _grams(text: Column, n: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))


def names_like(queries: DataFrame, nodes: DataFrame, expand: bool = True, first: int | None = 3) -> DataFrame:
    """(query, tid, name, rn): names equal to the query or, with ``expand``, containing it; first N in order of tid length and tid.

    A name that contains the query has all of its letter triples (pairs or letters, for shorter queries). Each query is
    joined on its rarest one and verified behind the join, so no query meets all names. An empty query finds nothing.
    """
    names = nodes.select("tid", "name")
    if expand:
        asked = queries.select("query").distinct().where("query <> ''").withColumn("size_", F.least(F.lit(3), F.length("query")))
        # one to three sizes
        sizes = [r.size_ for r in asked.select("size_").distinct().collect()]
        grams = F.flatten(F.array(*[F.when(F.length("name") >= n, _grams(F.col("name"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sizes] or [F.array().cast("array<string>")]))
        places = names.select("tid", "name", F.explode(grams).alias("gram_"))
        often = places.groupBy("gram_").agg(F.count("*").alias("often_"))
        parts = asked.select("query", F.size(_grams(F.col("query"), F.col("size_"))).alias("parts_"), F.explode(_grams(F.col("query"), F.col("size_"))).alias("gram_")).join(often, "gram_")
        # a query with a triple that no name has is contained in none
        rarest = parts.groupBy("query", "parts_").agg(F.count("*").alias("known_"), F.min_by("gram_", F.struct("often_", "gram_")).alias("gram_")).where("parts_ = known_")
        found = rarest.select("query", "gram_").join(places, "gram_").where(F.col("name").contains(F.col("query"))).select("query", "tid", "name")
        found = queries.join(found, "query")
    else:
        found = queries.join(names, F.col("query") == F.col("name"))
    w = Window.partitionBy("query").orderBy(F.length("tid"), "tid")
    ranked = found.withColumn("rn", F.row_number().over(w))
    return ranked if first is None else ranked.where(F.col("rn") <= first)


def names_fuzzy(queries: list[str], names: DataFrame, cutoff: float = 0.7, first: int | None = 3) -> DataFrame:
    """(query, tid, name, score): closest names by matching-block ratio, best first, at most ``first`` for each query.

    names: tid, name, e.g. all names of a dump. The few queries go with the task; the ratio is at most
    2 * min / (sum of lengths), which spares most names the comparison.
    """
    asked = sorted(set(queries))

    def score(frames):
        import difflib

        import pandas as pd

        for pdf in frames:
            out = []
            for q in asked:
                matcher = difflib.SequenceMatcher()
                matcher.set_seq2(q)
                for tid, name in zip(pdf.tid, pdf.name, strict=True):
                    if name is None or 2 * min(len(q), len(name)) < cutoff * (len(q) + len(name)):
                        continue
                    matcher.set_seq1(name)
                    if matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff and (r := matcher.ratio()) >= cutoff:
                        out.append((q, tid, name, r))
            yield pd.DataFrame(out, columns=["query", "tid", "name", "score"])

    scored = names.select("tid", "name").mapInPandas(score, "query string, tid string, name string, score double")
    if first is None:
        return scored
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "name", "tid")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first).drop("rn")


def name_to_taxid(queries: list[str], nodes: DataFrame, names: DataFrame | None = None, merged: DataFrame | None = None, rank_is: str | None = None, superkingdom: str | None = None, fuzzy: bool = True, cutoff: float = 0.7, first: int = 3, expand: bool = True) -> DataFrame:
    """(query, tid, name, place): at most ``first`` ids for each name, of one rank and superkingdom if these are given.

    expand: the closest of all ``names`` (tid, name; the nodes' own if None), equal ones alone unless ``fuzzy``; the
    closest ``first`` are found before the filters. Otherwise scientific names that hold the query (``fuzzy``) or equal it.
    """
    spark = nodes.sparkSession
    if expand:
        found = names_fuzzy(queries, nodes if names is None else names, cutoff if fuzzy else 1.0, first)
        order = [F.col("score").desc(), F.col("name"), F.col("tid")]
    else:
        asked = spark.createDataFrame([(q,) for q in sorted(set(queries))], "query string")
        found = names_like(asked, nodes, fuzzy, None).drop("rn")
        order = [F.length("tid"), F.col("tid")]
    if rank_is or superkingdom:
        found, _ = staged(found, "names")
        walked = walk(found.select(F.col("tid").alias("query")).distinct(), nodes, merged)
        facts = walked.select(F.col("query").alias("tid"), rank().alias("rank_"), name_on_rank("superkingdom").alias("top_"))
        found = found.join(facts, "tid")
        if rank_is:
            found = found.where(F.col("rank_") == rank_is)
        if superkingdom:
            found = found.where(F.col("top_") == superkingdom)
    w = Window.partitionBy("query").orderBy(*order)
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= first).select("query", "tid", "name", "place")
