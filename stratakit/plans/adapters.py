"""Views that turn the star-schema tables into alignments, statistics and a taxonomy, as SQL that two engines read alike.

All values come from integers, so results agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEN = "(cast(floor(l_quantity) as int) + 20 + l_linenumber % 2 + l_linenumber % 4)"
_FLAG = "case (l_orderkey * 7 + l_linenumber) % 13 when 0 then 16 when 1 then 64 when 2 then 128 when 3 then 256 when 4 then 2048 when 5 then 80 else 0 end"
_D, _I, _S = "((l_orderkey + l_linenumber) % 3)", "(l_linenumber % 2)", "(l_linenumber % 4)"

#: line_no and value (a SAM line of 14 fields) for each line item.
SAM_SQL = f"""
select ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as line_no,
       concat('r', cast(l_orderkey as string), chr(9), cast({_FLAG} as string), chr(9),
              'P', cast(l_partkey % 20 as string), '|1|1000|', cast(l_suppkey + 100 as string), case when l_linenumber = 3 then '|' when l_linenumber = 4 then '.0' else '' end, chr(9),
              cast(1 + (l_orderkey * 31 + l_linenumber * 17) % 800 as string), chr(9), '60', chr(9),
              case when {_S} > 0 then concat(cast({_S} as string), 'S') else '' end, cast(cast(floor(l_quantity) as int) + 10 as string), 'M',
              case when {_D} > 0 then concat(cast({_D} as string), 'D') else '' end, case when {_I} > 0 then concat(cast({_I} as string), 'I') else '' end, '10M', chr(9),
              '*', chr(9), '0', chr(9), '0', chr(9),
              substr(repeat('ACGTTGCAGNRYKAACCTG', 9), cast(1 + (l_orderkey + l_linenumber) % 40 as int), {_LEN}), chr(9), substr(repeat('HGFIJKEABC', 16), cast(1 + l_orderkey % 7 as int), {_LEN}), chr(9),
              'NM:i:', cast((l_orderkey + l_partkey) % 4 + {_D} + {_I} as string), chr(9), 'ms:i:0', chr(9), 'AS:i:', cast((l_suppkey + l_partkey) % 50 as string)) as value
from lineitem"""

STATS_SQL = """
select s_suppkey + 100 as id, cast(s_suppkey + 100 as string) as taxid, case when s_suppkey % 17 = 0 then 'species' else 'strain' end as db_level,
       cast(20000 + (s_suppkey % 7) * 1000 as bigint) as total_length, cast(1000000 + s_suppkey * 1000 as bigint) as genome_size,
       case when s_suppkey % 25 = 0 then 'plasmid' when s_suppkey % 10 = 3 then 'draft' else '' end as note
from supplier"""

EXCLUDED_SQL = "select distinct concat('P', cast(p_partkey % 20 as string)) as acc from part where p_size % 7 = 0 and p_partkey % 20 < 4"

_SPECIES = "300000 + s_nationkey * 100 + s_suppkey % 7"
#: tid, parent, rank, name. One nation in five has no order (a gap below class), one supplier in three a node without rank.
NODES_SQL = f"""
select '1' as tid, '1' as parent, 'root' as rank, 'root' as name
union all select cast(900000 + r_regionkey as string), '1', 'superkingdom', concat('realm ', r_name) from region
union all select cast(800000 + n_nationkey as string), cast(900000 + n_regionkey as string), 'phylum', concat('phylum ', n_name) from nation
union all select cast(700000 + n_nationkey as string), cast(800000 + n_nationkey as string), 'class', concat('class ', n_name) from nation
union all select cast(600000 + n_nationkey as string), cast(700000 + n_nationkey as string), 'order', concat('order ', n_name) from nation where n_nationkey % 5 <> 0
union all select cast(500000 + n_nationkey as string), cast(case when n_nationkey % 5 = 0 then 700000 else 600000 end + n_nationkey as string), 'family', concat('family ', n_name) from nation
union all select cast(400000 + n_nationkey as string), cast(500000 + n_nationkey as string), 'genus', concat('genus ', n_name) from nation
union all select distinct cast({_SPECIES} as string), cast(400000 + s_nationkey as string), 'species', concat('species ', cast({_SPECIES} as string)) from supplier
union all select cast(200000 + s_suppkey as string), cast({_SPECIES} as string), 'no rank', concat('group ', cast(s_suppkey as string)) from supplier where s_suppkey % 3 = 0
union all select cast(s_suppkey + 100 as string), case when s_suppkey % 3 = 0 then cast(200000 + s_suppkey as string) else cast({_SPECIES} as string) end,
       case when s_suppkey % 2 = 0 then 'no rank' else 'strain' end, concat('strain ', s_name) from supplier"""

MERGED_SQL = "select cast(1000000 + s_suppkey as string) as old, cast(s_suppkey + 100 as string) as new from supplier where s_suppkey % 4 = 0"

#: Every id of the taxonomy, the merged ones, and one that is unknown.
IDS_SQL = f"select tid as query from ({NODES_SQL}) union all select old from ({MERGED_SQL}) union all select '999999999'"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables in ``sf_dir``."""
    names = [n for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if n in sql]
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    for n in sorted(names, key=len, reverse=True):
        sql = _named(sql, n)
    return spark.sql(sql, **{f"t_{n}": df for n, df in frames.items()})


def _named(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\bfrom {name}\b", f"from {{t_{name}}}", sql)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, NODES_SQL)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments, spread over the cluster: a table of one row group would be made and parsed by one task."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    parts = spark.sparkContext.defaultParallelism
    if items.rdd.getNumPartitions() < 2 * parts:
        items = items.repartition(parts, "l_orderkey")
    return spark.sql(_named(SAM_SQL, "lineitem"), t_lineitem=items).select(F.col("line_no").cast("long").alias("line_no"), "value")
