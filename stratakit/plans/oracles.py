"""DuckDB SQL with the meaning of the registered queries, written independently of the DataFrame plans."""

from __future__ import annotations

from stratakit.functions.exprs import complements
from stratakit.plans import adapters as A

LINEAGE_SQL = """
select concat('sk__', r_name, ';p__', case when n_nationkey % 6 = 0 then '' else concat('P', cast(n_nationkey as string)) end, ';c__', n_name, ';s__S', cast(n_nationkey as string)) as lineage
from (select * from nation) n join (select * from region) r on n_regionkey = r_regionkey"""
ACC_SQL = "select distinct concat('P', cast(l_partkey % 5000 as string), case when l_partkey % 2 = 0 then '.1' else '' end) as acc from lineitem"
ACC_TABLE_SQL = """
select concat('P', cast(p_partkey as string)) as accession, cast(p_size as string) as taxid, 0 as priority from part where p_partkey % 3 = 0
union all select concat('P', cast(p_partkey as string)), cast(1000 + p_size as string), 1 from part where p_partkey % 3 <> 1
union all select concat('P', cast(p_partkey as string)), cast(2000 + p_size as string), 2 from part where p_partkey % 2 = 0"""

GTDB_SQL = "select concat('G', cast(n_nationkey as string), chr(9), 'd__', r_name, ';p__P', cast(n_nationkey as string), ';s__S', cast(n_nationkey as string)) as value from (select * from nation) n join (select * from region) r on n_regionkey = r_regionkey"

_ABBR = "case {0} when 'superkingdom' then 'sk' when 'phylum' then 'p' when 'class' then 'c' when 'order' then 'o' when 'family' then 'f' when 'genus' then 'g' when 'species' then 's' when 'strain' then 'n' else {0} end"
_NO = "case {0} when 'superkingdom' then 1 when 'phylum' then 2 when 'class' then 3 when 'order' then 4 when 'family' then 5 when 'genus' then 6 when 'species' then 7 when 'strain' then 8 end"
_MAJOR = "('superkingdom','phylum','class','order','family','genus','species','strain')"
_RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species", "strain")


def _sum_op(op: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+){op}', 1), lambda x: cast(x as bigint))), 0)::bigint"


def _py(x: str) -> str:
    """Python's repr of a value with six decimals at most."""
    return f"case when {x} = 0 then '0.0' when abs({x}) < 1e-4 then printf('%ge-0%d', round_even({x} * case when abs({x}) < 9.5e-6 then 1e6 else 1e5 end, 1), case when abs({x}) < 9.5e-6 then 6 else 5 end) else cast({x} as varchar) end"


def build(match_factor: float, cut) -> dict[str, str]:
    def alignments(mf: float) -> str:
        ok = f"greatest(mapped_len / (rend - rstart + 1), mapped_len / read_len) >= {mf}" if mf > 0 else "true"
        return f"""
        raw as ({A.SAM_SQL}),
        f as (select line_no, value, string_split(value, chr(9)) as f from raw),
        p0 as (select line_no, value, f[1] as qname, cast(f[2] as int) as flag, regexp_replace(rtrim(f[3], '|'), '\\.0$', '') as rname, cast(f[4] as bigint) as pos, f[6] as cigar, f[10] as seq, f[11] as qual,
                      cast(regexp_extract(value, 'AS:i:(\\d+)', 1) as int) as as_score, cast(regexp_extract(value, 'NM:i:(\\d+)', 1) as int) as nm from f),
        p1 as (select *, {_sum_op("M")} as mapped_len, {_sum_op("I")} as ins_len, {_sum_op("D")} as del_len, cast(length(seq) as int) as read_len, string_split(rname, '|') as parts from p0),
        ex as ({A.EXCLUDED_SQL}),
        p2 as (select *, parts[1] as acc, cast(parts[2] as bigint) as rstart, cast(parts[3] as bigint) as rend, parts[4] as taxid, pos as region_start, pos + mapped_len + del_len - 1 as region_end, flag & 2304 = 0 as is_primary from p1),
        aln as (select *, {ok} as valid_match, acc not in (select acc from ex) as valid_acc from p2),
        good as (select * from aln where is_primary and valid_match and valid_acc)"""

    base = alignments(match_factor)
    frag = """
        cov as (select rname, region_start as s, region_end as e, max(region_end) over (partition by rname order by region_start, region_end, line_no rows between unbounded preceding and 1 preceding) as before from good),
        frag as (select g.rname, mb, mr, nm, id, rl, sc from
                 (select rname, sum(region_end - region_start + 1)::bigint as mb, count(*) as mr, sum(nm)::bigint as nm, sum(ins_len + del_len)::bigint as id, sum(read_len)::bigint as rl from good group by rname) g
                 join (select rname, sum(greatest(0, e - greatest(s - 1, coalesce(before, s - 1))))::bigint as sc from cov group by rname) c on g.rname = c.rname)"""
    strain = f"""
        stats as ({A.STATS_SQL}),
        s0 as (select string_split(rname, '|')[4] as taxid, sum(mb)::bigint as total_bp_mapped, sum(mr)::bigint as read_count, sum(nm)::bigint as total_bp_mismatch, sum(id)::bigint as total_bp_indel, sum(rl)::bigint as total_read_len,
                      sum(sc)::bigint as covered_sig_len, sum(cast(string_split(rname, '|')[3] as bigint) - cast(string_split(rname, '|')[2] as bigint) + 1)::bigint as mapped_sig_len from frag group by 1),
        s1 as (select s0.*, db_level, genome_size, coalesce(note, '') as note, total_length as total_sig_len, covered_sig_len / total_length as best_sig_cov, total_bp_mapped / total_length as depth from s0 left join stats on s0.taxid = stats.taxid),
        s2 as (select *, depth * genome_size as genomic_content_est, total_bp_mapped / total_sig_len as a, total_bp_mapped / covered_sig_len as l, 1 - greatest(total_bp_mismatch * 0.995::double / total_bp_mapped, 1e-12) as p,
                      covered_sig_len * greatest(best_sig_cov, 1e-12) as n, 1.959963984540054::double as z from s1),
        s3 as (select *, (covered_sig_len * (l - a) * (l - a) + (total_sig_len - covered_sig_len) * a * a) / total_sig_len as v, (p + z * z / (2 * n)) / (1 + z * z / n) as centre,
                      z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) as hw from s2),
        strain as (select *, coalesce(case when v > 0 then (l - a) / sqrt(v) end, 0) as zscore, round_even(least(1, 1 - greatest(total_bp_mismatch / total_bp_mapped, 1e-12)), 6) as ani_naive, round_even(centre, 6) as ani_ci95,
                          round_even(least(greatest(centre - hw, 0), 1), 6) as ani_low, round_even(least(greatest(centre + hw, 0), 1), 6) as ani_high from s3)"""
    tree = f"""
        nodes as ({A.NODES_SQL}), merged as ({A.MERGED_SQL}), ids as ({A.IDS_SQL}),
        q as (select query, coalesce(new, query) as tid from ids left join merged on old = query),
        up as (select q.query, n.tid, n.parent, n.rank, n.name, 0 as dist from q join nodes n on q.tid = n.tid
               union all select up.query, n.tid, n.parent, n.rank, n.name, up.dist + 1 from up join nodes n on up.parent = n.tid where up.tid <> '1'),
        inner_ as (select distinct parent from nodes where tid <> parent),
        me as (select q.query, up.tid, up.rank as own_rank, up.name, up.tid is not null as known, up.tid is not null and up.tid not in (select parent from inner_) as is_leaf from q left join up on q.query = up.query and up.dist = 0)"""
    near = f"""
        near as (select query, arg_min(tid, dist) as tid, arg_min(rank, dist) as rank from up where dist > 0 and tid <> '1' and rank in {_MAJOR} group by query),
        ranked as (select me.*, near.tid as near_tid, case when not known then 'unknown' when me.tid = '1' then 'root' when own_rank = 'no rank' then case when is_leaf then 'strain' when near.rank = 'species' then 'species - others' else 'others' end else own_rank end as grank
                   from me left join near on me.query = near.query)"""
    places = []
    below = "own.name"
    cols = {}
    for k in range(8, 0, -1):
        r = _RANKS[k - 1]
        abbr = {1: "sk", 2: "p", 3: "c", 4: "o", 5: "f", 6: "g", 7: "s", 8: "n"}[k]
        cols[k] = (r, abbr)
        places.append((k, r, abbr, below))
    steps, prev = [], "l9"
    for k, r, abbr, _ in places:
        steps.append(f"""l{k} as (select b.*, case when h.name is not null then h.name when {k} <= lev then b.last || ' - no_{abbr}_rank' end as n{k}, case when h.name is not null then h.tid when {k} <= lev then '0' end as t{k}
            from (select * from {prev}_) b left join hit h on b.query = h.query and h.k = {k}),
            l{k}_ as (select * exclude (last), case when {k} <= lev then n{k} else last end as last from l{k})""")
        prev = f"l{k}"
    major = f"""{near},
        hit as (select up.query, {_NO.format("case when up.dist = 0 then r.grank else up.rank end")} as k, arg_min(up.tid, up.dist) as tid, arg_min(up.name, up.dist) as name from up join ranked r on up.query = r.query
                where {_NO.format("case when up.dist = 0 then r.grank else up.rank end")} is not null group by 1, 2),
        l9_ as (select query, coalesce({_NO.format("grank")}, 0) as lev, name as last from ranked where known), {", ".join(steps)}"""
    pipe = "concat_ws('|', " + ", ".join(f"case when n{k} is not null then concat('{r}|', t{k}, '|', n{k}) end" for k, r in enumerate(_RANKS, 1)) + ")"
    semi = "concat_ws(';', " + ", ".join(f"case when n{k} is not null then concat('{cols[k][1]}__', n{k}) end" for k in range(1, 8)) + ")"
    levels = " union all ".join(
        f"select s.*, {k} as level_no, '{r}' as level, n{k} as nm_, t{k} as lvl_taxid, {'n' + str(k - 1) if k > 1 else chr(39) + 'root' + chr(39)} as parent_name, {'t' + str(k - 1) if k > 1 else chr(39) + '1' + chr(39)} as parent_taxid from st s" for k, r in enumerate(_RANKS, 1)
    )
    sums = ", ".join(f"sum({c})::bigint as {c}" for c in ("total_bp_mapped", "read_count", "total_bp_mismatch", "total_bp_indel", "total_read_len", "covered_sig_len", "mapped_sig_len", "total_sig_len", "genome_size"))
    said = lambda cond, text: f"case when {cond} then {text} else '' end"
    note = " || ".join([
        "case when note <> '' then note || '; ' else '' end", said("sig_no < level_no", "'Not shown (' || level || '-result could be biased); '"),
        said(f"level = 'strain' and ani_ci95 < {cut.ani_strain}", f"'Filtered out (strain ANI > ' || {_py('ani_ci95')} || '); '"), said(f"level = 'species' and ani_ci95 < {cut.ani_species}", f"'Filtered out (species ANI > ' || {_py('ani_ci95')} || '); '"),
        said(f"best_sig_cov < {cut.min_cov}", f"'Filtered out (minCov > ' || {_py('round_even(best_sig_cov, 6)')} || '); '"), said(f"read_count < {cut.min_reads}", "'Filtered out (minReads > ' || read_count || '); '"),
        said(f"covered_sig_len < {cut.min_len}", "'Filtered out (minLen > ' || covered_sig_len || '); '"), said(f"zscore > {cut.max_zscore}", f"'Filtered out (maxZscore < ' || {_py('round_even(zscore, 6)')} || '); '"),
    ])
    report = f"""{base},{frag},{strain},{tree},{major},
        st as (select strain.*, {", ".join(f"n{k}, t{k}" for k in range(1, 9))} from strain join l1_ on strain.taxid = l1_.query),
        lv as ({levels}),
        rk as (select level_no, level, nm_ as name, case when level = 'strain' then taxid end as own_, arg_min(lvl_taxid, taxid) as taxid, arg_min(parent_name, taxid) as parent_name, arg_min(parent_taxid, taxid) as parent_taxid, {sums},
                      sum(depth) as depth, sum(genomic_content_est) as genomic_content_est, count(*)::bigint as genome_count, max(best_sig_cov) as best_sig_cov, max({_NO.format("db_level")}) as sig_no, max(ani_ci95) as ani_ci95, min(zscore) as zscore,
                      first(ani_naive order by ani_ci95 desc, taxid) as ani_naive, first(ani_low order by ani_ci95 desc, taxid) as ani_low, first(ani_high order by ani_ci95 desc, taxid) as ani_high,
                      array_to_string(list_distinct_ordered, '; ') as note
               from (select *, null as list_distinct_ordered from lv) group by 1, 2, 3, 4)"""
    # notes joined in taxid order without repeats
    report = report.replace("array_to_string(list_distinct_ordered, '; ') as note", "list(note order by taxid) as notes").replace("from (select *, null as list_distinct_ordered from lv)", "from lv")
    report += f""",
        rj as (select * exclude (notes), array_to_string(list_filter(notes, lambda x, i: list_position(notes, x) = i), '; ') as note from rk),
        tot as (select sum(depth) as total from strain),
        full_ as (select level, name, taxid, read_count, total_bp_mapped, ani_ci95, covered_sig_len, best_sig_cov, depth, depth / (select total from tot) as rel_abundance, parent_name, parent_taxid, total_read_len,
                        (total_bp_mapped - total_bp_mismatch) / total_read_len as read_idt, total_bp_mismatch, total_bp_indel, ani_naive, '[' || {_py("ani_low")} || '-' || {_py("ani_high")} || ']' as ani_ci95_lh, covered_sig_len / total_sig_len as sig_cov,
                        mapped_sig_len, total_sig_len, total_bp_mapped / covered_sig_len as covered_sig_depth, covered_sig_len / mapped_sig_len as covered_mapped_sig_cov, zscore, genomic_content_est, depth as abundance,
                        depth / sum(depth) over (partition by level) as rel_abundance_depth, genomic_content_est / sum(genomic_content_est) over (partition by level) as rel_abundance_gc,
                        case sig_no {" ".join(f"when {k} then '{r}'" for k, r in enumerate(_RANKS, 1))} end as sig_level, genome_count, genome_size, {note} as note from rj)"""
    columns = ("level", "name", "taxid", "read_count", "total_bp_mapped", "ani_ci95", "covered_sig_len", "best_sig_cov", "depth", "rel_abundance", "parent_name", "parent_taxid", "total_read_len", "read_idt", "total_bp_mismatch", "total_bp_indel", "ani_naive", "ani_ci95_lh", "sig_cov", "mapped_sig_len", "total_sig_len", "covered_sig_depth", "covered_mapped_sig_cov", "zscore", "genomic_content_est", "abundance", "rel_abundance_depth", "rel_abundance_gc", "sig_level", "genome_count", "genome_size", "note")
    doubles = {"ani_ci95", "best_sig_cov", "depth", "rel_abundance", "read_idt", "ani_naive", "sig_cov", "covered_sig_depth", "covered_mapped_sig_cov", "zscore", "genomic_content_est", "abundance", "rel_abundance_depth", "rel_abundance_gc"}
    pick = lambda names: ", ".join(f"round({c}, {3 if c == 'genomic_content_est' else 9}) as {c}" if c in doubles else c for c in names)
    shown = "where note not like '%Filtered out%' and note not like '%Not shown%'"
    table = complements()
    codes, pairs = "".join(table), "".join(table.values())
    r6 = lambda *names: ", ".join(f"round({c}, {3 if c == 'genomic_content_est' else 9}) as {c}" for c in names)
    fix = "regexp_replace(name, ' ', '_', 'g')"
    head = "qname || case when flag & 64 > 0 then '.1' when flag & 128 > 0 then '.2' else '' end || '|' || rname || ':' || region_start || '..' || region_end || ' LEVEL=' || level || ' NAME=' || tax_name || ' TAXID=' || tax"
    oseq = f"case when flag & 16 > 0 then translate(reverse(seq), '{codes}', '{pairs}') else seq end"
    oqual = "case when flag & 16 > 0 then reverse(qual) else qual end"
    reads = f"""{report},
        tx as (select distinct taxid as tax, level, {fix} as tax_name from full_ where note not like '%Filtered out%' and taxid <> '0'),
        hits as (select g.*, tx.tax, tx.level, tx.tax_name, row_number() over (partition by tx.tax order by g.line_no) as rn from good g join up on up.query = g.taxid join tx on tx.tax = up.tid)"""
    with_ = "with recursive "
    text = lambda x: f"coalesce({x}, '')"
    out = {
        "sam_parse": f"{with_}{base} select line_no, qname, flag, rname, pos, cigar, as_score, nm, mapped_len, ins_len, del_len, read_len, region_start, region_end, acc, rstart, rend, taxid, is_primary, valid_match, valid_acc from aln",
        "alignment_counters": f"{with_}{base} select count(*) as alignments, count(*) filter (not valid_match) as invalid_match, count(*) filter (not valid_acc) as excluded_acc, 0::bigint as malformed, count(*) filter (is_primary and valid_match and valid_acc) as mapped_reads from aln",
        "match_filter": f"{with_}{alignments(0.06)} select line_no, rname, round(greatest(mapped_len / (rend - rstart + 1), mapped_len / read_len), 9) as identity from aln where is_primary and valid_match",
        "excluded_anti": f"{with_}{base} select acc, count(*) as lines from aln where valid_acc group by acc",
        "best_hit": f"{with_}{alignments(0)}, b as (select case when flag & 128 > 0 then qname || '/2' else qname end as qkey, line_no, as_score, rname from aln where is_primary) select * from b qualify row_number() over (partition by qkey order by as_score desc, line_no) = 1",
        "region_merge": f"""{with_}{base}, o as (select rname, region_start as s, region_end as e, max(region_end) over (partition by rname order by region_start, region_end, line_no rows between unbounded preceding and 1 preceding) as before, line_no from good),
            i as (select *, sum(case when before is null or s > before + 1 then 1 else 0 end) over (partition by rname order by s, e, line_no) as k from o) select rname, min(s) as "start", max(e) as "end" from i group by rname, k""",
        "covered_length": f"{with_}{base},{frag} select rname, sc from frag",
        "fragment_agg": f"{with_}{base},{frag} select * from frag",
        "strain_agg": f"{with_}{base},{frag},{strain} select taxid, total_bp_mapped, read_count, total_bp_mismatch, total_bp_indel, total_read_len, covered_sig_len, mapped_sig_len, db_level, genome_size, note, total_sig_len, {r6('best_sig_cov', 'depth', 'zscore', 'genomic_content_est')} from strain",
        "zscore": f"{with_}{base},{frag},{strain} select taxid, round(zscore, 9) as zscore from strain",
        "ani_interval": f"{with_}{base},{frag},{strain} select taxid, ani_naive, ani_ci95, '[' || {_py('ani_low')} || '-' || {_py('ani_high')} || ']' as ani_ci95_lh from strain",
        "rank_report": f"{with_}{report} select {pick(columns)} from full_",
        "summary_report": f"{with_}{report} select {pick(columns[:10])} from full_ {shown}",
        "rank_rollup": f"{with_}{report} select level, name, taxid, read_count, total_bp_mapped, covered_sig_len, genome_count, genome_size from full_",
        "relative_abundance": f"{with_}{report} select level, name, {r6('rel_abundance', 'rel_abundance_depth', 'rel_abundance_gc')} from full_",
        "filter_notes": f"{with_}{report} select level, name, note from full_",
        "lineage_table": f"{with_}{report} select f.taxid, round(f.abundance, 6) as abundance, concat_ws(chr(9), n1, n2, n3, n4, n5, n6, n7, n8) as names from full_ f join l1_ on f.taxid = l1_.query {shown} and level = 'strain'",
        "taxon_lookup": f"""{with_}{tree},{near},
            par as (select query, arg_min(tid, dist) filter (tid = '1' or rank <> 'no rank') as parent, arg_min(tid, dist) as parent_any from up where dist > 0 group by query),
            sp as (select query, min(dist) as d from up where dist > 0 and rank = 'species' group by query),
            ty as (select sp.query, up.tid from sp join up on sp.query = up.query and up.dist = sp.d - 1 where sp.d > 1),
            dep as (select query, max(dist) as depth from up group by query)
            select r.query, grank as rank, case when known then own_rank else 'unknown' end as rank_as_is, case when known then r.name else 'unknown' end as name, depth, case when known then coalesce(par.parent, '1') else 'unknown' end as parent,
                   case when known then coalesce(par.parent_any, '1') else 'unknown' end as parent_any, case when known then coalesce(ty.tid, '0') else 'unknown' end as taxon_type, case when known then coalesce(near_tid, '1') else 'unknown' end as nearest_major, is_leaf
            from ranked r left join par on r.query = par.query left join ty on r.query = ty.query left join dep on r.query = dep.query""",
        "taxon_on_rank": f"""{with_}{tree}, onr as (select query, {", ".join(f"arg_min({c}, dist) filter (rank = '{r}') as {r}_{a}" for r in ("phylum", "order", "species", "strain") for a, c in (("name", "name"), ("taxid", "tid")))} from up group by query)
            select me.query, {", ".join(f"case when known then {r}_{a} else 'unknown' end as {r}_{a}" for r in ("phylum", "order", "species") for a in ("name", "taxid"))},
                   case when not known then 'unknown' when is_leaf then name else strain_name end as strain_name, case when not known then 'unknown' when own_rank = 'no rank' then tid else strain_taxid end as strain_taxid from me left join onr on me.query = onr.query""",
        "full_lineage": f"""{with_}{tree}, t as (select query, string_agg(rank || '|' || tid || '|' || name, '|' order by dist desc) as a, string_agg({_ABBR.format("rank")} || '__' || name, ';' order by dist desc) as b from up where tid <> '1' group by query)
            select ids.query, replace({text("a")}, ' ', '_') as lineage, {text("b")} as lineage_abbr from ids left join t on ids.query = t.query""",
        "lineage_links": f"{with_}{tree} select u.query, u.parent, u.tid as child from up u where u.tid <> '1'",
        "major_lineage": f"{with_}{tree},{major} select ids.query, coalesce({pipe}, '') as lineage, coalesce({semi}, '') as lineage_abbr from ids left join l1_ on ids.query = l1_.query",
        "lowest_common_ancestor": f"""{with_}{alignments(0)},{tree},{major}, r as (select distinct qname, taxid from aln), j as (select r.qname, {", ".join(f"coalesce(t{k}, '0') as t{k}" for k in range(1, 9))} from r join l1_ on r.taxid = l1_.query)
            select qname, coalesce({", ".join(f"case when min(t{k}) = max(t{k}) and min(t{k}) <> '0' then min(t{k}) end" for k in range(8, 0, -1))}, '1') as lca from j group by qname""",
        "descendants": f"""{with_}nodes as ({A.NODES_SQL}), dn as (select n.tid as query, c.tid, c.rank from nodes n join nodes c on c.parent = n.tid and c.tid <> c.parent where n.rank in ('superkingdom', 'class')
            union all select dn.query, c.tid, c.rank from dn join nodes c on c.parent = dn.tid where dn.rank <> 'species') select query, tid from dn where rank = 'species'""",
        "children": f"with nodes as ({A.NODES_SQL}) select parent as query, tid from nodes where tid <> parent",
        "child_counts": f"with nodes as ({A.NODES_SQL}) select parent, count(*) as children from nodes where tid <> parent group by parent",
        "merged_overlay": f"with nodes as ({A.NODES_SQL}) select tid, parent, rank, case when rank in ('genus', 'phylum') then name || ' (custom)' else name end as name from nodes",
        "lineage_loader": f"""with l as ({LINEAGE_SQL}), x as (select n_name, n_nationkey, r_name, case when n_nationkey % 6 = 0 then r_name || ' - no_p_rank' else 'P' || n_nationkey end as p from nation join region on n_regionkey = r_regionkey)
            select '1' as tid, '1' as parent, 'root' as rank, 'root' as name union select r_name, '1', 'superkingdom', r_name from x union select p, r_name, 'phylum', p from x
            union select n_name, p, 'class', n_name from x union select 'S' || n_nationkey, n_name, 'species', 'S' || n_nationkey from x""",
        "acc2taxid": f"with a as ({ACC_SQL}), t as ({ACC_TABLE_SQL}), b as (select accession, taxid from t qualify row_number() over (partition by accession order by priority, taxid) = 1) select acc, taxid from a left join b on string_split(acc, '.')[1] = accession",
        "name_lookup": f"with nodes as ({A.NODES_SQL}), w as (select 'NATION_' || n_nationkey as query from nation) select query, tid, name, row_number() over (partition by query order by length(tid), tid)::int as rn from w join nodes on contains(name, query) qualify rn <= 3",
        "extract_reads": f"{with_}{reads} select line_no, tax, '>' || {head} || chr(10) || {oseq} as record from hits where rn <= 20",
        "extract_reads_fastq": f"{with_}{reads} select line_no, tax, '@' || {head} || chr(10) || {oseq} || chr(10) || '+' || chr(10) || {oqual} as record from hits where rn <= 20",
        "text_search": f"with raw as ({A.SAM_SQL}), f as (select line_no, value, string_split(value, chr(9)) as f from raw) select line_no, f[1] as qname, f[2] as flag, f[3] as rname, f[6] as cigar, f[10] as seq, f[11] as qual from f where regexp_matches(value, '(\\|101\\b|\\|10[35]\\b)')",
        "reverse_complement": f"{with_}{alignments(0)} select line_no, translate(reverse(seq), '{codes}', '{pairs}') as revcomp, reverse(qual) as qual_reversed, case when flag & 64 > 0 then '.1' when flag & 128 > 0 then '.2' else '' end as mate, case when flag & 128 > 0 then qname || '/2' else qname end as qkey from aln",
        "distinct_refs": f"with raw as ({A.SAM_SQL}), n as (select distinct string_split(value, chr(9))[3] as rname from raw) select rname, try_cast(string_split(rname, '|')[3] as bigint) - try_cast(string_split(rname, '|')[2] as bigint) + 1 as length from n",
        "coordinate_sort": f"with raw as ({A.SAM_SQL}), f as (select line_no, string_split(value, chr(9)) as f from raw), r as (select line_no, f[1] as qname, f[3] as rname, cast(f[4] as bigint) as pos from f) select qname, rname, pos, row_number() over (order by rname, pos, line_no)::bigint as place from r",
        "sam_file": f"{with_}{base} select qname, flag, rname, pos, as_score, nm, mapped_len, read_len, region_start, region_end, is_primary, valid_match, false as malformed from aln",
        "stats_file": f"with s as ({A.STATS_SQL}) select db_level, taxid, total_length, case when id % 3 = 0 then 0 else genome_size end as genome_size, note from s",
        "list_file": "select distinct 'P' || (p_partkey % 200) as acc from part where p_partkey % 5 <> 0",
        "dump_files": f"with n as ({A.NODES_SQL}), m as ({A.MERGED_SQL}) select tid, parent, rank, name from n union all select old, new, 'merged', '' from m",
        "taxonomy_file": f"with n as ({A.NODES_SQL}) select tid, parent, rank, name from n",
        "gtdb_file": """with x as (select r_name, 'P' || n_nationkey as p, 'S' || n_nationkey as s, 'G' || n_nationkey as g from nation join region on n_regionkey = r_regionkey)
            select '1' as tid, '1' as parent, 'root' as rank, 'root' as name union select r_name, '1', 'superkingdom', r_name from x union select p, r_name, 'phylum', p from x union select s, p, 'species', s from x union select g, s, 'strain', g from x""",
        "acc2taxid_files": f"select accession, taxid, priority::int as priority from ({ACC_TABLE_SQL})",
        "extract_file": f"{with_}{reads}, kept as (select *, min(line_no) over (partition by tax) as first_ from hits where rn <= 20) select '>' || {head} as head, row_number() over (order by first_, tax, line_no)::bigint as place from kept",
        "report_order": f"{with_}{report} select level, name, taxid, row_number() over (order by {_NO.format('level')}, round(abundance, 9) desc, name, taxid)::int as place from full_",
        "lineage_types": f"""{with_}{tree}, sp as (select query, min(dist) as d from up where dist > 0 and rank = 'species' group by query)
            select sp.query, up.tid as type_taxid, up.name as type_name from sp join up on sp.query = up.query and up.dist = sp.d - 1 where sp.d > 1""",
        "name_filters": f"""{with_}{tree}, w as (select 'NATION_' || unnest(range(25)) as query)
            select w.query, n.tid, n.name, row_number() over (partition by w.query order by length(n.tid), n.tid)::int as place from w join nodes n on contains(n.name, w.query)
            join up s on s.query = n.tid and s.rank = 'superkingdom' and s.name = 'realm ASIA' where n.rank = 'family' qualify place <= 2""",
        "last_row_wins": "select cast(o_custkey as string) as tid, o_orderpriority as name from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1",
    }
    return out
