"""Matching tables derived from the given ones, in SQL for either engine.

Contigs are documents' letters folded on four bases, spacers are cut from them at places set by ids, so the truth is known.
Documents of under 61 letters give no spacer, as the places are drawn modulo the length less 60. Jobs and keys of intervals grow with their tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.functions.sequence import fold_letters
from protospark.operators.cube import RegionCube, region_cube
from protospark.session import cut
from protospark.sources.blocks import BlockedSequences, store_blocks

_FOLD = "'abcdefghijklmnopqrstuvwxyz','ACGTCAGTTGCAGATCCTAGACGTTC'"
#: name: (SQL, what it reads); {S} string type, {E} the quoted column end, {G} the flag of a global replace
VIEWS = {
    "fx_contigs": (f"select concat('ct_',cast(doc_id as {{S}})) contig_id, doc_id, seq, cast(length(seq) as bigint) length from (select doc_id, translate(regexp_replace(lower(text),'[^a-z]',''{{G}}), {_FOLD}) seq from documents) t where length(seq) > 0", ["documents"]),
    "fx_plan": ("select concat('sp_',cast(c.doc_id as {S}),'_',cast(j.j as {S})) spacer_id, c.contig_id, c.doc_id, j.j as j, (c.doc_id*37+j.j*101) % (c.length-60) as start0, 25+(c.doc_id+j.j)%16 as len, (c.doc_id+j.j)%2=1 as strand, c.seq as cseq from fx_contigs c cross join (select 0 j union all select 1 union all select 2) j where c.length > 60", ["fx_contigs"]),
    "fx_truth": ("select spacer_id, contig_id, start0 as start, start0+len as {E}, strand, cast(case when j=1 then 1 else 0 end as int) mismatches from fx_plan where j<2", ["fx_plan"]),
    "fx_spacers": ("select spacer_id, case when strand then reverse(translate(r,'ACGT','TGCA')) else r end as seq from (select spacer_id, strand, case when j=1 then concat(substring(q,1,9),translate(substring(q,10,1),'ACGT','CGTA'),substring(q,11)) else q end r from (select spacer_id, strand, j, substring(cseq,cast(start0+1 as int),cast(len as int)) q from fx_plan) a) b", ["fx_plan"]),
    "fx_hits": ("select p.spacer_id, p.contig_id, cast(p.len as int) spacer_length, p.strand, greatest(p.start0+((p.doc_id+t.t)%3)-1,0) as start, greatest(p.start0+((p.doc_id+t.t)%3)-1,0)+p.len as {E}, cast((p.doc_id+p.j+t.t)%4 as int) mismatches, concat('tool_',cast(t.t as {S})) tool from fx_plan p cross join (select 0 t union all select 1 union all select 2 union all select 3 union all select 4) t where (p.doc_id*7+p.j*3+t.t*11)%10<7 union all select p.spacer_id, p.contig_id, cast(p.len as int), p.strand, p.start0+12, p.start0+12+p.len, 5, concat('tool_',cast(t.t as {S})) from fx_plan p cross join (select 1 t union all select 3) t where (p.doc_id+p.j+t.t)%5=0", ["fx_plan"]),
    "fx_intervals": ("select concat('sp_',cast(cast(floor(l_partkey/40) as bigint) as {S})) spacer_id, concat('ct_',cast(l_suppkey%10 as {S})) contig_id, l_returnflag='R' as strand, (l_orderkey*13+l_linenumber*7)%20000 as start, (l_orderkey*13+l_linenumber*7)%20000+25+l_linenumber*2 as {E}, cast(l_linenumber%6 as int) mismatches, concat('tool_',cast(cast(l_quantity as bigint)%5 as {S})) tool, cast(l_suppkey%3 as bigint) fraction from lineitem", ["lineitem"]),
    "fx_catalog": ("select concat('ct_',cast(p_partkey as {S})) seqid, case when p_partkey%17=0 then null else concat('class_',cast(p_partkey%7 as {S})) end as class, cast(1001+(p_partkey*7919)%90000 as bigint) length, cast((p_partkey*31)%1000 as double)/1000 gc, p_size%3<>0 hq, concat('r__Duplodnaviria;k__;p__',p_type,';c__class_',cast(p_partkey%7 as {S}),';o__',p_brand,';f__;g__;s__') lineage from part", ["part"]),
    "fx_accounting": ("select concat(cast(1000+cast(floor(event_id/2) as bigint) as {S}),case when event_id%2=1 then '.batch' else '' end) JobID, concat('tool_',cast(user_id%5 as {S}),case when event_id%9=0 then '_long' else '' end) JobName, case event_type when 'error' then 'FAILED' when 'signup' then 'TIMEOUT' when 'click' then 'CANCELLED by 7' else 'COMPLETED' end State, '0:0' ExitCode, cast(1+user_id%64 as int) AllocCPUS, concat(case when event_id%10=0 then '1-' else '' end, lpad(cast(event_id%24 as {S}),2,'0'),':', lpad(cast(event_id%60 as {S}),2,'0'),':',lpad(cast((event_id*7)%60 as {S}),2,'0')) Elapsed, concat(lpad(cast((event_id*5)%24 as {S}),2,'0'),':',lpad(cast((event_id*3)%60 as {S}),2,'0'),':00') TotalCPU, concat(cast(1000+(event_id*977)%9000000 as {S}),'K') MaxRSS, '250G' ReqMem from events", ["events"]),
}
#: Derived by folding every text: written once in an application for each folder of tables, then read by all views and queries.
_WRITTEN = ("fx_contigs",)
_at: dict[tuple[str, str, str], DataFrame] = {}
_blocks: dict[tuple[str, str, str], BlockedSequences] = {}
_cubes: dict[tuple[str, str, str], RegionCube] = {}
_SPARK, _DUCK = {"S": "string", "E": "`end`", "G": ""}, {"S": "varchar", "E": '"end"', "G": ",'g'"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | BlockedSequences | RegionCube:
    """A derived table as a DataFrame; ``fx_blocks`` are the contigs in blocks, ``fx_cube`` the intervals' regions by tools, each stored once in an application."""
    if name == "fx_blocks":
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _blocks:
            _blocks[key] = store_blocks(view(spark, sf_dir, "fx_contigs"), size=1 << 12, overlap=1 << 7, length="length")
        return _blocks[key]
    if name == "fx_cube":
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _cubes:
            _cubes[key] = region_cube(view(spark, sf_dir, "fx_intervals"), dataset="fraction")
        return _cubes[key]
    if name in _WRITTEN:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _at:
            _at[key] = cut(_derived(spark, sf_dir, name))
        return _at[key]
    return _derived(spark, sf_dir, name)


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "fx_contigs":  # as its SQL, but letters are folded in numpy: the regular expression took most of the time
        d = fold_letters(view(spark, sf_dir, "documents").select("doc_id", "text"), "text", "seq", *(x.strip("'") for x in _FOLD.split(",")))
        return d.where("length(seq) > 0").select(F.concat(F.lit("ct_"), F.col("doc_id").cast("string")).alias("contig_id"), "doc_id", "seq", F.length("seq").cast("long").alias("length"))
    sql, needs = VIEWS[name]
    sql = sql.format(**_SPARK)
    for n in needs:
        sql = sql.replace(f" {n} ", f" {{{n}}} ") if f" {n} " in sql else sql.replace(f" {n}", f" {{{n}}}")
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs})


def with_views(sql: str) -> str:
    """DuckDB SQL that starts with the views it names (and theirs)."""
    used: list[str] = []

    def need(text: str) -> None:
        for n, (body, _) in VIEWS.items():
            if n in text and n not in used:
                need(body)
                used.append(n)

    need(sql)
    if not used:
        return sql
    head = ", ".join(f"{n} as materialized ({VIEWS[n][0].format(**_DUCK)})" for n in used)
    return f"with {head}, {sql.strip()[5:]}" if sql.strip().lower().startswith("with ") else f"with {head} {sql}"
