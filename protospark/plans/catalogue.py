"""Every query of the matching library by name, with its SQL: operators over the derived views, whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from protospark.functions import distance as dist, sequence as seq
from protospark.operators import agreement as ag, catalog as cat, classify as cl, joins as jo, resources as rs, sampling as sm, search
from protospark.plans.views import view, with_views
from protospark.session import own_dir
from protospark.sources import readers as rd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of derived views as a query."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


_DUR = lambda c: f"(coalesce(nullif(regexp_extract({c}, '^(?:(\\d+)-)?(\\d+):(\\d+):(\\d+)$', 1), '')::bigint, 0) * 86400 + regexp_extract({c}, '(\\d+):(\\d+):(\\d+)$', 1)::bigint * 3600 + regexp_extract({c}, '(\\d+):(\\d+):(\\d+)$', 2)::bigint * 60 + regexp_extract({c}, '(\\d+):(\\d+):(\\d+)$', 3)::bigint)"
HK = 'spacer_id, contig_id, start, "end", strand'
GK = "spacer_id, contig_id, strand"

# sequences
_cnt = lambda s, b: f"(length({s}) - length(replace(replace({s}, '{b}', ''), '{b.lower()}', '')))"
_frac = lambda s, b: f"{_cnt(s, b)}::double / nullif(length({s}), 0)"
_COMP = ", ".join(f"{_frac('seq', b)} {b.lower()}" for b in "ATCGN") + f", ({_cnt('seq', 'G')} + {_cnt('seq', 'C')})::double / nullif(length(seq), 0) gc"


@query("base_composition", "fx_spacers", sql=f"select spacer_id, length(seq)::int length, {_COMP}, {_cnt('seq', 'N')} > 0 has_n from fx_spacers")
def _(s):
    return seq.base_composition(s).select("spacer_id", "length", "a", "t", "c", "g", "n", "gc", "has_n")


@query("reverse_complement", "fx_contigs", sql="select contig_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) rc from fx_contigs")
def _(c):
    return c.select("contig_id", F.md5(seq.revcomp("seq").cast("binary")).alias("rc"))


_ENT = "with l as (select spacer_id, unnest(string_split(seq, '')) ch, length(seq) n from fx_spacers), p as (select spacer_id, ch, count(*)::double / any_value(n) p from l group by 1, 2), "
_LCC = "sum(case when ch in ('A','C','G','T') then -p * log2(p) / 2 else 0 end)"


@query("complexity", "fx_spacers", sql=_ENT + f"x as (select spacer_id, -sum(p * log2(p)) e, {_LCC} l from p group by 1) select spacer_id, round(e, 6) entropy, round(l, 6) lcc from x")
def _(s):
    return s.select("spacer_id", F.round(seq.shannon_entropy("seq"), 6).alias("entropy"), F.round(seq.lcc("seq"), 6).alias("lcc"))


@query("lcc_windows", "fx_spacers", sql="with w as (select spacer_id, i, substring(seq, i::int, 10) s from fx_spacers, unnest(range(1, length(seq) - 8)) r(i)), l as (select spacer_id, i, unnest(string_split(s, '')) ch from w), p as (select spacer_id, i, count(*) / 10.0::double p from l group by spacer_id, i, ch), x as (select spacer_id, i, -sum(p * log2(p) / 2) v from p group by 1, 2) select spacer_id, count(*) n, round(sum(v), 5) total from x group by 1")
def _(s):
    w = s.withColumn("w", seq.lcc_windows("seq", 10))
    return w.select("spacer_id", F.size("w").cast("long").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("lcc_windows_long", "fx_blocks", sql="with p as (select contig_id, length, unnest(string_split(seq, '')) ch, unnest(range(1, length + 1)) i from fx_contigs), w as (select contig_id, length, i, " + ", ".join(f"sum((ch = '{b}')::int) over x / 50.0::double {b.lower()}" for b in "ACGT") + " from p window x as (partition by contig_id order by i rows between current row and 49 following)), v as (select contig_id, -(" + " + ".join(f"case when {b} > 0 then {b} * log2({b}) / 2 else 0 end" for b in "acgt") + ") v from w where i <= length - 49) select contig_id, count(*)::int n, round(min(v), 6) least from v group by 1")
def _(c):
    w = seq.lcc_windows_blocks(c, 50).select("contig_id", F.size("lcc").alias("n"), F.array_min("lcc").alias("least"))
    return w.groupBy("contig_id").agg(F.sum("n").cast("int").alias("n"), F.round(F.min("least"), 6).alias("least"))


@query("kmer_counts", "fx_spacers", sql="with w as (select spacer_id, substring(seq, i::int, 4) kmer from fx_spacers, unnest(range(1, length(seq) - 2)) r(i)), c as (select spacer_id, kmer, count(*) n from w group by 1, 2) select *, n::double / sum(n) over (partition by spacer_id) share from c")
def _(s):
    return seq.kmer_counts(s, 4, relative=True, id="spacer_id")


@query("kmer_counts_alphabet", "documents", sql="with c as (select doc_id, string_split(upper(text), '') c from documents), w as (select doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) kmer from c) select doc_id, kmer, count(*) n from w where regexp_matches(kmer, '^[ACGTN]{3}$') group by 1, 2")
def _(d):
    return seq.kmer_counts(d, 3, alphabet="ACGTN", id="doc_id", seq="text")


_NON = "with w as (select spacer_id, k, substring(seq, i::int, k) m from fx_spacers, (values (3), (4), (5), (6)) v(k), unnest(range(1, length(seq) - k + 2)) r(i)), c as (select spacer_id, k, m, count(*) n from w group by 1, 2, 3), u as (select spacer_id, k, count(*) filter (n > 1) u, max(n) most from c group by 1, 2)"


@query("nonunique_kmers", "fx_spacers", sql=_NON + " select spacer_id, k::int k, u::int n from u")
def _(s):
    return seq.kmers_long(seq.nonunique_kmers(s), "spacer_id")


@query("filter_repetitive", "fx_spacers", sql=_NON + " select spacer_id from u where k = 3 and most <= 4")
def _(s):
    return seq.filter_repetitive(s, 3, 4).select("spacer_id")


_QC = _NON + f", e as (select spacer_id, -sum(p * log2(p)) e from (select spacer_id, ch, count(*)::double / any_value(n) p from (select spacer_id, unnest(string_split(seq, '')) ch, length(seq) n from fx_spacers) group by 1, 2) group by 1), cc as (select spacer_id, {_COMP} from fx_spacers)"
_KEPT = 'cc.n = 0 and greatest(cc.a, cc.t, cc.c, cc.g, cc.gc) < 0.95 and e > 1 and u < 4'


@query("filter_low_complexity", "fx_spacers", sql=_QC + f" select cc.spacer_id from cc join e using (spacer_id) join u using (spacer_id) where k = 6 and {_KEPT}")
def _(s):
    return seq.filter_low_complexity(s).select("spacer_id")


def _observed(df: DataFrame, counts: Observation) -> DataFrame:
    """What an observation has counted while ``df`` was computed."""
    df.write.format("noop").mode("overwrite").save()
    got = counts.get
    return df.sparkSession.createDataFrame([tuple(got.values())], ", ".join(f"{k} {'double' if k.endswith('pct') else 'long'}" for k in got))


@query("filter_low_complexity_counts", "fx_spacers", sql=_QC + f", x as (select count(*) as rows, count(*) filter (not coalesce({_KEPT}, false)) removed from cc left join e using (spacer_id) left join (select * from u where k = 6) u using (spacer_id)) select *, 100 * removed / nullif(rows, 0)::double removed_pct from x")
def _(s):
    counts = Observation()
    return _observed(seq.filter_low_complexity(s, counts=counts), counts)


@query("dust_masked", "fx_spacers", sql="with t as (select spacer_id, list_transform(range(1, length(seq) - 1), lambda i: substring(seq, i::int, 3)) t from fx_spacers), c as (select spacer_id, t, i, l, list_sum(list_transform(range(i, i + l), lambda p: len(list_filter(t[p + 1:i + l], lambda x: x = t[p])))) s from t, unnest(range(1, len(t) + 1)) r(i), unnest(range(1, 7)) q(l) where i + l <= len(t)), m as (select distinct spacer_id, unnest(range(i, i + l + 3)) p from c where 10 * s > 15 * l), n as (select spacer_id, count(*) k from m group by 1) select spacer_id, coalesce(k, 0)::int masked from fx_spacers left join n using (spacer_id)")
def _(s):
    return s.select("spacer_id", seq.dust_masked("seq").alias("masked"))


@query("cigar_functions", "fx_hits", sql="with c as (select *, 20 + mismatches a, mismatches + 1 b, spacer_length - 20 d from fx_hits) select spacer_id, contig_id, start, tool, (a + b + 3 + d)::bigint span, b::bigint x, a || 'M' || b || 'X3D2I' || '1=' || d || 'M' fixed from (select *, d - 1 as d2 from c)".replace("(a + b + 3 + d)", "(a + b + 3 + 1 + d)"))
def _(h):
    m, n = F.col("mismatches"), F.col("spacer_length")
    text = F.concat((20 + m).cast("string"), F.lit("M"), (m + 1).cast("string"), F.lit("X3D2I="), (n - 20).cast("string"), F.lit("M"))
    h = h.withColumn("fixed", seq.fix_cigar(text))
    return h.select("spacer_id", "contig_id", "start", "tool", seq.cigar_ref_span("fixed").alias("span"), seq.cigar_mismatches("fixed").alias("x"), "fixed")


# distances
_REG = 'case when strand then reverse(translate(r, \'ACGT\', \'TGCA\')) else r end'
_SEQS = f'with h as (select distinct {HK} from fx_hits), x as (select h.*, substring(c.seq, (start + 1)::int, ("end" - start)::int) r, s.seq sp from h join fx_contigs c using (contig_id) join fx_spacers s using (spacer_id)), y as (select *, {_REG} rg from x)'


@query("attach_sequences", "fx_hits", "fx_spacers", "fx_blocks", sql=_SEQS + f" select {HK}, sp spacer_seq, rg region_seq from y")
def _(h, s, c):
    return jo.attach_sequences(cl.unique_hits(h), s, c)


@query("distances", "fx_hits", "fx_spacers", "fx_blocks", sql=_SEQS + f', d as (select *, case when length(sp) = length(rg) then hamming(sp, rg) end h, levenshtein(sp, rg) e from y) select {HK}, h::int hamming, e::int edit, e <> h has_indels from d where length(sp) = length(rg)')
def _(h, s, c):
    d = jo.attach_sequences(cl.unique_hits(h), s, c).where("length(spacer_seq) = length(region_seq)")
    return dist.all_distances(d, affine=False).drop("spacer_seq", "region_seq")


@query("gap_affine", "fx_truth", "fx_spacers", "fx_blocks", sql="select spacer_id, contig_id, mismatches gap_affine from fx_truth")
def _(t, s, c):
    """Truth has at most one substitution, and that is cheaper than gaps."""
    return jo.attach_sequences(t, s, c).select("spacer_id", "contig_id", dist.gap_affine("spacer_seq", "region_seq").alias("gap_affine"))


_VARIANT = "(ascii(substring(seq, 1, 1)) + ascii(substring(seq, 2, 1))) % 4"


def _variants(s):
    """Spacers with two letters less, two or three letters more, or one letter changed, in their middle."""
    told = "case {v} when 0 then concat(substring(seq, 1, 11), substring(seq, 14)) when 1 then concat(substring(seq, 1, 12), 'AC', substring(seq, 13)) when 2 then concat(substring(seq, 1, 12), 'GTG', substring(seq, 13)) else concat(substring(seq, 1, 12), translate(substring(seq, 13, 1), 'ACGT', 'TGCA'), substring(seq, 14)) end".format(v=_VARIANT)
    return s.withColumn("other", F.expr(told))


@query("gap_affine_gaps", "fx_spacers", sql=f"select spacer_id, case {_VARIANT} when 2 then 3 when 3 then 1 else 2 end::int gap_affine from fx_spacers")
def _(s):
    """As all letters of the shorter one match, the best alignment has as many gaps as the lengths differ by."""
    return _variants(s).select("spacer_id", dist.gap_affine("seq", "other").alias("gap_affine"))


@query("hamming_unequal", "fx_spacers", sql="select spacer_id, list_min(list_transform(range(1, length(seq) - 13), lambda i: hamming(substring(seq, 3, 15), substring(reverse(seq), i::int, 15))))::int hamming from fx_spacers")
def _(s):
    return s.select("spacer_id", dist.hamming(F.substring("seq", 3, 15), F.reverse("seq")).alias("hamming"))


@query("rendering", "fx_truth", "fx_spacers", "fx_blocks", sql=f'with x as (select t.*, substring(c.seq, (start + 1)::int, ("end" - start)::int) r, s.seq sp from fx_truth t join fx_contigs c using (contig_id) join fx_spacers s using (spacer_id)), y as (select *, {_REG} rg from x) select spacer_id, contig_id, sp || chr(10) || array_to_string(list_transform(range(1, length(sp) + 1), lambda i: case when sp[i] = rg[i] then \'|\' else \'.\' end), \'\') || chr(10) || rg alignment from y')
def _(t, s, c):
    return dist.render_alignment(jo.attach_sequences(t, s, c), "hamming").select("spacer_id", "contig_id", "alignment")


@query("rendering_edit", "fx_spacers", sql=f"select spacer_id, case {_VARIANT} when 2 then 3 when 3 then 1 else 2 end::int n_different, true same_letters from fx_spacers")
def _(s):
    """The drawing has as many columns that differ as the edit distance is, and both strings' letters in order."""
    line = lambda i: F.element_at(F.split("alignment", "\n"), i)
    d = dist.render_alignment(_variants(s), "edit", "seq", "other")
    same = (F.translate(line(1), "-", "") == F.col("seq")) & (F.translate(line(3), "-", "") == F.col("other"))
    return d.select("spacer_id", (F.length(line(2)) - F.regexp_count(line(2), F.lit(r"\|"))).cast("int").alias("n_different"), same.alias("same_letters"))


@query("verify_truth", "fx_truth", "fx_blocks", "fx_spacers", sql=f'with x as (select t.*, substring(c.seq, (start + 1)::int, ("end" - start)::int) r, s.seq sp from fx_truth t join fx_contigs c using (contig_id) join fx_spacers s using (spacer_id)), d as (select mismatches m, levenshtein(sp, {_REG}) e from x) select count(*) n, count(*) filter (m <> e) n_wrong, coalesce(count(*) filter (m <> e)::double / nullif(count(*), 0), 0) wrong_share, count(*) filter (m <> e) = 0 passed from d')
def _(t, c, s):
    return cl.verify_truth(t, c, s)


# intervals
_MATCH = f'with u as (select distinct {HK} from fx_hits), m as (select u.*, t.start start_gt, t."end" end_gt, t.mismatches mismatches_gt, row_number() over (partition by u.spacer_id, u.contig_id, u.start, u."end", u.strand order by abs(u.start - t.start) + abs(u."end" - t."end"), t.start, t."end", t.mismatches) r from u join fx_truth t on u.spacer_id = t.spacer_id and u.contig_id = t.contig_id and u.strand = t.strand and abs(u.start - t.start) <= 5 and abs(u."end" - t."end") <= 5)'


@query("tolerance_match", "fx_truth", "fx_hits", sql=_MATCH + f" select {HK}, start_gt, end_gt, mismatches_gt from m where r = 1")
def _(t, h):
    return jo.match_with_tolerance(t, cl.unique_hits(h))


@query("overlap_join", "fx_truth", "fx_hits", sql='select a.contig_id, a.spacer_id spacer_id_1, a.start start_1, a."end" end_1, a.strand strand_1, a.mismatches mismatches_1, b.spacer_id spacer_id_2, b.spacer_length spacer_length_2, b.strand strand_2, b.start start_2, b."end" end_2, b.mismatches mismatches_2, b.tool tool_2, case when a.strand <> b.strand then \'strand_mismatch\' when a.start = b.start and a."end" = b."end" then \'exact_match\' else \'partial_overlap\' end overlap from fx_truth a join fx_hits b on a.contig_id = b.contig_id and b.mismatches <= 3 and a.start < b."end" and b.start < a."end"')
def _(t, h):
    return jo.overlap_join(t, h, 3)


def _merge_sql(src: str, key: str, tol: int) -> str:
    return f'with a as (select {key}, start, "end", max("end") over (partition by {key} order by start, "end" rows between unbounded preceding and 1 preceding) m from {src}), b as (select *, sum(case when m is null or start > m + {tol} then 1 else 0 end) over (partition by {key} order by start, "end" rows unbounded preceding) isl from a), c as (select {key}, min(start) start, max("end") "end", count(*) n_merged from b group by {key}, isl)'


@query("merge_intervals", "fx_intervals", sql=_merge_sql("fx_intervals", GK, 5) + " select * from c")
def _(i):
    return jo.merge_intervals(i, 5)


@query("merge_intervals_by_tool", "fx_intervals", sql=_merge_sql("fx_intervals", GK + ", tool", 3) + " select * from c")
def _(i):
    return jo.merge_intervals(i, 3, ["tool"])


_RG = f'with a as (select *, max("end") over (partition by {GK} order by start, "end" rows between unbounded preceding and 1 preceding) m from fx_intervals), b as (select *, sum(case when m is null or start > m + 5 then 1 else 0 end) over (partition by {GK} order by start, "end" rows unbounded preceding) isl from a), rg as (select *, min(start) over (partition by {GK}, isl) region_start, max("end") over (partition by {GK}, isl) region_end from b)'
_RK = "spacer_id, contig_id, strand, region_start"


@query("assign_regions", "fx_intervals", sql=_RG + f" select {HK}, mismatches, tool, region_start, region_end from rg")
def _(i):
    return jo.assign_regions(i).drop("region_id", "fraction")


# classification
_CLS = _MATCH + f", g as (select * from m where r = 1), x as (select u.*, g.start_gt, g.end_gt, g.mismatches_gt, substring(c.seq, (u.start + 1)::int, (u.\"end\" - u.start)::int) r, s.seq sp from u left join g using ({HK}) left join fx_contigs c using (contig_id) left join fx_spacers s using (spacer_id)), k as (select *, levenshtein(sp, {_REG}) e from x), cu as (select {HK}, start_gt, end_gt, case when start_gt is not null then 'positive_in_plan' when e <= 5 then 'positive_not_in_plan' else 'invalid_alignment' end classification, case when start_gt is not null then mismatches_gt else e end::int recalculated_distance from k), cf as (select h.*, cu.* exclude ({HK}) from fx_hits h join cu using ({HK}))"


@query("unique_hits", "fx_hits", sql=f"select distinct {HK} from fx_hits")
def _(h):
    return cl.unique_hits(h)


@query("classify", "fx_truth", "fx_hits", "fx_blocks", "fx_spacers", sql=_CLS + " select * from cf")
def _(t, h, c, s):
    return cl.classify(t, h, c, s)


_PERF = (
    f", al as (select {HK}, tool, classification, start_gt, end_gt from cf union all select distinct {HK}, 'all_tools_combined', classification, start_gt, end_gt from cf)"
    + ", own as (select * from al where classification = 'positive_not_in_plan')"
    + ", oa as (select tool, spacer_id, contig_id, strand, start, \"end\", max(\"end\") over (partition by tool, spacer_id, contig_id, strand order by start, \"end\" rows between unbounded preceding and 1 preceding) m from own)"
    + ", ob as (select tool, count(*) filter (m is null or start > m + 3) n from oa group by 1)"
    + ", pr as (select tool, count(distinct case when classification = 'positive_in_plan' then (spacer_id, contig_id, start_gt, end_gt, strand) end) tp, count(distinct case when classification = 'invalid_alignment' then (spacer_id, contig_id, start, \"end\", strand) end) bad from al group by 1)"
    + ", z as (select tool, tp planned_true_positives, bad invalid_alignments, coalesce(ob.n, 0) positives_not_in_plan, (select count(*) from fx_truth) ground_truth_planned, (select count(*) from fx_truth) + coalesce((select n from ob where tool = 'all_tools_combined'), 0) ground_truth_augmented from pr left join ob using (tool))"
    + ", zz as (select *, ground_truth_planned - planned_true_positives false_negatives_planned, planned_true_positives + positives_not_in_plan all_true_positives from z)"
    + ", zy as (select *, coalesce(planned_true_positives / nullif(planned_true_positives + positives_not_in_plan + invalid_alignments, 0)::double, 0) precision_planned, coalesce(planned_true_positives / nullif(planned_true_positives + false_negatives_planned, 0)::double, 0) recall_planned, ground_truth_augmented - all_true_positives false_negatives_augmented, coalesce(all_true_positives / nullif(all_true_positives + invalid_alignments, 0)::double, 0) precision_augmented, coalesce(all_true_positives / nullif(ground_truth_augmented, 0)::double, 0) recall_augmented from zz)"
    + " select *, coalesce(2 * precision_planned * recall_planned / nullif(precision_planned + recall_planned, 0), 0) f1_planned, coalesce(2 * precision_augmented * recall_augmented / nullif(precision_augmented + recall_augmented, 0), 0) f1_augmented from zy"
)


@query("tool_performance", "fx_truth", "fx_hits", "fx_blocks", "fx_spacers", sql=_CLS + _PERF)
def _(t, h, c, s):
    return cl.compare(t, h, c, s)


@query("compare_with_timings", "fx_truth", "fx_hits", "fx_blocks", "fx_spacers", "fx_accounting", sql=_CLS + _PERF.replace(" select *, coalesce(2 * precision_planned", ", fin as (select *, coalesce(2 * precision_planned") + f"), tm as (select split_part(JobName, '_long', 1) tool, avg({_DUR('Elapsed')}) mean from fx_accounting group by 1) select tool, recall_planned, f1_augmented, round(mean, 6) mean from fin left join tm using (tool)")
def _(t, h, c, s, a):
    timings = a.groupBy(F.element_at(F.split("JobName", "_long"), 1).alias("tool")).agg(F.avg(rs.parse_duration("Elapsed")).alias("mean"))
    return cl.compare(t, h, c, s, timings=timings).select("tool", "recall_planned", "f1_augmented", F.round("mean", 6).alias("mean"))


@query("false_negatives", "fx_truth", "fx_hits", "fx_blocks", "fx_spacers", sql=_CLS + ' select t.spacer_id, t.contig_id, t.start, t."end", t.strand, t.mismatches, k.tool from fx_truth t cross join (select distinct tool from fx_hits) k where not exists (select 1 from cf where cf.tool = k.tool and cf.spacer_id = t.spacer_id and cf.contig_id = t.contig_id and cf.strand = t.strand and cf.start_gt = t.start and cf.end_gt = t."end")')
def _(t, h, c, s):
    return cl.false_negatives(t, cl.classify(t, h, c, s))


@query("false_negative_counts", "fx_truth", "fx_hits", "fx_blocks", "fx_spacers", sql=_CLS + ", fd as (select distinct cf.tool, t.spacer_id, t.contig_id, t.strand, t.start, t.\"end\" from fx_truth t join cf on cf.spacer_id = t.spacer_id and cf.contig_id = t.contig_id and cf.strand = t.strand and cf.start_gt = t.start and cf.end_gt = t.\"end\"), fo as (select tool, count(*) n from fd group by 1 union all select 'all_tools', count(*) from (select distinct * exclude (tool) from fd)), ft as (select count(*) n_truth from fx_truth) select tool, n_truth, n_truth - coalesce(n, 0) n_missed, 100 * (n_truth - coalesce(n, 0)) / n_truth::double missed_pct from (select distinct tool from cf union all select 'all_tools') left join fo using (tool), ft")
def _(t, h, c, s):
    return cl.false_negative_counts(t, cl.classify(t, h, c, s))


@query("missed_by_all", "fx_truth", "fx_hits", "fx_blocks", "fx_spacers", sql=_CLS + ' select t.* from fx_truth t where not exists (select 1 from cf where cf.spacer_id = t.spacer_id and cf.contig_id = t.contig_id and cf.strand = t.strand and cf.start_gt = t.start and cf.end_gt = t."end")')
def _(t, h, c, s):
    return cl.missed_by_all(t, cl.classify(t, h, c, s))


@query("missed_by_two", "fx_truth", "fx_hits", "fx_blocks", "fx_spacers", sql=_CLS + ' select t.* from fx_truth t where not exists (select 1 from cf where cf.tool in (\'tool_0\', \'tool_1\') and cf.spacer_id = t.spacer_id and cf.contig_id = t.contig_id and cf.strand = t.strand and cf.start_gt = t.start and cf.end_gt = t."end")')
def _(t, h, c, s):
    return cl.missed_by_all(t, cl.classify(t, h.where("tool in ('tool_0', 'tool_1')"), c, s))


_LINES = "case when length(sp) = length(rr) then sp || chr(10) || array_to_string(list_transform(range(1, length(sp) + 1), lambda i: case when sp[i] = rr[i] then '|' else '.' end), '') || chr(10) || rr end"


@query("examples", "fx_truth", "fx_hits", "fx_blocks", "fx_spacers", sql=_CLS + f", l as (select classification, {HK}, string_agg(distinct tool, ',' order by tool) tools from cf group by all), lr as (select *, row_number() over (partition by classification order by {HK}) n from l), lx as (select lr.*, sp, {_REG} rr from lr join k using ({HK}) where n <= 3) select classification, {HK}, tools, n::int r, {_LINES} alignment from lx")
def _(t, h, c, s):
    return cl.examples(cl.classify(t, h, c, s), s, c, metric="hamming").drop("spacer_seq", "region_seq")


_RH = _RG.replace("with a as (select *", 'with h0 as (select spacer_id, contig_id, start, "end", strand, min(mismatches) reported_mismatches, string_agg(distinct tool, \',\' order by tool) tools from fx_hits group by all), a as (select *').replace("fx_intervals", "h0")
_MM = (
    _RH + f', g as (select * from (select u.*, t.start start_gt, t."end" end_gt, t.mismatches mismatches_gt, row_number() over (partition by u.spacer_id, u.contig_id, u.start, u."end", u.strand order by abs(u.start - t.start) + abs(u."end" - t."end"), t.start, t."end") r from (select {HK} from h0) u join fx_truth t on u.spacer_id = t.spacer_id and u.contig_id = t.contig_id and u.strand = t.strand and abs(u.start - t.start) <= 5 and abs(u."end" - t."end") <= 5) where r = 1)'
    + f', x as (select rg.*, g.start_gt, g.end_gt, g.mismatches_gt, substring(c.seq, (rg.start + 1)::int, (rg."end" - rg.start)::int) r, s.seq sp from rg left join g using ({HK}) left join fx_contigs c using (contig_id) left join fx_spacers s using (spacer_id))'
    + f", y as (select *, {_REG} rr from x), mm as (select *, case when length(sp) = length(rr) then hamming(sp, rr)::int end hamming, levenshtein(sp, rr)::int edit, case when start_gt is not null then 'positive_in_plan' when least(case when length(sp) = length(rr) then hamming(sp, rr) end, levenshtein(sp, rr)) <= 5 then 'positive_not_in_plan' else 'invalid_alignment' end classification from y)"
)


def _multi(t, h, c, s):
    """For queries that don't show the affine distance: it is never below the edit distance, so it changes no class."""
    return cl.multi_metric(t, h, c, s, affine=False)


_MV = ("fx_truth", "fx_hits", "fx_blocks", "fx_spacers")


# columns that aren't matches in the affine alignment of sp and rr (sn and rn letters with codes sa and ra), gaps of 5 a letter as by default, from diagonal to diagonal of its cells
# a cell: score * 16384, then its last step (8192 diagonal, 4096 a gap in rr) and its columns; at most one mismatch scores above any two gaps
_AFFINE = (
    "case when hamming <= 1 then hamming else list_reduce(list_transform(range(0, sn + rn + 1), lambda d: {'d': d, 'b': [0::bigint], 'c': [0::bigint]}), "
    "lambda x, y: {'d': y.d, 'b': x.c, 'c': list_transform(range(greatest(0, y.d - rn), least(sn, y.d) + 1), lambda i: case when i = 0 or i = y.d then y.d * (1 - 5 * 16384) "
    "else greatest(x.b[i - greatest(0, y.d - 2 - rn)] + case when sa[i] = ra[y.d - i] then 5 * 16384 + 8192 else 1 - 4 * 16384 + 8192 end, "
    "x.c[i - greatest(0, y.d - 1 - rn)] + 1 - 5 * 16384 + 4096, x.c[i + 1 - greatest(0, y.d - 1 - rn)] + 1 - 5 * 16384) & ~12288 end)}).c[1] & 4095 end::int gap_affine"
)
_MA = f", ml as (select *, length(sp) sn, length(rr) rn, list_transform(string_split(sp, ''), lambda c: ascii(c)) sa, list_transform(string_split(rr, ''), lambda c: ascii(c)) ra from mm), ma as (select * exclude (classification), {_AFFINE} from ml)"


@query("multi_metric", *_MV, sql=_MM + _MA + f" select {HK}, tools, region_start, region_end, hamming, edit, gap_affine, start_gt, end_gt, case when start_gt is not null then 'positive_in_plan' when least(hamming, edit, gap_affine) <= 5 then 'positive_not_in_plan' else 'invalid_alignment' end classification, coalesce(mismatches_gt, hamming)::int planned_mismatches from ma")
def _(t, h, c, s):
    return cl.multi_metric(t, h, c, s).select("spacer_id", "contig_id", "start", "end", "strand", F.array_join("tools", ",").alias("tools"), "region_start", "region_end", "hamming", "edit", "gap_affine", "start_gt", "end_gt", "classification", "planned_mismatches")


@query("multi_metric_affine", *_MV)
def _(t, h, c, s):
    return cl.multi_metric(t, h, c, s).groupBy("classification").agg(F.count("*").alias("n"), F.avg("gap_affine").alias("mean_gap_affine"))


@query("multi_metric_limited", *_MV, sql=_MM + f" select {HK}, case when hamming <= 5 then hamming end hamming, case when edit <= 5 then edit end edit, case when edit <= 5 then edit <> hamming end has_indels, classification from mm")
def _(t, h, c, s):
    return cl.multi_metric(t, h, c, s, affine=False, limit=5).select("spacer_id", "contig_id", "start", "end", "strand", "hamming", "edit", "has_indels", "classification")


_AT = "lg as (select classification, 'hamming' metric, hamming d from mm union all select classification, 'edit', edit from mm), mt as (select metric, threshold, count(*) filter (classification = 'positive_in_plan') n_planned, count(*) filter (classification = 'positive_in_plan' and d <= threshold) true_positives, count(*) filter (classification <> 'positive_in_plan' and d <= threshold) spurious, count(*) filter (classification <> 'positive_in_plan' and not d <= threshold) invalid, count(*) n from lg, (select unnest(range(0, 8))::int threshold) group by 1, 2)"


@query("metrics_at_thresholds", *_MV, sql=_MM + ", " + _AT + " select *, coalesce(true_positives / nullif(n_planned, 0)::double, 0) recall_planned, coalesce(true_positives / nullif(true_positives + spurious + invalid, 0)::double, 0) precision_planned, coalesce((true_positives + spurious) / nullif(true_positives + spurious + invalid, 0)::double, 0) precision_augmented, 100 * coalesce(invalid / nullif(n, 0)::double, 0) invalid_pct from mt")
def _(t, h, c, s):
    return cl.metrics_at(_multi(t, h, c, s), ["hamming", "edit"], range(8))


@query("metrics_by_space", *_MV, "fx_contigs", sql=_MM + ", " + _AT + ", sz as (select (select count(*) from fx_spacers)::double * (select count(*) from fx_contigs) pairs, (select sum(length(seq)) from fx_spacers)::double * (select sum(length) from fx_contigs) bp2) select metric, threshold, spurious, round(spurious * 1e6 / pairs, 6) spurious_per_m_pairs, round(spurious * 1e18 / bp2 / 1e6, 6) spurious_per_gbp2_m from mt, sz")
def _(t, h, c, s, contigs):
    d = cl.metrics_at(_multi(t, h, c, s), ["hamming", "edit"], range(8), rs.dataset_stats(s.withColumn("length", F.length("seq")), contigs))
    return d.select("metric", "threshold", "spurious", F.round("spurious_per_m_pairs", 6).alias("spurious_per_m_pairs"), F.round(F.col("spurious_per_gbp2") / 1e6, 6).alias("spurious_per_gbp2_m"))


@query("disagreements", *_MV, sql=_MM + f" select {HK}, hamming, edit from mm where hamming is distinct from edit order by md5('42:' || spacer_id || ':' || contig_id || ':' || start || ':' || \"end\" || ':' || strand), {HK} limit 20")
def _(t, h, c, s):
    return cl.disagreements(_multi(t, h, c, s), 20).select("spacer_id", "contig_id", "start", "end", "strand", "hamming", "edit")


@query("threshold_sweep", *_MV, sql=_MM + ", tt as (select unnest(range(0, 6))::int threshold), tr as (select threshold, count(*) n_truth from fx_truth, tt where mismatches <= threshold group by 1), rd as (select *, classification = 'positive_in_plan' and mismatches_gt <= threshold pl from mm, tt where reported_mismatches <= threshold), o as (select threshold, count(distinct case when pl then (spacer_id, contig_id, strand, start_gt, end_gt) end) identified, count(*) filter (not coalesce(pl, false) and edit <= threshold) spurious, count(*) filter (not coalesce(pl, false) and not coalesce(edit <= threshold, false)) invalid, count(*) n from rd group by 1) select threshold, n_truth, identified, spurious, invalid, n, n_truth - identified missed, 100 * coalesce(identified / nullif(n_truth, 0)::double, 0) identified_pct, 100 * coalesce((n_truth - identified) / nullif(n_truth, 0)::double, 0) missed_pct, 100 * coalesce(spurious / nullif(n, 0)::double, 0) spurious_pct, 100 * coalesce(invalid / nullif(n, 0)::double, 0) invalid_pct from tr left join o using (threshold)")
def _(t, h, c, s):
    return cl.threshold_sweep(_multi(t, h, c, s), t, range(6))


_AGR = ", ".join([*(f"{k}({m}){'::double' if k == 'avg' else ''} {n}_{m}" for m in ("hamming", "edit") for k, n in (("avg", "mean"), ("min", "min"), ("max", "max"))), "count(*) filter (hamming = edit) n_hamming_edit, 100 * count(*) filter (hamming = edit) / count(*)::double pct_hamming_edit", *(f"count(*) filter ({m} <= {t}) pass_{m}_{t}" for m in ("hamming", "edit") for t in range(1, 6))])


@query("metric_agreement", *_MV, sql=_MM + f" select count(*) n, count(*) filter (hamming = edit) n_all_equal, 100 * count(*) filter (hamming = edit) / count(*)::double pct_all_equal, {_AGR} from mm")
def _(t, h, c, s):
    return cl.metric_agreement(_multi(t, h, c, s))


@query("by_region", *_MV, sql=_MM + f", e as (select {_RK}, unnest(string_split(tools, ',')) t from mm), q as (select {_RK}, string_agg(distinct t, ',' order by t) tools from e group by all), n as (select {_RK}, count(*) n_alignments, min(hamming) min_hamming from mm group by all) select * from n join q using ({_RK})")
def _(t, h, c, s):
    return cl.region_summary(h, c, s)


@query("high_confidence", *_MV, sql=_MM + f" select {HK}, 'high' kind from mm where greatest(hamming, edit) <= 2 union all select {HK}, 'discordant' from mm where hamming <= 5 and edit > 5 union all select {HK}, 'edit_only' from mm where edit <= 5 and hamming > 5")
def _(t, h, c, s):
    m = _multi(t, h, c, s)
    tag = lambda d, k: d.select("spacer_id", "contig_id", "start", "end", "strand", F.lit(k).alias("kind"))
    return tag(cl.high_confidence(m, 2), "high").union(tag(cl.discordant(m, 5), "discordant")).union(tag(m.where("edit <= 5 and hamming > 5"), "edit_only"))


@query("spurious_rates", "fx_intervals", sql="with d as (select fraction dataset, count(*) filter (mismatches > 3) n_spurious, count(distinct spacer_id) n_spacers, sum(\"end\" - start)::bigint spacer_bp, count(distinct contig_id) n_contigs, max(\"end\")::bigint contig_bp from fx_intervals group by 1), r as (select *, n_spurious * 1e6::double / spacer_bp a from d) select round(avg(a), 6) mean_rate, round(stddev_pop(a), 6) std_rate, round(corr(n_spurious, spacer_bp * contig_bp::double), 6) corr_space from r")
def _(i):
    d = i.groupBy(F.col("fraction").alias("dataset")).agg(F.count_if(F.col("mismatches") > 3).alias("n_spurious"), F.count_distinct("spacer_id").alias("n_spacers"), F.sum(F.col("end") - F.col("start")).alias("spacer_bp"), F.count_distinct("contig_id").alias("n_contigs"), F.max("end").alias("contig_bp"))
    r = cl.rate_summary(cl.spurious_rates(d))
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


# agreement
@query("tool_summary", "fx_intervals", sql="select tool, count(*) n, count(distinct spacer_id) n_spacers, count(distinct contig_id) n_contigs, avg(mismatches) mean, median(mismatches) median, min(mismatches) min, max(mismatches) max from fx_intervals group by 1")
def _(i):
    return ag.tool_summary(i)


_RBD = ", sn as (select distinct fraction, tool, " + _RK + " from rg), tt as (select fraction, count(*) n_total from (select distinct fraction, " + _RK + " from sn) group by 1), ow as (select fraction, tool, count(*) n_found from sn group by 1, 2), rc as (select *, n_found::double / n_total recall from ow join tt using (fraction))"


@query("recall_by_dataset", "fx_cube", sql=_RG + _RBD + " select fraction, tool, n_found, n_total, recall from rc")
def _(c):
    return c.recall_by_dataset()


@query("recall_stats", "fx_cube", "fx_intervals", sql=_RG + _RBD + ", st as (select tool, avg(recall) mean, coalesce(stddev_samp(recall), 0) std, min(recall) min, max(recall) max from rc group by 1) select tool, round(mean, 9) mean, round(std, 9) std, min, max, round(greatest(mean - std, 0), 9) low, round(least(mean + std, 1), 9) high from st")
def _(c, i):
    r = ag.recall_stats(c.recall_by_dataset(), i)
    return r.select("tool", *(F.round(c, 9).alias(c) for c in ("mean", "std")), "min", "max", *(F.round(c, 9).alias(c) for c in ("low", "high")))


@query("recall_pivot", "fx_cube", sql=_RG + _RBD + ' select tool, max(recall) filter (fraction = 0) "0", max(recall) filter (fraction = 1) "1", max(recall) filter (fraction = 2) "2" from rc group by 1')
def _(c):
    return ag.recall_pivot(c.recall_by_dataset(), [0, 1, 2])


_TH = lambda op: _RG + f", tt as (select unnest(range(0, 6))::int threshold), sn as (select distinct threshold, tool, {_RK} from rg, tt where mismatches {op} threshold), t2 as (select threshold, count(*) n_total from (select distinct threshold, {_RK} from sn) group by 1), ow as (select threshold, tool, count(*) n_found from sn group by 1, 2) select threshold, tool, n_found, n_total, n_found::double / n_total recall from ow join t2 using (threshold)"


@query("recall_by_threshold", "fx_cube", sql=_TH("<="))
def _(c):
    return c.recall_by_threshold(range(6))


@query("recall_at_distance", "fx_cube", sql=_TH("="))
def _(c):
    return c.recall_by_threshold(range(6), exact=True)


_DM = lambda src, key, cond, diag: f"tl as (select distinct tool from {src}), ks as (select distinct tool, {key} from {src} where {cond}) select a.tool row_tool, b.tool col_tool, (select count(*) from ks x where x.tool = a.tool and {'(a.tool = b.tool or ' if diag else '('}a.tool <> b.tool) and {'(a.tool = b.tool or ' if diag else '('}not exists (select 1 from ks y where y.tool = b.tool and {' and '.join(f'y.{c} = x.{c}' for c in key.split(', '))}))) n from tl a, tl b"


@query("difference_matrix_pairs", "fx_hits", sql="with " + _DM("fx_hits", "spacer_id, contig_id", "true", True))
def _(h):
    return ag.difference_matrix(h, ["spacer_id", "contig_id"], diagonal=True)


@query("difference_matrix_hits", "fx_hits", sql="with " + _DM("fx_hits", HK, "mismatches = 2", False))
def _(h):
    return ag.difference_matrix(h.where("mismatches = 2"), ["spacer_id", "contig_id", "start", "end", "strand"])


@query("difference_matrix_regions", "fx_cube", sql=_RG + ", " + _DM("rg", _RK, "true", False) .replace("tl as", "tl as", 1))
def _(c):
    return ag.matrix_long(c.difference_matrix()).drop("row_total")


@query("difference_matrix_wide", "fx_hits", sql="with mx as (with " + _DM("fx_hits", "spacer_id, contig_id", "true", True) + ") select row_tool, " + ", ".join(f"max(n) filter (col_tool = 'tool_{t}') tool_{t}" for t in range(5)) + " from mx group by 1")
def _(h):
    return ag.matrix_wide(ag.difference_matrix(h, ["spacer_id", "contig_id"], diagonal=True), [f"tool_{t}" for t in range(5)])


@query("matched_contigs", "fx_cube", sql=_RG + f" select contig_id, count(distinct spacer_id) n_spacers, count(distinct ({_RK})) n_regions, string_agg(distinct tool, ',' order by tool) tools, count(distinct tool) n_tools from rg group by 1")
def _(c):
    return c.matched_contigs()


@query("tool_combinations", "fx_cube", sql=_RG + f", s as (select {_RK}, string_agg(distinct tool, ',' order by tool) tools from rg where mismatches <= 3 group by all) select tools, count(*) n_regions from s group by 1")
def _(c):
    return c.tool_combinations(3, exact=False)


@query("only_by", "fx_cube", sql=_RG + f", s as (select {_RK}, bool_and(tool in ('tool_0', 'tool_1')) o from rg group by all) select count(*) filter (o) n_only, count(*) n_total, 100 * count(*) filter (o) / count(*)::double pct from s")
def _(c):
    return c.only_by(["tool_0", "tool_1"])


_OCC = "with d as (select distinct spacer_id, contig_id, tool from {0}), o as (select spacer_id, count(distinct contig_id) n_occurrences from d group by 1), f as (select o.*, t.tool, (select count(*) from d where d.spacer_id = o.spacer_id and d.tool = t.tool) n_found from o, (select distinct tool from {0}) t), fr as (select *, n_found::double / n_occurrences fraction from f)"


@query("occurrence_fractions", "fx_intervals", sql=_OCC.format("fx_intervals") + " select spacer_id, tool, n_occurrences, n_found, fraction from fr")
def _(i):
    return ag.occurrence_fractions(i)


@query("occurrence_wide", "fx_hits", sql=_OCC.format("fx_hits") + " select spacer_id, n_occurrences, " + ", ".join(f"max(fraction) filter (tool = 'tool_{t}') tool_{t}" for t in range(5)) + " from fr group by 1, 2")
def _(h):
    return ag.occurrence_wide(ag.occurrence_fractions(h), [f"tool_{t}" for t in range(5)])


_BINS = "(values " + ", ".join(f"({i}, {a!r}::double, {b!r}::double)".replace("inf::double", "'inf'::double") for i, a, b in ag.occurrence_bins()) + ") b(bin, low, high)"


@query("recall_by_occurrence", "fx_cube", sql=_RG + f", d as (select distinct {_RK}, tool from rg), o as (select spacer_id, count(*) n from (select distinct {_RK} from d) group by 1), f as (select o.spacer_id, o.n, t.tool, (select count(*) from d where d.spacer_id = o.spacer_id and d.tool = t.tool)::double / o.n v from o, (select distinct tool from rg) t) select tool, bin::int bin, round(avg(v), 9) mean_fraction, count(*) n_spacers from f join {_BINS} on n >= low and n < high group by 1, 2")
def _(c):
    return ag.recall_by_occurrence(c.occurrence_fractions()).withColumn("mean_fraction", F.round("mean_fraction", 9))


@query("recall_difference", "fx_cube", sql=_RG + f", d as (select distinct {_RK}, tool from rg), r as (select tool, count(*)::double / (select count(*) from (select distinct {_RK} from d)) v from d group by 1) select a.tool row_tool, b.tool col_tool, a.v - b.v difference from r a, r b")
def _(c):
    return ag.recall_difference(c.recall())


@query("value_counts", "fx_intervals", sql="select mismatches as value, count(*) n, count(*)::double / (select count(*) from fx_intervals) share from fx_intervals group by 1")
def _(i):
    return ag.value_counts(i, "mismatches", normalize=True)


@query("describe_catalog", "fx_catalog", sql='with l as (select \'length\' "column", length::double v from fx_catalog union all select \'gc\', gc from fx_catalog) select "column", count(v) n, round(avg(v), 6) mean, round(stddev_samp(v), 6) std, min(v) min, round(quantile_cont(v, 0.25), 6) q25, round(median(v), 6) median, round(quantile_cont(v, 0.75), 6) q75, max(v) max from l group by 1')
def _(c):
    d = ag.describe(c, ["length", "gc"])
    return d.select("column", "n", *(x if x in ("min", "max") else F.round(x, 6).alias(x) for x in ("mean", "std", "min", "q25", "median", "q75", "max")))


@query("histogram", "fx_catalog", sql="select (least(floor((length - 1000) / 9100.0), 9) + 1)::int bucket, count(*) n from fx_catalog where length between 1000 and 92000 group by 1")
def _(c):
    return ag.histogram(c, "length", 1000, 92000, 10)


@query("dataset_summary", "fx_intervals", "fx_contigs", "fx_accounting", sql="with c as (select doc_id % 3 fraction, count(*) n_contigs, sum(length)::bigint n_bp from fx_contigs group by 1), j as (select distinct tool, fraction, state from (select split_part(JobName, '_long', 1) tool, AllocCPUS % 3 fraction, State state from fx_accounting)), js as (select fraction, coalesce(string_agg(distinct tool, ',' order by tool) filter (state = 'COMPLETED'), '') completed, coalesce(string_agg(distinct tool, ',' order by tool) filter (state = 'TIMEOUT'), '') timed_out, coalesce(string_agg(distinct tool, ',' order by tool) filter (state is null), '') missing from j group by 1), " + _RG[5:] + f", r as (select fraction, count(*) n_rows, count(distinct ({_RK})) n_regions from rg group by 1) select * from c left join r using (fraction) left join js using (fraction)")
def _(i, c, a):
    jobs = a.select(F.element_at(F.split("JobName", "_long"), 1).alias("tool"), (F.col("AllocCPUS") % 3).cast("long").alias("fraction"), F.col("State").alias("state")).distinct()
    return ag.dataset_summary(jo.assign_regions(i), c.select((F.col("doc_id") % 3).alias("fraction"), "contig_id", "length"), jobs)


# sampling
_ED = lambda c: f"(select list_distinct(quantile_cont({c}, [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) from fx_catalog)".replace("0.30000000000000004", "0.3")
_QB = f"with q as (select *, len(list_filter({_ED('gc')}, lambda e: gc > e))::int gc_bin, len(list_filter({_ED('length')}, lambda e: length > e))::int length_bin from fx_catalog)"


@query("quantile_bins", "fx_catalog", sql=_QB + " select seqid, gc_bin, length_bin from q")
def _(c):
    return sm.quantile_bins(sm.quantile_bins(c, "gc"), "length").select("seqid", "gc_bin", "length_bin")


@query("stratified_sample", "fx_catalog", sql=_QB + ", o as (select *, md5('42:' || seqid) ord from q), ce as (select class, count(*) n from (select distinct class, gc_bin, length_bin from o where class is not null) group by 1), qu as (select class, greatest(1, greatest(1, 300 // (select count(*) from ce)) // n) quota from ce), f as (select seqid from (select seqid, quota, row_number() over (partition by class, gc_bin, length_bin order by ord) p from o join qu using (class)) where p <= quota), r as (select seqid from (select seqid, row_number() over (order by ord) p from o where seqid not in (select seqid from f)) where p + (select count(*) from f) <= 300) select c.seqid, c.class, c.length, c.gc, c.hq from fx_catalog c where seqid in (select seqid from f union all select seqid from r)")
def _(c):
    return sm.stratified_sample(c, 300).select("seqid", "class", "length", "gc", "hq")


_POOL = _QB.replace("with q as", "with pool as (select * from fx_catalog where hq), q as").replace("from fx_catalog)", "from pool)").replace("from fx_catalog)", "from pool)")


@query("subsample", "fx_contigs", "fx_catalog", sql=_POOL + ", o as (select *, md5('42:' || seqid) ord from q), k as (select (count(*) * 0.2)::int k from pool), ce as (select class, count(*) n from (select distinct class, gc_bin, length_bin from o where class is not null) group by 1), qu as (select class, greatest(1, greatest(1, (select k from k) // (select count(*) from ce)) // n) quota from ce), f as (select seqid from (select seqid, quota, row_number() over (partition by class, gc_bin, length_bin order by ord) p from o join qu using (class)) where p <= quota), r as (select seqid from (select seqid, row_number() over (order by ord) p from o where seqid not in (select seqid from f)) where p + (select count(*) from f) <= (select k from k)) select p.seqid, p.class, p.length, c.length sequence_length from pool p left join fx_contigs c on c.contig_id = p.seqid where p.seqid in (select seqid from f union all select seqid from r)")
def _(c, m):
    seqs, meta = sm.subsample(c.withColumnRenamed("contig_id", "seqid"), m, 0.2)
    return meta.join(seqs.select("seqid", F.col("length").alias("sequence_length")), "seqid", "left").select("seqid", "class", "length", "sequence_length")


@query("subset_summary", "fx_catalog", sql="with s as (select * from fx_catalog where hq and ('0x' || substr(md5('7:' || seqid), 1, 8))::bigint / 4294967296.0 < 0.25), f as (select class, count(*) n_full from fx_catalog group by 1), g as (select class, count(*) n, min(length) min_length, max(length) max_length, min(gc) min_gc, max(gc) max_gc from s group by 1) select g.*, n_full, n::double / n_full ratio from g join f on g.class is not distinct from f.class")
def _(c):
    return sm.subset_summary(c, sm.sample_hq(c, 0.25, 7))


@query("select_sequences", "fx_contigs", "fx_truth", sql="select contig_id, length from fx_contigs where contig_id in (select contig_id from fx_truth where mismatches = 1 and strand)")
def _(c, t):
    return rd.select_sequences(c, t.where("mismatches = 1 and strand"), "contig_id").select("contig_id", "length")


# catalogue and ids
@query("extract_ranks", "fx_catalog", sql="select seqid, " + ", ".join(f"nullif(regexp_extract(lineage, '(?:^|;){v}__([^;]*)', 1), '') \"{k}\"" for k, v in cat.RANKS.items()) + " from fx_catalog")
def _(c):
    return cat.extract_ranks(c.drop("class")).select("seqid", *cat.RANKS)


@query("exclude_taxa", "fx_catalog", sql="select seqid, class from fx_catalog where coalesce(class not in ('class_1', 'class_2'), true)")
def _(c):
    return cat.exclude_taxa(c, {"class": ["class_1", "class_2"]}).select("seqid", "class")


@query("contig_catalog", "part", sql="select concat_ws('|', 'U' || p_partkey, p_size::varchar, 'S' || p_partkey % 5, nullif(case when p_partkey % 3 = 0 then 'whole' else '1-' || p_size end, 'whole')) seqid, p_partkey * 10 length, (p_partkey % 100) / 100.0::double gc, p_partkey % 4 = 0 hq from part where p_partkey * 10 > 1000 and p_size % 7 <> 0 and p_partkey % 11 <> 0")
def _(p):
    k = F.col("p_partkey")
    info = p.select(F.concat(F.lit("U"), k).alias("UVIG"), F.col("p_size").cast("string").alias("Taxon_oid"), F.concat(F.lit("S"), k % 5).alias("Scaffold_oid"), F.when(k % 3 == 0, "whole").otherwise(F.concat(F.lit("1-"), "p_size")).alias("coordinates"), (k * 10).alias("Length"), F.when(F.col("p_size") % 7 == 0, "GVMAG").otherwise("Linear").alias("Topology"), F.when(k % 11 == 0, ";;;;;").otherwise("r__A;k__B").alias("Taxonomic classification"), F.when(k % 4 == 0, "High-quality").otherwise("Draft").alias("MIUViG quality"))
    stats = cat.build_contig_id(info).select("seqid", F.col("Length").alias("length"), ((F.regexp_extract("UVIG", r"(\d+)", 1).cast("long") % 100) / 100).alias("GC"))
    return cat.prepare_contig_catalog(stats, info).select("seqid", "length", "gc", "hq")


@query("prefixes", "fx_truth", sql="with i as (select spacer_id, 'contig_' || start c, case when start % 2 = 0 then '0123abcd_contig_' || start else 'contig_' || start end id from fx_truth) select spacer_id, id, 'deadbeef_' || c added, c stripped, id <> c has from i")
def _(t):
    i = t.select("spacer_id", F.concat(F.when(F.col("start") % 2 == 0, "0123abcd_").otherwise(""), F.lit("contig_"), "start").alias("id"))
    return i.select("spacer_id", "id", cat.add_prefix("id", "deadbeef").alias("added"), cat.strip_prefix("id").alias("stripped"), cat.has_prefix("id").alias("has"))


@query("append_like", "fx_hits", "fx_intervals", sql='select spacer_id, contig_id, strand, start, "end", mismatches, tool from fx_hits union all select spacer_id, contig_id, strand, start, "end", mismatches, tool from fx_intervals')
def _(h, i):
    return cat.append_like(h.drop("spacer_length"), i.select("tool", "mismatches", F.col("end").cast("string").alias("end"), "start", "strand", "contig_id", "spacer_id"))


@query("filter_tools", "fx_hits", sql="select tool, count(*) n from fx_hits where tool not in ('tool_2') group by 1")
def _(h):
    return cat.filter_tools(h, skip=["tool_2"]).groupBy("tool").agg(F.count("*").alias("n"))


@query("short_hash", "fx_catalog", sql="select seqid, substring(sha256(seqid), 1, 8) h from fx_catalog")
def _(c):
    return c.select("seqid", cat.short_hash("seqid").alias("h"))


# accounting
_JE = f"with d as (select *, split_part(JobID, '.', 1) job, {_DUR('Elapsed')} el, {_DUR('TotalCPU')} cp, rtrim(MaxRSS, 'K')::double / 1024 rss from fx_accounting), je as (select job, arg_min(JobName, JobID) name, max(AllocCPUS) cpus, string_agg(distinct State, ',' order by State) states, '0:0' exit_codes, max(rss) rss_mb, 256000.0::double req_mb, sum(el)::bigint elapsed_s, sum(cp)::bigint cpu_s from d group by 1 having not bool_or(State like '%CANCELLED%' or State like '%FAILED%'))"


@query("job_efficiency", "fx_accounting", sql=_JE + " select *, round(100 * cpu_s / nullif(elapsed_s * cpus, 0)::double, 2) cpu_pct, round(100 * rss_mb / req_mb, 2) mem_pct from je")
def _(a):
    return rs.job_efficiency(a)


def _jobs(a):
    j = rs.job_efficiency(a, drop_failed=False)
    return j.select(F.regexp_replace("name", "_long$", "").alias("tool"), (F.col("job").cast("long") % 7).alias("fraction"), "job", F.element_at(F.split("states", ","), -1).alias("state"), F.col("name").endswith("_long").alias("is_long"), "elapsed_s", "cpu_s", "cpus", "rss_mb")


_JB = _JE.split(" having")[0] + "), jb as (select regexp_replace(name, '_long$', '') tool, job::bigint % 7 fraction, job, string_split(states, ',')[-1] state, name like '%\\_long' escape '\\' is_long, elapsed_s, cpu_s, cpus, rss_mb from je)"


@query("best_job", "fx_accounting", sql=_JB + ", e as (select *, bool_or(not is_long and state <> 'COMPLETED') over (partition by tool, fraction) fl, row_number() over (partition by tool, fraction order by case when is_long and state = 'COMPLETED' then 0 when is_long then 1 when state = 'COMPLETED' then 2 else 3 end, job desc) r from jb where state not like '%CANCELLED%') select tool, fraction, job, state, is_long, elapsed_s, case when cpu_s < 1 then elapsed_s else cpu_s end cpu_s, cpus, rss_mb, is_long and fl replaced_failed_job from e where r = 1")
def _(a):
    return rs.select_best_job(_jobs(a))


@query("resource_summary", "fx_accounting", sql=_JB + " select tool, fraction, count(*) n_jobs, round(avg(cpu_s / 3600.0::double), 6) avg_cpu_h, round(min(cpu_s / 3600.0::double), 6) min_cpu_h, round(max(cpu_s / 3600.0::double), 6) max_cpu_h, round(sum(cpu_s / 3600.0::double), 6) sum_cpu_h, round(avg(rss_mb / 1024), 6) avg_gb, round(max(rss_mb / 1024), 6) max_gb, string_agg(distinct cpus::varchar, ',' order by cpus::varchar) cpus from jb group by 1, 2".replace("string_agg(distinct cpus::varchar, ',' order by cpus::varchar)", "array_to_string(list_sort(list(distinct cpus)), ',')"))
def _(a):
    r = rs.resource_summary(_jobs(a), ["tool", "fraction"])
    return r.select("tool", "fraction", "n_jobs", *(F.round(c, 6).alias(c) for c in ("avg_cpu_h", "min_cpu_h", "max_cpu_h", "sum_cpu_h", "avg_gb", "max_gb")), "cpus")


@query("label_settings", "fx_accounting", sql=_JB + " select job, case when tool = 'tool_1' and fraction <= 2 then 'k3' when tool = 'tool_1' and fraction <= 6 then 'k1' when tool = 'tool_2' and fraction <= 3 then 'all' else 'N/A' end setting, case when tool = 'tool_1' and fraction <= 2 then 'tool_1_k3' when tool = 'tool_1' and fraction <= 6 then 'tool_1_k1' when tool = 'tool_2' and fraction <= 3 then 'tool_2_all' else tool end display from jb")
def _(a):
    return rs.label_settings(_jobs(a), [("tool_1", 2, "k3"), ("tool_1", 6, "k1"), ("tool_2", 3, "all")]).select("job", "setting", "display")


@query("extrapolate", "fx_accounting", sql=_JB + " select job, cpu_s * case when tool = 'tool_3' and fraction = 6 then 2.266::double else 1 end cpu_s, case when tool = 'tool_3' and fraction = 6 then 'COMPLETED' else state end state from jb")
def _(a):
    rules = a.sparkSession.createDataFrame([("tool_3", 6, 2.266)], "tool string, fraction long, factor double")
    return rs.extrapolate(_jobs(a), rules).select("job", "cpu_s", "state")


@query("failed_jobs", "fx_accounting", sql="select JobName, State, count(*) n from fx_accounting where State in ('FAILED', 'TIMEOUT') group by 1, 2")
def _(a):
    return rs.failed_jobs(a)


@query("format_duration", "fx_accounting", sql=f"with d as (select JobID, JobName, Elapsed, {_DUR('Elapsed')} s from fx_accounting) select JobID, JobName, s, case when s >= 86400 then (s // 86400) || '-' else '' end || lpad((s % 86400 // 3600)::varchar, 2, '0') || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') text from d")
def _(a):
    return a.select("JobID", "JobName", rs.parse_duration("Elapsed").alias("s")).withColumn("text", rs.format_duration("s"))


@query("scale_sizes", "fx_catalog", sql="select seqid, length size, dense_rank() over (order by length)::int size_rank, round(3 + 7 * (log10(length) - (select log10(min(length)) from fx_catalog)) / (select log10(max(length)) - log10(min(length)) from fx_catalog), 6) scaled from fx_catalog")
def _(c):
    return rs.scale_sizes(c.select("seqid", F.col("length").alias("size"))).withColumn("scaled", F.round("scaled", 6))


@query("dataset_stats", "fx_spacers", "fx_contigs", sql="select a.*, b.*, spacer_bp * contig_bp search_space from (select count(*) n_spacers, sum(length(seq))::bigint spacer_bp from fx_spacers) a, (select count(*) n_contigs, sum(length)::bigint contig_bp from fx_contigs) b")
def _(s, c):
    return rs.dataset_stats(s.withColumn("length", F.length("seq")), c)


@query("join_logs", "fx_accounting", sql=_JE + " select l.job, regexp_extract(p, '([^/]+)-\\d+\\.(?:out|err)$', 1) tool, 0.1::double fraction, je.cpus from (select distinct split_part(JobID, '.', 1) job, 'x/fraction_0.1/slurm_logs/t-' || split_part(JobID, '.', 1) || '.out' p from fx_accounting) l join je using (job)")
def _(a):
    path = F.concat(F.lit("x/fraction_0.1/slurm_logs/t-"), F.element_at(F.split("JobID", r"\."), 1), F.lit(".out"))
    logs = rd.parse_log_paths(a.select(path.alias("path")).distinct()).select("job", "tool", "fraction")
    return rd_join(logs, rs.job_efficiency(a))


def rd_join(logs, jobs):
    return rs.join_logs(logs, jobs).select("job", "tool", "fraction", "cpus")


# readers, on lines written from the views
_LEN = "select spacer_id, length(seq) length from fx_spacers"


def _lengths(s):
    return s.select("spacer_id", F.length("seq").alias("length"))


@query("read_fasta", "fx_contigs", sql="select contig_id || ' doc ' || doc_id seqid, md5(seq) seq from fx_contigs")
def _(c):
    rec = c.select(F.concat(F.lit(">"), "contig_id", F.lit(" doc "), "doc_id", F.lit("\n"), F.substring("seq", 1, 60), F.lit("\n"), F.expr("substring(seq, 61)"), F.lit("\n")).alias("value"))
    return rd.fasta_records(rec).withColumn("seq", F.md5(F.col("seq").cast("binary")))


@query("read_sassy", "fx_hits", "fx_spacers", sql=f'select distinct spacer_id, contig_id, length::int spacer_length, strand, start, "end", mismatches from fx_hits join ({_LEN}) using (spacer_id) where mismatches <= 3 and mismatches % 2 = 0')
def _(h, s):
    rows = h.select(F.col("spacer_id").alias("pat_id"), F.col("contig_id").alias("text_id"), F.col("mismatches").alias("cost"), F.when(F.col("strand"), "-").otherwise("+").alias("strand"), "start", "end", F.expr("concat('ACGT', repeat('N', mismatches % 2 * 6))").alias("match_region"), F.expr("concat(spacer_length, '=')").alias("cigar"))
    return rd.hits_of_sassy(rows, _lengths(s), 3)


@query("read_blast", "fx_hits", "fx_spacers", sql=f'select distinct spacer_id, contig_id, length::int spacer_length, strand, start, "end", mismatches from fx_hits join ({_LEN}) using (spacer_id) where mismatches <= 4')
def _(h, s):
    n, m = F.col("spacer_length"), F.col("mismatches")
    a, b = F.col("start") + 1, F.col("end")
    rows = h.select(F.col("spacer_id").alias("query"), F.col("contig_id").alias("target"), (n - m).alias("nident"), n.alias("alnlen"), m.alias("mismatch"), n.alias("qlen"), F.lit(0).alias("gapopen"), F.lit(1).alias("qstart"), n.alias("qend"), F.when(F.col("strand"), b).otherwise(a).alias("tstart"), F.when(F.col("strand"), a).otherwise(b).alias("tend"))
    return rd.hits_of_blast(rows, _lengths(s), 4)


def _sam(h):
    return h.select(F.concat_ws("\t", "spacer_id", F.when(F.col("strand"), "16").otherwise("0"), "contig_id", F.col("start") + 1, F.lit("60"), F.concat("spacer_length", F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), "mismatches")).alias("value"))


@query("read_sam", "fx_hits", "fx_spacers", sql=f'select distinct spacer_id, contig_id, length::int spacer_length, strand, start, start + spacer_length "end", (length - spacer_length + mismatches)::int mismatches from fx_hits join ({_LEN}) using (spacer_id) where mismatches <= 3 and length - spacer_length + mismatches <= 3')
def _(h, s):
    return rd.hits_of_sam(_sam(h), _lengths(s), 3)


@query("sam_dropped", "fx_hits", "fx_spacers", sql=f"select count(*) records, count(*) filter (length is null) unknown_spacer, count(*) filter (d < 0) negative, count(*) filter (d >= 0 and greatest(d, mismatches) > 2) over_limit from (select *, length - spacer_length + mismatches d from fx_hits left join (select * from ({_LEN}) where split_part(spacer_id, '_', 2)::bigint % 3 > 0) using (spacer_id))")
def _(h, s):
    """A third of the spacers are unknown to the reader."""
    counts = Observation()
    known = _lengths(s).where("cast(split_part(spacer_id, '_', 2) as bigint) % 3 > 0")
    return _observed(rd.hits_of_sam(_sam(h), known, 2, counts=counts), counts)


@query("read_sam_cigar_total", "fx_hits", "fx_spacers", sql=f'select distinct spacer_id, contig_id, length::int spacer_length, strand, start, start + spacer_length "end", (length - spacer_length + mismatches)::int mismatches from fx_hits join ({_LEN}) using (spacer_id) where length - spacer_length + mismatches between 0 and 3')
def _(h, s):
    return rd.hits_of_sam(_sam(h), _lengths(s), 3, "cigar_total")


@query("read_tab", "fx_hits", "fx_spacers", sql=f'select distinct spacer_id, contig_id, length::int spacer_length, strand, start, "end", 0 mismatches from fx_hits join ({_LEN}) using (spacer_id)')
def _(h, s):
    return rd.hits_of_tab(h.select("contig_id", "spacer_id", "start", "end", F.when(F.col("strand"), "-").otherwise("+").alias("strand")), _lengths(s))


@query("read_ground_truth", "fx_hits", sql=f"select {HK}, min(mismatches) mismatches from fx_hits where mismatches <= 2 group by all")
def _(h):
    return rd.truth_of(h, 2)


@query("query_fractions", "fx_intervals", sql="select fraction, tool, count(*) n, avg(mismatches) mean from fx_intervals group by 1, 2")
def _(i):
    return rd.query_fractions(i, "select fraction, tool, count(*) n, avg(mismatches) mean from {fractions} group by 1, 2")


@query("parse_dataset_name", "fx_truth", sql="select distinct 's/ns_' || start || '_nc_' || \"end\" || '_x' as name, start ns, \"end\" nc from fx_truth")
def _(t):
    d = t.select(F.concat(F.lit("s/ns_"), "start", F.lit("_nc_"), "end", F.lit("_x")).alias("name")).distinct()
    ns, nc = rd.parse_dataset_name("name")
    return d.select("name", ns.alias("ns"), nc.alias("nc"))


# files: written to the shared folder, then read
def _path(df: DataFrame, name: str) -> str:
    return f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"


@query("fasta_file", "fx_contigs", sql="select contig_id seqid, md5(seq) seq from fx_contigs")
def _(c):
    path = _path(c, "contigs.fasta")
    rd.write_fasta(c.select(F.col("contig_id").alias("seqid"), "seq"), path)
    return rd.read_fasta(c.sparkSession, path).withColumn("seq", F.md5(F.col("seq").cast("binary")))


def _sassy_rows(h):
    return h.select(F.col("spacer_id").alias("pat_id"), F.col("contig_id").alias("text_id"), F.col("mismatches").alias("cost"), F.when(F.col("strand"), "-").otherwise("+").alias("strand"), "start", "end", F.lit("ACGT").alias("match_region"), F.concat("spacer_length", F.lit("=")).alias("cigar"))


def _tab_rows(h):
    return h.select("contig_id", "spacer_id", "start", "end", F.when(F.col("strand"), "-").otherwise("+").alias("strand"))


@query("read_all_tools", "fx_hits", "fx_spacers", sql=f'with l as ({_LEN}), x as (select spacer_id, contig_id, length::int spacer_length, strand, start, "end", mismatches, \'sassy\' tool from fx_hits join l using (spacer_id) where mismatches <= 3 union select spacer_id, contig_id, length::int, strand, start, start + spacer_length, (length - spacer_length + mismatches)::int, \'sam\' from fx_hits join l using (spacer_id) where mismatches <= 3 and length - spacer_length + mismatches between 0 and 3 union select spacer_id, contig_id, length::int, strand, start, "end", 0, \'tab\' from fx_hits join l using (spacer_id)) select * from x')
def _(h, s):
    spark = h.sparkSession
    sassy, sam, tab = (_path(h, n) for n in ("sassy", "sam", "tab"))
    rd.save(_sassy_rows(h), sassy, "tsv")
    _sam(h).write.text(sam)
    _tab_rows(h).write.csv(tab, sep="\t")
    specs = [("sassy", "sassy", sassy), ("sam", "sam", sam), ("tab", "tab", tab), ("missing", "blast", _path(h, "none"))]
    return rd.read_all_tools(spark, specs, _lengths(s), 3)


@query("metadata_file", "fx_catalog", sql="select seqid, length, gc, hq from fx_catalog")
def _(c):
    path = _path(c, "catalog.tsv")
    rd.save(c.select("seqid", "length", "gc", "hq"), path, "tsv")
    return rd.read_metadata(c.sparkSession, path, schema="seqid string, length long, gc double, hq boolean")


@query("load_fractions", "fx_intervals", sql="select (fraction / 10.0)::double fraction, tool, count(*) n from fx_intervals group by 1, 2")
def _(i):
    paths = {f / 10: _path(i, f"fraction_{f}.parquet") for f in range(3)}
    for f, path in paths.items():
        rd.save(i.where(F.col("fraction") == round(10 * f)).drop("fraction"), path)
    return rd.load_fractions(i.sparkSession, {**paths, 0.9: _path(i, "none.parquet")}).groupBy("fraction", "tool").agg(F.count("*").alias("n"))


@query("timings_file", "fx_accounting", sql=f"select round(avg({_DUR('Elapsed')}), 6) mean, 0.0::double stddev, 'run' command from fx_accounting group by AllocCPUS")
def _(a):
    path = _path(a, "timings")
    runs = a.groupBy("AllocCPUS").agg(F.array(F.struct(F.round(F.avg(rs.parse_duration("Elapsed")), 6).alias("mean"), F.lit(None).cast("double").alias("stddev"), F.lit("run").alias("command"))).alias("results")).select("results")
    runs.repartition(8).write.option("maxRecordsPerFile", 1).json(path)  # a file for each run
    return rd.read_timings(a.sparkSession, [path]).select("mean", "stddev", "command")


@query("accounting_file", "fx_accounting", sql=_JE + " select *, round(100 * cpu_s / nullif(elapsed_s * cpus, 0)::double, 2) cpu_pct, round(100 * rss_mb / req_mb, 2) mem_pct from je")
def _(a):
    path = _path(a, "accounting")
    a.write.csv(path, sep="|", header=True)
    return rs.job_efficiency(rd.read_accounting(a.sparkSession, path))


@query("read_sam_clips", "fx_hits", "fx_spacers", sql=f"select distinct spacer_id, contig_id, length::int spacer_length, strand, start, start + spacer_length - 1 \"end\", (length - spacer_length + mismatches + 4)::int mismatches from fx_hits join ({_LEN}) using (spacer_id) where length - spacer_length + mismatches + 4 between 0 and 6 and mismatches + 2 <= 6")
def _(h, s):
    """Two letters clipped, one letter of the contig skipped."""
    cigar = F.concat(F.lit("2S"), F.col("spacer_length") - 5, F.lit("M1D3M"))
    lines = h.select(F.concat_ws("\t", "spacer_id", F.when(F.col("strand"), "16").otherwise("0"), "contig_id", F.col("start") + 1, F.lit("60"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("AS:i:9"), F.concat(F.lit("NM:i:"), "mismatches")).alias("value"))
    return rd.hits_of_sam(lines, _lengths(s), 6)


@query("read_blast_gaps", "fx_hits", "fx_spacers", sql=f'select distinct spacer_id, contig_id, length::int spacer_length, strand, start, "end", (mismatches + start % 2)::int mismatches from fx_hits join ({_LEN}) using (spacer_id) where mismatches + start % 2 <= 4')
def _(h, s):
    """Gaps in rows of odd starts, queries that run backwards in the others."""
    n, m, odd = F.col("spacer_length"), F.col("mismatches"), F.col("start") % 2
    a, b = F.col("start") + 1, F.col("end")
    low, high = F.when(F.col("strand"), b).otherwise(a), F.when(F.col("strand"), a).otherwise(b)
    rows = h.select(F.col("spacer_id").alias("query"), F.col("contig_id").alias("target"), (n - m).alias("nident"), n.alias("alnlen"), m.alias("mismatch"), n.alias("qlen"), odd.cast("int").alias("gapopen"), F.when(odd == 1, 1).otherwise(n).alias("qstart"), F.when(odd == 1, n).otherwise(1).alias("qend"), F.when(odd == 1, low).otherwise(high).alias("tstart"), F.when(odd == 1, high).otherwise(low).alias("tend"))
    return rd.hits_of_blast(rows, _lengths(s), 4)


# search
#: The same pigeonhole as a join: whole pieces of each spacer and strand with all words of the contigs.
_SEARCH = "with n0 as (select distinct seq from fx_spacers where length(seq) > 3), n1 as (select seq, false strand, seq x from n0 union all select seq, true, reverse(translate(seq, 'ACGT', 'TGCA')) from n0), p as (select *, length(x) // 4 q, (j * length(x)) // 4 off from n1, (values (0), (1), (2), (3)) v(j)), n as (select *, substring(x, off::int + 1, q::int) word from p), c as (select contig_id, seq cseq, length, unnest(range(0, length)) pos from fx_contigs), w as (select contig_id, pos, q, substring(cseq, pos::int + 1, q::int) word, substring(cseq, greatest(pos - 40, 0)::int + 1, 90) around, greatest(pos - 40, 0) base, length from c, (select distinct q from p) z where pos + q <= length), m as (select n.seq, n.strand, w.contig_id, w.pos - n.off s, length(n.x) l, hamming(substring(around, (w.pos - n.off - base + 1)::int, length(n.x)::int), n.x) d from w join n using (q, word) where w.pos >= n.off and w.pos - n.off + length(n.x) <= w.length), h as (select distinct seq, strand, contig_id, s, l, d from m where d <= 3) select spacer_id, contig_id, s start, s + l \"end\", strand, d::int mismatches from h join fx_spacers using (seq)"


@query("protospacer_search", "fx_spacers", "fx_contigs", sql=_SEARCH)
def _(s, c):
    return search.protospacer_search(s, c, 3)
