"""Classification of hits against truth and sequences, and metrics per tool and threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from protospark.functions.distance import all_distances, hamming, render_alignment, validate
from protospark.operators.joins import assign_regions, attach_regions, attach_sequences, attach_spacers, locate, match_with_tolerance, merge_intervals
from protospark.schemas import GROUP_KEY, HIT_KEY
from protospark.session import cut
from protospark.sources.blocks import BlockedSequences

PLANNED, UNPLANNED, INVALID = "positive_in_plan", "positive_not_in_plan", "invalid_alignment"
COMBINED = "all_tools_combined"


def unique_hits(hits: DataFrame) -> DataFrame:
    return hits.select(*HIT_KEY).distinct()


def classify_unique(truth, hits, contigs, spacers, max_distance: int = 5, metric: str = "edit", tol: int = 5) -> DataFrame:
    """One row per location: ``start_gt, end_gt, classification, recalculated_distance``.

    In plan if truth lies within ``tol`` (the distance is then the planned one); else valid if the recomputed distance is at most
    ``max_distance``; a missing sequence makes it invalid.
    """
    unique = unique_hits(hits)
    matched = match_with_tolerance(truth, unique, tol)
    planned = matched.select(*HIT_KEY, "start_gt", "end_gt", F.lit(PLANNED).alias("classification"), F.col("mismatches_gt").cast("int").alias("recalculated_distance"))
    rest = validate(attach_sequences(unique.join(matched.select(*HIT_KEY), HIT_KEY, "left_anti"), spacers, contigs), metric)
    kind = F.when(F.col("alignment_test") <= max_distance, UNPLANNED).otherwise(INVALID)
    null = F.lit(None).cast("long")
    rest = rest.select(*HIT_KEY, null.alias("start_gt"), null.alias("end_gt"), kind.alias("classification"), F.col("alignment_test").alias("recalculated_distance"))
    return planned.unionByName(rest)


def classify(truth, hits, contigs, spacers, max_distance: int = 5, metric: str = "edit", tol: int = 5) -> DataFrame:
    """Every hit with its location's classification."""
    return hits.join(classify_unique(truth, hits, contigs, spacers, max_distance, metric, tol), HIT_KEY, "left")


def classify_locations(truth, hits, contigs, spacers, max_distance: int = 5, metric: str = "edit", tol: int = 5) -> DataFrame:
    """Each location once, classified as in ``classify_unique``, with the ``tools`` that report it. Written to the shared folder.

    A location whose sequences are missing, or whose hits name no tool (``tools`` is empty then), stays.
    """
    found = cut(locate(truth, hits, tol))
    rest = validate(attach_sequences(found.where("start_gt is null").select(*HIT_KEY, "tools"), spacers, contigs), metric)
    null = F.lit(None).cast("long")
    kind = F.when(F.col("alignment_test") <= max_distance, UNPLANNED).otherwise(INVALID)
    rest = rest.select(*HIT_KEY, "tools", null.alias("start_gt"), null.alias("end_gt"), kind.alias("classification"), F.col("alignment_test").alias("recalculated_distance"))
    planned = found.where("start_gt is not null").select(*HIT_KEY, "tools", "start_gt", "end_gt", F.lit(PLANNED).alias("classification"), F.col("mismatches_gt").cast("int").alias("recalculated_distance"))
    return cut(planned.unionByName(rest))


def with_combined(hits: DataFrame) -> DataFrame:
    """Adds all locations, once each, as a tool of their own."""
    return hits.unionByName(hits.dropDuplicates(HIT_KEY).withColumn("tool", F.lit(COMBINED)))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def tool_performance(classified: DataFrame, truth: DataFrame, merge_tol: int = 3) -> DataFrame:
    """Counts, precision, recall and F1 per tool, against planned truth and truth with merged unplanned positives."""
    found = F.when(F.col("classification") == PLANNED, F.struct("spacer_id", "contig_id", "start_gt", "end_gt", "strand"))
    wrong = F.when(F.col("classification") == INVALID, F.struct(*HIT_KEY))
    per = classified.groupBy("tool").agg(F.count_distinct(found).alias("planned_true_positives"), F.count_distinct(wrong).alias("invalid_alignments"))
    extra = classified.where(F.col("classification") == UNPLANNED)
    own = merge_intervals(extra, merge_tol, ["tool"]).groupBy("tool").agg(F.count("*").alias("positives_not_in_plan"))
    merged = merge_intervals(extra.select(*HIT_KEY).distinct(), merge_tol).agg(F.count("*").alias("merged"))
    return _rates(per, own, merged, truth)


def location_performance(locations: DataFrame, truth: DataFrame, merge_tol: int = 3) -> DataFrame:
    """``tool_performance`` with the combined tool, from rows as of ``classify_locations``: intervals are merged once, for all tools and the combined one."""
    long = locations.withColumn("tool", F.explode(F.concat("tools", F.array(F.lit(COMBINED))))).drop("tools")
    found = F.when(F.col("classification") == PLANNED, F.struct("spacer_id", "contig_id", "start_gt", "end_gt", "strand"))
    per = long.groupBy("tool").agg(F.count_distinct(found).alias("planned_true_positives"), F.count_if(F.col("classification") == INVALID).alias("invalid_alignments"))
    own = merge_intervals(long.where(F.col("classification") == UNPLANNED), merge_tol, ["tool"]).groupBy("tool").agg(F.count("*").alias("positives_not_in_plan"))
    own = cut(own)  # a row per tool, read for the tools and for the truth with merged positives
    return _rates(per, own, own.where(F.col("tool") == COMBINED).agg(F.coalesce(F.sum("positives_not_in_plan"), F.lit(0).cast("long")).alias("merged")), truth)


def _rates(per: DataFrame, own: DataFrame, merged: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts of each tool, and of the truth and merged unplanned positives (one row), as precision, recall and F1."""
    gt = truth.agg(F.count("*").alias("ground_truth_planned")).crossJoin(merged).select("ground_truth_planned", (F.col("ground_truth_planned") + F.col("merged")).alias("ground_truth_augmented"))
    d = per.join(own, "tool", "left").fillna(0, ["positives_not_in_plan"]).crossJoin(F.broadcast(gt))
    tp, extra_, bad = F.col("planned_true_positives"), F.col("positives_not_in_plan"), F.col("invalid_alignments")
    d = d.withColumn("false_negatives_planned", F.col("ground_truth_planned") - tp).withColumn("all_true_positives", tp + extra_)
    d = d.withColumns({"precision_planned": _ratio(tp, tp + extra_ + bad), "recall_planned": _ratio(tp, tp + F.col("false_negatives_planned"))})
    every = F.col("all_true_positives")
    d = d.withColumns({"false_negatives_augmented": F.col("ground_truth_augmented") - every, "precision_augmented": _ratio(every, every + bad), "recall_augmented": _ratio(every, F.col("ground_truth_augmented"))})
    f1 = lambda s: _ratio(2 * F.col(f"precision_{s}") * F.col(f"recall_{s}"), F.col(f"precision_{s}") + F.col(f"recall_{s}"))
    return d.withColumns({"f1_planned": f1("planned"), "f1_augmented": f1("augmented")})


def false_negatives(truth: DataFrame, classified: DataFrame) -> DataFrame:
    """Truth rows that a tool has not found, for every tool."""
    key = ["spacer_id", "contig_id", "strand", "start", "end"]
    found = classified.where(F.col("classification") == PLANNED).select("tool", "spacer_id", "contig_id", "strand", F.col("start_gt").alias("start"), F.col("end_gt").alias("end")).distinct()
    tools = classified.select("tool").distinct()
    return truth.crossJoin(F.broadcast(tools)).join(found, [*key, "tool"], "left_anti")


def false_negative_counts(truth: DataFrame, classified: DataFrame) -> DataFrame:
    """Per tool, and for ``all_tools`` together: truth rows (``n_truth``), those missed, and their share in per cent.

    Found rows are counted, so the truth never meets the tools.
    """
    found = classified.where(F.col("classification") == PLANNED).select("tool", "spacer_id", "contig_id", "strand", F.col("start_gt").alias("start"), F.col("end_gt").alias("end")).distinct()
    key = ["spacer_id", "contig_id", "strand", "start", "end"]
    hit = truth.select(*key).join(found, key)
    own = hit.groupBy("tool").agg(F.count("*").alias("n_found"))
    every = hit.select(*key).distinct().agg(F.count("*").alias("n_found")).select(F.lit("all_tools").alias("tool"), "n_found")
    tools = classified.select("tool").distinct().join(own, "tool", "left").fillna(0, ["n_found"]).unionByName(every)
    total = F.broadcast(truth.agg(F.count("*").alias("n_truth")))
    missed = F.col("n_truth") - F.col("n_found")
    return tools.crossJoin(total).select("tool", "n_truth", missed.alias("n_missed"), (100 * _ratio(missed, F.col("n_truth"))).alias("missed_pct"))


def missed_by_all(truth: DataFrame, classified: DataFrame) -> DataFrame:
    """Truth rows that no tool has found."""
    found = classified.where(F.col("classification") == PLANNED).select("spacer_id", "contig_id", "strand", F.col("start_gt").alias("start"), F.col("end_gt").alias("end"))
    return truth.join(found, ["spacer_id", "contig_id", "strand", "start", "end"], "left_anti")


def examples(classified: DataFrame, spacers: DataFrame, contigs: DataFrame, n: int = 3, metric: str = "edit") -> DataFrame:
    """The first ``n`` locations of each class, with the tools that report them and their alignment."""
    loc = classified.groupBy("classification", *HIT_KEY).agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))
    top = loc.withColumn("r", F.row_number().over(Window.partitionBy("classification").orderBy(*HIT_KEY))).where(F.col("r") <= n)
    return render_alignment(attach_sequences(top, spacers, contigs), metric)


def compare(truth, hits, contigs, spacers, max_distance: int = 5, metric: str = "edit", timings: DataFrame | None = None) -> DataFrame:
    """The whole comparison: classify, add the combined tool, performance (and run times), best planned recall first.

    Locations are classified and written once, with their tools; every count reads them there, and hits are not joined back.
    """
    out = location_performance(classify_locations(truth, hits, contigs, spacers, max_distance, metric), truth)
    out = out if timings is None else out.join(timings, "tool", "left")
    return out.orderBy(F.desc("recall_planned"), "tool")


def multi_metric(truth, hits, contigs, spacers, max_distance: int = 5, tol: int = 5, affine: bool = True, limit: int | None = None) -> DataFrame:
    """One row per location: region, tools, all distances, truth and class (invalid only if every distance exceeds ``max_distance``).

    Distances beyond ``limit`` (``max_distance`` at least) are null and are not computed to the end; see ``all_distances``.
    Locations are gathered with their truth and written once; regions, sequences and distances are added to these rows.
    """
    if limit is not None and limit < max_distance:
        raise ValueError("limit is below max_distance")
    per = cut(locate(truth, hits, tol, least="mismatches").withColumnRenamed("mismatches", "reported_mismatches"))
    longest = per.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    match = ["start_gt", "end_gt", "mismatches_gt"]
    d = all_distances(attach_sequences(assign_regions(per, tol), spacers, contigs, longest=longest or 0), affine=affine, limit=limit)
    d = d.select(*HIT_KEY, *(c for c in d.columns if c not in (*HIT_KEY, *match)), *match)
    least = F.least("hamming", "edit", *(["gap_affine"] if affine else []))
    kind = F.when(F.col("start_gt").isNotNull(), PLANNED).when(least <= max_distance, UNPLANNED).otherwise(INVALID)
    return d.withColumns({"classification": kind, "planned_mismatches": F.coalesce("mismatches_gt", "hamming")})


def metrics_at(df: DataFrame, metrics: Sequence[str], thresholds: Sequence[int], space: DataFrame | None = None) -> DataFrame:
    """Counts by class and recall, precision and invalid share for each distance and threshold, in one pass.

    With ``space`` (one row, as from ``dataset_stats``) also spurious locations per million pairs of spacer and contig, and per 10^18 products of bases.

    ``df``: as from ``multi_metric``. A location in plan counts as found if within the threshold, one not in plan as spurious.
    """
    long = df.select("classification", *metrics).unpivot(["classification"], list(metrics), "metric", "distance")
    t = df.sparkSession.createDataFrame([(int(x),) for x in thresholds], "threshold int")
    n = lambda c: F.count_if(c)
    planned, within = F.col("classification") == PLANNED, F.col("distance") <= F.col("threshold")
    out = long.join(F.broadcast(t), F.lit(True)).groupBy("metric", "threshold").agg(
        n(planned).alias("n_planned"), n(planned & within).alias("true_positives"), n(~planned & within).alias("spurious"), n(~planned & ~within).alias("invalid"), F.count("*").alias("n")
    )
    tp, sp, bad = F.col("true_positives"), F.col("spurious"), F.col("invalid")
    out = out.withColumns({"recall_planned": _ratio(tp, F.col("n_planned")), "precision_planned": _ratio(tp, tp + sp + bad), "precision_augmented": _ratio(tp + sp, tp + sp + bad), "invalid_pct": 100 * _ratio(bad, F.col("n"))})
    if space is None:
        return out
    size = F.broadcast(space.select((F.col("n_spacers") * F.col("n_contigs").cast("double")).alias("_pairs"), (F.col("spacer_bp") * F.col("contig_bp").cast("double")).alias("_bp2")))
    return out.crossJoin(size).withColumns({"spurious_per_m_pairs": F.try_divide(sp * 1e6, F.col("_pairs")), "spurious_per_gbp2": F.try_divide(sp * 1e18, F.col("_bp2"))}).drop("_pairs", "_bp2")


def threshold_sweep(df: DataFrame, truth: DataFrame, thresholds: Sequence[int], metric: str = "edit") -> DataFrame:
    """For each threshold: truth within it that is identified or missed, and locations that are spurious or invalid, in per cent.

    ``df``: as from ``multi_metric``. Locations are counted by their distances, and truth by the threshold it is first identified at; only these counts meet the thresholds.
    """
    t = df.sparkSession.createDataFrame([(int(x),) for x in thresholds], "threshold int")
    at = lambda d, c: d.join(F.broadcast(t), F.col(c) <= F.col("threshold")).groupBy("threshold")
    total = at(truth.groupBy("mismatches").agg(F.count("*").alias("_n")), "mismatches").agg(F.sum("_n").alias("n_truth"))
    read = df.where(F.col("reported_mismatches").isNotNull())
    in_plan = read.where(F.col("start_gt").isNotNull() & F.col("mismatches_gt").isNotNull())
    first = in_plan.groupBy("spacer_id", "contig_id", "strand", "start_gt", "end_gt").agg(F.min(F.greatest("reported_mismatches", "mismatches_gt")).alias("_first"))
    found = at(first.groupBy("_first").agg(F.count("*").alias("_n")), "_first").agg(F.sum("_n").alias("identified"))
    by = read.groupBy("reported_mismatches", F.col("start_gt").isNotNull().alias("_planned"), "mismatches_gt", metric).agg(F.count("*").alias("_n"))
    planned = F.col("_planned") & F.coalesce(F.col("mismatches_gt") <= F.col("threshold"), F.lit(False))
    within = F.coalesce(F.col(metric) <= F.col("threshold"), F.lit(False))
    n = lambda c, name: F.sum(F.when(c, F.col("_n")).otherwise(0)).alias(name)
    out = at(by, "reported_mismatches").agg(n(~planned & within, "spurious"), n(~planned & ~within, "invalid"), F.sum("_n").alias("n"))
    out = found.join(out, "threshold", "right").select("threshold", F.coalesce("identified", F.lit(0).cast("long")).alias("identified"), "spurious", "invalid", "n")
    out = total.join(out, "threshold", "left").fillna(0)
    pct = lambda a, b: 100 * _ratio(F.col(a), F.col(b))
    return out.withColumn("missed", F.col("n_truth") - F.col("identified")).withColumns({"identified_pct": pct("identified", "n_truth"), "missed_pct": pct("missed", "n_truth"), "spurious_pct": pct("spurious", "n"), "invalid_pct": pct("invalid", "n")})


def spurious_rates(df: DataFrame) -> DataFrame:
    """Per dataset: spurious hits by search space. ``df``: ``dataset, n_spurious, n_spacers, spacer_bp, n_contigs, contig_bp``."""
    n = F.col("n_spurious")
    return df.withColumns({"per_m_spacer_bp": F.try_divide(n * 1e6, F.col("spacer_bp")), "per_gbp2": F.try_divide(n * 1e18, F.col("spacer_bp") * F.col("contig_bp").cast("double")), "per_pair": F.try_divide(n.cast("double"), F.col("n_spacers") * F.col("n_contigs")), "per_1k_spacers": F.try_divide(n * 1e3, F.col("n_spacers"))})


def rate_summary(rates: DataFrame) -> DataFrame:
    """Mean, population deviation and Pearson correlation of the rates with the search space."""
    return rates.agg(F.avg("per_m_spacer_bp").alias("mean_rate"), F.stddev_pop("per_m_spacer_bp").alias("std_rate"), F.corr("n_spurious", F.col("spacer_bp") * F.col("contig_bp").cast("double")).alias("corr_space"))


def metric_agreement(df: DataFrame, metrics: Sequence[str] = ("hamming", "edit"), ts: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Means, extremes, how often the distances agree (counts and per cent), and how many pass each threshold."""
    a, b = metrics[0], metrics[1]
    cols = [f(m).alias(f"{k}_{m}") for m in metrics for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    share = lambda c: 100 * _ratio(F.count_if(c), F.count("*"))
    cols += [f.alias(f"{k}_{x}_{y}") for i, x in enumerate(metrics) for y in metrics[i + 1 :] for k, f in (("n", F.count_if(F.col(x) == F.col(y))), ("pct", share(F.col(x) == F.col(y))))]
    cols += [F.count_if(F.col(m) <= t).alias(f"pass_{m}_{t}") for m in metrics for t in ts]
    same = F.col(a) == F.col(b)
    for m in metrics[2:]:
        same = same & (F.col(m) == F.col(a))
    return df.agg(F.count("*").alias("n"), F.count_if(same).alias("n_all_equal"), share(same).alias("pct_all_equal"), *cols)


def disagreements(df: DataFrame, n: int, metrics: Sequence[str] = ("hamming", "edit"), seed: int = 42) -> DataFrame:
    """A sample of ``n`` locations whose distances differ (one may be missing), by a seeded hash of their key: the same in every run.

    Each task keeps its ``n`` smallest hashes, and these are merged, so no sort of all rows.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in HIT_KEY))
    differ = F.lit(False)
    for m in metrics[1:]:
        differ = differ | ~F.col(m).eqNullSafe(F.col(metrics[0]))
    return df.where(differ).withColumn("_order", F.md5(text.cast("binary"))).orderBy("_order", *HIT_KEY).limit(n).drop("_order")


def by_region(df: DataFrame) -> DataFrame:
    """Per region: locations, tools (joined in order), least Hamming distance. ``df``: as from ``multi_metric``."""
    return df.groupBy(*GROUP_KEY, "region_start").agg(F.count("*").alias("n_alignments"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))), ",").alias("tools"), F.min("hamming").alias("min_hamming"))


def region_summary(hits, contigs, spacers, tol: int = 5) -> DataFrame:
    """``by_region`` of ``multi_metric``, with nothing in it that a region does not show: no truth is met, and no other distance computed.

    Of contigs stored as blocks, hits are dealt once as these are; there the tools of a location are gathered and its region is cut. Locations are
    written once, with their distance, and then grouped by key. Tools are gathered as bits, 63 in a long, in as many longs as their names need.
    """
    longest, names = hits.agg(F.max(F.col("end") - F.col("start")), F.array_sort(F.collect_set("tool"))).first()
    place = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("tool")) - 1 if names else F.lit(None).cast("long")
    sets = [f"_tools_{i}" for i in range(-(-len(names) // 63))]
    bits = [F.when(F.floor(place / 63) == i, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 63).cast("int"))).otherwise(0).alias(c) for i, c in enumerate(sets)]
    gathered = [F.bit_or(c).alias(c) for c in sets]
    hits, blocked = hits.select(*HIT_KEY, *bits), isinstance(contigs, BlockedSequences) and (longest or 0) <= contigs.overlap + 1
    found = (contigs.deal(hits, "_at").groupBy(*HIT_KEY, "_at") if blocked else hits.groupBy(*HIT_KEY)).agg(F.count("*").alias("_n"), *gathered)
    found = attach_regions(found, contigs, longest or 0, at="_at") if blocked else attach_regions(found, contigs)
    found = attach_spacers(found, spacers).withColumn("hamming", hamming("spacer_seq", "region_seq"))
    found = assign_regions(cut(found.select(*HIT_KEY, *sets, "hamming")), tol)
    has = (F.when(F.col(sets[i // 63]).bitwiseAND(F.lit(1 << i % 63).cast("long")) != 0, F.lit(n)) for i, n in enumerate(names))
    tools = F.array_join(F.array(*has).cast("array<string>"), ",").alias("tools")
    out = found.groupBy(*GROUP_KEY, "region_start").agg(F.count("*").alias("n_alignments"), *gathered, F.min("hamming").alias("min_hamming"))
    return out.select(*GROUP_KEY, "region_start", "n_alignments", tools, "min_hamming")


def high_confidence(df: DataFrame, t: int, metrics: Sequence[str] = ("hamming", "edit")) -> DataFrame:
    return df.where(F.greatest(*metrics) <= t)


def discordant(df: DataFrame, t: int) -> DataFrame:
    return df.where((F.col("hamming") <= t) & (F.col("edit") > t))


def verify_truth(truth: DataFrame, contigs: DataFrame, spacers: DataFrame, metric: str = "edit") -> DataFrame:
    """Rows of truth, rows whose distance differs from the planned one, their share, and whether none does."""
    d = validate(attach_sequences(truth, spacers, contigs), metric)
    bad = F.coalesce(F.col("alignment_test") != F.col("mismatches"), F.lit(True))
    out = d.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_wrong"))
    return out.withColumns({"wrong_share": _ratio(F.col("n_wrong"), F.col("n")), "passed": F.col("n_wrong") == 0})
