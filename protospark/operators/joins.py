"""Joins of hits with sequences, ground truth and each other; merging of intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, Window, functions as F

from protospark.functions.distance import region_of
from protospark.functions.sequence import revcomp
from protospark.schemas import GROUP_KEY, HIT_KEY
from protospark.session import cut
from protospark.sources.blocks import BlockedSequences

#: Keys or bins with very many rows that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 17


def attach_spacers(hits: DataFrame, spacers: DataFrame) -> DataFrame:
    """Adds ``spacer_seq`` by ``spacer_id`` (null if missing). ``spacers``: ``spacer_id, seq``."""
    return hits.join(spacers.select("spacer_id", F.col("seq").alias("spacer_seq")), "spacer_id", "left")


def attach_regions(hits: DataFrame, contigs: DataFrame | BlockedSequences, longest: int | None = None, at: str | None = None) -> DataFrame:
    """Adds ``region_seq``: the contig between ``start`` and ``end``, reverse complemented once where ``strand`` is true.

    Regions are cut before they are joined back, so rows never carry whole contigs. Of contigs stored as blocks, regions join their blocks only,
    and no contig is shuffled; a region that begins beyond its contig's end is then null instead of empty. If no hit is longer than ``longest`` and
    blocks overlap by that much, each hit meets its one block and carries its columns along, so nothing is joined back (``at``: see ``short_regions``).
    """
    key = ["contig_id", "start", "end", "strand"]
    if isinstance(contigs, BlockedSequences):
        if longest is not None and longest <= contigs.overlap + 1:
            return contigs.short_regions(hits, "_cut", at).withColumn("region_seq", F.when(F.col("strand"), revcomp("_cut")).otherwise(F.col("_cut"))).drop("_cut")
        cut_ = contigs.regions(hits.select(*key).distinct(), "_cut")
        return hits.join(cut_.select(*key, F.when(F.col("strand"), revcomp("_cut")).otherwise(F.col("_cut")).alias("region_seq")), key, "left")
    needed = hits.select(*key).distinct().join(contigs.select("contig_id", "seq"), "contig_id")
    return hits.join(needed.select(*key, region_of("seq", "start", "end", "strand").alias("region_seq")), key, "left")


def attach_sequences(hits: DataFrame, spacers: DataFrame, contigs: DataFrame | BlockedSequences, drop_missing: bool = False, longest: int | None = None) -> DataFrame:
    out = attach_regions(attach_spacers(hits, spacers), contigs, longest)
    return out.where("spacer_seq is not null and region_seq is not null") if drop_missing else out


def _near(truth: DataFrame, tol: int) -> DataFrame:
    """Truth under the buckets ``_b`` of ``tol + 1`` starts that may hold its hits."""
    t = truth.select(*GROUP_KEY, F.col("start").alias("start_gt"), F.col("end").alias("end_gt"), F.col("mismatches").alias("mismatches_gt"))
    at = F.expr(f"start_gt div {tol + 1}")
    return t.withColumn("_b", F.explode(F.array(at - 1, at, at + 1)))


def match_with_tolerance(truth: DataFrame, hits: DataFrame, tol: int = 5) -> DataFrame:
    """Hits with the closest truth row of their group key, start and end within ``tol``: adds ``start_gt, end_gt, mismatches_gt``.

    Starts are put in buckets of ``tol + 1`` and the truth is listed under its bucket and both neighbours, so that a group key with
    very many rows meets only what is near. Ties go to the smaller truth interval. Hits without a match are left out.
    """
    t = _near(truth, tol)
    pairs = hits.withColumn("_b", F.expr(f"start div {tol + 1}")).join(t, [*GROUP_KEY, "_b"])
    away = F.abs(F.col("start") - F.col("start_gt")) + F.abs(F.col("end") - F.col("end_gt"))
    pairs = pairs.where((F.abs(F.col("start") - F.col("start_gt")) <= tol) & (F.abs(F.col("end") - F.col("end_gt")) <= tol))
    order = Window.partitionBy(*HIT_KEY).orderBy(away, "start_gt", "end_gt", "mismatches_gt")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_b")


def locate(truth: DataFrame, hits: DataFrame, tol: int = 5, least: str | None = None) -> DataFrame:
    """One row for each location of ``hits``: ``tools`` that report it (in order), and the closest truth row as in ``match_with_tolerance`` (nulls if none).
    With ``least``, a column of hits, also its smallest value there.

    Tools are gathered and the closest row is chosen where the join has put the location, so hits are shuffled once, by group key and bucket of
    starts, and a group key with very many rows is spread.
    """
    t = _near(truth, tol)
    t = t.select(*(F.col(c).alias(f"_t_{c}") if c in (*GROUP_KEY, "_b") else F.col(c) for c in t.columns))
    same = [F.col(c) == F.col(f"_t_{c}") for c in (*GROUP_KEY, "_b")]
    close = (F.abs(F.col("start") - F.col("start_gt")) <= tol) & (F.abs(F.col("end") - F.col("end_gt")) <= tol)
    more = [least] if least else []
    both = hits.select(*HIT_KEY, "tool", *more).withColumn("_b", F.expr(f"start div {tol + 1}")).join(t, reduce(and_, [*same, close]), "left")
    away = F.abs(F.col("start") - F.col("start_gt")) + F.abs(F.col("end") - F.col("end_gt"))
    best = F.min(F.when(F.col("start_gt").isNotNull(), F.struct(away.alias("away"), "start_gt", "end_gt", "mismatches_gt"))).alias("_best")
    out = both.groupBy(*HIT_KEY, "_b").agg(F.array_sort(F.collect_set("tool")).alias("tools"), best, *(F.min(c).alias(c) for c in more))
    return out.select(*HIT_KEY, "tools", *more, "_best.start_gt", "_best.end_gt", "_best.mismatches_gt")


def overlap_join(planned: DataFrame, hits: DataFrame, k: int, width: int = 512, fine: int = 32, most: int = 1 << 14) -> DataFrame:
    """Overlapping intervals of a contig, half-open, with a label; columns get ``_1`` (planned) and ``_2`` (hits).

    Hits with more than ``k`` mismatches are left out. Both sides are listed under the bins they touch; a bin that more than ``most`` hits
    start in is split into cells of ``fine`` places (``width`` is a multiple of it), where hits are dealt in blocks of about ``most`` rows and
    planned rows meet each block. A pair is kept where the later of its starts lies, so it needs no distinct.
    """
    hits = hits.where(F.col("mismatches") <= k)
    hot = hits.groupBy("contig_id", F.expr(f"start div {width}").alias("_bin")).count().where(F.col("count") > most)
    hot = cut(hot.select("contig_id", "_bin", F.ceil(F.col("count") / most).alias("_blocks")))
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot

    def binned(df: DataFrame, s: str) -> DataFrame:
        out = df.select("contig_id", *(F.col(c).alias(f"{c}{s}") for c in df.columns if c != "contig_id"))
        begin, last = f"start{s}", f"greatest(end{s} - 1, start{s})"
        out = out.withColumn("_bin", F.explode(F.sequence(F.expr(f"{begin} div {width}"), F.expr(f"{last} div {width}"))))
        if not n_hot:
            return out
        cells = F.sequence(F.expr(f"greatest({begin} - _bin * {width}, 0) div {fine}"), F.expr(f"least({last} - _bin * {width}, {width - 1}) div {fine}"))
        own = F.array(F.pmod(F.xxhash64(*out.columns), F.col("_blocks"))) if s == "_2" else F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)
        out = out.join(hot, ["contig_id", "_bin"], "left")
        out = out.withColumn("_cell", F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(cells)))
        return out.withColumn("_block", F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(own))).drop("_blocks")

    met = ["_bin", "_cell", "_block"] if n_hot else ["_bin"]
    here = f"_bin = greatest(start_1, start_2) div {width}" + (f" and _cell in (-1, (greatest(start_1, start_2) - _bin * {width}) div {fine})" if n_hot else "")
    pairs = binned(planned, "_1").join(binned(hits, "_2"), ["contig_id", *met]).where(f"{here} and start_1 < end_2 and start_2 < end_1")
    label = F.when(F.col("strand_1") != F.col("strand_2"), "strand_mismatch").when((F.col("start_1") == F.col("start_2")) & (F.col("end_1") == F.col("end_2")), "exact_match").otherwise("partial_overlap")
    return pairs.withColumn("overlap", label).drop(*met)


#: Buckets of starts in a range of a key: windows never see more rows of one partition, whatever the number of intervals.
RANGE = 1 << 12
#: Intervals of a key that one task may hold; keys with more are spread over their ranges.
MOST = 1 << 16
#: Intervals of all keys together that a task should hold (under 1 KB each, over its sorts and sums), if there are more than that for each core.
TASK = 1 << 19


def _islands(df: DataFrame, tol: int, key: Sequence[str], width: int) -> DataFrame:
    """``key, _bucket, _island, end, n_merged``: intervals whose starts share a bucket of ``tol + 1`` places, with the start of their island.

    Such intervals always belong together, so they are counted before the shuffle. Islands are found within ranges of ``width``
    buckets; then the largest end of the ranges before tells which of a range's first islands go on with an earlier one.
    """
    bucket, range_ = (f"({x} - pmod({x}, {n}L)) div {n}L" for x, n in (("start", tol + 1), ("_bucket", width)))
    points = df.groupBy(*key, F.expr(bucket).alias("_bucket")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged"))
    within = Window.partitionBy(*key, "_range").orderBy("_bucket")
    reach = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    points = points.withColumn("_range", F.expr(range_)).withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + tol), F.col("start")))
    points = cut(points.withColumn("_local", F.max("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("start", "_new"))

    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = points.groupBy(*key, "_range").agg(F.max("end").alias("_end"), F.max("_local").alias("_last")).withColumn("_reach", F.max("_end").over(before))
    begins = F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach") + tol), F.col("_last"))
    ranges = ranges.withColumn("_carried", F.max(begins).over(before)).select(*key, "_range", "_reach", "_carried")
    goes_on = F.col("_local") <= F.col("_reach") + tol
    out = _met(points, ranges, [*key, "_range"]).withColumn("_island", F.when(goes_on, F.col("_carried")).otherwise(F.col("_local")))
    return out.select(*key, "_bucket", "_island", "end", "n_merged")


def _met(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which a null equals a null; ``right`` has a row for each key of ``left`` at most."""
    right = right.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(right, reduce(and_, same), "left").drop(*(f"_r_{c}" for c in on))


def _by_heat(df: DataFrame, key: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that have ``most`` rows at most, and rows of the others (None if there are none).

    Where the former are very many, they are dealt by key into tasks of about ``TASK`` rows: left to itself, Spark joins partitions up to a size
    on disk, however many rows that is, and has no more of them than ``spark.sql.shuffle.partitions``.
    """
    seen = Observation()
    counts = df.groupBy(*key).count().observe(seen, F.sum("count").alias("rows"))
    hot = cut(counts.where(F.col("count") > most).select(*(F.col(c).alias(f"_r_{c}") for c in key)))
    cores = df.sparkSession.sparkContext.defaultParallelism
    n, tasks = hot.count(), -(-(seen.get.get("rows") or 0) // TASK)
    deal = lambda rows: rows.repartition(-(-tasks // cores) * cores, *key) if tasks > cores else rows  # noqa: E731  # full rounds of tasks
    if not n:
        return deal(df), None
    hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in key])
    return deal(df.join(hot, same, "left_anti")), df.join(hot, same, "left_semi")


def _key_islands(df: DataFrame, tol: int, key: Sequence[str]) -> DataFrame:
    """Adds ``_island`` to rows of keys that a task may hold: the start of the island."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + tol), F.col("start"))
    return df.withColumn("_new", new).withColumn("_island", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_intervals(df: DataFrame, tol: int, by: Sequence[str] = (), most: int = MOST, width: int = RANGE) -> DataFrame:
    """Intervals of a group key (and ``by``) that start within ``tol`` of what came before end, merged.

    ``end >= start`` is taken for granted. Keys may hold nulls; rows without a start are islands of their own key. A key of more than ``most``
    intervals is spread over its ranges of ``width * (tol + 1)`` places, with the same result.
    """
    key = [*GROUP_KEY, *by]
    rows, hot = _by_heat(df.select(*key, "start", "end"), key, most)
    islands = _key_islands(rows, tol, key).groupBy(*key, "_island").agg(F.max("end").alias("end"), F.count("*").alias("n_merged"))
    if hot is not None:
        islands = islands.unionByName(_islands(hot, tol, key, width).groupBy(*key, "_island").agg(F.max("end").alias("end"), F.sum("n_merged").alias("n_merged")))
    return islands.withColumnRenamed("_island", "start")


def assign_regions(df: DataFrame, tol: int = 5, most: int = MOST, width: int = RANGE) -> DataFrame:
    """Adds ``region_start, region_end, region_id`` of each hit: the merged interval it lies in. The id is the same in every run.

    Hits of keys with more than ``most`` find their region by key and bucket of starts, so they are spread; see ``merge_intervals``.
    """
    rows, hot = _by_heat(df, GROUP_KEY, most)
    w = Window.partitionBy(*GROUP_KEY, "_island")
    out = _key_islands(rows, tol, GROUP_KEY).withColumn("region_end", F.max("end").over(w)).withColumnRenamed("_island", "region_start")
    if hot is not None:
        islands = cut(_islands(hot.select(*GROUP_KEY, "start", "end"), tol, GROUP_KEY, width).withColumnRenamed("_island", "region_start"))
        ends = islands.groupBy(*GROUP_KEY, "region_start").agg(F.max("end").alias("region_end"))
        regions = _met(islands.drop("end", "n_merged"), ends, [*GROUP_KEY, "region_start"])
        hot = hot.withColumn("_bucket", F.expr(f"(start - pmod(start, {tol + 1}L)) div {tol + 1}L"))
        out = out.unionByName(_met(hot, regions, [*GROUP_KEY, "_bucket"]).drop("_bucket"))
    return out.select(*df.columns, "region_start", "region_end", F.xxhash64(*GROUP_KEY, "region_start").alias("region_id"))
