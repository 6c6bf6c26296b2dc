"""How tools agree: summaries, recall over datasets and thresholds, difference matrices, occurrences, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from protospark.operators.quantiles import quantiles
from protospark.schemas import GROUP_KEY

REGION = [*GROUP_KEY, "region_start"]


def tool_summary(df: DataFrame, distance: str = "mismatches") -> DataFrame:
    """Per tool: rows, spacers, contigs, and mean, exact median and extremes of the distance."""
    told = df.groupBy("tool").agg(
        F.count("*").alias("n"), F.count_distinct("spacer_id").alias("n_spacers"), F.count_distinct("contig_id").alias("n_contigs"),
        F.avg(distance).alias("mean"), F.min(distance).alias("min"), F.max(distance).alias("max"),
    )
    middle = quantiles(df, [distance], [0.5], ["tool"]).select(F.col("tool").alias("_tool"), F.element_at("quantiles", 1).alias("median"))
    return told.join(middle, F.col("tool").eqNullSafe(F.col("_tool")), "left").select("tool", "n", "n_spacers", "n_contigs", "mean", "median", "min", "max")


def recall_by_dataset(df: DataFrame, dataset: str = "fraction", key: Sequence[str] = REGION) -> DataFrame:
    """Regions of a tool among all regions of its dataset. Region-tool pairs are made distinct once, then counted by rows."""
    seen = df.select(dataset, "tool", *key).distinct()
    total = seen.select(dataset, *key).distinct().groupBy(dataset).agg(F.count("*").alias("n_total"))
    own = seen.groupBy(dataset, "tool").agg(F.count("*").alias("n_found"))
    return own.join(total, dataset).withColumn("recall", F.try_divide("n_found", "n_total"))


def recall_by_threshold(df: DataFrame, thresholds: Sequence[int], distance: str = "mismatches", exact: bool = False, key: Sequence[str] = REGION) -> DataFrame:
    """Recall per tool at each threshold: of regions with a distance up to it, or with ``exact`` of just it."""
    t = F.broadcast(df.sparkSession.createDataFrame([(int(x),) for x in thresholds], "threshold int"))
    if exact:
        seen = df.join(t, F.col(distance) == F.col("threshold")).select("threshold", "tool", *key).distinct()
    else:  # a region's least distance per tool decides
        least = df.groupBy("tool", *key).agg(F.min(distance).alias("_d"))
        seen = least.join(t, F.col("_d") <= F.col("threshold")).select("threshold", "tool", *key)
    return recall_by_dataset(seen, "threshold", key)


def recall_stats(recalls: DataFrame, tools: DataFrame | None = None, clip: bool = True) -> DataFrame:
    """Over datasets: mean, sample deviation (0 for one), extremes, and mean plus and minus the deviation."""
    out = recalls.groupBy("tool").agg(F.avg("recall").alias("mean"), F.coalesce(F.stddev_samp("recall"), F.lit(0.0)).alias("std"), F.min("recall").alias("min"), F.max("recall").alias("max"))
    out = out if tools is None else tools.select("tool").distinct().join(out, "tool", "left").fillna(0.0)
    low, high = F.col("mean") - F.col("std"), F.col("mean") + F.col("std")
    return out.withColumns({"low": F.greatest(low, F.lit(0.0)) if clip else low, "high": F.least(high, F.lit(1.0)) if clip else high})


def recall_pivot(recalls: DataFrame, values: Sequence, dataset: str = "fraction") -> DataFrame:
    """Tools by datasets; null where a tool was not run."""
    return recalls.groupBy("tool").pivot(dataset, list(values)).agg(F.first("recall"))


def difference_matrix(df: DataFrame, key: Sequence[str], diagonal: bool = False, distance: int | None = None, column: str = "mismatches") -> DataFrame:
    """``row_tool, col_tool, n``: keys that the row's tool has and the column's tool lacks (with ``diagonal``: all of the row's own).

    The set of tools of each key is gathered once; equal sets are counted together before they are compared with the tools.
    """
    df = df if distance is None else df.where(F.col(column) == distance)
    tools = df.select("tool").distinct()
    sets = df.groupBy(*key).agg(F.array_sort(F.collect_set("tool")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    cells = tools.select(F.col("tool").alias("row_tool")).crossJoin(F.broadcast(tools.select(F.col("tool").alias("col_tool"))))
    lacks = sets.select("n", F.explode("s").alias("row_tool"), "s").join(F.broadcast(tools.select(F.col("tool").alias("col_tool"))), (F.col("col_tool") == F.col("row_tool")) | ~F.array_contains("s", F.col("col_tool")))
    out = lacks.groupBy("row_tool", "col_tool").agg(F.sum("n").alias("n"))
    out = cells.join(out, ["row_tool", "col_tool"], "left").fillna(0, ["n"])
    return out if diagonal else out.withColumn("n", F.when(F.col("row_tool") == F.col("col_tool"), 0).otherwise(F.col("n")))


def matrix_wide(matrix: DataFrame, tools: Sequence[str]) -> DataFrame:
    return matrix.groupBy("row_tool").pivot("col_tool", list(tools)).agg(F.first("n"))


def matrix_long(matrix: DataFrame) -> DataFrame:
    """With each row's total, largest totals first."""
    total = matrix.groupBy("row_tool").agg(F.sum("n").alias("row_total"))
    return matrix.join(total, "row_tool").orderBy(F.desc("row_total"), "row_tool", "col_tool")


def matched_contigs(df: DataFrame) -> DataFrame:
    """Per contig: spacers, regions, tools (in order) and their number."""
    return df.groupBy("contig_id").agg(
        F.count_distinct("spacer_id").alias("n_spacers"), F.count_distinct(F.struct(*REGION)).alias("n_regions"),
        F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.count_distinct("tool").alias("n_tools"),
    )


def tool_combinations(df: DataFrame, distance: int | None = None, exact: bool = True, column: str = "mismatches", key: Sequence[str] = REGION) -> DataFrame:
    """How many regions each exact set of tools has."""
    if distance is not None:
        df = df.where(F.col(column) == distance if exact else F.col(column) <= distance)
    return df.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools")).groupBy("tools").agg(F.count("*").alias("n_regions"))


def only_by(df: DataFrame, tools: Sequence[str], key: Sequence[str] = REGION) -> DataFrame:
    """Regions that only these tools have, among all."""
    per = df.groupBy(*key).agg(F.bool_and(F.col("tool").isin(list(tools))).alias("only"))
    return per.agg(F.count_if("only").alias("n_only"), F.count("*").alias("n_total")).withColumn("pct", 100 * F.coalesce(F.try_divide("n_only", "n_total"), F.lit(0.0)))


def occurrence_fractions(df: DataFrame, distance: int | None = None, exact: bool = False, unit: Sequence[str] = ("contig_id",), column: str = "mismatches") -> DataFrame:
    """``spacer_id, tool, n_occurrences, n_found, fraction`` for every spacer and tool; what a tool lacks is 0."""
    if distance is not None:
        df = df.where(F.col(column) == distance if exact else F.col(column) <= distance)
    seen = df.select("spacer_id", *unit, "tool").distinct()
    total = seen.select("spacer_id", *unit).distinct().groupBy("spacer_id").agg(F.count("*").alias("n_occurrences"))
    own = seen.groupBy("spacer_id", "tool").agg(F.count("*").alias("n_found"))
    grid = total.crossJoin(F.broadcast(df.select("tool").distinct()))
    return grid.join(own, ["spacer_id", "tool"], "left").fillna(0, ["n_found"]).withColumn("fraction", F.try_divide("n_found", "n_occurrences"))


def occurrence_wide(fractions: DataFrame, tools: Sequence[str]) -> DataFrame:
    return fractions.groupBy("spacer_id", "n_occurrences").pivot("tool", list(tools)).agg(F.first("fraction")).fillna(0.0)


def occurrence_bins(n_low: int = 149, n_high: int = 10) -> list[tuple[int, float, float]]:
    """(bin, from, to): log-spaced from 1 to 1000, then to 10000; the last is open. Half-open."""
    low = [10 ** (3 * i / n_low) for i in range(n_low + 1)]
    high = [10 ** (3 + i / n_high) for i in range(n_high + 1)]
    edges = [*zip(low, low[1:]), *zip(high, high[1:])]
    return [(i, a, b if i < len(edges) - 1 else float("inf")) for i, (a, b) in enumerate(edges)]


def recall_by_occurrence(fractions: DataFrame, n_low: int = 149, n_high: int = 10) -> DataFrame:
    """Mean fraction per tool and bin of occurrences. Equal counts are averaged together before they meet the (constant) bins."""
    bins = fractions.sparkSession.createDataFrame(occurrence_bins(n_low, n_high), "bin int, low double, high double")
    sums = fractions.groupBy("tool", "n_occurrences").agg(F.sum("fraction").alias("s"), F.count("*").alias("n"))
    both = sums.join(F.broadcast(bins), (F.col("n_occurrences") >= F.col("low")) & (F.col("n_occurrences") < F.col("high")))
    return both.groupBy("tool", "bin").agg((F.sum("s") / F.sum("n")).alias("mean_fraction"), F.sum("n").alias("n_spacers"))


def recall_difference(recalls: DataFrame) -> DataFrame:
    """Pairs of tools with the difference of their recalls, row minus column. ``recalls``: one row per tool."""
    a, b = recalls.select(F.col("tool").alias("row_tool"), F.col("recall").alias("x")), recalls.select(F.col("tool").alias("col_tool"), F.col("recall").alias("y"))
    return a.crossJoin(F.broadcast(b)).select("row_tool", "col_tool", (F.col("x") - F.col("y")).alias("difference"))


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    out = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(df.agg(F.count("*").alias("_t")))).withColumn("share", F.col("n") / F.col("_t")).drop("_t") if normalize else out


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and largest of each column."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).unpivot([], list(cols), "column", "v")
    told = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = lambda i: F.element_at("quantiles", i)
    return told.join(quantiles(df, cols, [0.25, 0.5, 0.75]), "column", "left").select("column", "n", "mean", "std", "min", q(1).alias("q25"), q(2).alias("median"), q(3).alias("q75"), "max")


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.width_bucket(F.col(col).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def dataset_summary(df: DataFrame, contigs: DataFrame, jobs: DataFrame, dataset: str = "fraction") -> DataFrame:
    """Per dataset: contigs and bases, regions and rows, and the tools that completed, timed out or are missing.

    ``contigs``: dataset, ``contig_id, length``; ``jobs``: dataset, ``tool, state``.
    """
    size = contigs.groupBy(dataset).agg(F.count("*").alias("n_contigs"), F.sum("length").alias("n_bp"))
    rows = df.groupBy(dataset).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*REGION)).alias("n_regions"))
    names = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("tool")))), ",")
    state = jobs.groupBy(dataset).agg(names(F.col("state") == "COMPLETED").alias("completed"), names(F.col("state") == "TIMEOUT").alias("timed_out"), names(F.col("state").isNull()).alias("missing"))
    return size.join(rows, dataset, "left").join(state, dataset, "left")
