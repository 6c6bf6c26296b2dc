"""Regions by tools, written once: a row per region with the tools that report it as bits, by distance and by dataset.

Recall, difference matrices, sets of tools and occurrences are counts over these rows, each with one small exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from protospark.operators.agreement import REGION
from protospark.operators.joins import assign_regions
from protospark.schemas import GROUP_KEY
from protospark.session import cut

#: Bits of a long that a set of tools may use.
MOST_TOOLS = 63


@dataclass(frozen=True)
class RegionCube:
    """``regions``: the region's key, ``region_end``, ``tools`` (bits), ``at`` (bits for distances 0 to ``limit``) and ``sets`` (dataset and bits).

    Bit ``i`` stands for ``tools[i]``; names are in order.
    """

    regions: DataFrame
    tools: tuple[str, ...]
    limit: int
    dataset: str | None

    def recall(self) -> DataFrame:
        """``tool, n_found, n_total, recall`` over all regions."""
        return self._recall(self.regions.select(F.lit(1).alias("_all"), F.col("tools").alias("_set")), "_all").drop("_all")

    def recall_by_dataset(self) -> DataFrame:
        """Regions of a tool among all regions of its dataset; a tool without any there has no row."""
        if self.dataset is None:
            raise ValueError("the cube was built without a dataset column")
        return self._recall(self.regions.select(F.inline("sets")), self.dataset)

    def recall_by_threshold(self, thresholds: Sequence[int], exact: bool = False) -> DataFrame:
        """Recall per tool at each threshold: of regions with a distance up to it, or with ``exact`` of just it."""
        sets = [F.struct(F.lit(int(t)).alias("threshold"), self._set(t, exact).alias("_set")) for t in thresholds]
        return self._recall(self.regions.select(F.inline(F.array(*sets))).where("_set != 0"), "threshold")

    def difference_matrix(self, diagonal: bool = False, distance: int | None = None) -> DataFrame:
        """``row_tool, col_tool, n``: regions that the row's tool has and the column's tool lacks (with ``diagonal``: all of the row's own)."""
        counts = self.regions.select(self._set(distance).alias("_set")).groupBy("_set").agg(F.count("*").alias("_n"))
        counts = counts.unionByName(self.regions.sparkSession.range(1).select(F.lit(0).cast("long").alias("_set"), F.lit(0).cast("long").alias("_n")))
        cells = counts.select("_n", "_set", F.explode(self._each()).alias("r")).select("_n", "_set", "r", F.explode(self._each()).alias("c"))
        has = lambda tool: F.col("_set").bitwiseAND(F.col(f"{tool}.bit")) != 0
        own = F.lit(diagonal) & (F.col("r.bit") == F.col("c.bit"))
        n = F.sum(F.when(has("r") & (own | ~has("c")), F.col("_n")).otherwise(0))
        return cells.groupBy(F.col("r.tool").alias("row_tool"), F.col("c.tool").alias("col_tool")).agg(n.alias("n"))

    def matched_contigs(self) -> DataFrame:
        """Per contig: spacers, regions, tools (in order) and their number. Counted by contig and spacer first, so a hot contig is spread."""
        pairs = self.regions.groupBy("contig_id", "spacer_id").agg(F.count("*").alias("_n"), F.bit_or("tools").alias("_set"))
        out = pairs.groupBy("contig_id").agg(F.count("spacer_id").alias("n_spacers"), F.sum("_n").alias("n_regions"), F.bit_or("_set").alias("_set"))
        return out.select("contig_id", "n_spacers", "n_regions", self._names("_set").alias("tools"), F.bit_count("_set").cast("long").alias("n_tools"))

    def tool_combinations(self, distance: int | None = None, exact: bool = True) -> DataFrame:
        """How many regions each exact set of tools has."""
        counts = self.regions.select(self._set(distance, exact).alias("_set")).where("_set != 0").groupBy("_set").agg(F.count("*").alias("n_regions"))
        return counts.select(self._names("_set").alias("tools"), "n_regions")

    def only_by(self, tools: Sequence[str]) -> DataFrame:
        """Regions that only these tools have, among all."""
        others = sum(1 << i for i, t in enumerate(self.tools) if t not in tools)
        out = self.regions.agg(F.count_if(F.col("tools").bitwiseAND(F.lit(others).cast("long")) == 0).alias("n_only"), F.count("*").alias("n_total"))
        return out.withColumn("pct", 100 * F.coalesce(F.try_divide("n_only", "n_total"), F.lit(0.0)))

    def occurrence_fractions(self, distance: int | None = None, exact: bool = False) -> DataFrame:
        """``spacer_id, tool, n_occurrences, n_found, fraction``, occurrences being regions; every tool of the cube has a row for each spacer."""
        sets = self.regions.select("spacer_id", self._set(distance, exact).alias("_set")).where("_set != 0")
        out = self._by_tool(sets, "spacer_id", "n_occurrences")
        return out.select("spacer_id", "tool", "n_occurrences", "n_found", F.try_divide("n_found", "n_occurrences").alias("fraction"))

    def _set(self, distance: int | None = None, exact: bool = True) -> Column:
        """The tools that report a region, at this distance or (not ``exact``) up to it."""
        if distance is None:
            return F.col("tools")
        if not 0 <= distance <= self.limit:
            raise ValueError(f"distance {distance}: the cube holds 0 to {self.limit}")
        at = F.slice("at", distance + 1 if exact else 1, 1 if exact else distance + 1)
        return F.aggregate(at, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    def _each(self) -> Column:
        return F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(1 << i).cast("long").alias("bit")) for i, t in enumerate(self.tools))).cast("array<struct<tool:string,bit:bigint>>")

    def _names(self, bits: str) -> Column:
        return F.array_join(F.transform(F.filter(self._each(), lambda t: F.col(bits).bitwiseAND(t["bit"]) != 0), lambda t: t["tool"]), ",")

    def _by_tool(self, sets: DataFrame, by: str, total: str) -> DataFrame:
        """``by, total, tool, n_found``: rows of each value, and those with the tool's bit in ``_set``."""
        found = [F.sum(F.shiftright("_set", i).bitwiseAND(F.lit(1).cast("long"))) for i in range(len(self.tools))]
        counts = sets.groupBy(by).agg(F.count("*").alias(total), F.array(*found).cast("array<bigint>").alias("_found"))
        pairs = F.arrays_zip(self._each().getField("tool").alias("tool"), F.col("_found").alias("n_found"))
        return counts.select(by, total, F.explode(pairs).alias("_t")).select(by, total, F.col("_t.tool").alias("tool"), F.col("_t.n_found").alias("n_found"))

    def _recall(self, sets: DataFrame, by: str) -> DataFrame:
        out = self._by_tool(sets, by, "n_total").where("n_found > 0")
        return out.select(by, "tool", "n_found", "n_total", F.try_divide("n_found", "n_total").alias("recall"))


def region_cube(hits: DataFrame, dataset: str | None = None, distance: str = "mismatches", limit: int = 5, tol: int = 5, tools: Sequence[str] | None = None) -> RegionCube:
    """Merge hits to regions and write one row for each.

    Regions are merged over all hits with a tool (of ``tools``, if given); 63 tools at most. A hit whose distance is null or not in 0 to
    ``limit`` counts in ``tools`` and ``sets`` only. Nulls in the region's key and in ``dataset`` are values of their own. Without hits the
    cube is empty.
    """
    if tools is None:
        tools = [r.tool for r in hits.where("tool is not null").select("tool").distinct().limit(MOST_TOOLS + 1).collect()]
    if len(set(tools)) > MOST_TOOLS:
        raise ValueError(f"more than {MOST_TOOLS} tools")
    names = tuple(sorted(set(tools)))
    return RegionCube(cut(_cells(hits, names, dataset, distance, limit, tol)), names, limit, dataset)


def _cells(hits: DataFrame, names: Sequence[str], dataset: str | None, distance: str, limit: int, tol: int) -> DataFrame:
    """Regions, datasets and masks under the one partitioning by group key that merging needs (hot keys' regions are dealt again)."""
    extra = [dataset] if dataset else []
    own = hits.where(F.col("tool").isin(*names) if names else F.lit(False)).select(*GROUP_KEY, "start", "end", "tool", F.col(distance).alias("_distance"), *extra)
    place = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("tool")) - 1
    rows = assign_regions(own, tol).withColumn("_bit", F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")))
    masks = [F.coalesce(F.bit_or(F.when(F.col("_distance") == t, F.col("_bit"))), F.lit(0).cast("long")).alias(f"_{t}") for t in range(limit + 1)]
    per = rows.groupBy(*REGION, *extra).agg(F.max("region_end").alias("region_end"), F.bit_or("_bit").alias("tools"), *masks)
    at = [F.col(f"_{t}") for t in range(limit + 1)]
    if dataset:
        sets = F.collect_list(F.struct(F.col(dataset), F.col("tools").alias("_set"))).alias("sets")
        per = per.groupBy(*REGION).agg(F.max("region_end").alias("region_end"), F.bit_or("tools").alias("tools"), *(F.bit_or(c).alias(f"_{t}") for t, c in enumerate(at)), sets)
    return per.select(*REGION, "region_end", "tools", F.array(*at).alias("at"), *(["sets"] if dataset else []))
