"""Subsampling of a contig catalogue."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from protospark.operators.quantiles import quantiles
from protospark.session import cut


def parse_reduction(value: float, total: int) -> int:
    """Rows to keep: a share if the value is in (0, 1], to the nearest row (halves up), else a number."""
    if value <= 0:
        raise ValueError("reduction must be positive")
    if value > 1:
        return min(int(value), total)
    return int((total * Decimal(str(value))).quantize(Decimal(1), ROUND_HALF_UP))


def order_of(seed: int, id: str = "seqid") -> Column:
    """A random order that is the same in every run (and in other engines)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id)).cast("binary"))


def sample_hq(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Of the high-quality rows, those whose seeded hash falls below the fraction."""
    part = F.conv(F.substring(order_of(seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.where("hq").where(part < fraction)


def quantile_bins(df: DataFrame, col: str, n: int = 10, out: str | None = None) -> DataFrame:
    """Adds the quantile bin (0 to n - 1) of a column; upper edges are closed, equal edges make one bin."""
    return _binned(df, {col: out or f"{col}_bin"}, n)


def _above(col: str):
    return lambda e: F.col(col) > e


def _binned(df: DataFrame, outs: dict[str, str], n: int) -> DataFrame:
    """The bins of several columns, whose edges are found together."""
    of = lambda c: F.first(F.when(F.col("column") == c, F.col("quantiles")), ignorenulls=True).alias(f"_edges_{c}")
    edges = quantiles(df, list(outs), [i / n for i in range(1, n)]).agg(*map(of, outs))  # a row also without values
    bins = {out: F.size(F.filter(F.array_distinct(f"_edges_{c}"), _above(c))) for c, out in outs.items()}
    return df.crossJoin(F.broadcast(edges)).withColumns(bins).drop(*(f"_edges_{c}" for c in outs))


def stratified_sample(df: DataFrame, target: int, rank: str | None = "class", gc_bins: int = 10, length_bins: int = 10, seed: int = 42, top_up: bool = True) -> DataFrame:
    """Rows from each cell of taxon, GC and length bins, in seeded order; then others until ``target``.

    A taxon gets ``max(1, target div taxa)`` rows, dealt over its cells with one each at least, so the target may be exceeded.
    Rows without the taxon only serve to top up; without ``rank`` the cells are those of the bins alone.
    """
    both = gc_bins == length_bins
    d = _binned(df, {"gc": "gc_bin", "length": "length_bin"}, gc_bins) if both else quantile_bins(quantile_bins(df, "gc", gc_bins), "length", length_bins)
    d = d.withColumn("_order", order_of(seed))
    taxon = F.col(rank) if rank else F.lit("all")
    d = d.withColumn("_taxon", taxon)
    cells = d.where("_taxon is not null").select("_taxon", "gc_bin", "length_bin").distinct().groupBy("_taxon").agg(F.count("*").alias("_cells"))
    taxa = cells.agg(F.count("*").alias("_taxa"))
    quota = cells.crossJoin(F.broadcast(taxa)).select("_taxon", F.expr(f"greatest(1, greatest(1, {int(target)} div _taxa) div _cells)").alias("_quota"))
    place = F.row_number().over(Window.partitionBy("_taxon", "gc_bin", "length_bin").orderBy("_order"))
    chosen = d.where("_taxon is not null").withColumn("_place", place).join(quota, "_taxon").where("_place <= _quota").select("seqid").withColumn("_first", F.lit(True))
    if not top_up:
        return df.join(chosen.drop("_first"), "seqid", "left_semi")
    # hash prefixes are counted, so that one prefix alone has to be sorted
    chosen = cut(chosen)
    lacking = int(target) - chosen.count()
    rest = cut(d.join(chosen, "seqid", "left_anti").select("seqid", "_order", F.substring("_order", 1, 4).alias("_prefix"))) if lacking > 0 else None
    if rest is None:
        return df.join(chosen.select("seqid"), "seqid", "left_semi")
    full, taken = "", 0  # prefixes up to ``full`` are taken whole
    edge = None
    for prefix, n in rest.groupBy("_prefix").count().orderBy("_prefix").collect():  # 65,536 at most
        if taken + n > lacking:
            edge = prefix
            break
        full, taken = prefix, taken + n
    more = rest.where(F.col("_prefix") <= full).select("seqid")
    if edge is not None:
        more = more.union(rest.where(F.col("_prefix") == edge).orderBy("_order", "seqid").limit(lacking - taken).select("seqid"))
    return df.join(chosen.select("seqid").union(more), "seqid", "left_semi")


def subset_summary(full: DataFrame, subset: DataFrame, rank: str = "class") -> DataFrame:
    """Per taxon of the subset: rows, ranges of length and GC, and the share of the full set's rows."""
    total = full.groupBy(rank).agg(F.count("*").alias("n_full"))
    out = subset.groupBy(rank).agg(F.count("*").alias("n"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.min("gc").alias("min_gc"), F.max("gc").alias("max_gc"))
    return out.join(total, out[rank].eqNullSafe(total[rank])).drop(total[rank]).withColumn("ratio", F.col("n") / F.col("n_full"))


def subsample(sequences: DataFrame, metadata: DataFrame, reduction: float, rank: str = "class", hq_only: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sequences, metadata) of a stratified sample of a share or number of the rows."""
    pool = metadata.where("hq") if hq_only else metadata
    chosen = stratified_sample(pool, parse_reduction(reduction, pool.count()), rank, seed=seed)
    return sequences.join(chosen.select("seqid"), "seqid", "left_semi"), chosen
