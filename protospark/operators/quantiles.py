"""Exact quantiles without a column's values in any one state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from protospark.session import cut

#: Buckets that a range of values is counted in; rows of a bucket that are sorted to find a rank (a larger one is counted in buckets again).
BUCKETS, SORTED = 1 << 12, 1 << 20
#: Ranges (groups times columns times ranks) that may be broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 1 << 18


def quantiles(df: DataFrame, cols: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, column, quantiles`` (array of doubles, as ``probabilities``): linear between ranks, as ``percentile`` and ``quantile_cont`` are.

    1. Rows, least and largest value of each group and column give the ranks wanted.
    2. Values between are counted in buckets of equal width, with each bucket's own least and largest value: rows of one bucket hold a rank. Counts are
       added up before the shuffle, so a group costs ``BUCKETS`` rows a task at most, whatever it holds. A bucket of more than ``SORTED`` rows and more than
       one value is counted in buckets again.
    3. Only values in the ranks' buckets are grouped (equal values to one row) and added up in order.

    Nulls and NaN don't count; a group without values gives no row. Groups may be null.
    """
    key = [*(f"_by{i}" for i in range(len(by))), "column"]
    long = df.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("v")) for i, c in enumerate(cols))))
    rows = long.select(*key[:-1], pairs.alias("p")).select(*key[:-1], "p.column", "p.v").where("v is not null and not isnan(v)")
    p = F.explode(F.array(*map(F.lit, map(float, probabilities))))
    stats = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = cut(stats.withColumn("p", p).withColumn("at", F.col("p") * (F.col("rows") - 1)))
    # ranks: how many of the range's values are before it
    rank = F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))
    ranges = wanted.select(*key, "low", "high", "rows", rank.alias("rank"), F.lit(0).cast("long").alias("before")).distinct()

    def within(ranges: DataFrame) -> DataFrame:
        r = ranges.select(*(F.col(c).alias(f"r_{c}") for c in key), "low", "high").distinct()
        small = F.broadcast(r) if r.count() <= BROADCAST_RANGES else r
        same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in key]
        return rows.join(small, [*same, F.col("v").between(F.col("low"), F.col("high"))]).drop(*(f"r_{c}" for c in key))

    while not (wide := ranges.where((F.col("low") < F.col("high")) & (F.col("rows") > SORTED))).isEmpty():
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        some = within(wide).withColumn("bucket", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
        counts = some.groupBy(*key, "low", "high", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = Window.partitionBy(*key, "low", "high").orderBy("bucket")
        counts = counts.withColumn("upto", F.sum("n").over(order)).withColumnsRenamed({c: f"c_{c}" for c in (*key, "low", "high")})
        same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in (*key, "low", "high")]
        inside = (F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("n"))
        finer = wide.join(counts, [*same, inside]).select(*key, F.col("least").alias("low"), F.col("most").alias("high"), F.col("n").alias("rows"), "rank", (F.col("before") + F.col("upto") - F.col("n")).alias("before"))
        ranges = cut(ranges.where((F.col("low") >= F.col("high")) | (F.col("rows") <= SORTED)).union(finer))
    known = ranges.where("low = high").select(*key, "rank", F.col("low").alias("v"))
    open_ = ranges.where("low < high")
    values = within(open_).groupBy(*key, "low", "high", "v").agg(F.count("*").alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy(*key, "low", "high").orderBy("v"))).withColumnsRenamed({c: f"c_{c}" for c in (*key, "low", "high")})
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in (*key, "low", "high")]
    inside = (F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("n"))
    found = known.union(open_.join(values, [*same, inside]).select(*key, "rank", "v"))
    found = found.withColumnsRenamed({c: f"f_{c}" for c in key})
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in key]
    both = wanted.join(found, [*same, (F.col("rank") == F.floor("at")) | (F.col("rank") == F.ceil("at"))])
    low, high = F.min(F.struct("rank", "v"))["v"], F.max(F.struct("rank", "v"))["v"]
    at = F.first("at")
    value = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    each = both.groupBy(*key, "p").agg(value.alias("q"))
    told = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda x: x["q"]).alias("quantiles"))
    return told.withColumnsRenamed({f"_by{i}": c for i, c in enumerate(by)})
