"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 3); DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from protospark.llm.common import cut, table

_WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of keys per power of two, at least, and rows of a table for each of them: a bucket holds a small share of a source's rows, whatever the weights.
_FINE, _ROWS = 1024, 1 << 18
#: Sources that may be broadcast (a few numbers each); more are joined by a shuffle.
BROADCAST_SOURCES = 1 << 17


def text_quality(text: str = "text") -> Column:
    """A document's weight, 0.1 to 1: less for each share of sign characters in its text (null and empty texts: 1)."""
    signs = F.length(text) - F.length(F.translate(text, "#*$%&|<>{}=+~^_@!", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 5 * F.try_divide(signs, F.length(text))), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``src, source_size, target`` from ``src, source, source_size``: sources by code point (null last) get ``weights`` in turn.

    All targets together are ``share`` of all sizes; none is above ``most`` times its source's size, what is over
    being dealt again by weight. One row per source, in one task.
    """
    every = Window.partitionBy()
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(place - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    t = t.withColumn("all_w", F.sum("w").over(every)).withColumn("all_t", share * F.sum("source_size").over(every))
    before = every.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("place", place)
    level = (F.col("all_t") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("full", level * F.col("w") > F.col("cap"))
    rest = F.col("all_t") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.col("all_w") - F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(every)
    return t.select("src", "source_size", F.least("cap", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.try_divide(rest, free))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, quality: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` and the columns in ``carry``, for every row of ``docs``.

    ``docs`` has ``doc_id``, ``text`` and ``source``; a size is a text's words. A source's whole epochs come first (each
    takes every row once); what is left of its target goes to the rows with the smallest keys ``-ln(u) / quality``, ``u`` being
    drawn from id and text, up to the row that brings the sum nearest to the target. Reruns agree.

    Keys are summed by source and bucket first, and prefix sums of buckets tell in which bucket a source's target ends. Rows of
    the buckets before it are taken, those after it are not; only rows of that one bucket are sorted, so that no task has
    all rows of a source, and no other row is shuffled.
    Null texts have size 0 (taken: 0), null sources are one source, rows with equal ids and texts count one after the other.
    """
    quality = text_quality() if quality is None else quality
    fine, n = _FINE, docs.count()
    while n > fine * _ROWS:
        fine *= 2
    drawn = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    rows = docs.select("doc_id", *carry, F.struct("source").alias("_source"), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"), (-F.log(u) / quality).alias("_key"))
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("_source.source")), F.lit("")))
    rows = rows.withColumn("_bucket", F.floor(F.log2(F.greatest("_key", F.lit(1e-300))) * fine))
    if not carry:
        rows = cut(rows)
    sums = cut(rows.groupBy("src", "_bucket").agg(F.sum("size").alias("n"), F.first("_source").alias("_source")))
    sizes = sums.groupBy("src").agg(F.sum("n").alias("source_size"), F.first("_source").getField("source").alias("source"))
    goal = targets(sizes, weights, share, most)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    goal = goal.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(goal.select("src", "left"), "src")
    ends = ends.where("before <= left and left < before + n").select("src", F.col("_bucket").alias("_end"), "before")
    goal = cut(goal.join(ends, "src", "left"))
    told = rows.join(F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal, "src")
    columns = ["doc_id", "size", "source_size", "target", "epochs", *carry]
    most_rows = told.where("_end is null or _bucket <> _end").select(*columns, F.coalesce(F.col("_bucket") < F.col("_end"), F.lit(False)).alias("_more"))
    inside = Window.partitionBy("src").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = told.where("_bucket = _end").withColumn("_more", start + F.col("size") / 2 <= F.col("left")).select(*columns, "_more")
    told = most_rows.union(last).withColumn("copies", (F.col("epochs") + F.when(F.col("_more") & (F.col("size") > 0), 1).otherwise(0)).cast("int"))
    return told.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *carry)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5(coalesce(text, '')) tm,
  coalesce(greatest(0.1::double, 1 - 5 * ((length(text) - length(translate(text, '#*$%&|<>{}=+~^_@!', '')))::double / nullif(length(text), 0))), 1.0::double) q from documents),
k as (select *, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || tm), 1, 13))::bigint::double + 0.5) / 4503599627370496) / q k from d),
s as (select source, sum(size)::bigint n from d group by 1),
w as (select *, 2.0::double * n cap, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end w,
  row_number() over (order by source nulls last) p from s),
v as (select *, sum(w) over () aw, 1.5::double * sum(n) over () tt,
  coalesce(sum(cap) over b, 0) bc, coalesce(sum(w) over b, 0) bw from w window b as (order by cap / w, p rows between unbounded preceding and 1 preceding)),
f as (select *, (tt - bc) / (aw - bw) * w > cap as fl from v),
t as (select source, n, least(cap, case when fl then cap else w * ((tt - sum(case when fl then cap else 0 end) over ()) / nullif(aw - sum(case when fl then w else 0 end) over (), 0)) end) target from f),
e as (select *, coalesce(floor(target / nullif(n, 0)), 0) ep from t),
r as (select k.*, e.n, e.target, e.ep, e.target - e.ep * e.n lft,
  coalesce(sum(size) over (partition by k.source order by k.k, doc_id, size rows between unbounded preceding and 1 preceding), 0) b
  from k join e on k.source is not distinct from e.source)
select doc_id, size, n source_size, target, ((ep + case when size > 0 and b + size / 2 <= lft then 1 else 0 end) * size)::bigint taken from r
"""
