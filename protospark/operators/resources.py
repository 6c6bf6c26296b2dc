"""Job accounting: durations, memory, efficiency, the best job of each tool, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from protospark.functions.sequence import _c
from protospark.session import cut


def parse_duration(text) -> Column:
    """Seconds of ``[D-]HH:MM:SS``; anything else, null too, is 0."""
    t = _c(text)
    pattern = r"^(?:(\d+)-)?(\d+):(\d+):(\d+)$"
    n = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, pattern, i), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0))
    return F.when(t.rlike(pattern), n(1) * 86400 + n(2) * 3600 + n(3) * 60 + n(4)).otherwise(0).cast("long")


def parse_memory(text, strict: bool = False) -> Column:
    """MB of ``K``, ``M``, ``G`` or ``T`` amounts; plain numbers are MB, anything else is 0 (with ``strict``, so is ``M``)."""
    t = _c(text)
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([KMGT]?)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([KMGT]?)$", 2)
    scale = F.when(unit == "K", 1 / 1024).when(unit == "G", 1024.0).when(unit == "T", 1048576.0).when((unit == "M") & F.lit(strict), 0.0).otherwise(1.0)
    return F.coalesce(n * scale, F.lit(0.0))


def format_duration(seconds) -> Column:
    s = _c(seconds).cast("long")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    days, hours = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600)
    return F.concat(F.when(days > 0, F.concat(days.cast("string"), F.lit("-"))).otherwise(""), part(hours), F.lit(":"), part(F.floor(F.pmod(s, F.lit(3600)) / 60)), F.lit(":"), part(F.pmod(s, F.lit(60))))


def job_efficiency(df: DataFrame, drop_failed: bool = True) -> DataFrame:
    """One row per job (the id before the dot): its steps put together; jobs with a cancelled or failed step are dropped."""
    d = df.withColumn("job", F.element_at(F.split("JobID", r"\."), 1))
    d = d.withColumns({"elapsed_s": parse_duration("Elapsed"), "cpu_s": parse_duration("TotalCPU"), "rss_mb": parse_memory("MaxRSS"), "req_mb": parse_memory("ReqMem")})
    bad = F.bool_or(F.coalesce(F.col("State").rlike("CANCELLED|FAILED"), F.lit(False)))
    out = d.groupBy("job").agg(
        F.min_by("JobName", "JobID").alias("name"), F.max("AllocCPUS").alias("cpus"), F.array_join(F.array_sort(F.collect_set("State")), ",").alias("states"),
        F.array_join(F.array_sort(F.collect_set("ExitCode")), ",").alias("exit_codes"), F.max("rss_mb").alias("rss_mb"), F.max("req_mb").alias("req_mb"),
        F.sum("elapsed_s").alias("elapsed_s"), F.sum("cpu_s").alias("cpu_s"), bad.alias("_bad"),
    )
    out = out.where("not _bad") if drop_failed else out
    return out.drop("_bad").withColumns({"cpu_pct": F.round(100 * F.try_divide(F.col("cpu_s"), F.col("elapsed_s") * F.col("cpus")), 2), "mem_pct": F.round(100 * F.try_divide("rss_mb", "req_mb"), 2)})


def join_logs(logs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Logs (``job, tool, fraction``) with their jobs."""
    return logs.join(jobs, "job")


def select_best_job(df: DataFrame, exclude: Sequence[str] = ("CANCELLED",)) -> DataFrame:
    """One job per tool and fraction: a long retry before a regular run, completed before failed; then the later id.

    ``df``: ``tool, fraction, job, state, is_long, elapsed_s, cpu_s``. ``replaced_failed_job``: the group has a failed regular run
    and a long one was taken. CPU time under a second is taken from the elapsed time.
    """
    d = df.where(~F.coalesce(F.col("state").rlike("|".join(exclude)), F.lit(False)))
    done = F.col("state") == "COMPLETED"
    rank = F.when(F.col("is_long") & done, 0).when(F.col("is_long"), 1).when(done, 2).otherwise(3)
    group = Window.partitionBy("tool", "fraction")
    d = d.withColumn("_failed", F.bool_or(~F.col("is_long") & ~done).over(group)).withColumn("_r", F.row_number().over(group.orderBy(rank, F.desc("job"))))
    d = d.where("_r = 1").withColumn("replaced_failed_job", F.col("is_long") & F.col("_failed")).drop("_r", "_failed")
    return d.withColumn("cpu_s", F.when(F.col("cpu_s") < 1, F.col("elapsed_s")).otherwise(F.col("cpu_s")))


def extrapolate(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Partial runs (``rules``: ``tool, fraction, factor``) scaled up and marked completed."""
    d = df.join(F.broadcast(rules), ["tool", "fraction"], "left")
    f = F.coalesce("factor", F.lit(1.0))
    return d.withColumns({"cpu_s": F.col("cpu_s") * f, "elapsed_s": F.col("elapsed_s") * f, "state": F.when(F.col("factor").isNotNull(), "COMPLETED").otherwise(F.col("state"))}).drop("factor")


def resource_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    h = F.col("cpu_s") / 3600
    gb = F.col("rss_mb") / 1024
    return df.groupBy(*by).agg(F.count("*").alias("n_jobs"), F.avg(h).alias("avg_cpu_h"), F.min(h).alias("min_cpu_h"), F.max(h).alias("max_cpu_h"), F.sum(h).alias("sum_cpu_h"), F.avg(gb).alias("avg_gb"), F.max(gb).alias("max_gb"), F.array_join(F.transform(F.array_sort(F.collect_set("cpus")), lambda x: x.cast("string")), ",").alias("cpus"))


def label_settings(df: DataFrame, rules: Sequence[tuple[str, float, str]], default: str = "N/A") -> DataFrame:
    """``setting`` of the first rule (tool, largest fraction, label) that fits, and a ``display`` name with it. Fractions are compared as numbers."""
    label = F.lit(default)
    for tool, most, text in reversed(list(rules)):
        label = F.when((F.col("tool") == tool) & (F.col("fraction").cast("double") <= most), text).otherwise(label)
    return df.withColumn("setting", label).withColumn("display", F.when(F.col("setting") == default, F.col("tool")).otherwise(F.concat_ws("_", "tool", "setting")))


def scale_sizes(df: DataFrame, size: str = "size") -> DataFrame:
    """Rank of each distinct size, and its logarithm scaled to 3 to 10 over all rows.

    Distinct sizes are dealt by range and ranked within each range; the ranges' counts add up to what comes before.
    """
    part = cut(df.select(size).distinct().repartitionByRange(size).withColumn("_part", F.spark_partition_id()))
    before = part.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(size))
    sizes = part.withColumn("_place", inside).join(F.broadcast(before), "_part").select(size, (F.col("_place") + F.col("_before")).cast("int").alias("size_rank"))
    ends = df.agg(F.log10(F.min(size)).alias("_a"), F.log10(F.max(size)).alias("_b"))
    scaled = 3 + 7 * F.coalesce(F.try_divide(F.log10(size) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))
    return df.join(sizes, size).crossJoin(F.broadcast(ends)).withColumn("scaled", scaled).drop("_a", "_b")


def dataset_stats(spacers: DataFrame, contigs: DataFrame) -> DataFrame:
    """Numbers, bases, and the product of bases, of both sides. Each has ``length``."""
    a = spacers.agg(F.count("*").alias("n_spacers"), F.sum("length").cast("long").alias("spacer_bp"))
    b = contigs.agg(F.count("*").alias("n_contigs"), F.sum("length").cast("long").alias("contig_bp"))
    return a.crossJoin(b).withColumn("search_space", F.col("spacer_bp") * F.col("contig_bp"))


def failed_jobs(df: DataFrame) -> DataFrame:
    """Failed and timed-out jobs per name and state, most first."""
    return df.where(F.col("State").rlike("FAILED|TIMEOUT")).groupBy("JobName", "State").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "JobName", "State")
