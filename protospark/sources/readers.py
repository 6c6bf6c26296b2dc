"""Sequence files and the outputs of search tools, as hits in one form; sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from protospark.schemas import HITS, TRUTH
from protospark.sources.sam import sam_records

#: Bytes of a file (a line has 35 to 80 of them) whose hits a task should hold, under 1 KB each, if there are more than that for each core.
TASK = 1 << 24
_HIT = [c.split()[0].strip("`") for c in HITS.split(", ")][:-1]


def fasta_records(lines: DataFrame) -> DataFrame:
    """``seqid, seq`` of text records that were split at ``\\n>``."""
    v = F.regexp_replace("value", "^>", "")
    head = F.substring_index(v, "\n", 1)
    body = F.when(F.instr(v, "\n") > 0, F.expr("substring(value_, instr(value_, '\n') + 1)")).otherwise("")
    d = lines.withColumn("value_", v).where(F.length(F.trim("value_")) > 0)
    return d.select(F.regexp_replace(head, "\r$", "").alias("seqid"), F.regexp_replace(body, r"\s", "").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``seqid`` (the whole header) and ``seq`` (its lines joined). Plain files are split among tasks."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path))


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "seqid", F.lit("\n"), "seq").alias("value")).write.text(path)


def select_sequences(seqs: DataFrame, ids: DataFrame, id: str = "seqid") -> DataFrame:
    return seqs.join(ids.select(id), id, "left_semi")


def _dealt(df: DataFrame, tasks: int | None, id: str = "spacer_id") -> DataFrame:
    """Rows by spacer in ``tasks`` partitions at least, which the join with lengths and the distinct go on with; Spark would join partitions up to a size on disk.

    None: as Spark does. A join takes no side's partitions that are fewer than ``spark.sql.shuffle.partitions``, hence the larger of both.
    """
    spark = df.sparkSession
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), id) if tasks and tasks > spark.sparkContext.defaultParallelism else df


def _finish(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """Inner join with spacer lengths (``spacer_id, length``), the hits' columns, distinct."""
    d = df.join(lengths.select("spacer_id", F.col("length").cast("int").alias("spacer_length")), "spacer_id")
    return d.select("spacer_id", "contig_id", "spacer_length", "strand", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("mismatches").cast("int").alias("mismatches")).distinct()


def hits_of_sassy(rows: DataFrame, lengths: DataFrame, max_mismatches: int = 5, max_gaps: int | None = None, max_ns: int = 5, tasks: int | None = None) -> DataFrame:
    """Rows ``pat_id, text_id, cost, strand, start, end, match_region, cigar``. ``max_gaps`` limits gap operations (not bases)."""
    d = rows.where((F.regexp_count("match_region", F.lit("[Nn]")) <= max_ns) & (F.col("cost") <= max_mismatches))
    if max_gaps is not None:
        d = d.where(F.regexp_count("cigar", F.lit("[IDN]")) <= max_gaps)
    d = d.select(F.col("pat_id").alias("spacer_id"), F.col("text_id").alias("contig_id"), (F.col("strand") == "-").alias("strand"), "start", "end", F.col("cost").alias("mismatches"))
    return _finish(_dealt(d, tasks), lengths)


SASSY = "pat_id string, text_id string, cost int, strand string, start long, `end` long, match_region string, cigar string"
BLAST = "query string, target string, nident int, alnlen int, mismatch int, qlen int, gapopen int, qstart long, qend long, tstart long, tend long, evalue double, bits double"


def read_sassy(spark: SparkSession, path: str, lengths: DataFrame, **limits) -> DataFrame:
    return hits_of_sassy(spark.read.csv(path, sep="\t", header=True, schema=SASSY), lengths, **limits, tasks=_tasks(spark, path))


def hits_of_blast(rows: DataFrame, lengths: DataFrame, max_mismatches: int = 5, tasks: int | None = None) -> DataFrame:
    """13-column rows, 1-based; ends of the target are swapped where the query runs backwards."""
    k = max_mismatches
    back = F.col("qend") < F.col("qstart")
    d = rows.where(F.col("mismatch") <= k).withColumns({"_a": F.when(back, F.col("tend")).otherwise(F.col("tstart")), "_b": F.when(back, F.col("tstart")).otherwise(F.col("tend"))})
    d = d.withColumn("mismatches", F.col("qlen") - F.col("nident") + F.col("gapopen")).where(F.col("mismatches") <= k)
    d = d.select(F.col("query").alias("spacer_id"), F.col("target").alias("contig_id"), (F.col("_a") > F.col("_b")).alias("strand"), (F.least("_a", "_b") - 1).alias("start"), F.greatest("_a", "_b").alias("end"), "mismatches")
    return _finish(_dealt(d, tasks), lengths)


def read_blast_tab(spark: SparkSession, path: str, lengths: DataFrame, max_mismatches: int = 5) -> DataFrame:
    return hits_of_blast(spark.read.csv(path, sep="\t", schema=BLAST), lengths, max_mismatches, _tasks(spark, path))


def hits_of_sam(lines: DataFrame, lengths: DataFrame, max_mismatches: int = 5, mode: str = "aligned", counts: Observation | None = None, tasks: int | None = None) -> DataFrame:
    """SAM lines (``value``). Unmapped and malformed records and headers are skipped; unknown spacers and negative counts are dropped.

    ``counts`` is filled by the first action on the result: ``records`` (mapped), and of these ``unknown_spacer``, ``negative``, ``over_limit``.

    ``aligned``: aligned bases are M, = and X; clips and the NM tag add to mismatches. ``cigar_total``: all CIGAR numbers are aligned.
    """
    d = _dealt(sam_records(lines), tasks).join(lengths.select("spacer_id", F.col("length").alias("_len")), "spacer_id", "inner" if counts is None else "left")
    if mode == "aligned":
        nm = F.col("nm") + F.col("clip")
        d = d.withColumns({"mismatches": F.col("_len") - F.col("aligned") + nm, "end": F.col("start") + F.col("span"), "_most": F.greatest(F.col("_len") - F.col("aligned") + nm, nm)})
    else:
        d = d.withColumns({"mismatches": F.col("_len") - F.col("total") + F.col("clip") + F.col("nm"), "end": F.col("start") + F.col("total")}).withColumn("_most", F.col("mismatches"))
    if counts is not None:
        known, negative = F.col("_len").isNotNull(), F.col("mismatches") < 0
        d = d.observe(counts, F.count(F.lit(1)).alias("records"), F.count_if(~known).alias("unknown_spacer"), F.count_if(negative).alias("negative"), F.count_if(~negative & (F.col("_most") > max_mismatches)).alias("over_limit"))
    d = d.where(F.col("_most") <= max_mismatches).where("mismatches >= 0")
    return _finish(d.withColumn("strand", F.expr("flag & 16 <> 0")).select("spacer_id", "contig_id", "strand", "start", "end", "mismatches"), lengths)


def read_sam(spark: SparkSession, path: str, lengths: DataFrame, max_mismatches: int = 5, mode: str = "aligned", counts: Observation | None = None) -> DataFrame:
    return hits_of_sam(spark.read.text(path), lengths, max_mismatches, mode, counts, _tasks(spark, path))


def hits_of_tab(rows: DataFrame, lengths: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows ``contig_id, spacer_id, start, end, strand``: exact matches."""
    strand = F.when(F.lower(F.col("strand").cast("string")).isin("-", "true", "1"), True).otherwise(False)
    return _finish(_dealt(rows.select("spacer_id", "contig_id", strand.alias("strand"), "start", "end", F.lit(0).alias("mismatches")), tasks), lengths)


def read_tab(spark: SparkSession, path: str, lengths: DataFrame) -> DataFrame:
    return hits_of_tab(spark.read.csv(path, sep="\t", schema="contig_id string, spacer_id string, start long, `end` long, strand string"), lengths, _tasks(spark, path))


READERS = {"sassy": read_sassy, "blast": read_blast_tab, "sam": read_sam, "tab": read_tab}


def _size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of a folder's files; 0 if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def _exists(spark: SparkSession, path: str) -> bool:
    return _size(spark, path) > 0


def _tasks(spark: SparkSession, path: str) -> int:
    return -(-_size(spark, path) // TASK)


def read_all_tools(spark: SparkSession, specs: Sequence[tuple[str, str, str]], lengths: DataFrame, max_mismatches: int = 5) -> DataFrame:
    """Hits of all ``(tool, format, path)``; files that are missing or empty are skipped. Without any, an empty table."""
    parts = []
    for tool, kind, path in specs:
        if _exists(spark, path):
            limit = {} if kind == "tab" else {"max_mismatches": max_mismatches}
            parts.append(READERS[kind](spark, path, lengths, **limit).withColumn("tool", F.lit(tool)))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], HITS)) if parts else spark.createDataFrame([], HITS)


def truth_of(rows: DataFrame, max_mismatches: int) -> DataFrame:
    """Rows within the limit, one per hit key (the fewest mismatches)."""
    return rows.where(F.col("mismatches") <= max_mismatches).groupBy("spacer_id", "contig_id", "start", "end", "strand").agg(F.min("mismatches").alias("mismatches"))


def read_ground_truth(spark: SparkSession, path: str, max_mismatches: int = 5) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, schema=TRUTH) if _exists(spark, path) else spark.createDataFrame([], TRUTH)
    return truth_of(rows, max_mismatches)


def read_metadata(spark: SparkSession, path: str, required: Sequence[str] = ("seqid", "length", "gc"), schema: str | None = None) -> DataFrame:
    """Parquet, CSV or TSV by the path's ending. With a schema, text tables are read once; without, once more to find the types."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, sep="\t" if ".tsv" in path else ",", header=True, schema=schema, inferSchema=None if schema else True)
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    return df


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    if fmt == "parquet":
        df.write.mode(mode).option("compression", "snappy").parquet(path)
    elif fmt == "tsv":
        df.write.mode(mode).csv(path, sep="\t", header=True)
    else:
        raise ValueError(f"no format {fmt!r}")


def load_fractions(spark: SparkSession, paths: Mapping[float, str]) -> DataFrame:
    """Tables of several dataset fractions under each other, with ``fraction``; missing ones are skipped."""
    parts = [spark.read.parquet(p).withColumn("fraction", F.lit(float(f))) for f, p in sorted(paths.items()) if _exists(spark, p)]
    if not parts:
        raise FileNotFoundError("no fraction has a table")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def query_fractions(fractions: DataFrame, sql: str, out: str | None = None) -> DataFrame:
    """SQL over the table ``{fractions}`` (braces are part of the SQL's text); saved as Parquet if ``out`` is given. No view is left behind."""
    df = fractions.sparkSession.sql(sql, fractions=fractions)
    if out:
        save(df, out)
    return df


def read_timings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per timing file: the first result's times, the command, and the tool (the file's name)."""
    run = "mean double, stddev double, median double, user double, system double, min double, max double, command string"
    df = spark.read.schema(f"results array<struct<{run.replace(' double', ': double').replace(' string', ': string')}>>").json(list(paths), multiLine=True)
    tool = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.sh)?\.json$", 1)
    return df.select(F.element_at("results", 1).alias("r"), tool.alias("tool")).select("r.*", "tool").withColumn("stddev", F.coalesce("stddev", F.lit(0.0)))


ACCOUNTING = "JobID string, JobName string, State string, ExitCode string, AllocCPUS int, Elapsed string, TotalCPU string, MaxRSS string, ReqMem string"


def read_accounting(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="|", header=True, schema=ACCOUNTING)


def parse_log_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``job``, ``fraction`` or ``simulation``, and ``tool`` from paths like ``…/fraction_0.1/slurm_logs/tool-123.out``."""
    none = lambda c: F.nullif(c, F.lit(""))
    return df.withColumns({
        "job": none(F.regexp_extract(path, r"-(\d+)\.(?:out|err)$", 1)), "fraction": none(F.regexp_extract(path, r"fraction_([0-9.]+)", 1)).try_cast("double"),
        "simulation": none(F.regexp_extract(path, r"(ns_\d+_nc_\d+[^/]*)", 1)), "tool": none(F.regexp_extract(path, r"([^/]+)-\d+\.(?:out|err)$", 1)),
    })


def parse_dataset_name(name: str) -> tuple[Column, Column]:
    """(spacers, contigs) of a name like ``ns_100_nc_5000…``."""
    return F.regexp_extract(name, r"ns_(\d+)", 1).try_cast("long"), F.regexp_extract(name, r"nc_(\d+)", 1).try_cast("long")
