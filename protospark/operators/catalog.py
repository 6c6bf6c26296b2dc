"""Projections and filters: contig catalogue, ids, tools, schema alignment."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

RANKS = {"realm": "r", "kingdom": "k", "phylum": "p", "class": "c", "order": "o", "family": "f", "genus": "g", "species": "s"}
_PREFIXED = r"^[0-9a-f]{8}_((contig|spacer)_[0-9]+)"


def build_contig_id(df: DataFrame, parts: Sequence[str] = ("UVIG", "Taxon_oid", "Scaffold_oid", "coordinates"), out: str = "seqid") -> DataFrame:
    """Parts joined by ``|``; nulls and coordinates ``whole`` are left out."""
    return df.withColumn(out, F.concat_ws("|", *(F.nullif(F.col(p).cast("string"), F.lit("whole")) if p == "coordinates" else F.col(p).cast("string") for p in parts)))


def extract_ranks(df: DataFrame, lineage: str = "lineage") -> DataFrame:
    """Adds the eight ranks of a lineage string; null where absent or empty."""
    return df.withColumns({k: F.nullif(F.regexp_extract(lineage, rf"(?:^|;){v}__([^;]*)", 1), F.lit("")) for k, v in RANKS.items()})


def prepare_contig_catalog(stats: DataFrame, info: DataFrame, min_length: int = 1000) -> DataFrame:
    """Stats (``seqid, length, GC``) with info of the same length; no ``GVMAG`` topology, nothing unclassified; names in snake case."""
    d = build_contig_id(info).join(stats.select("seqid", F.col("length").alias("_length"), F.col("GC").alias("gc")), "seqid").where("Length = _length").drop("_length")
    d = d.where("coalesce(Topology, '') <> 'GVMAG'").where(~F.coalesce(F.col("Taxonomic classification").rlike(";;;;;"), F.lit(False)))
    d = d.withColumn("hq", F.coalesce(F.col("MIUViG quality").rlike("(?i)high"), F.lit(False)))
    d = extract_ranks(d, "Taxonomic classification").where(F.col("Length") > min_length)
    return d.toDF(*(c.lower().replace(" ", "_") for c in d.columns))


def exclude_taxa(df: DataFrame, taxa: Mapping[str, Sequence[str]]) -> DataFrame:
    """Without rows of these taxa; a null rank stays."""
    for rank, names in taxa.items():
        df = df.where(~F.coalesce(F.col(rank).isin(list(names)), F.lit(False)))
    return df


def append_like(a: DataFrame, b: DataFrame) -> DataFrame:
    """``b`` under ``a``, its columns cast and put in the order of ``a``."""
    return a.unionByName(b.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in a.schema)))


def strip_prefix(id: str) -> Column:
    return F.regexp_replace(id, _PREFIXED, "$1")


def has_prefix(id: str) -> Column:
    return F.col(id).rlike(_PREFIXED)


def add_prefix(id: str, dataset: str) -> Column:
    """The dataset's prefix before ``contig_N`` and ``spacer_N``, in place of another; other ids stay."""
    bare = strip_prefix(id)
    return F.when(bare.rlike("^(contig|spacer)_[0-9]+"), F.concat(F.lit(f"{dataset}_"), bare)).otherwise(F.col(id))


def filter_tools(df: DataFrame, only: Sequence[str] | None = None, skip: Sequence[str] | None = None) -> DataFrame:
    if only:
        return df.where(F.col("tool").isin(list(only)))
    return df.where(~F.col("tool").isin(list(skip))) if skip else df


def dataset_id(params: Mapping) -> str:
    """Eight hex digits that are the same for the same parameters."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:8]


def short_hash(col: str) -> Column:
    return F.substring(F.sha2(F.col(col).cast("binary"), 256), 1, 8)
