"""Distances up to a limit, and on distinct pairs, against the full ones; the affine table row by row."""

import random

import pytest
from pyspark.sql import functions as F

from protospark.functions import distance as dist
from protospark.operators import classify as cl, joins as jo
from protospark.plans.views import view
from tests.test_cube import DATA, rows


@pytest.mark.parametrize("limit", [0, 2, 5])
def test_limited_equals_full_up_to_the_limit(spark, limit):
    rng = random.Random(limit)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    pairs = [(None, "A"), ("A", None), ("", ""), ("", "ACG")]
    for _ in range(150):
        a = word(rng.randrange(1, 20))
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choices("ACGT", k=rng.randrange(2))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs + pairs[:40], "spacer_seq string, region_seq string").withColumn("k", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    full = {r.k: r for r in dist.all_distances(df).collect()}
    got = dist.all_distances(df, limit=limit)
    assert got.columns == dist.all_distances(df).columns
    up_to = lambda v: v if v is not None and v <= limit else None
    for r in got.collect():
        f = full[r.k]
        assert (r.hamming, r.edit, r.gap_affine) == tuple(up_to(v) for v in (f.hamming, f.edit, f.gap_affine)), f
        assert r.has_indels == (None if r.edit is None else f.edit != f.hamming), f
    assert rows(dist.all_distances(df, limit=limit, distinct=True)) == rows(got)
    assert rows(dist.all_distances(df, distinct=True)) == rows(dist.all_distances(df))


def test_affine_table_row_by_row(spark):
    truth, hits, contigs, spacers = (view(spark, DATA, v) for v in ("fx_truth", "fx_hits", "fx_contigs", "fx_spacers"))
    some = hits.where("pmod(hash(spacer_id), 6) = 0")  # plain alignments in Python are slow; the operator itself reads all rows
    key = lambda r: (r.spacer_id, r.contig_id, r.start, r.end, r.strand)
    full, limited = ({key(r): r for r in cl.multi_metric(truth, some, contigs, spacers, limit=n).collect()} for n in (None, 6))
    seqs = jo.attach_sequences(cl.unique_hits(some), spacers, contigs).collect()
    assert len(seqs) == len(full) == len(limited) > 50
    for r in seqs:
        top, bottom = dist.gotoh(r.spacer_seq, r.region_seq, 5, 5)
        n = sum(x != y for x, y in zip(top, bottom))
        assert full[key(r)].gap_affine == n
        assert limited[key(r)].gap_affine == (n if n <= 6 else None)
        assert limited[key(r)].classification == full[key(r)].classification
    with pytest.raises(ValueError):
        cl.multi_metric(truth, some, contigs, spacers, limit=4)
