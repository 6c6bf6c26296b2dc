"""The affine distance: in multi_metric, and its counts against the alignment that a plain version draws."""

import random

import numpy as np
import pytest

from protospark.functions.distance import affine_columns, gap_affine, gotoh
from protospark.plans import catalogue
from protospark.plans.views import view

DATA = "/root/testdata/sf0.001"


def plain(a: str, b: str, open_: int = 5, extend: int = 5) -> int:
    return sum(x != y for x, y in zip(*gotoh(a, b, open_, extend)))


def test_multi_metric_has_all_three_distances(spark):
    """Every location's affine distance is that of its sequences, and its class takes all three."""
    d = catalogue.QUERIES["multi_metric"](spark, DATA)
    spacers, contigs = ({r[0]: r[1] for r in view(spark, DATA, v).select(k, "seq").collect()} for v, k in (("fx_spacers", "spacer_id"), ("fx_contigs", "contig_id")))
    flip = str.maketrans("ACGT", "TGCA")
    rows = d.collect()
    assert len(rows) > 500 and len({r.gap_affine for r in rows}) > 5
    for r in rows:
        region = contigs[r.contig_id][r.start : r.end]
        region = region[::-1].translate(flip) if r.strand else region
        assert r.gap_affine == plain(spacers[r.spacer_id], region) >= r.edit
        known = [x for x in (r.hamming, r.edit, r.gap_affine) if x is not None]
        assert r.classification == ("positive_in_plan" if r.start_gt is not None else "positive_not_in_plan" if min(known) <= 5 else "invalid_alignment")


@pytest.mark.parametrize("costs", [(5, 5), (10, 5), (7, 1), (5, 0), (3, 6), (0, 0), (100_000, 100_000), (200_000, 100_000)])
def test_columns_against_the_drawn_alignment(costs):
    """High costs take scores of more than 32 bits."""
    rng = np.random.default_rng(2)
    for n, m in ((0, 4), (4, 0), (1, 1), (6, 9), (11, 7), (14, 14)):
        x, y = (rng.integers(65, 68, (30, k)).astype(np.uint32) for k in (n, m))
        y[:15, : min(n, m)] = x[:15, : min(n, m)]
        text = lambda z: ["".join(map(chr, r)) for r in z]
        assert affine_columns(x, y, *costs).tolist() == [plain(a, b, *costs) for a, b in zip(text(x), text(y))]


def test_few_mismatches_and_long_sequences(spark):
    """Pairs of one length that few mismatches tell apart meet no alignment."""
    rng = random.Random(6)
    long = "".join(rng.choices("ACGT", k=200))
    pairs = [(long, long[1:] + "A"), (long, long[:90] + long[120:]), (long[:50], long[:50]), ("ACGTACGT", "ACGAACGT"), ("ACGTACGT", "CGTACGTT"), ("", ""), ("A", ""), (None, "A")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(gap_affine("a", "b").alias("n"), gap_affine("a", "b", 0, 0).alias("z")).collect()
    assert [(r.n, r.z) for r in rows] == [(None, None) if None in p else (plain(*p), plain(*p, 0, 0)) for p in pairs]
