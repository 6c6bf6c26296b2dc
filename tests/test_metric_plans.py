"""What is done once: distances of a location, and their counts for all thresholds."""

from pyspark.sql import functions as F

from protospark.functions import distance as dist
from protospark.operators import classify as cl
from protospark.plans import catalogue
from tests.test_cube import DATA, rows

MULTI = "spacer_id string, contig_id string, strand boolean, start_gt long, end_gt long, mismatches_gt int, reported_mismatches int, edit int"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distances_are_computed_once(spark):
    """A filter on both distances stays above them, so that regions are cut once and blocks are left behind; the sweep needs the edit distance only."""
    plan = _plan(catalogue.QUERIES["disagreements"](spark, DATA))
    assert plan.count("_hamming(") == 1
    assert "_hamming(" not in _plan(catalogue.QUERIES["threshold_sweep"](spark, DATA))


def test_limited_distance_is_called_once(spark):
    pairs = spark.createDataFrame([("ACGTACGT", "ACGTTCGT"), ("AAAAAAAA", "TTTTTTTT")], "spacer_seq string, region_seq string")
    d = dist.all_distances(pairs, limit=5)
    assert [_plan(d).count(x) for x in ("_hamming(", "_affine(")] == [1, 1]
    assert sorted((r.hamming, r.edit, r.gap_affine) for r in d.collect() if r.edit is not None) == [(1, 1, 1)]


def test_sweep_with_missing_values(spark):
    """A truth row found at several places, distances and reports that are missing, planned places of unknown distance."""
    df = [("a", "x", True, 1, 30, 0, 2, 0), ("a", "x", True, 1, 30, 0, 1, 1), ("b", "x", True, 1, 30, 1, 0, None), ("c", "x", False, None, None, None, 1, 2), ("c", "x", False, None, None, None, 0, None), ("d", "x", True, 5, 9, None, 0, 0), ("e", "x", True, 5, 9, 0, None, 0)]
    truth = spark.createDataFrame([(0,), (1,), (1,), (None,)], "mismatches int")
    df = spark.createDataFrame(df, MULTI).withColumn("classification", F.when(F.col("start_gt").isNotNull(), cl.PLANNED).otherwise(cl.INVALID))
    got = cl.threshold_sweep(df, truth, range(3)).select("threshold", "n_truth", "identified", "spurious", "invalid", "n", "missed")
    assert rows(got) == rows(spark.createDataFrame([(0, 1, 0, 1, 2, 3, 1), (1, 3, 2, 1, 2, 5, 1), (2, 3, 2, 2, 1, 6, 1)], got.schema))
