"""Sizes of a subsample."""

from protospark.operators import sampling as sm


def test_share_is_taken_to_the_nearest_row(spark):
    assert [sm.parse_reduction(0.2, n) for n in (13, 14, 15, 80946, 40473)] == [3, 3, 3, 16189, 8095]
    assert [sm.parse_reduction(v, 13) for v in (0.5, 1, 5.9, 40)] == [7, 13, 5, 13]
    rows = [(f"ct_{i}", "class_1", 100, 0.5, True) for i in range(13)]
    pool = spark.createDataFrame(rows, "seqid string, class string, length long, gc double, hq boolean")
    assert sm.subsample(pool.select("seqid"), pool, 0.2)[1].count() == 3
