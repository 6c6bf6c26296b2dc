"""The region cube against the operators that gather tools by name, on odd rows and on derived hits."""

import random

import pytest
from pyspark.sql import functions as F

from protospark.operators import agreement as ag, cube as cu, joins as jo
from protospark.plans.views import view

DATA = "/root/testdata/sf0.001"
HITS = "spacer_id string, contig_id string, strand boolean, start long, end long, tool string, mismatches int, fraction long"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def odd_hits(spark, n, seed=5):
    rng = random.Random(seed)
    some = lambda *v: rng.choice(v)
    out = []
    for _ in range(n):
        start = rng.randrange(400)
        out.append((some("a", "b", "c", None), some("x", "y", None), some(True, False), start, start + rng.randrange(1, 40), some("t1", "t2", "T3", "t,4"), some(0, 1, 2, 3, 5, 6, 9, None), some(0, 1, None)))
    return spark.createDataFrame(out + out[: n // 5], HITS)


@pytest.mark.parametrize("which", ["odd", "derived"])
def test_cube_equals_operators_over_names(spark, which):
    hits = odd_hits(spark, 300) if which == "odd" else view(spark, DATA, "fx_intervals")
    regions = jo.assign_regions(hits).cache()
    cube = cu.region_cube(hits, dataset="fraction")
    one = regions.withColumn("all", F.lit(1))
    known = regions.where("fraction is not null")  # a join on datasets leaves nulls out
    assert rows(cube.recall_by_dataset().where("fraction is not null")) == rows(ag.recall_by_dataset(known))
    assert rows(cube.recall()) == rows(ag.recall_by_dataset(one, "all").drop("all"))
    for exact in (False, True):
        assert rows(cube.recall_by_threshold(range(6), exact)) == rows(ag.recall_by_threshold(regions, range(6), exact=exact))
        assert rows(cube.tool_combinations(3, exact)) == rows(ag.tool_combinations(regions, 3, exact))
    assert rows(cube.tool_combinations()) == rows(ag.tool_combinations(regions))
    for diagonal in (False, True):
        assert rows(cube.difference_matrix(diagonal)) == rows(ag.difference_matrix(regions, ag.REGION, diagonal))
        assert rows(cube.difference_matrix(diagonal, 2)) == rows(ag.difference_matrix(regions, ag.REGION, diagonal, 2))
    if which == "derived":  # counts of structs and spacers read nulls differently
        assert rows(cube.matched_contigs()) == rows(ag.matched_contigs(regions))
        assert rows(cube.occurrence_fractions()) == rows(ag.occurrence_fractions(regions, unit=ag.REGION[1:]))
        assert rows(cube.occurrence_fractions(1)) == rows(ag.occurrence_fractions(regions, 1, unit=ag.REGION[1:]))
    assert rows(cube.only_by(["t1", "tool_1"])) == rows(ag.only_by(regions, ["t1", "tool_1"]))
    regions.unpersist()


def test_cube_without_hits_without_tools_and_beyond_limits(spark):
    hits = odd_hits(spark, 20)
    empty = cu.region_cube(hits.where("false"), dataset="fraction")
    assert empty.regions.count() == empty.recall_by_dataset().count() == empty.difference_matrix().count() == empty.tool_combinations().count() == empty.occurrence_fractions().count() == 0
    unnamed = cu.region_cube(hits.withColumn("tool", F.when(F.col("start") % 2 == 0, F.col("tool"))))
    kept = jo.assign_regions(hits.where("start % 2 = 0"))
    assert unnamed.regions.count() == kept.select(*ag.REGION).distinct().count()
    assert cu.region_cube(hits, tools=["t1"]).tools == ("t1",)
    with pytest.raises(ValueError):
        unnamed.recall_by_dataset()
    with pytest.raises(ValueError):
        unnamed.recall_by_threshold([6])
    with pytest.raises(ValueError):
        cu.region_cube(hits, tools=[f"t{i}" for i in range(64)])
    wide = cu.region_cube(hits.withColumn("tool", F.format_string("t%02d", F.monotonically_increasing_id() % 63)), tools=[f"t{i:02}" for i in range(63)])
    assert wide.recall().agg(F.sum("n_found")).first()[0] == wide.regions.select(F.sum(F.bit_count("tools"))).first()[0]


def test_one_hot_key(spark):
    """One key beyond what a task may hold: the regions come from ranges of the key, with the same counts."""
    n = jo.MOST + 5000
    hits = spark.range(n).selectExpr("'a' spacer_id", "'x' contig_id", "true strand", "(id * 7919) % 900000 start", "(id * 7919) % 900000 + 3 end", "concat('t', id % 3) tool", "cast(id % 4 as int) mismatches", "id % 2 fraction")
    cube, regions = cu.region_cube(hits, dataset="fraction"), jo.assign_regions(hits, most=n)
    assert rows(cube.recall_by_dataset()) == rows(ag.recall_by_dataset(regions))
    assert rows(cube.tool_combinations()) == rows(ag.tool_combinations(regions))


def test_exchanges(spark):
    """One exchange builds the cube, one reads a count from it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cube = cu.region_cube(view(spark, DATA, "fx_intervals"), dataset="fraction")
        build = cu._cells(view(spark, DATA, "fx_intervals"), cube.tools, "fraction", "mismatches", 5, 5)
        n = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert n(build) == 1
        assert [n(df) for df in (cube.recall_by_dataset(), cube.recall_by_threshold(range(6)), cube.tool_combinations(), cube.occurrence_fractions())] == [1, 1, 1, 1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
