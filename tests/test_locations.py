"""Locations with their tools, and the comparison over them, against the operators that keep every hit."""

import random

from pyspark.sql import functions as F

from protospark.operators import classify as cl, joins as jo
from protospark.plans.views import view
from protospark.schemas import HIT_KEY
from tests.test_cube import DATA, rows

TRUTH = "spacer_id string, contig_id string, start long, end long, strand boolean, mismatches int"


def test_locate_equals_match_and_sets(spark):
    rng = random.Random(9)
    some = lambda *v: rng.choice(v)
    place = lambda: (some("a", "b", None), some("x", None), s := rng.randrange(-3, 90), s + rng.randrange(20, 32), some(True, False))
    truth = [(*place(), rng.randrange(4)) for _ in range(60)]
    hits = [(*p, some("t1", "t2", None)) for p in (place() for _ in range(250)) for _ in range(rng.randrange(1, 4))]
    truth, hits = spark.createDataFrame(truth, TRUTH), spark.createDataFrame(hits, TRUTH.replace("mismatches int", "tool string"))
    got = jo.locate(truth, hits)
    assert rows(got.where("start_gt is not null").drop("tools")) == rows(jo.match_with_tolerance(truth, cl.unique_hits(hits)))
    assert rows(got.select(*HIT_KEY, "tools")) == rows(hits.groupBy(*HIT_KEY).agg(F.array_sort(F.collect_set("tool")).alias("tools")))
    assert jo.locate(truth.where("false"), hits).where("start_gt is not null").count() == jo.locate(truth, hits.where("false")).count() == 0


def test_one_exchange_of_hits(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jo.locate(view(spark, DATA, "fx_truth"), view(spark, DATA, "fx_hits"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # hits and truth
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_performance_of_locations_equals_that_of_hits(spark):
    truth, hits, contigs, spacers = (view(spark, DATA, v) for v in ("fx_truth", "fx_hits", "fx_contigs", "fx_spacers"))
    hits = hits.unionByName(hits.where("start % 5 = 0"))  # repeated rows
    spacers = spacers.where("spacer_id not like '%7_2'")  # missing sequences
    told = cl.classify(truth, hits, contigs, spacers).cache()
    locations = cl.classify_locations(truth, hits, contigs, spacers)
    assert rows(locations.drop("tools")) == rows(told.select(*locations.drop("tools").columns).distinct())
    assert rows(cl.location_performance(locations, truth)) == rows(cl.tool_performance(cl.with_combined(told), truth))
    told.unpersist()
