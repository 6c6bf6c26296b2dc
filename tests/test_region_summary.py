"""Regions' locations, tools and least distance without the truth, against the way over all distances; what all sequence queries share on the way."""

import random

import pytest
from pyspark.sql import functions as F

from protospark.functions import distance as dist
from protospark.operators import classify as cl
from protospark.plans import catalogue
from protospark.plans.views import view
from protospark.sources.blocks import store_blocks
from tests.test_cube import DATA, rows

HITS = "spacer_id string, contig_id string, start long, end long, strand boolean, mismatches int, tool string"
TRUTH = HITS.replace(", tool string", "")


@pytest.mark.parametrize("longest", [9, 30])
def test_equals_the_way_over_all_distances(spark, longest):
    """Nulls in every column, missing and short sequences, repeated hits, places beyond a contig's end, 130 tools; regions of one block, and of several."""
    rng = random.Random(longest)
    word = lambda n: "".join(rng.choices("ACGT", k=n))
    contigs = spark.createDataFrame([(f"c{i}", word(n)) for i, n in enumerate((200, 90, 16, 3))], "contig_id string, seq string")
    spacers = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate([word(8), word(7), "", None, word(longest)])], "spacer_id string, seq string")
    some = lambda v: None if rng.random() < 0.03 else v
    hits = [(some(f"s{rng.randrange(6)}"), some(f"c{rng.randrange(5)}"), some(a), a + rng.randrange(longest + 1), some(rng.random() < 0.5), some(1), some(f"t{rng.randrange(130)}")) for a in (rng.randrange(210) for _ in range(1500))]
    hits = spark.createDataFrame(hits + hits[:200], HITS)
    for given in (contigs, store_blocks(contigs, size=32, overlap=8)):
        got, want = cl.region_summary(hits, given, spacers), cl.by_region(cl.multi_metric(spark.createDataFrame([], TRUTH), hits, given, spacers, affine=False))
        assert got.dtypes == want.dtypes
        assert rows(got) == rows(want) and got.count() > 200
    assert cl.region_summary(hits.where("false"), contigs, spacers).count() == 0
    assert {r.tools for r in cl.region_summary(hits.withColumn("tool", F.lit(None).cast("string")), contigs, spacers).collect()} == {""}


def test_query_meets_no_truth(spark, monkeypatch):
    want = rows(cl.by_region(cl.multi_metric(*(view(spark, DATA, v) for v in ("fx_truth", "fx_hits", "fx_blocks", "fx_spacers")), affine=False)))
    monkeypatch.setattr(cl, "locate", None)
    assert rows(catalogue.QUERIES["by_region"](spark, DATA)) == want


def test_hits_are_dealt_once_as_blocks_are(spark, monkeypatch):
    """Hits are shuffled to the blocks, where locations are gathered; locations and spacers meet by another exchange; blocks stay where they are."""
    plans = []
    monkeypatch.setattr(cl, "cut", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or d)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cl.region_summary(*(view(spark, DATA, v) for v in ("fx_hits", "fx_blocks", "fx_spacers")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0].count("Exchange hashpartitioning") == 3 and "_edit" not in plans[0] and "ObjectHashAggregate" not in plans[0]


def test_hamming_of_odd_pairs(spark):
    rng = random.Random(4)
    word = lambda s, n: "".join(rng.choices(s, k=n))
    pairs = [(None, "A"), ("A", None), (None, None), ("", ""), ("", "ACG"), ("AC", ""), ("aé", "éa"), ("é", "ab"), ("ACG\U0001f600", "ACGT")]
    pairs += [(word("ACGTN", rng.randrange(6)), word("ACGTé", rng.randrange(6))) for _ in range(400)]

    def brute(a, b):
        if a is None or b is None:
            return None
        a, b = sorted((a, b), key=len)
        return min(sum(x != y for x, y in zip(a, b[i:])) for i in range(len(b) - len(a) + 1))

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert {r.i: r.h for r in df.withColumn("h", dist.hamming("a", "b")).collect()} == {i: brute(*p) for i, p in enumerate(pairs)}


def test_blocks_of_letters_of_several_bytes(spark):
    """Parts are counted in letters, also where they are copied by bytes."""
    seqs = [("plain", "ACGT" * 25), ("wide", "Aé\U0001f600T" * 25), ("short", "é"), ("empty", ""), ("null", None)]
    df = spark.createDataFrame(seqs, "contig_id string, seq string")
    for given in (store_blocks(df, size=16, overlap=4), store_blocks(df.withColumn("n", F.length("seq")), size=16, overlap=4, length="n")):
        got = {(r.contig_id, r.block): (r.own, r.seq) for r in given.table.collect()}
        assert got == {(i, b): (min(16, len(s) - b * 16), s[b * 16 : b * 16 + 20]) for i, s in seqs if s for b in range(-(-len(s) // 16))}
