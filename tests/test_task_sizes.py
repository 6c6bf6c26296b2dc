"""What a task holds, and how often rows are read, does not grow with the tables."""

import random

from pyspark.sql import functions as F

from protospark.operators import classify as cl, joins as jo
from protospark.plans import views
from protospark.sources import blocks as blocks_, readers as rd

DATA = "/root/testdata/sf0.001"


def test_many_intervals_are_dealt_into_tasks(spark, monkeypatch):
    """Small partitions are not joined into tasks of any number of rows; a hot key and nulls stay right."""
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(300)}" if rng.random() < 0.95 else None, "c", rng.random() < 0.5, a, a + rng.randrange(1, 30)) for a in (rng.randrange(2000) for _ in range(4000))]
    rows += [("hot", "c", True, a, a + 9) for a in range(0, 1500, 3)]
    df = spark.createDataFrame(rows, "spacer_id string, contig_id string, strand boolean, start long, end long")
    want = sorted(map(str, jo.assign_regions(df).collect()))
    monkeypatch.setattr(jo, "TASK", 250, raising=False)
    assert sorted(map(str, jo.assign_regions(df, most=100).collect())) == want
    got = jo.assign_regions(df)
    assert sorted(map(str, got.collect())) == want
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 1000  # the hot key has 500 of its own
    assert jo.assign_regions(df.where("false")).count() == 0


def test_folded_letters_equal_their_sql(spark, tmp_path):
    """Every character, alone among the letters; nulls, empty texts, texts without letters, slices of a batch."""
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{c}a" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)] + [None, "", "12 é", "İK", "KkKK", "K" * 3, "ÃÄİ"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sql, _ = views.VIEWS["fx_contigs"]
    want = spark.sql(sql.format(**views._SPARK).replace(" documents)", " {documents})"), documents=docs)
    got = views.view(spark, str(tmp_path), "fx_contigs")
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 300


def test_locations_are_written_before_they_are_measured(spark):
    """Each location meets its block once and carries its columns along: its hits are gathered once, and no row is joined back."""
    truth, hits, blocks, spacers = (views.view(spark, DATA, v) for v in ("fx_truth", "fx_hits", "fx_blocks", "fx_spacers"))
    got = cl.multi_metric(truth, hits, blocks, spacers, affine=False)
    want = cl.multi_metric(truth, hits, views.view(spark, DATA, "fx_contigs"), spacers, affine=False)  # regions cut from whole contigs and joined back
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    joins = lambda d: d._jdf.queryExecution().sparkPlan().toString().count("Join")
    assert joins(got) == 3  # spacers, blocks, and the cross join in the view of spacers


def test_regions_longer_than_the_overlap(spark):
    """Regions within a block, over several, over the end, of no block and before the start: by either way the same."""
    rng = random.Random(8)
    seqs = spark.createDataFrame([(f"c{i}", "".join(rng.choices("ACGT", k=n))) for i, n in enumerate((70, 16, 3))], "contig_id string, seq string")
    stored = blocks_.store_blocks(seqs, size=16, overlap=4)
    rows = [("s", f"c{rng.randrange(4)}", a, a + rng.randrange(0, 30), rng.random() < 0.5) for a in (rng.randrange(-3, 80) for _ in range(400))] + [("s", "c0", None, 3, True), ("s", None, 1, 3, True)]
    hits = spark.createDataFrame(rows, "spacer_id string, contig_id string, start long, end long, strand boolean")
    short = hits.where("end - start <= 5 or start is null")
    for h, longest in ((short, 5), (hits, 29)):
        plain, quick = (sorted(map(str, jo.attach_regions(h, stored, n).select(*h.columns, "region_seq").collect())) for n in (None, longest))
        assert plain == quick


def test_hits_of_large_files_are_dealt_into_tasks(spark, tmp_path, monkeypatch):
    """By the file's size, for every format; rows are the same."""
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(200)}", f"c{rng.randrange(3)}", rng.randrange(1, 500), rng.choice("+-")) for _ in range(3000)]
    lengths = spark.createDataFrame([(f"s{i}", 30) for i in range(190)], "spacer_id string, length int")
    files = {
        "sassy": ["\t".join(rd.SASSY.replace("`", "").split(", ")), *(f"{s}\t{c}\t1\t{d}\t{a}\t{a + 30}\tACGT\t30=" for s, c, a, d in rows)],
        "sam": [f"{s}\t{16 * (d == '-')}\t{c}\t{a}\t9\t30M\t*\t0\t0\t*\t*\tNM:i:1" for s, c, a, d in rows],
        "tab": [f"{c}\t{s}\t{a}\t{a + 30}\t{d}" for s, c, a, d in rows],
        "blast": [f"{s}\t{c}\t29\t30\t1\t30\t0\t1\t30\t{a}\t{a + 29}\t0.0\t0.0" for s, c, a, _ in rows],
    }
    for kind, lines in files.items():
        (tmp_path / kind).write_text("\n".join(lines) + "\n")
    specs = [(kind, kind, str(tmp_path / kind)) for kind in files]
    want = sorted(map(str, rd.read_all_tools(spark, specs, lengths, 3).collect()))
    monkeypatch.setattr(rd, "TASK", 1 << 12, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # files that need tasks are no files to be broadcast
    try:
        got = rd.read_all_tools(spark, specs, lengths, 3)
        assert sorted(map(str, got.collect())) == want and len(want) > 8000
        sizes = [r["count"] for r in got.groupBy("tool", F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 600  # of some 2,800 a tool
