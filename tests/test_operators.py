"""Golden cases, brute force and invariants of the matching operators."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protospark.functions import distance as dist, sequence as seq
from protospark.operators import agreement as ag, classify as cl, joins as jo, quantiles as qu, resources as rs, search
from protospark.plans import catalogue
from protospark.schemas import HITS, TRUTH
from protospark.sources import readers as rd, sam
from protospark.sources.blocks import store_blocks

DATA = "/root/testdata/sf0.001"


def one(spark, col, **values):
    return spark.range(1).select(col.alias("v")).first()[0]


def test_golden_cigar_and_sequences(spark):
    lit = F.lit
    assert one(spark, seq.cigar_ref_span(lit("34M2D1X"))) == 37
    assert one(spark, seq.fix_cigar(lit("10I=M3"))) == "10I=1M3".replace("I=", "I1=")
    assert one(spark, seq.cigar_mismatches(lit("3X4M2X"))) == 5
    assert one(spark, seq.revcomp(lit("ACGTNRa"))) == "aYNACGT"
    assert one(spark, seq.shannon_entropy(lit("ACGT"))) == pytest.approx(2.0)
    assert one(spark, seq.shannon_entropy(lit(""))) == 0
    assert one(spark, seq.lcc(lit("AACCGGTT"))) == pytest.approx(1.0)
    text = "aaaaaatttttttgggggcccccc"
    assert one(spark, seq.most_repeated_kmer(lit(text), 3)) == 5
    assert one(spark, seq.n_nonunique_kmers(lit(text), 3)) == 4


def test_distances(spark):
    rng = random.Random(3)
    pairs = [("ACGT", "TTACGTTT"), ("AAAA", "AAT"), ("", "A"), (None, "A")]
    pairs += [("".join(rng.choices("ACGT", k=rng.randint(1, 9))), "".join(rng.choices("ACGT", k=rng.randint(1, 9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", dist.hamming("a", "b").alias("h"), dist.gap_affine("a", "b").alias("g"))
    for a, b, h, g in df.collect():
        if a is None:
            assert h is None and g is None
            continue
        x, y = sorted((a, b), key=len)
        assert h == min(sum(p != q for p, q in zip(x, y[i:])) for i in range(len(y) - len(x) + 1))
        assert g <= max(len(a), len(b)) + min(len(a), len(b))
    top, bottom = dist.gotoh("ACGTACGT", "ACGTCGT", 5, 5)
    assert (top, bottom) == ("ACGTACGT", "ACGT-CGT")


def test_alignments_with_gaps_against_plain_versions(spark):
    rng = random.Random(13)
    word = lambda a, b: "".join(rng.choices("ACGT", k=rng.randint(a, b)))
    pairs = [(a := word(5, 14), a[:3] + a[rng.randint(4, 5):] + word(0, 3)) for _ in range(40)] + [(word(0, 9), word(0, 9)) for _ in range(80)] + [(None, "A"), ("A", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for open_, extend in ((5, 5), (10, 1), (3, 2)):
        for a, b, g in df.select("a", "b", dist.gap_affine("a", "b", open_, extend)).collect():
            assert g == (None if a is None or b is None else sum(p != q for p, q in zip(*dist.gotoh(a, b, open_, extend))))
    for a, b, e in df.where("a is not null and b is not null").select("a", "b", F.levenshtein("a", "b")).collect():
        top, bottom = dist.edit_alignment(a, b)
        assert sum(p != q for p, q in zip(top, bottom)) == e and top.replace("-", "") == a and bottom.replace("-", "") == b
    assert dist.edit_alignment("ACGTACGT", "AGGTACGT") == ("ACGTACGT", "AGGTACGT")


def test_dust_against_a_plain_loop(spark):
    def plain(s, window, threshold):
        s, n, mask = s.upper(), len(s) - 2, [False] * len(s)
        for i in range(max(n, 0)):
            seen, score = {}, 0
            for j in range(i, min(n, i + window - 2)):
                t = s[j : j + 3]
                score += seen.get(t, 0)
                seen[t] = seen.get(t, 0) + 1
                if j > i and 10 * score > threshold * (j - i):
                    mask[i : j + 3] = [True] * (j + 3 - i)
        return sum(mask)

    rng = random.Random(17)
    seqs = ["", "A", "AAAA", "acgtacgtacgt", "é" * 9] + ["".join(rng.choices("ACG", [6, 2, 1], k=rng.randint(3, 60))) for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in [*seqs, None]], "s string")
    for window, threshold in ((9, 15), (9, 5), (20, 20)):
        for s, got in df.select("s", seq.dust_masked("s", window, threshold)).collect():
            assert got == (None if s is None else plain(s, window, threshold))


def test_search_in_parts_and_with_repeats(spark, monkeypatch):
    """Several shards and blocks, equal spacers and contigs, letters that match nothing, spacers longer than a word of 32 letters."""
    rng = random.Random(19)
    contigs = [(f"c{i}", "".join(rng.choices("ACGTN", [8, 8, 8, 8, 1], k=n))) for i, n in enumerate((900, 500, 90, 0))]
    contigs += [("c0", contigs[0][1]), ("none", None)]
    spacers = [(f"s{i}", contigs[i % 2][1][a : a + n]) for i, (a, n) in enumerate(((0, 30), (470, 30), (200, 75), (200, 75), (820, 80), (333, 41)))] + [("short", "ACG"), ("null", None)]
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = sorted((s, c, i, i + len(q), strand, d) for s, q in spacers if q and len(q) > 3 for strand, x in ((False, q), (True, flip(q))) for c, t in contigs if t for i in range(len(t) - len(q) + 1) if (d := sum(a != b or a == "N" or b == "N" for a, b in zip(x, t[i : i + len(q)]))) <= 3)
    monkeypatch.setattr(search, "SHARD", 2)
    monkeypatch.setattr(search, "BLOCK", 128)
    monkeypatch.setattr(search, "CANDIDATES", 64)
    got = search.protospacer_search(spark.createDataFrame(spacers, "spacer_id string, seq string"), spark.createDataFrame(contigs, "contig_id string, seq string"), 3)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 4


def test_worked_example_of_three_tools(spark):
    sp, ct = "s_10034", "c_1828"
    truth = spark.createDataFrame([(sp, ct, 5001, 5036, True, 1)], TRUTH)
    lengths = spark.createDataFrame([(sp, 35)], "spacer_id string, length int")
    blast = spark.createDataFrame([(sp, ct, 34, 34, 0, 35, 0, 1, 34, 5036, 5003, 0.0, 0.0), (sp, ct, 34, 35, 1, 35, 0, 35, 1, 5002, 5036, 0.0, 0.0)], rd.BLAST)
    sassy = spark.createDataFrame([(sp, ct, 1, "-", 5000, 5036, "ACGT", "34=1I1=")], rd.SASSY)
    hits = rd.hits_of_blast(blast, lengths).union(rd.hits_of_sassy(sassy, lengths))
    got = {(r.start, r.end, r.strand, r.mismatches) for r in hits.collect()}
    assert got == {(5002, 5036, True, 1), (5001, 5036, True, 1), (5000, 5036, True, 1)}
    assert jo.match_with_tolerance(truth, hits).count() == 3
    assert [(r.start, r.end) for r in jo.merge_intervals(hits, 5).collect()] == [(5000, 5036)]
    assert rd.hits_of_sassy(sassy, lengths, max_gaps=0).count() == 0


def _merged_by_loop(rows, tol):
    """{(key, start): (end, rows)} of the islands; rows are (key, start, end)."""
    out, at = {}, {}
    for key, s, e in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key in at and s <= out[key, at[key]][0] + tol:
            end, n = out[key, at[key]]
            out[key, at[key]] = (max(end, e), n + 1)
        else:
            at[key] = s
            out[key, s] = (e, 1)
    return out


@pytest.mark.parametrize("tol", [0, 5])
def test_islands_across_ranges_of_a_key(spark, tol):
    """Islands that span ranges, end in them or cover several; null keys, negative starts, repeated rows."""
    rng = random.Random(tol)
    rows = [(rng.choice(["a", "b", None]), s, s + rng.choice([0, 1, 3, 8, 8, 120])) for s in (rng.randint(-500, 4000) for _ in range(900))]
    rows += rows[:50]
    df = spark.createDataFrame([("s", k, True, a, b) for k, a, b in rows], "spacer_id string, contig_id string, strand boolean, start long, `end` long")
    want = _merged_by_loop(rows, tol)
    for most, width in ((0, 1), (315, 4), (1000, 4)):  # keys all spread, some, none
        got = jo.merge_intervals(df, tol, most=most, width=width).collect()
        assert {(r.contig_id, r.start): (r.end, r.n_merged) for r in got} == want and len(got) == len(want)
        told = jo.assign_regions(df, tol, most=most, width=width).collect()
        assert sorted((str(r.contig_id), r.start, r.end) for r in told) == sorted((str(k), a, b) for k, a, b in rows)
        for r in told:
            assert want[r.contig_id, r.region_start][0] == r.region_end and r.region_start <= r.start and r.end <= r.region_end
    empty = df.where("start > 10000")
    assert jo.merge_intervals(empty, tol).count() == 0 == jo.assign_regions(empty, tol).count()


def test_one_key_with_all_intervals_is_spread(spark):
    """A million intervals of one key: islands as in numpy, and no range has more rows than its width."""
    n, tol, width = 1_000_000, 5, 256
    at = F.pmod(F.xxhash64("id"), F.lit(9_000_000))
    df = spark.range(n).select(F.lit("s").alias("spacer_id"), F.lit("c").alias("contig_id"), F.lit(True).alias("strand"), at.alias("start"), (at + 1 + F.pmod(F.col("id"), F.lit(30))).alias("end"))
    start, end = (np.concatenate([c.to_numpy() for c in col.chunks]) for col in df.select("start", "end").toArrow().columns)
    order = np.lexsort((end, start))
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1] + tol])
    got = jo.merge_intervals(df, tol, width=width).orderBy("start").toArrow()
    assert np.array_equal(got["start"].to_numpy(), start[first])
    assert np.array_equal(got["end"].to_numpy(), end[np.r_[first[1:], n] - 1])
    assert np.array_equal(got["n_merged"].to_numpy(), np.diff(np.r_[first, n]))
    ranges = jo._islands(df, tol, jo.GROUP_KEY, width).groupBy(F.expr(f"_bucket div {width}")).count()
    assert ranges.count() > 1000 and ranges.agg(F.max("count")).first()[0] <= width


def test_overlaps_on_one_contig_with_split_bins(spark):
    """All rows on one contig, most in one bin, some across bins: the pairs of a loop, once each, whatever is split."""
    rng = random.Random(8)
    place = lambda: rng.choice([rng.randint(500, 530), rng.randint(0, 3000), 1024])
    planned = [(f"p{i}", "c", a, a + rng.choice([20, 40, 700]), i % 2 == 0, 0) for i, a in enumerate(place() for _ in range(60))]
    hits = [(f"h{i}", "c", 30, i % 3 == 0, a, a + rng.choice([1, 30, 600]), i % 5, "t") for i, a in enumerate(place() for _ in range(300))]
    hits += hits[:20]
    want = sorted((p[0], h[0], "strand_mismatch" if p[4] != h[3] else "exact_match" if p[2:4] == h[4:6] else "partial_overlap") for p in planned for h in hits if h[6] <= 3 and p[2] < h[5] and h[4] < p[3])
    truth, found = spark.createDataFrame(planned, TRUTH), spark.createDataFrame(hits, HITS)
    for most in (1 << 14, 40, 5, 0.5):
        got = jo.overlap_join(truth, found, 3, most=most)
        assert sorted((r.spacer_id_1, r.spacer_id_2, r.overlap) for r in got.collect()) == want
    assert jo.overlap_join(truth, found.where("mismatches > 3"), 3).count() == 0


def test_merge_and_match_against_loops(spark):
    rng = random.Random(5)
    rows = [("s", f"c{rng.randint(0, 2)}", rng.random() < 0.5, a, a + rng.randint(1, 30)) for a in (rng.randint(0, 400) for _ in range(150))]
    df = spark.createDataFrame(rows, "spacer_id string, contig_id string, strand boolean, start long, `end` long")
    want = set()
    for key in {r[:3] for r in rows}:
        cur = None
        for s, e in sorted(r[3:] for r in rows if r[:3] == key):
            if cur and s <= cur[1] + 5:
                cur[1] = max(cur[1], e)
            else:
                cur and want.add((*key, *cur))
                cur = [s, e]
        want.add((*key, *cur))
    assert {(r.spacer_id, r.contig_id, r.strand, r.start, r.end) for r in jo.merge_intervals(df, 5).collect()} == want
    truth = df.limit(40).withColumn("mismatches", F.lit(0))
    for tol in (0, 5):
        t, h = [tuple(r) for r in truth.collect()], df.distinct().collect()
        near = {tuple(x) for x in h if any(y[:3] == tuple(x)[:3] and abs(y[3] - x.start) <= tol and abs(y[4] - x.end) <= tol for y in t)}
        got = jo.match_with_tolerance(truth, df.distinct(), tol)
        assert {(r.spacer_id, r.contig_id, r.strand, r.start, r.end) for r in got.collect()} == near
    plan = jo.match_with_tolerance(truth, df.distinct())._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_search_finds_every_place(spark):
    rng = random.Random(7)
    contigs = {f"c{i}": "".join(rng.choices("ACGT", k=n)) for i, n in enumerate((300, 700, 40))}
    spacers = {f"s{i}": contigs["c1"][a : a + 21] for i, a in enumerate((0, 115, 250, 679))}
    spacers["n"] = "N" * 20 + "A"
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    spacers["r"] = flip(contigs["c0"][100:125])
    want = {(s, c, i, strand, d) for s, q in spacers.items() for strand, x in ((False, q), (True, flip(q))) for c, t in contigs.items() for i in range(len(t) - len(q) + 1) if (d := sum(a != b or a == "N" for a, b in zip(x, t[i : i + len(q)]))) <= 3}
    got = search.protospacer_search(spark.createDataFrame(list(spacers.items()), "spacer_id string, seq string"), spark.createDataFrame(list(contigs.items()), "contig_id string, seq string"), 3)
    assert {(r.spacer_id, r.contig_id, r.start, r.strand, r.mismatches) for r in got.collect()} == want


def test_search_query_allows_three_mismatches(spark, tmp_path):
    rng = random.Random(11)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300))
    near = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if i % 11 == 0 else c for i, c in enumerate(text))
    spark.createDataFrame([(1, text), (2, near)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    contigs, spacers = ({r[0]: r.seq for r in catalogue.view(spark, str(tmp_path), v).collect()} for v in ("fx_contigs", "fx_spacers"))
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {(s, c, i, strand, d) for s, q in spacers.items() for strand, x in ((False, q), (True, flip(q))) for c, t in contigs.items() for i in range(len(t) - len(q) + 1) if (d := sum(a != b for a, b in zip(x, t[i : i + len(q)]))) <= 3}
    assert {w[-1] for w in want} >= {2, 3}
    got = catalogue.QUERIES["protospacer_search"](spark, str(tmp_path)).collect()
    assert {(r.spacer_id, r.contig_id, r.start, r.strand, r.mismatches) for r in got} == want


def test_durations_and_memory(spark):
    for text, want in (("1-02:03:04", 93784), ("00:10:00", 600), ("10:00", 0), ("", 0), (None, 0)):
        assert one(spark, rs.parse_duration(F.lit(text).cast("string"))) == want
    for text, want in (("2048K", 2), ("2G", 2048), ("1T", 1048576), ("7M", 7), ("12", 12), ("x", 0), (None, 0)):
        assert one(spark, rs.parse_memory(F.lit(text).cast("string"))) == want
    assert one(spark, rs.format_duration(F.lit(93784))) == "1-02:03:04"


def test_readers_from_files(spark, tmp_path):
    fasta = tmp_path / "a.fasta"
    fasta.write_text(">one x\nACGT\nAC\n>two\n\n>three\nGG\n")
    assert sorted((r.seqid, r.seq) for r in rd.read_fasta(spark, str(fasta)).collect()) == [("one x", "ACGTAC"), ("three", "GG"), ("two", "")]
    sam = tmp_path / "a.sam"
    sam.write_text("@HD\tVN:1\ns1\t16\tc1\t11\t9\t4S30M\t*\t0\t0\t*\t*\tNM:i:0\ns1\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\nzz\t0\tc1\t1\t9\t34M\t*\t0\t0\t*\t*\n")
    lengths = spark.createDataFrame([("s1", 34)], "spacer_id string, length int")
    assert rd.read_sam(spark, str(sam), lengths, 8).select("start", "end", "strand", "mismatches").collect() == [(10, 40, True, 8)]
    hits = rd.read_all_tools(spark, [("a", "sam", str(sam)), ("b", "sam", str(tmp_path / "none"))], lengths, 8)
    assert hits.count() == 1 and hits.dtypes == spark.createDataFrame([], HITS).dtypes
    assert rd.read_ground_truth(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "t.sh.json").write_text('{"results": [{"mean": 1.5, "stddev": null, "command": "x"}]}')
    row = rd.read_timings(spark, [str(tmp_path / "t.sh.json")]).first()
    assert (row.mean, row.stddev, row.tool) == (1.5, 0.0, "t")


def test_performance_adds_up(spark):
    rows = catalogue.QUERIES["tool_performance"](spark, DATA).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.planned_true_positives + r.false_negatives_planned == r.ground_truth_planned
        assert 0 <= r.recall_planned <= 1 and 0 <= r.precision_planned <= 1


def test_matrix_is_difference_of_sets(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9)], "tool string, k int")
    got = {(r.row_tool, r.col_tool): r.n for r in ag.difference_matrix(df, ["k"], diagonal=True).collect()}
    assert got["a", "a"] == 2 and got["a", "b"] == 1 and got["b", "a"] == 1 and got["c", "a"] == 1 and len(got) == 9


@pytest.mark.parametrize("name", ["tolerance_match", "merge_intervals", "classify", "multi_metric", "recall_by_threshold", "stratified_sample", "read_sam", "job_efficiency", "best_job"])
def test_queries_match_sql(spark, name):
    import os

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.split('.')[0]} as from '{DATA}/{t}'")
    df = catalogue.QUERIES[name](spark, DATA)
    want = con.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda rows, names: sorted((tuple(round(r[names.index(c)], 9) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in cols) for r in rows), key=str)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(want.fetchall(), list(want.columns))


def test_empty_tables(spark):
    hits, truth = spark.createDataFrame([], HITS), spark.createDataFrame([], TRUTH)
    s, c = spark.createDataFrame([], "spacer_id string, seq string"), spark.createDataFrame([], "contig_id string, seq string")
    assert cl.compare(truth, hits, c, s).count() == 0
    assert cl.multi_metric(truth, hits, c, s).count() == 0
    assert search.protospacer_search(s, c).count() == 0


def test_search_of_long_contigs_and_hot_words(spark, monkeypatch):
    """A contig of 2.5 million letters in blocks, spacers that share one word, low complexity; against all windows in numpy."""
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"ACGT", np.uint8)
    long = letters[rng.integers(0, 4, 2_500_000)]
    long[1_000_000:1_000_400] = ord("A")
    long[77:90] = ord("N")
    word = "ACGTTGCAACGTTG"
    spacers = {f"w{i}": word + "".join(rng.choice(list("ACGT"), 20)) for i in range(300)} | {"a": "A" * 33, "t": "T" * 26}
    for i in range(12):
        at = int(rng.integers(0, 2_499_900)) if i else (1 << 20) - 17
        piece = bytearray(long[at : at + 25 + i].tobytes())
        for j in rng.integers(0, len(piece), i % 5):
            piece[j] = b"ACGT"[b"ACGT".find(piece[j]) ^ 1]
        spacers[f"s{i}"] = piece.decode().replace("N", "A")
    monkeypatch.setattr(search, "FINE", 1 << 19)
    got = search.protospacer_search(spark.createDataFrame(list(spacers.items()), "spacer_id string, seq string"), spark.createDataFrame([("long", long.tobytes().decode())], "contig_id string, seq string"), 3)
    flip = str.maketrans("ACGT", "TGCA")
    want = set()
    for name, seq in spacers.items():
        if name[0] == "w" and name > "w110":
            continue
        for strand, x in ((False, seq), (True, seq[::-1].translate(flip))):
            wrong = np.zeros(len(long) - len(x) + 1, np.uint8)
            for j, ch in enumerate(x.encode()):
                wrong += long[j : j + len(wrong)] != ch
            want |= {(name, int(i), int(i) + len(x), strand, int(wrong[i])) for i in np.flatnonzero(wrong <= 3)}
    rows = [r for r in got.collect() if not (r.spacer_id[0] == "w" and r.spacer_id > "w110")]
    assert len(rows) == len(want) and {(r.spacer_id, r.start, r.end, r.strand, r.mismatches) for r in rows} == want
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    index = search.Index(list(spacers.values()), 3)
    index.find(search._CODE[long[:500_000]])
    assert index.candidates < 50_000  # a tenth of a candidate a letter


def test_blocked_sequences(spark):
    """A contig of 2.5 million letters: regions over block edges, long regions, windows, whole again; the second use doesn't shuffle contigs."""
    rng = random.Random(9)
    long = "".join(rng.choices("ACGT", k=2_500_000))
    seqs = {"long": long, "b": long[:5000], "edge": long[: 3 * (1 << 16)], "short": "ACGTN", "empty": "", "none": None}
    df = spark.createDataFrame(list(seqs.items()), "contig_id string, seq string")
    blocks = store_blocks(df, buckets=6)
    rows = [("long", a, a + n, strand) for a, n, strand in ((0, 30, False), ((1 << 16) - 10, 40, True), ((1 << 16) * 7 - 1, 1025, False), (65000, 300000, True), (2_499_990, 10, False), (2_499_990, 99, False), (2_499_990, 5000, True))]
    rows += [("b", 4990, 5200, False), ("edge", (1 << 16) * 2 - 5, (1 << 16) * 3, True), ("short", 1, 4, True), ("nobody", 1, 4, True), ("none", 0, 3, False)] + [("long", a, a + 33, False) for a in rng.choices(range(2_499_000), k=60)]
    hits = spark.createDataFrame(rows, "contig_id string, start long, `end` long, strand boolean")
    want = {(r.contig_id, r.start, r.end, r.strand): r.region_seq for r in jo.attach_regions(hits, df).collect()}
    for use in range(2):
        got = jo.attach_regions(hits, blocks)
        assert {(r.contig_id, r.start, r.end, r.strand): r.region_seq for r in got.collect()} == want
    plan = jo.attach_regions(hits.hint("merge"), blocks)._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("FileScan parquet")
    assert "Bucketed: true" in plan and not any("Exchange" in line for line in plan[:scan].splitlines()[-4:])  # filter, project, sort above the scan
    assert {r.contig_id: r.seq for r in blocks.whole().collect()} == {k: v for k, v in seqs.items() if v}
    assert {r.contig_id for r in blocks.where_ids(df.where("contig_id in ('b', 'short')").select("contig_id")).whole().collect()} == {"b", "short"}
    told = {(r.contig_id, r.start): r.lcc for r in seq.lcc_windows_blocks(blocks, 101).collect()}
    for name in ("long", "b", "edge"):
        whole = seq._window_lcc(seqs[name].encode(), 101)
        mine = np.concatenate([told[k] for k in sorted(told) if k[0] == name])
        assert len(mine) == len(whole) and np.allclose(mine, whole)
    assert ("short", 0) not in told
    with pytest.raises(ValueError):
        seq.lcc_windows_blocks(blocks, 2000)


def test_sam_columns_against_a_loop(spark, tmp_path):
    """Random records, odd tags and CIGARs; a file read with splits at any byte gives the same rows."""
    import re

    rng = random.Random(12)
    lines = ["@HD\tVN:1.6", "", "short\t0", "@\t0\tc\t5\t60\t5M\t*\t0\t0\t*\t*", "s\tx\tc\t5\t60\t5M\t*\t0\t0\t*\t*", "s\t0\tc\t\t60\t5M\t*\t0\t0\t*\t*", "s\t0\tc\t7\t60\t*\t*\t0\t0\t*\tNM:i:9"]
    for i in range(400):
        cigar = "".join(f"{rng.choice(['', '', rng.randint(1, 200)])}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randint(1, 6)))
        tags = [rng.choice(["AS:i:4", "NM:i:3", "nm:i:12", "NM:i:", "NM:i:x", "NM:i:5z", "XX:Z:NM:i:7", "NM:f:3", "Nm:i:0"]) for _ in range(rng.randint(0, 4))]
        lines.append("\t".join([f"s{i % 40}é", str(rng.choice([0, 4, 16, 20, 256, 272])), f"c{i % 7}", str(rng.randint(0, 10**6)), "60", cigar, "*", "0", "0", "A" * (i % 50), "*", *tags]))
    want = []
    for line in lines:
        f = line.split("\t")
        if line.startswith("@") or len(f) < 11 or not f[1].isdigit() or not f[3].isdigit() or int(f[1]) & 4:
            continue
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)([A-Z=])", re.sub("(?<=[A-Z=])(?=[A-Z=])", "1", f[5]))]
        tag = next((int(m[1]) for t in f[11:] if (m := re.match(r"(?i:NM):i:(\d+)", t))), 0)
        total = lambda letters: sum(n for n, o in ops if o in letters)
        want.append((f[0], f[2], int(f[1]), int(f[3]) - 1, total("M=X"), total("MDN=X"), sum(n for n, _ in ops), total("S"), tag))
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    whole = sorted(map(tuple, sam.sam_records(spark.read.text(str(tmp_path))).collect()))
    assert whole == sorted(want) and len(want) > 200
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    try:
        parts = spark.read.text(str(tmp_path))
        assert parts.rdd.getNumPartitions() > 20 and sorted(map(tuple, sam.sam_records(parts).collect())) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sam.parse(pa.array([], pa.string())).num_rows == 0 and sam.parse(pa.array([None, "x"])).num_rows == 0


@pytest.mark.parametrize("limit, buckets", [(1 << 20, 1 << 12), (3, 4)])
def test_quantiles_against_numpy(spark, monkeypatch, limit, buckets):
    """Ties, outliers, one value, no value, null groups; small limits force buckets within buckets."""
    monkeypatch.setattr(qu, "SORTED", limit)
    monkeypatch.setattr(qu, "BUCKETS", buckets)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5, 0.5, 1e12, -3.0]), rng.randint(0, 5)) for _ in range(300)]
    rows += [("one", 7.0, 7), ("none", None, None), ("nan", float("nan"), None), ("two", -1e300, 1), ("two", 1e300, 2)]
    df = spark.createDataFrame(rows, "g string, x double, y long")
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.column): r.quantiles for r in qu.quantiles(df, ["x", "y"], ps, ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for i, c in ((1, "x"), (2, "y")):
            v = [float(r[i]) for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]]
            if v:
                want[g, c] = np.quantile(np.array(v) / 4, ps) * 4
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    whole = qu.quantiles(df, ["y"], [0.5]).collect()
    assert len(whole) == 1 and whole[0].quantiles == [np.median([r[2] for r in rows if r[2] is not None])]
    assert qu.quantiles(df.limit(0), ["x"], [0.5]).count() == 0
