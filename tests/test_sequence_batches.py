"""Windows and k-mers of many sequences in one Arrow batch."""

from collections import Counter

import numpy as np
import pyarrow as pa

from protospark.functions import sequence as seq


def test_windows_of_a_batch_leave_in_stretches(monkeypatch):
    """A batch of 40 blocks leaves in stretches of few letters, with the same windows; blocks shorter than a window have none."""
    monkeypatch.setattr(seq, "LETTERS", 300)
    texts = ["ACGTTGCA" * (i % 9) for i in range(40)] + ["ACGT" * 200, None]
    batch = pa.RecordBatch.from_pydict({"contig_id": [f"c{i}" for i in range(42)], "start": pa.array(range(42), pa.int64()), "seq": pa.array(texts, pa.string())})
    out = list(seq._lcc_batches(20)(iter([batch])))
    assert len(out) > 3 and max(len(b.column(2).flatten()) for b in out) <= 781
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["contig_id"], r["start"]) for r in rows] == [(f"c{i}", i) for i in range(42)]
    for r, s in zip(rows, texts, strict=True):
        assert np.array_equal(r["lcc"], seq._window_lcc((s or "").encode(), 20))


def test_kmers_of_an_alphabet_are_counted_before_the_shuffle(spark, monkeypatch):
    """Other letters, case, short, empty and null texts, a repeated id, signs beyond 16 bits; a row per k-mer of a text reaches the shuffle."""
    rows = [(1, "acgtACGTn"), (2, "AC"), (3, ""), (4, None), (5, "AAAA\U0001f600AAAA stra\u00dfe GATTACA"), (6, "ACG"), (6, "ACGACG"), (None, "TTTT")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = seq.kmer_counts(df, 3, alphabet="ACGTN", id="doc_id", seq="text")
    want = Counter((i, w) for i, s in rows for t in [(s or "").upper()] for a in range(len(t) - 2) if set(w := t[a : a + 3]) <= set("ACGTN"))
    assert {(r.doc_id, r.kmer): r.n for r in out.collect()} == want
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(seq, "LETTERS", 5)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "seq": [s and s.upper() for _, s in rows]})
    parts = list(seq._kmer_batches(3, "ACGTN")(iter([batch])))
    told = Counter()
    for r in (r for p in parts for r in p.to_pylist()):
        told[r["doc_id"], r["kmer"]] += r["n"]
    assert len(parts) > 2 and told == want
