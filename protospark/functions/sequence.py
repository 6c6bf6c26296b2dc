"""Sequence functions on columns: composition, complexity, k-mers, CIGAR strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType

from protospark.sources.blocks import BlockedSequences

#: IUPAC codes and their complements (fixed values).
IUPAC, COMPLEMENT = "ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN"
#: Letters whose windows a task holds at once.
LETTERS = 1 << 20
_c = lambda c: F.col(c) if isinstance(c, str) else c


def revcomp(seq) -> Column:
    """Reverse complement; upper-case IUPAC letters are complemented, all else stays."""
    return F.reverse(F.translate(_c(seq), IUPAC, COMPLEMENT))


def count_of(seq, letter: str) -> Column:
    """How often a letter occurs, in either case."""
    return F.length(_c(seq)) - F.length(F.translate(_c(seq), letter.upper() + letter.lower(), ""))


def base_composition(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds ``length``, fractions ``a t c g n gc`` and ``has_n``; an empty sequence has null fractions."""
    share = lambda *letters: F.try_divide(sum(count_of(seq, x) for x in letters), F.length(seq))
    return df.withColumns({"length": F.length(seq), **{x.lower(): share(x) for x in "ATCGN"}, "gc": share("G", "C"), "has_n": count_of(seq, "N") > 0})


def shannon_entropy(seq) -> Column:
    """Base 2, over all characters; null and empty sequences have 0."""
    seq = _c(seq)
    chars = F.split(F.coalesce(seq, F.lit("")), "")
    part = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / F.length(seq)
    parts = F.transform(F.array_sort(F.array_distinct(chars)), part)
    return F.when(F.coalesce(F.length(seq), F.lit(0)) == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def lcc(seq) -> Column:
    """Local composition complexity: entropy base 4 over A, C, G and T, divided by the whole length; 0 for empty."""
    seq = _c(seq)
    n = F.length(seq)
    part = lambda x: F.coalesce(F.try_divide(count_of(seq, x), n), F.lit(0.0))
    term = lambda x: F.when(part(x) > 0, -part(x) * F.log2(part(x)) / 2).otherwise(0.0)
    return term("A") + term("C") + term("G") + term("T")


def lcc_windows(seq, window: int) -> Column:
    """LCC of each window, in order; empty if the sequence is shorter than a window."""
    seq = _c(seq)
    starts = F.when(F.length(seq) >= window, F.sequence(F.lit(1), F.length(seq) - window + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: lcc(F.substring(seq, i, window)))


def _window_lcc(text: bytes, window: int) -> np.ndarray:
    """LCC of every window, from running counts."""
    b = np.frombuffer(text.upper(), np.uint8)
    total = np.zeros(max(0, len(b) - window + 1))
    for ch in b"ACGT":
        n = np.cumsum(np.r_[0, b == ch])
        p = (n[window:] - n[:-window]) / window
        total -= np.where(p > 0, p * np.log2(np.maximum(p, 1e-300)) / 2, 0)
    return total


@F.pandas_udf(ArrayType(DoubleType()))
def _lcc_long(seqs: pd.Series, windows: pd.Series) -> pd.Series:
    return pd.Series([np.zeros(0) if s is None else _window_lcc(s.encode("latin-1", "replace"), w) for s, w in zip(seqs, windows)])


def lcc_windows_long(seq, window: int) -> Column:
    """As ``lcc_windows``, for contigs that fit a task: running counts in Arrow batches. Longer ones: ``lcc_windows_blocks``."""
    return _lcc_long(_c(seq), F.lit(window))


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``LETTERS`` letters, of one row at least."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LETTERS, "right")))
        yield a, b
        a = b


def _lcc_batches(window: int):
    """The windows of a batch's sequences (its last column), a stretch of rows at a time, so that memory doesn't grow with a batch's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)):
                some = batch.slice(a, b - a)
                each = [_window_lcc((s or "").encode("latin-1", "replace"), window) for s in some.column(2).to_pylist()]
                ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(ends, np.concatenate(each))], [*batch.schema.names[:2], "lcc"])

    return run


def lcc_windows_blocks(blocks: BlockedSequences, window: int) -> DataFrame:
    """``<id>, start, lcc``: the LCC of the windows of each stored block, ``lcc[i]`` that of the window at ``start + i``; no contig is put together or shuffled.

    A block gives the windows that begin in it, so ``window`` may be longer than the blocks' overlap by one letter at most. Blocks in which no window begins give no row.
    """
    if window > blocks.overlap + 1:
        raise ValueError(f"windows of {window} letters need blocks that overlap by {window - 1}")
    rows = blocks.table.select(blocks.id, (F.col("block") * blocks.size).alias("start"), F.expr(f"substring(seq, 1, own + {window - 1})").alias("seq"))
    told = rows.mapInArrow(_lcc_batches(window), rows.drop("seq").schema.add("lcc", ArrayType(DoubleType())))
    return told.where(F.size("lcc") > 0)


def kmers(seq, k: int) -> Column:
    """All windows of ``k`` letters, in order. Letters are split once, so that long texts take time in proportion to their length."""
    cut = lambda chars: F.transform(
        F.when(F.size(chars) >= k, F.sequence(F.lit(1), F.size(chars) - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(chars, i, k), "")
    )
    # the letters are a lambda's variable, else they were split again for each window
    return F.element_at(F.transform(F.array(F.filter(F.split(_c(seq), ""), lambda x: x != "")), cut), 1)


def _kmer_batches(k: int, alphabet: str):
    """``id, kmer, n`` of each row, a stretch of rows at a time: k-mers as numbers, counted in numpy."""
    letters = sorted(set(alphabet))
    codes = np.full(max(map(ord, letters)) + 2, len(letters), np.int64)
    codes[[ord(x) for x in letters]] = np.arange(len(letters))
    size = len(letters) ** k

    def word(at: int) -> str:
        return "".join(letters[at // len(letters) ** j % len(letters)] for j in range(k - 1, -1, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)):
                points = [np.frombuffer((s or "").encode("utf-32-le", "surrogatepass"), np.uint32) for s in batch.column(1).slice(a, b - a).to_pylist()]
                row = np.repeat(np.arange(b - a), [len(x) for x in points])
                code = codes[np.minimum(np.concatenate(points), len(codes) - 1)]
                n = max(0, len(code) - k + 1)
                key, own = np.zeros(n, np.int64), row[:n] == row[len(row) - n :]
                for j in range(k):
                    key = key * len(letters) + code[j : j + n]
                    own &= code[j : j + n] < len(letters)
                found, count = np.unique(row[:n][own] * size + key[own], return_counts=True)
                some, which = np.unique(found % size, return_inverse=True)
                kmer = pa.array(map(word, some.tolist()), pa.string()).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(found // size)), kmer, pa.array(count.astype(np.int64))], [batch.schema.names[0], "kmer", "n"])

    return run


def kmer_counts(df: DataFrame, k: int, relative: bool = False, alphabet: str | None = None, id: str = "seqid", seq: str = "seq") -> DataFrame:
    """``id, kmer, n`` (and ``share`` within the sequence). With an alphabet: upper-cased k-mers of its letters only, counted before the shuffle."""
    if alphabet and alphabet.isalnum() and k > 0 and len(set(alphabet)) ** k <= 1 << 40:  # a number holds row and k-mer
        rows = df.select(id, F.upper(seq).alias("_seq"))
        words = rows.mapInArrow(_kmer_batches(k, alphabet), rows.select(id).schema.add("kmer", StringType()).add("n", LongType()))
        out = words.groupBy(id, "kmer").agg(F.sum("n").alias("n"))
    else:
        words = df.select(id, F.explode(kmers(F.upper(seq) if alphabet else F.col(seq), k)).alias("kmer"))
        if alphabet:
            words = words.where(F.col("kmer").rlike(f"^[{alphabet}]{{{k}}}$"))
        out = words.groupBy(id, "kmer").agg(F.count("*").alias("n"))
    if relative:
        out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(id)))
    return out


def n_nonunique_kmers(seq, k: int) -> Column:
    """Distinct k-mers that occur more than once, from the sequence's sorted k-mers; no shuffle."""

    def again(words):
        before = lambda i: F.when(i > 0, F.get(words, F.greatest(i - 1, F.lit(0))))
        return F.size(F.filter(words, lambda w, i: F.coalesce(w == F.get(words, i + 1), F.lit(False)) & ~F.coalesce(w == before(i), F.lit(False))))

    return F.element_at(F.transform(F.array(F.array_sort(kmers(seq, k))), again), 1)


def most_repeated_kmer(seq, k: int) -> Column:
    """The largest count of any k-mer of the sequence."""
    words = F.array_sort(kmers(seq, k))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a, w):
        n = F.when(a.w == w, a.n + 1).otherwise(1)
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(a.best, n).alias("best"))

    return F.aggregate(words, start, step, lambda a: a.best)


def nonunique_kmers(df: DataFrame, ks=(3, 4, 5, 6), seq: str = "seq") -> DataFrame:
    return df.withColumns({f"n_nonunique_kmer_{k}": n_nonunique_kmers(seq, k) for k in ks})


def filter_repetitive(df: DataFrame, k: int = 6, max_count: int = 4, seq: str = "seq") -> DataFrame:
    """Without the sequences that have a k-mer more than ``max_count`` times."""
    return df.where(most_repeated_kmer(seq, k) <= max_count)


def filter_low_complexity(df: DataFrame, seq: str = "seq", counts: Observation | None = None) -> DataFrame:
    """Sequences without N, with no base (nor G and C together) at 95 % or more, entropy over 1, under four repeated 6-mers.

    ``counts`` is filled by the first action on the result, without another pass: ``rows``, ``removed`` and ``removed_pct`` (null without rows).
    """
    d = base_composition(df, seq).withColumns({"entropy": shannon_entropy(seq), "n_nonunique_kmer_6": n_nonunique_kmers(seq, 6)})
    keep = (F.col("n") == 0) & (F.greatest("a", "g", "c", "t", "gc") < 0.95) & (F.col("entropy") > 1) & (F.col("n_nonunique_kmer_6") < 4)
    if counts is None:
        return d.where(keep)
    d = d.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    rows, removed = F.count(F.lit(1)), F.count_if(~F.col("_keep"))
    return d.observe(counts, rows.alias("rows"), removed.alias("removed"), (100 * F.try_divide(removed, rows)).alias("removed_pct")).where("_keep").drop("_keep")


def kmers_long(df: DataFrame, id: str = "seqid", ks=(3, 4, 5, 6)) -> DataFrame:
    """Columns ``n_nonunique_kmer_k`` as rows ``id, k, n``."""
    cols = [f"n_nonunique_kmer_{k}" for k in ks]
    return df.unpivot([id], cols, "_k", "n").select(id, F.regexp_extract("_k", r"(\d+)$", 1).cast("int").alias("k"), "n")


def dust_counts(seqs: list[str], window: int, threshold: int) -> np.ndarray:
    """For each sequence the bases in perfect low-complexity intervals by triplet scores (Morgulis et al., 2006); a score is 10 * sum(c(c-1)/2) / (l - 1).

    All sequences side by side: an interval of l triplets gains the pairs that its last triplet makes, which are comparisons at shifts below l.
    """
    seqs = [s.upper() for s in seqs]
    size = np.array([len(s) for s in seqs], np.int64)
    letters = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(seqs)), size)
    n = max(len(letters) - 2, 0)
    triplet = letters[:n] << np.uint64(42) | letters[1 : n + 1] << np.uint64(21) | letters[2 : n + 2]
    score, edge = np.zeros(n, np.int64), np.zeros(len(letters) + 1, np.int64)
    for last in range(1, window - 2):
        m = n - last
        if m <= 0:
            break
        for d in range(1, last + 1):
            score[:m] += triplet[last - d : last - d + m] == triplet[last : last + m]
        low = np.flatnonzero((doc[:m] == doc[last + 2 : last + 2 + m]) & (10 * score[:m] > threshold * last))
        edge[low] += 1
        np.add.at(edge, low + last + 3, -1)
    return np.bincount(doc, np.cumsum(edge)[:-1] > 0, len(seqs)).astype(np.int64)


@F.pandas_udf(IntegerType())
def _dust(seqs: pd.Series, window: pd.Series, threshold: pd.Series) -> pd.Series:
    known = seqs.notna().to_numpy()
    out = np.zeros(len(seqs), np.int64)
    if known.any():
        out[known] = dust_counts(list(seqs[known]), int(window.iloc[0]), int(threshold.iloc[0]))
    return pd.Series(pd.array(out, dtype="Int32")).mask(pd.Series(~known))


def dust_masked(seq, window: int = 9, threshold: int = 15) -> Column:
    """How many bases lie in low-complexity intervals."""
    return _dust(_c(seq), F.lit(window), F.lit(threshold))


def _cigar_sum(cigar, ops: str) -> Column:
    parts = F.regexp_extract_all(_c(cigar), F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def cigar_ref_span(cigar) -> Column:
    """Bases of the reference that an alignment covers."""
    return _cigar_sum(cigar, "MDN=X")


def cigar_mismatches(cigar) -> Column:
    return _cigar_sum(cigar, "X")


def fix_cigar(cigar) -> Column:
    """Put the missing length 1 between neighbouring operators."""
    return F.regexp_replace(_c(cigar), r"(?<=[A-Z=|])(?=[A-Z=|])", "1")


def fold_letters(df: DataFrame, text: str, out: str, letters: str, to: str) -> DataFrame:
    """``text`` replaced by ``out``: its ASCII letters in lower case, each of ``letters`` as the one of ``to`` in its place, and nothing else. Null stays null.

    Two other characters have an ASCII letter as their lower case, as in SQL's ``lower``: U+0130 (i) and the Kelvin sign (k).
    """
    table = np.zeros(256, np.uint8)
    for a, b in zip(letters.encode(), to.encode(), strict=True):
        table[[a, a - 32]] = b
    at = df.columns.index(text)
    schema = ", ".join(f"`{out}` string" if f.name == text else f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)):
                part = batch.slice(a, b - a)
                cols = [fold(c) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(cols, [out if n == text else n for n in part.schema.names])

    def fold(strings: pa.Array) -> pa.Array:
        strings = strings.cast(pa.large_binary())
        null = strings.is_null().to_numpy(zero_copy_only=False)
        strings = strings.fill_null(b"")
        offs = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        data = np.frombuffer(strings.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(strings) and offs[-1] else np.zeros(0, np.uint8)
        got = table[data]
        for code, letter in (("\u0130", "i"), ("\u212a", "k")):  # their bytes are no ASCII, so the first of them may stand for the letter
            raw = np.frombuffer(code.encode(), np.uint8)
            first = np.flatnonzero(data[: len(data) - len(raw) + 1] == raw[0]) if len(data) >= len(raw) else np.zeros(0, np.int64)
            for j in range(1, len(raw)):
                first = first[data[first + j] == raw[j]]
            got[first] = table[ord(letter)]
        keep = got != 0
        ends = np.r_[0, np.cumsum(keep)][offs - offs[0]].astype(np.int64)
        gone = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None
        return pa.Array.from_buffers(pa.large_string(), len(strings), [gone, pa.py_buffer(ends), pa.py_buffer(got[keep].tobytes())]).cast(pa.string())

    return df.mapInArrow(run, schema)
