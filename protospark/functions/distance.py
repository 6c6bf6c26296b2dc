"""Distances between a spacer and a region, and how an alignment looks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType

from protospark.functions.sequence import _c, revcomp

#: NUC.4.4 scores of unambiguous bases: match and mismatch (fixed values).
MATCH, MISMATCH = 5, -4


def _codes(s: pd.Series, at: np.ndarray, n: int) -> np.ndarray:
    """Strings of ``n`` code points each as rows of a matrix."""
    return np.frombuffer("".join(s.iloc[at]).encode("utf-32-le"), np.uint32).reshape(len(at), n)


def _by_lengths(a: pd.Series, b: pd.Series):
    """(rows, x, y) of pairs without nulls that share both lengths, as matrices."""
    known = (a.notna() & b.notna()).to_numpy()
    la, lb = (s.str.len().fillna(-1).to_numpy(np.int64) for s in (a, b))
    shapes, which = np.unique(np.stack([la, lb])[:, known], axis=1, return_inverse=True)
    some = np.flatnonzero(known)
    for k, (n, m) in enumerate(shapes.T.tolist()):
        at = some[which == k]
        yield at, _codes(a, at, n), _codes(b, at, m)


def _letters(strings: pa.Array) -> np.ndarray:
    """The bytes of all strings, one after the other."""
    strings = strings.cast(pa.large_binary())
    offs = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] else np.zeros(0, np.uint8)


@F.arrow_udf(IntegerType())
def _hamming(a: pa.Array, b: pa.Array) -> pa.Array:
    """ASCII pairs of equal lengths are compared as one run of bytes; others as matrices, those of unequal lengths by sliding the shorter ones along the longer ones."""
    la, lb, ba, bb = (pc.fill_null(f(s), -1).to_numpy(zero_copy_only=False).astype(np.int64) for f in (pc.utf8_length, pc.binary_length) for s in (a, b))
    out, even = np.full(len(a), -1, np.int64), (la == lb) & (la == ba) & (lb == bb) & (la >= 0)
    if even.any():
        x, y = (_letters(s.filter(pa.array(even))) for s in (a, b))
        ends = np.cumsum(la[even])
        out[even] = np.diff(np.r_[0, np.cumsum(x != y)][np.r_[0, ends]])
    rest = np.flatnonzero(~even & (la >= 0) & (lb >= 0))
    if len(rest):
        for at, x, y in _by_lengths(*(s.take(pa.array(rest)).to_pandas() for s in (a, b))):
            x, y = (x, y) if x.shape[1] <= y.shape[1] else (y, x)
            n = x.shape[1]
            out[rest[at]] = np.min([(x != y[:, i : i + n]).sum(axis=1) for i in range(y.shape[1] - n + 1)], axis=0) if n else 0
    return pa.array(np.where(out < 0, 0, out), pa.int32(), mask=out < 0)


def hamming(a, b) -> Column:
    """Mismatches; of unequal lengths, the least over ungapped places of the shorter in the longer. Null if either is.

    It is told to Spark as not deterministic: else a filter on the distance is pushed down to where a region is still cut from its block, with a copy
    of this call, which then runs twice and past which whole blocks are carried. So use it once in a ``withColumn`` and refer to that column.
    """
    return _hamming.asNondeterministic()(_c(a), _c(b))


def edit_distance(a, b) -> Column:
    return F.levenshtein(_c(a), _c(b))


def gotoh(a: str, b: str, open_: int, extend: int) -> tuple[str, str]:
    """Global alignment with affine gaps: both strings with ``-``. Ties: diagonal, then a gap in ``b``, then in ``a``.

    A gap of n costs ``open_ + (n - 1) * extend``.
    """
    n, m, low = len(a), len(b), -(10**9)
    h, e, f = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    h[0][0] = 0
    for i in range(1, n + 1):
        e[i][0] = h[i][0] = -open_ - (i - 1) * extend
    for j in range(1, m + 1):
        f[0][j] = h[0][j] = -open_ - (j - 1) * extend
    for i in range(1, n + 1):
        up, eu, row, er, fr = h[i - 1], e[i - 1], h[i], e[i], f[i]
        for j in range(1, m + 1):
            x, y = max(up[j] - open_, eu[j] - extend), max(row[j - 1] - open_, fr[j - 1] - extend)
            er[j], fr[j] = x, y
            row[j] = max(up[j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), x, y)
    i, j, top, bottom, state = n, m, [], [], "h"
    while i or j:
        if state == "h":
            if i and j and h[i][j] == h[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
                top.append(a[i - 1])
                bottom.append(b[j - 1])
                i, j = i - 1, j - 1
                continue
            state = "e" if i and h[i][j] == e[i][j] else "f"
        if state == "e":
            top.append(a[i - 1])
            bottom.append("-")
            state = "h" if i == 1 and j == 0 or e[i][j] == h[i - 1][j] - open_ else "e"
            i -= 1
        else:
            top.append("-")
            bottom.append(b[j - 1])
            state = "h" if j == 1 and i == 0 or f[i][j] == h[i][j - 1] - open_ else "f"
            j -= 1
    return "".join(reversed(top)), "".join(reversed(bottom))


def affine_columns(x: np.ndarray, y: np.ndarray, open_: int, extend: int) -> np.ndarray:
    """For pairs of rows, the columns that aren't matches in the alignment that ``gotoh`` draws.

    All pairs go forward in step, a row of cells at a time. A cell is one number: its score, then two bits for the choice that ``gotoh``'s way back
    prefers among equal scores, then the columns that aren't matches; so the largest number is the right choice and brings its columns along.
    """
    pairs, n, m = len(x), x.shape[1], y.shape[1]
    bits = (n + m).bit_length()
    way, unit = 1 << bits, 4 << bits
    kind, low = (np.int32, -1 << 29) if unit * (open_ + (n + m) * (extend + MATCH)) < 1 << 28 else (np.int64, -1 << 60)
    new, more, told = 1 - open_ * unit, 1 - extend * unit, ~(3 * way)
    same, other = kind(MATCH * unit + 2 * way), kind(MISMATCH * unit + 1 + 2 * way)
    linear = open_ == extend  # an opened gap then never scores below an extended one, and is preferred
    y = np.ascontiguousarray(y.T)
    up = np.zeros((m + 1, pairs), kind)
    up[1:] = (new + more * np.arange(m))[:, None]
    down = np.full((m, pairs), low, kind)
    for i in range(n):
        row = np.empty_like(up)
        row[0] = new + more * i
        np.add(up[:-1], np.where(y == x[:, i], same, other), out=row[1:])
        opened = up[1:] + (new + way)
        if not linear:
            down = np.maximum(opened, down + more) & told
            opened = down + way
        np.maximum(row[1:], opened, out=row[1:])
        across = np.full(pairs, low, kind)
        for j in range(1, m + 1):
            across = row[j - 1] + new if linear else np.maximum(row[j - 1] + (new + way), across + more) & told
            np.maximum(row[j], across, out=row[j])
            row[j] &= told
        up = row
    return (up[m] & (way - 1)).astype(np.int64)


@F.pandas_udf(IntegerType())
def _affine(a: pd.Series, b: pd.Series, o: pd.Series, e: pd.Series) -> pd.Series:
    out = np.full(len(a), -1, np.int64)
    if len(a):
        for at, x, y in _by_lengths(a, b):
            out[at], far = 0, np.ones(len(at), bool)
            if x.shape == y.shape:  # few mismatches score above any alignment with gaps, as that has two at least and a match less
                out[at] = differ = (x != y).sum(axis=1)
                far = (MATCH - MISMATCH) * differ >= MATCH + 2 * int(o.iloc[0])
            if far.any():
                out[at[far]] = affine_columns(x[far], y[far], int(o.iloc[0]), int(e.iloc[0]))
    return pd.Series(pd.array(np.where(out < 0, 0, out), dtype="Int32")).mask(pd.Series(out < 0))


def gap_affine(a, b, open_: int = 5, extend: int = 5) -> Column:
    """Columns of the best affine-gap alignment that aren't matches. Use it as ``hamming``."""
    return _affine.asNondeterministic()(_c(a), _c(b), F.lit(open_), F.lit(extend))


METRICS = {"hamming": hamming, "edit": edit_distance, "gap_affine": gap_affine}


def region_of(contig, start, end, strand) -> Column:
    """``contig[start:end]``, reverse complemented where ``strand`` is true."""
    cut = F.substring(_c(contig), (_c(start) + 1).cast("int"), (_c(end) - _c(start)).cast("int"))
    return F.when(_c(strand), revcomp(cut)).otherwise(cut)


def validate(df: DataFrame, metric: str = "edit", spacer: str = "spacer_seq", region: str = "region_seq", out: str = "alignment_test") -> DataFrame:
    """Adds the distance of a metric; a missing sequence gives null."""
    return df.withColumn(out, METRICS[metric](spacer, region))


def all_distances(df: DataFrame, spacer: str = "spacer_seq", region: str = "region_seq", affine: bool = True, limit: int | None = None, distinct: bool = False) -> DataFrame:
    """Adds ``hamming``, ``edit``, ``gap_affine`` and ``has_indels`` (edit differs from Hamming).

    With ``limit``, a distance beyond it is null, and work stops there: the edit distance is computed within a band, and as neither the
    affine alignment nor, of equal lengths, Hamming can be below it, only pairs within the limit go on to them. ``has_indels`` is null where
    the edit distance is. With ``distinct``, each pair of sequences is compared once and joined back: for hits that repeat pairs.
    """
    if distinct:
        pairs = all_distances(df.select(spacer, region).where(F.col(spacer).isNotNull() & F.col(region).isNotNull()).distinct(), spacer, region, affine, limit)
        return df.join(pairs, [spacer, region], "left").select(*df.columns, *pairs.columns[2:])
    if limit is None:
        d = df.withColumns({"hamming": hamming(spacer, region), "edit": edit_distance(spacer, region)})
        d = d.withColumn("gap_affine", gap_affine(spacer, region)) if affine else d
        return d.withColumn("has_indels", F.col("edit") != F.col("hamming"))
    within = lambda d: F.when(d.between(0, limit), d)
    near = F.col("edit").isNotNull()
    d = df.withColumn("edit", within(F.levenshtein(F.col(spacer), F.col(region), limit)))
    d = d.withColumn("hamming", hamming(F.when(near | (F.length(spacer) != F.length(region)), F.col(spacer)), region))
    d = d.withColumn("hamming", within(F.col("hamming")))
    d = d.withColumn("gap_affine", gap_affine(F.when(near, F.col(spacer)), region)).withColumn("gap_affine", within(F.col("gap_affine"))) if affine else d
    d = d.withColumn("has_indels", F.when(near, ~F.col("edit").eqNullSafe(F.col("hamming"))))
    return d.select(*df.columns, "hamming", "edit", *(["gap_affine"] if affine else []), "has_indels")


def edit_alignment(a: str, b: str) -> tuple[str, str]:
    """An alignment of least edit distance: both strings with ``-``. Ties: diagonal, then a gap in ``b``, then in ``a``."""
    n, m = len(a), len(b)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, top, bottom = n, m, [], []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            top.append(a[i])
            bottom.append(b[j])
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            top.append(a[i])
            bottom.append("-")
        else:
            j -= 1
            top.append("-")
            bottom.append(b[j])
    return "".join(reversed(top)), "".join(reversed(bottom))


def _render(a: str, b: str, metric: str) -> str:
    if metric == "hamming":
        n = max(len(a), len(b))
        right, left = (a.ljust(n, "@"), b.ljust(n, "@")), (a.rjust(n, "@"), b.rjust(n, "@"))
        wrong = lambda p: sum(x != y for x, y in zip(*p))
        top, bottom = right if wrong(right) < wrong(left) else left
    else:
        top, bottom = gotoh(a, b, 5, 5) if metric == "gap_affine" else edit_alignment(a, b)
    return "\n".join((top, "".join("|" if x == y else "." if "-" not in (x, y) else " " for x, y in zip(top, bottom)), bottom))


def render_alignment(df: DataFrame, metric: str = "edit", spacer: str = "spacer_seq", region: str = "region_seq") -> DataFrame:
    """Adds ``alignment``: spacer, match line and region, one under the other, row by row: for frames of examples. Hamming pads the shorter with ``@`` on the better side (ties: left)."""

    @F.pandas_udf(StringType())
    def draw(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _render(x, y, metric) for x, y in zip(a, b)])

    return df.withColumn("alignment", draw(F.col(spacer), F.col(region)))
