"""Periodic runs of words by online dyadic square catching (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.llm.common import batches, in_arrow, table
from protospark.llm.crc import CRC_TABLE, crc32_sql, points_sql
from protospark.llm.text import Words, chunks, mix

#: Words that are appended to a catcher at once.
STRETCH = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "array<struct<start: long, length: long, period: long>>"


class _Level:
    """Catchers of the blocks of ``size`` words: each looks for its block ``size`` to ``2 * size - 1`` words after it."""

    def __init__(self, size: int):
        self.size = size
        #: hashes of the windows of ``size`` words, from window ``at`` on
        self.hashes, self.at = np.zeros(0, np.uint64), 0
        #: squares that may still grow: period -> [start, last matching block, blocks]
        self.open: dict[int, list[int]] = {}
        #: runs that were closed here
        self.runs: list[tuple[int, int]] = []


class SquareCatcher:
    """Finds the runs (maximal repetitions) of a stream of words, of at least ``exponent`` periods and ``least`` words, while words are appended.

    A completed block of b = 2^k words, aligned to b, is watched by a catcher for the periods b to 2b - 1. An appended word completes
    one window at each level, and that window is compared with the one block whose catcher waits for it. A hit is a square once it spans a
    period; hits of neighbouring blocks at one period are one square that grows, and as the next block fails, its ends are fixed by comparing
    words (fewer than b to either side), and it is a run. As a run's first two periods hold a whole block, and its words repeat
    ``exponent`` - 1 times, no run is missed. Hits inside a run of a smaller period are multiples of that period (Fine and Wilf), and are passed over.

    ``append`` may be called with any stretches; the result doesn't depend on them. Words are 64-bit numbers; equal numbers are equal words.
    """

    def __init__(self, exponent: int = 4, least: int = 6, longest: int | None = None):
        if exponent < 3:
            raise ValueError("runs of fewer than three periods need not hold a whole block")
        self.exponent, self.least, self.longest = exponent, least, longest
        self.words = np.zeros(0, np.uint64)
        self.levels: list[_Level] = []
        self.found: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        self.words = np.r_[self.words, words]
        n = len(self.words)
        while 2 * (b := 1 << len(self.levels)) <= n and (self.longest is None or self.exponent * b <= self.longest):
            self.levels.append(_Level(b))
        lower = None
        for level in self.levels:
            b, old = level.size, level.at + len(level.hashes)
            if old > n - b:
                break
            if lower is None:
                new = mix(self.words[old:] * _ODD)
            else:
                a, c = old - lower.at, n - b - lower.at + 1
                new = mix(lower.hashes[a:c] * _ODD + (lower.hashes[a + b // 2 : c + b // 2] ^ np.uint64(b)))
            level.hashes = np.r_[level.hashes, new]
            self._catch(level, old)
            lower = level
        for level in self.levels:  # what later windows are compared with, or made of
            cut = max(0, n - 5 * level.size - level.at)
            level.hashes, level.at = level.hashes[cut:], level.at + cut

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start and period."""
        for level in self.levels:
            for q, square in level.open.items():
                self._close(level, q, square)
            level.open = {}
        return sorted((a, z - a, q) for (a, z), q in self.found.items())

    def _covers(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of periods under ``below``, and how far the runs that start there or earlier reach."""
        spans = [s for lv in self.levels if lv.size < below for s in (*lv.runs, *((o[0], o[1] + lv.size + q) for q, o in lv.open.items() if o[1] + lv.size - o[0] >= (self.exponent - 1) * q))]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, z = np.array(sorted(spans), np.int64).T
        return a, np.maximum.accumulate(z)

    def _catch(self, level: _Level, first: int) -> None:
        b, top = level.size, len(self.words) - level.size
        at = np.arange(max(first, b), top + 1)
        block = (at // b - 1) * b
        hit = np.flatnonzero(level.hashes[at - level.at] == level.hashes[block - level.at])
        block, q = block[hit], (at - block)[hit]
        starts, reach = self._covers(b)
        if len(starts):
            inside = np.searchsorted(starts, block, "right") - 1
            bare = (inside < 0) | (reach[inside] < block + q + b)
            block, q = block[bare], q[bare]
            for p, o in list(level.open.items()):
                k = int(np.searchsorted(starts, o[1], "right")) - 1
                if k >= 0 and reach[k] >= o[1] + p + b:
                    del level.open[p]
        order = np.lexsort((block, q))
        block, q = block[order], q[order]
        new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (block[1:] != block[:-1] + b)]) if len(q) else np.zeros(0, np.int64)
        count = np.diff(np.r_[new, len(q)])
        head, period = block[new], q[new]
        tail = head + (count - 1) * b
        waits = tail + b + period > top  # the next block's window is not complete
        need = (np.maximum(self.least, self.exponent * period) - period - b + 1) // b
        known = np.isin(period, list(level.open)) if level.open else np.zeros(len(new), bool)
        for k in np.flatnonzero(waits | known | (count >= need)).tolist():
            p, a, z, c = int(period[k]), int(head[k]), int(tail[k]), int(count[k])
            square = level.open.pop(p, None)
            if square and square[1] + b == a:
                square[1:] = [z, square[2] + c]
            else:
                if square:
                    self._close(level, p, square)
                square = [self._back(a, p), z, c]
            if z + b + p > top:
                level.open[p] = square
            else:
                self._close(level, p, square)
        for p, square in list(level.open.items()):
            if square[1] + b + p <= top:
                self._close(level, p, level.open.pop(p))

    def _back(self, at: int, q: int) -> int:
        """The first word from which on words repeat ``q`` later, up to ``at``."""
        x, step = self.words, 16
        while at > 0:
            low = max(0, at - step)
            differ = np.flatnonzero(x[low:at] != x[low + q : at + q])
            if len(differ):
                return low + int(differ[-1]) + 1
            at, step = low, 2 * step
        return 0

    def _close(self, level: _Level, q: int, square: list[int]) -> None:
        x, n, at, step = self.words, len(self.words), square[1] + level.size, 16
        while at + q < n:
            high = min(n - q, at + step)
            differ = np.flatnonzero(x[at:high] != x[at + q : high + q])
            if len(differ):
                at += int(differ[0])
                break
            at, step = high, 2 * step
        start, end = square[0], at + q
        if end - start >= max(self.least, self.exponent * q) and np.array_equal(x[start : end - q], x[start + q : end]):
            level.runs.append((start, end))
            self.found[start, end] = min(q, self.found.get((start, end), q))


def _chunk_runs(w: Words, exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each document of a chunk: the documents are one stream, with a number that occurs once between them."""
    catcher, docs = SquareCatcher(exponent, least, int(w.count.max(initial=0))), len(w.count)
    begin = w.first[:-1] + np.arange(docs)
    stream = np.zeros(len(w.start) + docs, np.uint64)
    stream[np.arange(len(w.start)) + w.doc] = w.hashes()
    stream[w.first[1:] + np.arange(docs)] = mix(np.arange(1, docs + 1, dtype=np.uint64) << np.uint64(40))
    for a in range(0, len(stream), STRETCH):
        catcher.append(stream[a : a + STRETCH])
    out: list[list] = [[] for _ in range(docs)]
    for start, length, q in catcher.finish():
        k = int(np.searchsorted(begin, start, "right")) - 1
        out[k].append((start - int(begin[k]), length, q))
    return out


def _find(exponent: int, least: int):
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            n, runs, texts = [], [], []
            for i, j, data, offs in chunks(batch.column(1)):
                w = Words(data, offs)
                body = data.tobytes()
                n += w.count.tolist()
                for k, found in enumerate(_chunk_runs(w, exponent, least)):
                    words = body[offs[k] : offs[k + 1]].split()
                    if found:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for start, length, q in found:
                            edge[start + q] += 1
                            edge[start + length] -= 1
                        words = [words[x] for x in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                    texts.append(b" ".join(words))
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row of ``docs`` (``doc_id``, ``text``).

    A run is a stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` with smallest period q (words q apart are identical) of at least ``max(least, exponent * q)`` words
    that can't be extended with that period; ``runs`` lists them as (start, length, period) by start and period, words numbered from 0.
    ``collapsed`` is the text less every word that a run holds after its first q words, joined by single spaces.

    A text is read by one task, in whole, with about 50 bytes of memory for a word; nothing is shuffled. Null and empty texts have no words and no runs.
    Rows with null or repeated ids are documents of their own; other columns are ignored. Words are compared as 64-bit hashes, always within a
    text (about 10^14 comparisons in 100 TB of text: one of them wrong with a chance of some millionths).
    """
    batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, _find(exponent, least), f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def plant_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where 10 divides h, crc32 of the decimal id, the words from a = g % n on (g = h // 10) become a repetition of the p = 1 + (n - a) // (3 + g % 8) words there.

    Their words are joined by single spaces; all other texts, and those without words, stay as they are. A null id counts as the text ``''``.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda x: x != "")
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("long")
    some = some.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int"))), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """From ``runs`` and ``collapsed``: counts, the run of most periods (ties: smallest start, then period), and digests."""
    # two unequal fractions of numbers under 2^26 differ by more than a double's rounding
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = found.withColumn("best", best)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.n) div (-best.p)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(plant_repeats(table(spark, sf_dir, "documents"))))


OP13_SQL = rf"""
with crc as ({CRC_TABLE}),
k as (select row_number() over () k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
h as (select k, doc_id, w, len(w) n, {crc32_sql(points_sql("coalesce(doc_id::varchar, '')"))} h from k, crc),
g as (select *, h // 10 g, case when h % 10 = 0 and n > 0 then (h // 10) % n end a from h),
d as materialized (select k, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[(case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1)::int]) end w from g),
w as materialized (select k, unnest(w) word, unnest(range(n)) i from d where n > 0),
e as (select x.k, x.i, y.i - x.i q from w x join w y on x.k = y.k and x.word = y.word and y.i > x.i join d on d.k = x.k where 4 * (y.i - x.i) <= d.n),
s as (select k, q, i, i - row_number() over (partition by k, q order by i) s from e),
m as (select k, q, min(i) a, count(*) + q n from s group by k, q, s having count(*) + q >= greatest(6, 4 * q)),
r as materialized (select k, a, n, min(q) q from m group by k, a, n),
b as (select k, count(*) c, string_agg(concat(a, ',', n, ',', q, chr(10)), '' order by a, q) t, arg_min([a, n, q], (-(n / q), a, q)) z from r group by k),
x as (select distinct k, unnest(range(a + q, a + n)) i from r),
c as (select w.k, string_agg(word, ' ' order by w.i) t from w left join x on w.k = x.k and w.i = x.i where x.i is null group by w.k)
select doc_id, coalesce(c, 0) n_runs, z[1] as start, z[2] as length, z[3] as period, 1000 * z[2] // z[3] exponent_milli,
  sha256(coalesce(b.t, '')) runs_sha256, sha256(coalesce(c.t, '')) collapsed_sha256
from d left join b using (k) left join c using (k)
"""
