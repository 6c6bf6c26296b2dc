"""Spelling variants by blocked Gram matrices of letter counts (operator 12)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.llm.common import batches, cut, in_arrow, table
from protospark.llm.crc import CRC_TABLE, crc32_sql, points_sql

#: Words of one block (a side of a Gram matrix) at most; blocks of a larger group are multiplied tile by tile.
TILE = 1 << 10
#: Distinct words that a task counts before it hands on the counts; code points of a text that are read at once.
HELD, PIECE = 1 << 18, 1 << 20
#: Groups larger than a tile whose sizes may be broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 1 << 17
#: The same for words that have a form.
BROADCAST_FORMS = 1 << 19
_LETTER = "[A-Za-zÀ-ÿ]"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Letters that are counted: a to z, and six into which all others fold.
DIMENSIONS = 32
_PAIR = "a string, na long, b string, nb long"


def _pieces(text: str) -> Iterator[str]:
    """Parts of a long text that end where a run of letters does."""
    at, gap = 0, re.compile("[^A-Za-zÀ-ÿ]")
    while len(text) - at > PIECE:
        end = gap.search(text, at + PIECE)
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


class _Numbers(dict):
    """A number for each run of letters, that of its lower-cased form, with that form's text, bytes and crc32."""

    def __init__(self):
        super().__init__()
        self.words: list[str] = []
        self.crc: list[int] = []
        self.size: list[int] = []

    def __missing__(self, run: str) -> int:
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        if word != run:
            number = self[word]
        else:
            number, raw = len(self.words), word.encode()
            self.words.append(word)
            self.crc.append(zlib.crc32(raw))
            self.size.append(len(raw))
        self[run] = number
        return number


def _shifts(heads: np.ndarray, size: int) -> np.ndarray:
    """What crc32 makes of ``heads`` after 0 to ``size`` more zero bytes: crc32 is linear, so ``crc32(w, head) = crc32(w) ^ shifts[head, len(w)]``."""
    table = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
    table ^= table[0]
    out = np.empty((len(heads), size + 1), np.uint32)
    out[:, 0] = heads
    for k in range(size):
        out[:, k + 1] = table[out[:, k] & 0xFF] ^ (out[:, k] >> np.uint32(8))
    return out


def _counted(least: int, modulus: int):
    """Counts of words of ``least`` code points and more: runs of letters, lower-cased, one letter deleted where ``modulus`` divides the run's crc32."""
    letters = re.compile(f"{_LETTER}{{{least},}}")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Numbers(), np.zeros(0, np.int64)
        heads: list[int] = []
        found: list[np.ndarray] = []

        def add() -> None:
            nonlocal total
            doc, number = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
            if modulus:
                size = np.array(known.size)[number]
                at = np.minimum(size, 64)
                h = np.array(known.crc, np.uint32)[number] ^ _shifts(np.array(heads, np.uint32), int(at.max(initial=0)))[doc, at]
                for k in np.flatnonzero(size > 64).tolist():
                    h[k] = zlib.crc32(known.words[number[k]].encode(), heads[doc[k]])
                hit = h % modulus == 0
                cut_ = []
                for k, code in zip(number[hit].tolist(), h[hit].tolist()):
                    word = known.words[k]
                    i = code % len(word)
                    if len(word) > least:
                        cut_.append(known[word[:i] + word[i + 1 :]])
                number = np.r_[number[~hit], np.array(cut_, np.int64)]
            more = np.bincount(number, minlength=len(known.words))
            more[: len(total)] += total
            total = more
            heads.clear()
            found.clear()

        def emit() -> pa.RecordBatch:
            nonlocal known, total
            some = np.flatnonzero(total)
            batch = pa.RecordBatch.from_arrays([pa.array(known.words, pa.string()).take(pa.array(some)), pa.array(total[some])], ["word", "n"])
            known, total = _Numbers(), np.zeros(0, np.int64)
            return batch

        for batch in batches_:
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in _pieces(text or ""):
                    found.append(np.fromiter(map(known.__getitem__, letters.findall(piece)), np.int64))
                    heads.append(zlib.crc32(f"{'' if doc is None else doc}:".encode()))
                    held += len(found[-1])
                    if held >= HELD:
                        add()
                        held = 0
            if found:
                add()
            if len(known) >= HELD:
                yield emit()
        if len(total):
            yield emit()

    return run


def count_words(docs: DataFrame, least: int = 6, occurrences: int = 5, modulus: int = 0) -> DataFrame:
    """``word, n``: maximal runs of letters of the texts (A-Z lower-cased) of at least ``least`` code points that occur at least ``occurrences`` times.

    With ``modulus``, a run loses the code point h % length if that number divides h, the crc32 of ``<doc_id>:<run>`` in UTF-8, before it counts
    (a null id counts as the text ``''``). Null texts have no words. Tasks count before the shuffle, so a common word is a row a task.
    """
    batches(docs.sparkSession)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, _counted(least, modulus), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def letter_counts(words: list[str]) -> np.ndarray:
    """How often each word has each of ``DIMENSIONS`` letters (those beyond a-z fold into six)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    dim = np.where((points > 96) & (points < 123), points - 97, 26 + points % 6).astype(np.int64)
    return np.bincount(row * DIMENSIONS + dim, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float32)


def _groups(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word under up to four keys: (length of the shorter words, first or last half of it, letters of that half).

    Of two words one edit apart, the shorter one's first ``size // 2`` letters begin the longer one, or its other letters end it.
    """
    for batch in batches_:
        words = batch.column(0).to_pylist()
        keys, times, upper = [], [], []
        for i, w in enumerate(words):
            for up in (0, 1):
                size = len(w) - up
                half = size // 2
                keys += (f"{size}<{w[:half]}", f"{size}>{w[len(w) - size + half:]}")
                times += (i, i)
                upper += (up, up)
        at = pa.array(times)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(upper, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], ["key", "upper", "word", "n"])


def _matrix(words: list[str], size: int, right: bool) -> np.ndarray:
    return np.frombuffer("".join(w.rjust(size, "\0") if right else w.ljust(size, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, size)


def _one_edit(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs, whose lengths differ by one at most, are one inserted, deleted or replaced code point apart: common beginning and end leave nothing else."""
    size = np.array([len(w) for w in words])
    short, long = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    out = np.zeros(len(i), bool)
    for n in np.unique(long).tolist():
        mine = np.flatnonzero(long == n)
        used, back = np.unique(np.r_[i[mine], j[mine]], return_inverse=True)
        x, y = back[: len(mine)], back[len(mine) :]
        left, right = (_matrix([words[k] for k in used.tolist()], n, r) for r in (False, True))
        step = max(1, (1 << 21) // n)
        for a in range(0, len(mine), step):
            m = slice(a, a + step)
            alike = left[x[m]] == left[y[m]], (right[x[m]] == right[y[m]])[:, ::-1]
            head, tail = (np.where(q.all(axis=1), n, np.argmin(q, axis=1)) for q in alike)
            least = short[mine[m]]
            # a word and itself (rows that came twice) have no edit between them
            out[mine[m]] = (np.minimum(head, least) + np.minimum(tail, least) >= least - (least == n)) & (head < n)
    return out


def _multiplied(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs one edit apart from rows (key, cell, cross, side, word, n) that are sorted by the first two; a cell is a Gram matrix."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, cross, side = batch.column(4).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
        key = batch.column(0).dictionary_encode().indices.to_numpy()
        cell = batch.column(1).to_numpy()
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), True])
        begin, count = edge[:-1], np.diff(edge)
        counts = letter_counts(words)
        square = (counts * counts).sum(axis=1)
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        room = 1
        while room < count.max(initial=0):  # cells of about one size are multiplied together
            room *= 2
            some = np.flatnonzero((count > room // 2) & (count <= room) & (count > 1))
            for a in range(0, len(some), step := max(1, (1 << 22) // room**2)):
                at = begin[some[a : a + step]][:, None] + np.arange(room)
                real = np.arange(room) < count[some[a : a + step]][:, None]
                at = np.where(real, at, 0)
                x, s = counts[at], side[at]
                near = square[at][:, :, None] + square[at][:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)) <= 2
                near &= real[:, :, None] & real[:, None, :]
                # in a tile of its own, or in a group that is not dealt, two longer words meet in another group
                near &= np.where(cross[at[:, 0]][:, None, None], s[:, :, None] < s[:, None, :], (s[:, :, None] + s[:, None, :] < 2) & np.triu(np.ones((room, room), bool), 1))
                c, i, j = np.nonzero(near)
                first.append(at[c, i])
                second.append(at[c, j])
        i, j = np.concatenate(first), np.concatenate(second)
        fine = _one_edit(words, i, j)
        i, j = i[fine], j[fine]
        # a letter inserted between the halves: such a pair has both keys, and counts under the first
        keep = []
        ends = [k[k.lstrip("0123456789") and len(k) - len(k.lstrip("0123456789"))] == ">" for k in batch.column(0).take(pa.array(i)).to_pylist()]
        for p, q, end in zip(i.tolist(), j.tolist(), ends):
            half = min(len(words[p]), len(words[q])) // 2
            keep.append(not (end and words[p][:half] == words[q][:half]))
        i, j = pa.array(i[np.array(keep, bool)]), pa.array(j[np.array(keep, bool)])
        return pa.RecordBatch.from_arrays([batch.column(c).take(x) for x in (i, j) for c in (4, 5)], ["a", "na", "b", "nb"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches_:
        # whole cells go to work, several batches at once; the last cell waits for more rows
        held.append(batch)
        rows += batch.num_rows
        if rows < 1 << 14:
            continue
        all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key, cell = all_.column(0), all_.column(1).to_numpy()
        last, n = key[len(key) - 1].as_py(), all_.num_rows
        other = np.flatnonzero((cell != cell[-1]) | ~pa.compute.equal(key, last).to_numpy(zero_copy_only=False))
        at = int(other[-1]) + 1 if len(other) else 0
        if at:
            yield work(all_.slice(0, at))
        held, rows = [all_.slice(at)], n - at
    if rows:
        yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, na, b, nb``: each pair of ``words`` (``word, n``; distinct) that one insertion, deletion or replacement of a code point tells apart, once.

    Words are points of letter counts. One edit moves a word by a squared distance of at most two, and to an adjacent length at most; squared distances
    of whole blocks come from Gram matrices (numpy products), and only pairs at two or less are compared letter by letter. Blocks are words of one
    length, and of the next, that share a half of the shorter word; no pair is lost, as one edit leaves one half whole.
    A group of more than ``TILE`` words is dealt into tiles by length and hash, and each two tiles that may hold pairs meet in a cell of their own,
    so no task multiplies more than two tiles at once and no group is unsplit.
    """
    rows = cut(words.select("word", "n").transform(in_arrow, _groups, "key string, upper int, word string, n long"))
    sizes = rows.groupBy("key").agg(F.count_if(F.col("upper") == 0).alias("lower"), F.count_if(F.col("upper") == 1).alias("higher"))
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int").alias(c)
    large = cut(sizes.where(F.col("lower") + F.col("higher") > TILE).select("key", tiles("lower"), tiles("higher")))
    many = large.count()
    large = F.broadcast(large) if many <= BROADCAST_GROUPS else large
    cells = rows.join(large, "key", "left_anti").select("key", F.lit(0).cast("long").alias("cell"), F.lit(False).alias("cross"), F.col("upper").alias("side"), "word", "n")
    if many:
        dealt = rows.join(large, "key").withColumn("own", F.pmod(F.xxhash64("word"), F.when(F.col("upper") == 0, F.col("lower")).otherwise(F.col("higher"))).cast("int"))
        up_to = lambda c, f: F.transform(F.filter(F.sequence(F.lit(0), F.col(c)), lambda j: j < F.col(c)), f)
        cell = lambda kind, i, j, cross, side: F.struct(F.xxhash64(F.lit(kind), i, j).alias("cell"), cross.alias("cross"), side.cast("int").alias("side"))
        own = F.col("own")
        lower = F.concat(
            up_to("lower", lambda j: cell(0, F.least(own, j), F.greatest(own, j), own != j, F.when(own == j, 0).otherwise((own > j).cast("int")))),
            up_to("higher", lambda j: cell(1, own, j, F.lit(True), F.lit(0))),
        )
        higher = up_to("lower", lambda i: cell(1, i, own, F.lit(True), F.lit(1)))
        dealt = dealt.withColumn("c", F.explode(F.when(F.col("upper") == 0, lower).otherwise(higher)))
        cells = cells.union(dealt.select("key", "c.cell", "c.cross", "c.side", "word", "n"))
    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell").transform(in_arrow, _multiplied, _PAIR)


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each of ``words`` (``word, n``; distinct).

    A word's form is the near word (one edit away) of largest n, ties to the smallest in code-point order, if that n is at least ``ratio`` times the word's; else null.
    Root: the end of the chain of forms, by pointer jumping (n grows by ``ratio`` with each step, so a chain of words is short). No words, no rows; null words are left out.
    """
    batches(words.sparkSession)
    words = cut(words.where("word is not null").select("word", "n"))
    near = near_pairs(words)
    both = near.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("p"))
    best = both.groupBy("p.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("p.m")).alias("m"), F.col("p.other").alias("other"))).alias("best"))
    told = words.join(best, "word", "left")
    fits = -F.col("best.m") >= ratio * F.col("n")
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    roots = cut(told.where("form is not null").select("word", F.col("form").alias("root")))
    small = roots.count() <= BROADCAST_FORMS
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = roots.join(F.broadcast(step) if small else step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        ahead = cut(ahead)
        roots = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            break
    told = told.join(F.broadcast(roots) if small else roots, "word", "left")
    return told.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, sf_dir, "documents"), modulus=199))


OP12_SQL = rf"""
with recursive crc as ({CRC_TABLE}),
r as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) w from documents),
l as (select coalesce(doc_id::varchar, '') d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w, count(*) c from r where length(w) >= 6 group by 1, 2),
h as (select w, c, {crc32_sql(points_sql("d || ':' || w"))} h from l, crc),
v as materialized (select word, sum(c)::bigint n from (select case when h % 199 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end word, c from h)
  where length(word) >= 6 group by word having sum(c) >= 5),
i as (select word, n, unnest(range(length(word))) i from v),
p as (select word, n, left(word, i::int) || '_' || substr(word, i::int + 2) p from i),
x as (select distinct word, n, left(word, i::int) || substr(word, i::int + 2) p from i),
e as (select a.word, b.word o, b.n m from p a join p b using (p) where a.word <> b.word
  union all select x.word, v.word, v.n from x join v on x.p = v.word union all select v.word, x.word, x.n from x join v on x.p = v.word),
f as (select word, count(*) n_near, max(m) m from e group by word),
g as (select e.word, min(o) o from e join f on e.word = f.word and e.m = f.m group by e.word),
t as materialized (select v.word, v.n, coalesce(n_near, 0) n_near, case when m >= 5 * v.n then o end form, case when m >= 5 * v.n then m end form_n from v left join f using (word) left join g using (word)),
c as (select word, word last, form nxt, 0 k from t union all select c.word, t.word, t.form, k + 1 from c join t on c.nxt = t.word)
select t.word, form, c.last root, n, n_near, form_n from t join c on c.word = t.word and c.nxt is null
"""
