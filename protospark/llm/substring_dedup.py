"""Substring dedup by difference-cover anchors (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.llm.common import batches, cut, in_arrow, table
from protospark.llm.shared import bucket_bits, occurrences
from protospark.llm.text import Words, chunks, rolling

#: Perfect difference sets: of any two residues, some shift below the period brings both into the set.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Ids of exact copies that may be broadcast; beyond that they are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: The same for groups of copies (five longs each).
BROADCAST_CLASSES = 1 << 18


def _digest(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        n, a, b = [], [], []
        for _, _, data, offs in chunks(batch.column(1)):
            w = Words(data, offs)
            n.append(w.count)
            for which, out in ((0, a), (1, b)):
                h, first = w.hashes(which), w.first[:-1]
                at = np.arange(len(h)) - np.repeat(first, w.count)
                s = h * (np.uint64(2) * at.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                out.append(np.add.reduceat(np.r_[s, np.zeros(1, np.uint64)], np.minimum(first, len(s))) * (w.count > 0))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cat(n, np.int64)), pa.array(cat(a, np.uint64).view(np.int64)), pa.array(cat(b, np.uint64).view(np.int64))], ["id", "n", "a", "b"])


def _anchors(length: int, period: int):
    width, cover = length - period + 1, np.isin(np.arange(period), COVERS[period])

    def keys_of(batch):
        keys, rows, poss = [], [], []
        for i, _, data, offs in chunks(batch.column(1)):
            w = Words(data, offs)
            h = rolling(w.hashes(), width)
            at = np.arange(len(h)) - w.first[w.doc[: len(h)]]
            ok = cover[at % period] & (at + width <= w.count[w.doc[: len(h)]]) & (w.count[w.doc[: len(h)]] >= length)
            keys.append(h[ok])
            rows.append(w.doc[: len(h)][ok] + i)
            poss.append(at[ok])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, rows, poss))

    return keys_of


def _windows(length: int, period: int):
    """Hashes (64 bits, and 32 of another) of the windows that contain an anchor in ``batch[2]`` (list of positions)."""

    def keys_of(batch):
        keys, rows, poss, more = [], [], [], []
        lists = batch.column(2)
        flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        begin = np.r_[0, np.cumsum(size)]
        for i, j, data, offs in chunks(batch.column(1)):
            w = Words(data, offs)
            if not len(w.start):
                continue
            anchor = flat[begin[i] : begin[j]] + np.repeat(w.first[:-1], size[i:j])
            low = np.maximum(anchor - (period - 1), np.repeat(w.first[:-1], size[i:j]))
            high = np.minimum(anchor, np.repeat(w.first[1:], size[i:j]) - length)
            edge = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(edge, low[low <= high], 1)
            np.add.at(edge, high[low <= high] + 1, -1)
            at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            h = rolling(w.hashes(), length)
            keys.append(h[at])
            rows.append(w.doc[at] + i)
            poss.append(at - w.first[w.doc[at]])
            more.append((rolling(w.hashes(1), length, 1)[at] >> np.uint64(32)).astype(np.uint32))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, rows, poss, more))

    return keys_of


def _strip(length: int, texts: bool):
    """From (doc_id, text, whole, starts[], ...): words, removed words, digest of what is kept (and its text)."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            n, removed, sha, kept = [], [], [], []
            whole, starts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j, data, offs in chunks(batch.column(1)):
                w = Words(data, offs)
                body = data.tobytes()
                for k in range(j - i):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    keep = np.ones(b - a, bool)
                    if whole[i + k]:
                        keep[:] = False
                    elif starts[i + k]:
                        edge = np.zeros(b - a + 1, np.int32)
                        s = np.unique(np.asarray(starts[i + k]))
                        edge[s] += 1
                        edge[s + length] -= 1
                        keep = np.cumsum(edge)[:-1] == 0
                    at = np.flatnonzero(keep) + a
                    text = b" ".join([body[x:y] for x, y in zip(w.start[at].tolist(), w.end[at].tolist())])
                    n.append(b - a)
                    removed.append(b - a - len(at))
                    sha.append(hashlib.sha256(text).hexdigest())
                    if texts:
                        kept.append(body[offs[k] : offs[k + 1]].decode() if len(at) == b - a else text.decode())
            more = list(range(4, batch.num_columns))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(out) + texts] + [batch.schema.names[c] for c in more]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.string())] * texts + [batch.column(c) for c in more], names)

    return run


def _keyed(docs: DataFrame, more: list[str]) -> DataFrame:
    """Adds ``id``, unique by row and in the order of ``doc_id``: that itself, unless some are null or repeated; then the place in a sort of the rows."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("id", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), *more]
    return cut(docs.orderBy(*order).withColumn("id", F.monotonically_increasing_id()))


def substring_dedup(docs: DataFrame, length: int = 20, period: int = 13, texts: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Remove the words covered by a window of ``length`` words that also starts earlier in the corpus.

    ``docs`` has ``doc_id`` and ``text``. Returns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept_text``
    (the text unchanged if nothing is removed, else the kept words joined by a space), then the columns in ``carry``.

    1. Documents with equal word sequences: all but those with the smallest id go whole (if as long as a window).
    2. Anchors: ``length - period + 1`` words, hashed only where the position modulo ``period`` is in a difference cover.
       Two equal windows, wherever they start, hold equal anchors at one shift, so both anchors recur.
    3. Only windows with a recurring anchor are hashed whole, by 96 bits of two hash functions; all but the earliest of equal hashes are removed
       (among 10^12 windows a false removal has a chance of about 10^-5).

    Null or empty texts have no words. Every row is a document of its own. "Earlier" goes by id, a null id after all others; rows that
    share an id (or have none) go by a hash of their texts, then by the columns in ``carry``. Other columns are ignored.
    """
    spark = docs.sparkSession
    batches(spark)
    more = [f"_carry{i}" for i in range(len(carry))]
    kind = {c: docs.schema[c].dataType.simpleString() for c in carry}
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(m) for c, m in zip(carry, more))), more)
    digest = cut(docs.select("id", "text").transform(in_arrow, _digest, "id long, n long, a long, b long"))
    first = cut(digest.where(F.col("n") >= length).groupBy("n", "a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last"))
    first = F.broadcast(first) if first.count() <= BROADCAST_CLASSES else first  # beyond that, a large group is split as a skewed join
    copies = cut(digest.join(first, ["n", "a", "b"]).where("id <> first").select("id"))
    words = digest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    small = copies.count() <= BROADCAST_IDS
    copies = F.broadcast(copies) if small else copies
    bits = bucket_bits(words * len(COVERS[period]) // period)
    fresh = docs.select("id", "text").join(copies, "id", "left_anti")
    places = cut(occurrences(fresh, ["id", "text"], _anchors(length, period), bits).select("id", "pos"))
    dealt = docs.repartition("id")
    marked = dealt.join(places, "id").select("id", "text", "pos")
    starts = occurrences(marked, ["id", "text", "pos"], _windows(length, period), bits, later=True, wide=True).select("id", F.col("pos").alias("starts"))
    told = dealt.join(starts, "id", "left").join(copies.withColumn("whole", F.lit(True)), "id", "left")
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts + "".join(f", {m} {kind[c]}" for c, m in zip(carry, more))
    out = told.select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts", *more).transform(in_arrow, _strip(length, texts), kinds)
    return out.withColumnsRenamed(dict(zip(more, carry)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(case when len(w) >= 20 then range(1, len(w) - 18) else []::bigint[] end) i, w from w),
h as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) h from s),
f as (select doc_id, i, row_number() over (partition by h order by doc_id, i) r from h),
c as (select distinct doc_id, unnest(range(i, i + 20)) p from f where r > 1),
p as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from w where len(w) > 0),
k as (select doc_id, p.p, word, c.p is null as keep from p left join c using (doc_id, p))
select w.doc_id, len(w.w)::bigint n_words, count(*) filter (not keep) n_removed,
  sha256(coalesce(string_agg(word, ' ' order by p) filter (keep), '')) kept_sha256
from w left join k using (doc_id) group by w.doc_id, len(w.w)
"""
