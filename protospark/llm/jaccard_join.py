"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones (operator 4)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.llm.common import batches, cut, in_arrow, table
from protospark.llm.graph import components
from protospark.llm.shared import bucket_bits, occurrences
from protospark.llm.text import LOWER, Words, chunks, mix, per_document, rolling

#: Counters of shingle occurrences, by hash; they order shingles from rare to common, which any order may do.
CELLS, CHUNK = 1 << 22, 1 << 16
#: Largest set size for which subsets are considered.
MOST_SMALL = 13
#: Cost of a posting in an inverted list, in enumerated subsets.
POSTING_COST = 3
BROADCAST_IDS = 1 << 20
#: Rounds in which the members of an inverted list are compared with so many of them only: in the first round the smallest id is one.
STAR_ROUNDS, HUBS = 2, 4
#: Members of a list within a band of sizes that one block holds on average.
LIST = 1 << 9
#: Cells into which a set's shingles are counted, by hash: what two sets have in common is at most the sum of the cells' minima.
PROFILE, FULL = 128, 65535


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document) of a chunk, and set sizes; fewer than ``width`` words are one shingle."""
    w = Words(LOWER[data], offs)
    word = w.hashes()
    h = rolling(word, width)
    ok = w.doc[: len(h)] == w.doc[width - 1 : width - 1 + len(h)]
    h, doc = h[ok], w.doc[: len(h)][ok]
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(short):
        whole = np.array([mix(rolling(word[w.first[d] : w.first[d + 1]], int(w.count[d])) + w.count[d : d + 1].astype(np.uint64))[0] for d in short.tolist()], np.uint64)
        h, doc = np.r_[h, whole], np.r_[doc, short]
    h, doc = per_document(h, doc)
    return h, doc, np.bincount(doc, minlength=len(offs) - 1)


def _digest(width: int):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            n, a, b, profiles = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for i, j, data, offs in chunks(batch.column(1)):
                h, doc, size = shingles(data, offs, width)
                n.append(size)
                cells = np.bincount(doc * PROFILE + (mix(h) % np.uint64(PROFILE)).astype(np.int64), minlength=(j - i) * PROFILE).reshape(-1, PROFILE)
                profiles += [c.tobytes() for c in np.minimum(cells, FULL).astype(np.uint16)]
                for out, v in ((a, mix(h)), (b, mix(h ^ np.uint64(0x5851F42D4C957F2D)))):
                    s = np.zeros(j - i, np.uint64)
                    np.add.at(s, doc, v)
                    out.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (n, a, b)), pa.array(profiles, pa.binary())], ["id", "n", "a", "b", "profile"])

    return run


def _count_cells(width: int):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches_:
            for _, _, data, offs in chunks(batch.column(1), 8 << 20):
                h, _, _ = shingles(data, offs, width)
                total += np.bincount((h % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        for k in range(CELLS // CHUNK):
            part = total[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                planes = part.view(np.uint8).reshape(-1, 4).T.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(planes, 1)], pa.binary())], ["part", "body"])

    return run


def _sum_cells(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches_:
        for k, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.ascontiguousarray(np.frombuffer(zlib.decompress(body), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            totals[k] = totals.get(k, 0) + part.astype(np.uint64)
    for k, total in totals.items():
        level = np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "body"])


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """A level per cell (``CELLS`` bytes, whatever the input): logarithm of how many shingles of all documents fall into it."""
    parts = docs.select("id", "text").transform(in_arrow, _count_cells(width), "part int, body binary").repartition("part").transform(in_arrow, _sum_cells, "part int, body binary")
    level = np.zeros(CELLS, np.uint8)
    for k, body in parts.collect():
        level[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(body, np.uint8)
    return level


def _prefixes(width: int, smallest: int, level):
    """The ``n - ceil(3n/4) + 1`` rarest shingles of each set of ``smallest`` or more: similar sets share one of them."""

    def keys_of(batch):
        keys, rows, ranks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order_of = level.value
        for i, _, data, offs in chunks(batch.column(1)):
            h, doc, size = shingles(data, offs, width)
            order = np.lexsort((h, order_of[(h % np.uint64(CELLS)).astype(np.int64)], doc))
            h, doc = h[order], doc[order]
            rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            n = size[doc]
            ok = (n >= smallest) & (rank < n - (3 * n + 3) // 4 + 1)
            keys.append(h[ok])
            rows.append(doc[ok] + i)
            ranks.append(rank[ok])
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(ranks)

    return keys_of


def _subsets(width: int, boundary: int):
    """(c, key, id, n): hashes of the c-subsets of small sets, for every c that a partner may ask for."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out = [[], [], [], []]
            for i, _, data, offs in chunks(batch.column(1)):
                h, doc, size = shingles(data, offs, width)
                begin = np.cumsum(size) - size
                for d in np.flatnonzero((size > 0) & (size < boundary)).tolist():
                    n = int(size[d])
                    s = mix(h[begin[d] : begin[d] + n])
                    for c in range((3 * n + 3) // 4, n + 1):
                        key = mix(s[np.array(list(combinations(range(n), c)))].sum(axis=1, dtype=np.uint64) + np.uint64(c))
                        for o, x in zip(out, (np.full(len(key), c), key.view(np.int64), np.full(len(key), ids[i + d]), np.full(len(key), n)), strict=True):
                            o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["c", "key", "id", "n"])

    return run


def boundary_of(sizes: dict[int, int]) -> int:
    """The boundary of least cost. ``sizes``: how many sets there are of each size up to ``MOST_SMALL``.

    Sets under the boundary enumerate subsets; sets from three quarters of it on have prefix postings.
    """
    subsets = lambda n: sum(comb(n, c) for c in range((3 * n + 3) // 4, n + 1))
    scan = lambda n: POSTING_COST * (n - (3 * n + 3) // 4 + 1)
    cost = lambda x: sum(k * (subsets(n) * (n < x) + scan(n) * (4 * n >= 3 * x)) for n, k in sizes.items())
    return min(range(1, MOST_SMALL + 1), key=cost)


def _similar(width: int, percent: int):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            sets = []
            for column in (2, 3):
                h, d, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, _, data, offs in chunks(batch.column(column)):
                    x, doc, size = shingles(data, offs, width)
                    h.append(x)
                    d.append(doc + i)
                    n.append(size)
                sets.append((np.concatenate(h), np.concatenate(d), np.concatenate(n)))
            (h, d, n), (h2, d2, n2) = sets
            h, d = np.r_[h, h2], np.r_[d, d2]
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            both = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=len(n))
            ok = (100 * both >= percent * (n + n2 - both)) & (both > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    return run


def _within_bound(percent: int):
    """From (a, b, n_a, n_b, profile_a, profile_b) the pairs that may be similar by the cells' minima; a full cell bounds nothing."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, PROFILE).astype(np.int64) for c in (4, 5))
            n, n2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            least = np.where((x == FULL) & (y == FULL), 1 << 40, np.minimum(x, y)).sum(axis=1)
            both = np.minimum(least, np.minimum(n, n2))
            ok = pa.array(100 * both >= percent * (n + n2 - both))
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    return run


def _of_ids(rows: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """The ``rows`` whose ``id`` is in ``pairs[column]``: what isn't needed is left out before a shuffle."""
    ids = cut(pairs.select(F.col(column).alias("id")).distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, digest: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The pairs ``(a, b)`` whose texts' shingle sets have that Jaccard similarity, compared exactly in whole numbers.

    Pairs whose ``digest`` profiles rule the similarity out go first; their texts are not moved. A document in very many
    pairs meets them in 16 places.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(16)))

    def met(rows: DataFrame, *columns: str) -> DataFrame:
        named = {x: [F.col(c).alias(f"{c}_{x}") for c in columns] for x in "ab"}
        left = salted.select("a", "salt").distinct().join(_of_ids(rows, salted, "a").select(F.col("id").alias("a"), *named["a"]), "a")
        both = salted.join(_of_ids(rows, salted, "b").select(F.col("id").alias("b"), *named["b"]), "b").join(left, ["a", "salt"])
        return both.select("a", "b", *(f"{c}_{x}" for c in columns for x in "ab"))

    near = met(digest.select("id", "n", "profile"), "n", "profile").transform(in_arrow, _within_bound(percent), "a long, b long").distinct()
    salted = cut(near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(16))))
    return met(docs, "text").transform(in_arrow, _similar(width, percent), "a long, b long")


def _banded(posts: DataFrame) -> DataFrame:
    """Pairs of list members whose sizes and ranks may fit, each with its other member's columns as ``o_``.

    With x the member of smaller set, an overlap of 3/7 of both sizes from its rank on needs ``rank <= n / 7`` in x: what lies
    deeper in its set looks others up, but isn't looked up itself. Members are matched within bands of sizes. Of a list with
    over ``LIST`` rows on either side of a band both sides are dealt in blocks, and each block meets all of the other side's
    apart from the rest, so a task has the pairs of two blocks only.
    """
    band = lambda size: F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(8 / 7)))
    most = F.least(F.col("low"), F.floor((7 * (F.col("n") - F.col("rank")) - 3 * F.col("low")) / 3))
    least = F.floor(3 * F.col("low") / 4)
    small = posts.where("7 * rank <= 7 * n - 6 * low").withColumn("band", F.explode(F.sequence(band(F.col("low")), band(F.col("n")))))
    large = posts.withColumn("most", most).where(F.col("most") >= least).withColumn("band", F.explode(F.sequence(band(least), band(F.col("most"))))).drop("most")
    sides = small.select("key", "band", F.lit(1).alias("s"), F.lit(0).alias("l")).union(large.select("key", "band", F.lit(0).alias("s"), F.lit(1).alias("l")))
    sides = sides.groupBy("key", "band").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(x) / LIST)).alias(x) for x in "sl")).where("s > 1 or l > 1")
    sides = cut(sides)
    sides = F.broadcast(sides) if sides.count() <= BROADCAST_IDS else sides

    def dealt(rows: DataFrame, own: str, others: str) -> DataFrame:
        """One block of its own side for each row, and every block of the other side."""
        rows = rows.join(sides, ["key", "band"], "left").withColumns({x: F.coalesce(x, F.lit(1)) for x in "sl"})
        return rows.withColumn(f"{own}_block", F.pmod(F.xxhash64("id"), F.col(own))).withColumn(f"{others}_block", F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("s", "l")

    large, small = dealt(large, "l", "s"), dealt(small, "s", "l")
    met = ["key", "band", "s_block", "l_block"]
    other = small.select(*met, *(F.col(c).alias(f"o_{c}") for c in ("id", "n", "low", "rank", "component")))
    return large.join(other, met).where("id <> o_id and (o_low < low or o_low = low and o_id < id)")


def jaccard_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id``: components of the links of Jaccard similarity 0.75 or more.

    ``docs`` has ``doc_id`` and ``text``; ASCII letters are lower-cased.

    1. Equal sets become one class, named by its smallest id.
    2. Small sets emit hashed subsets of each size c that a partner can ask for. Of the sets with a subset in common, each is
       linked to the smallest only: sets a <= b that c suffices for both link to it, so no link between components is lost.
    3. Large sets, and the small ones that may be similar to them, post their rarest shingles to inverted lists. Members of
       a list are first compared with four of them, in two rounds; then, only where a list still spans several components,
       with those members of the others that sizes and ranks allow, in blocks. Every pair is verified on its whole texts.

    Null or empty texts have an empty set, and are linked with nothing (``component_id`` is their own id). Rows that share an
    id are one document. A row whose id is null takes no part and gets a null component. Other columns are ignored.
    """
    spark = docs.sparkSession
    batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    digest = cut(docs.transform(in_arrow, _digest(width), "id long, n long, a long, b long, profile binary"))
    known = digest.where("id is not null and n > 0")
    classes = known.groupBy("n", "a", "b").agg(F.min("id").alias("cls"), F.count("*").alias("copies"))
    several = cut(classes.where("copies > 1"))
    member = cut(known.join(several, ["n", "a", "b"]).select("id", "n", "cls"))
    spare = cut(member.where("id <> cls").select("id").distinct().join(classes.select(F.col("cls").alias("id")).distinct(), "id", "left_anti"))
    spare = F.broadcast(spare) if spare.count() <= BROADCAST_IDS else spare
    fresh = docs.where("id is not null").join(spare, "id", "left_anti")

    sizes = {r[0]: r[1] for r in classes.where(F.col("n") <= MOST_SMALL).groupBy("n").count().collect()}
    boundary = boundary_of(sizes)
    small = cut(fresh.transform(in_arrow, _subsets(width, boundary), "c long, key long, id long, n long"))
    hub = small.groupBy("c", "key").agg(F.min(F.struct("n", "id")).alias("hub"))
    light = small.join(hub, ["c", "key"]).where("id <> hub.id and 3 * (n + hub.n) <= 7 * c").select(F.col("hub.id").alias("a"), F.col("id").alias("b"))

    smallest = (3 * boundary + 3) // 4
    level = spark.sparkContext.broadcast(rarity(fresh, width))
    total = classes.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * 0.75) + 1), F.lit(0))).first()[0]
    found = occurrences(fresh, ["id", "text"], _prefixes(width, smallest, level), bucket_bits(total))
    node = classes.groupBy(F.col("cls").alias("id")).agg(F.max("n").alias("n"), F.min("n").alias("low"))
    lists = cut(found.join(node, "id"))

    def near(x: str, y: str, *ranked: str) -> str:
        """Sizes fit, and what follows the shared shingle in the sets whose rank is known leaves room for the overlap needed."""
        room = [f"7 * ({z}n - {z}rank) >= 3 * ({x}low + {y}low)" for z in ranked]
        return " and ".join([f"4 * {x}n >= 3 * {y}low and 4 * {y}n >= 3 * {x}low", *room])

    links, tried, comp = cut(light.distinct()), None, None
    for turn in range(STAR_ROUNDS + 1):
        if comp is None:
            rows = lists.withColumn("component", F.col("id"))
        else:
            rows = lists.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        posts = rows.select("id", "n", "low", "component", F.explode(F.arrays_zip("key", "pos")).alias("p")).select("p.key", F.col("p.pos").alias("rank"), "id", "n", "low", "component")
        hubs = [F.min("id") if turn + k == 0 else F.min_by("id", F.xxhash64("id", F.lit(HUBS * turn + k))) for k in range(HUBS if turn < STAR_ROUNDS else 0)]
        mixed = posts.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), *(h.alias(f"hub{k}") for k, h in enumerate(hubs))).where("x <> y")
        if turn < STAR_ROUNDS:
            pairs = posts.join(mixed, "key").select("id", "n", "low", "rank", "component", F.explode(F.array(*(f"hub{k}" for k in range(HUBS)))).alias("o_id"))
            pairs = pairs.where("id <> o_id").groupBy("id", "o_id", "n", "low", "component").agg(F.min("rank").alias("rank"))
            pairs = pairs.join(rows.select(*(F.col(c).alias(f"o_{c}") for c in ("id", "n", "low", "component"))), "o_id").where(near("", "o_", ""))
        else:
            posts = cut(posts.join(mixed.select("key"), "key", "left_semi"))
            pairs = _banded(posts).where(near("", "o_", "", "o_"))
        pairs = pairs.where("component <> o_component").select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        links = cut(links.union(verified(pairs, fresh, digest, width)).distinct())
        tried = pairs if tried is None else tried.union(pairs)
        comp = components(links)

    cls = member.groupBy("id").agg(F.min("cls").alias("cls"))
    told = digest.join(cls, "id", "left").withColumn("cls", F.coalesce("cls", "id"))
    told = told.join(comp.withColumnRenamed("id", "cls"), "cls", "left")
    return told.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "cls").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: Exact brute force over sharing pairs, for DuckDB.
OP4_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
d as (select doc_id, md5(string_agg(g, chr(10) order by g)) k, count(*) n from s group by 1),
r as (select k, min(doc_id) r from d group by 1),
c as (select doc_id, r from d join r using (k)),
u as (select s.doc_id, g from s join r on s.doc_id = r.r),
p as (select a.doc_id a, b.doc_id b, count(*) i from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
l as (select a, b from e union all select b, a from e union all select r, doc_id from c union all select doc_id, r from c),
t as (with recursive q(x, y) as (select doc_id, doc_id from documents union select q.x, l.b from q join l on l.a = q.y) select x, min(y) y from q group by 1)
select documents.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(t.y, documents.doc_id) component_id
from documents left join n using (doc_id) left join t on t.x = documents.doc_id
"""
