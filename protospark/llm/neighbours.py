"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 1)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from protospark.llm.common import batches, cut, in_arrow, table
from protospark.llm.text import mix

#: Hash tables, bucket width on unit vectors (a projection of a random unit vector has spread 1), and buckets visited per table (at least, at most).
TABLES, WIDTH, PROBES, MOST_PROBES = 8, 1.7, 60, 1000
#: Share of true k-th neighbours that buckets have to hold, and queries whose k-th neighbour is looked up in the whole table to tell.
SUCCESS, SAMPLE = 0.97, 64
#: Index rows that one task compares at once; larger groups of buckets are split, and their queries sent to each part.
BLOCK = 1 << 13
_FOUND = "query long, cls long, score double"


def hashes_for(rows: int) -> int:
    """Projections per table: they grow with the logarithm of the rows, so that buckets don't."""
    return int(max(4, round(np.log2(max(rows, 2)) / 2) - 2))


def probe_order(m: int, probes: int) -> list[tuple[int, ...]]:
    """Perturbation sets over the ranks of the 2m boundary distances, by expected squared distance (Lv et al., 2007)."""
    e = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    e += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    heap, out = [(e[0], (0,))], [()]
    while heap and len(out) < probes:
        cost, s = heapq.heappop(heap)
        if all(2 * m - 1 - i not in s for i in s):
            out.append(s)
        if (j := s[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (cost - e[j] + e[j + 1], (*s[:-1], j + 1)))
            heapq.heappush(heap, (cost + e[j + 1], (*s, j + 1)))
    return out


def probes_needed(m: int, distances, tables: int = TABLES, width: float = WIDTH, success: float = SUCCESS, most: int = MOST_PROBES, seed: int = 7) -> int | None:
    """Buckets to visit per table so that points at these distances from a query share one with probability ``success`` on average; None beyond ``most``.

    For drawn offsets and projections: the rank, in the probe order, of the bucket the neighbour is in.
    """
    rank_of = {tuple(sorted(s)): i for i, s in enumerate(probe_order(m, most))}
    rng, missed = np.random.default_rng([seed, m]), np.zeros(most)
    for d in distances:
        f = rng.uniform(0, 1, (2000, m))
        step = np.floor(f + rng.normal(0, d / width, f.shape)).astype(np.int64)
        place = np.argsort(np.argsort(np.concatenate([f, 1 - f], axis=1), axis=1, kind="stable"), axis=1)
        hit = np.zeros(most)
        for st, pl in zip(step[(np.abs(step) < 2).all(axis=1)], place[(np.abs(step) < 2).all(axis=1)]):
            r = rank_of.get(tuple(sorted(int(pl[j if st[j] < 0 else m + j]) for j in np.flatnonzero(st))))
            if r is not None:
                hit[r] += 1
        missed += (1 - np.cumsum(hit) / len(f)) ** tables / len(distances)
    enough = np.flatnonzero(1 - missed >= success)
    return int(enough[0]) + 1 if len(enough) else None


def plan(rows: int, distances, tables: int = TABLES, width: float = WIDTH, probes: int = PROBES) -> tuple[int, int]:
    """(projections, probes): the most projections up to ``hashes_for`` that need no more than ``MOST_PROBES``; fewer make larger buckets, which are split."""
    for m in range(hashes_for(rows), 0, -1):
        if not len(distances):
            return m, probes
        if needed := probes_needed(m, distances, tables, width):
            return m, max(probes, needed)
    return 1, MOST_PROBES


def _nearest(queries: dict[int, np.ndarray], k: int):
    """The ``k`` best cosines of each sampled query within a task, itself left out."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches_:
            ids = batch.column(0).to_numpy()
            for at, x in _matrix(batch.column(1)):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for q, v in queries.items():
                    if len(v) == x.shape[1]:
                        score = (x @ v)[ids[at] != q]
                        best[q] = np.sort(np.r_[best.get(q, []), score])[-k:]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, b in best.items() for _ in b], pa.int64()), pa.array([float(y) for b in best.values() for y in b], pa.float64())], ["query", "score"])

    return run


def sampled_distances(classes: DataFrame, k: int) -> list[float]:
    """Distances of unit vectors to their k-th neighbour, for ``SAMPLE`` queries by a hash of the id."""
    unit = lambda v: (w := np.asarray(v, float) / np.abs(v).max()) / np.linalg.norm(w)
    queries = {r.cls: unit(r.vec) for r in classes.where("asks").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).collect()}
    found = classes.select("cls", "vec").transform(in_arrow, _nearest(queries, k), "query long, score double").groupBy("query")
    kth = found.agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query", F.element_at("s", F.least(F.lit(k), F.size("s"))).alias("s")).orderBy("query")
    return [float(np.sqrt(max(0.0, 2 - 2 * r.s))) for r in kth.collect()]


def _matrix(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double) for each length of vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat, begin = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(size)]
    out = []
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out.append((at, flat[begin[at][:, None] + np.arange(d)]))
    return out


def _projected(x: np.ndarray, tables: int, m: int, width: float, seed: int) -> np.ndarray:
    """Positions in bucket widths, rows x tables x m: Gaussian projections of unit vectors, shifted."""
    d = x.shape[1]
    rng = np.random.default_rng([seed, d, tables, m])
    a, b = rng.normal(size=(d, tables * m)) / np.sqrt(d), rng.uniform(0, 1, tables * m)
    scale = np.abs(x).max(axis=1, keepdims=True)  # against overflow
    unit = x / scale
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return (unit @ a * np.sqrt(d) / width + b).reshape(len(x), tables, m)


def _codes(cells: np.ndarray, d: int) -> np.ndarray:
    """A 64-bit code per row and table of integer cells (rows x tables x m)."""
    h = np.full(cells.shape[:2], d, np.uint64)
    for k in range(cells.shape[2]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k].astype(np.int64).view(np.uint64))
    return h


def _group(code: np.ndarray, groups: int) -> np.ndarray:
    """Table and bucket group in one number."""
    return (np.arange(code.shape[1])[None, :] * groups + (code % np.uint64(groups)).astype(np.int64)).astype(np.int64)


def _index(tables, m, width, seed, groups, vectors):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for at, x in _matrix(batch.column(1)):
                code = _codes(np.floor(_projected(x, tables, m, width, seed)), x.shape[1])
                take = pa.array(np.repeat(at, tables))
                grp = pa.array(_group(code, groups).ravel())
                if vectors:
                    yield pa.RecordBatch.from_arrays([grp, pa.array(code.view(np.int64).ravel()), batch.column(0).take(take), batch.column(1).take(take)], ["grp", "bucket", "cls", "vec"])
                else:
                    yield pa.RecordBatch.from_arrays([grp], ["grp"])

    return run


def _probe(tables, m, width, seed, groups, probes):
    order_of = probe_order(m, probes)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for at, x in _matrix(batch.column(1)):
                p = _projected(x, tables, m, width, seed)
                cell = np.floor(p)
                edge = np.concatenate([p - cell, 1 - (p - cell)], axis=2)
                rank = np.argsort(edge, axis=2, kind="stable")
                codes = []
                for s in order_of:
                    moved = cell.copy()
                    for j in s:
                        which = rank[:, :, j]
                        np.put_along_axis(moved, (which % m)[:, :, None], np.take_along_axis(moved, (which % m)[:, :, None], 2) + np.where(which < m, -1, 1)[:, :, None], 2)
                    codes.append(_codes(moved, x.shape[1]))
                code = np.stack(codes, axis=2)  # rows x tables x probes
                grp = np.arange(tables)[None, :, None] * groups + (code % np.uint64(groups)).astype(np.int64)
                row = np.repeat(np.arange(len(x)), tables * len(order_of))
                grp, code = grp.ravel(), code.ravel()
                o = np.lexsort((code, grp, row))
                row, grp, code = row[o], grp[o], code[o]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (grp[1:] != grp[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(code)].astype(np.int32)), pa.array(code.view(np.int64)))
                take = pa.array(at[row[new]])
                yield pa.RecordBatch.from_arrays([pa.array(grp[new]), batch.column(0).take(take), batch.column(1).take(take), lists], ["grp", "query", "qvec", "probes"])

    return run


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows brought under 1 by powers of two: cosines keep every bit, and products of large components don't overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _compare(keep: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if index.num_rows and queries.num_rows:
            bucket, cls = index.column("bucket").to_numpy(), index.column("cls").to_numpy()
            probes = queries.column("probes").combine_chunks()
            q_of, wanted = np.repeat(np.arange(len(probes)), np.diff(probes.offsets.to_numpy())), probes.flatten().to_numpy()
            query = queries.column("query").to_numpy()
            vectors = {x.shape[1]: (at, _scaled(x)) for at, x in _matrix(index.column("vec"))}
            for qat, q in _matrix(queries.column("qvec")):
                if q.shape[1] not in vectors:
                    continue
                at, x = vectors[q.shape[1]]
                q = _scaled(q)
                where = np.full(len(query), -1)
                where[qat] = np.arange(len(qat))
                ok = where[q_of] >= 0
                asked, asking = wanted[ok], where[q_of[ok]]
                o = np.argsort(asked, kind="stable")
                asked, asking = asked[o], asking[o]
                mine = np.argsort(bucket[at], kind="stable")
                b = bucket[at][mine]
                qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
                starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
                for s, e in zip(starts, np.r_[starts[1:], len(b)]):
                    rows, qs = mine[s:e], asking[np.searchsorted(asked, b[s], "left") : np.searchsorted(asked, b[s], "right")]
                    for k in range(0, len(qs), 512):
                        part = qs[k : k + 512]
                        score = (q[part] @ x[rows].T) / (qn[part][:, None] * xn[rows][None, :])
                        ids = cls[at[rows]]
                        n = min(keep, len(rows))
                        top = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :n]
                        out[0].append(np.repeat(query[qat[part]], n))
                        out[1].append(ids[top].ravel())
                        out[2].append(np.take_along_axis(score, top, 1).ravel())
        query, cls, score = (np.concatenate(x) for x in out)
        o = np.lexsort((cls, -score, query))
        query, cls, score = query[o], cls[o], score[o]
        first = np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]], np.arange(len(query)), 0)) if len(query) else query
        ok = np.arange(len(query)) - first < keep
        return pa.table({"query": query[ok], "cls": cls[ok], "score": score[ok]})

    return run


def neighbours(vectors: DataFrame, is_query, k: int = 5, tables: int = TABLES, width: float = WIDTH, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by cosine found for each row where ``is_query`` (a Column) holds.

    ``vectors`` has ``vec_id`` (long) and ``embedding`` (array of float or double). Equal vectors are one class with its ``k + 1`` smallest
    ids, searched once; the index holds every class in each of ``tables`` tables, a query visits ``probes``
    buckets of each, or as many more as the k-th neighbours of a few queries need (see ``plan``). Bucket members are compared exactly, in double precision, on the original vectors.

    Vectors that are null, empty, zero, or hold nulls or non-finite numbers, and null ids, take no part. Vectors are
    compared with those of their own length only. Ties go to the smaller id; an id that is repeated is one row for each of its vectors.
    """
    spark = vectors.sparkSession
    batches(spark)
    e = F.col("embedding")
    fine = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), e, is_query.alias("asks")).where("id is not null and embedding is not null").where(fine)
    rows = rows.withColumn("a", F.xxhash64("embedding")).withColumn("b", F.xxhash64(F.lit(1), "embedding"))
    classes = cut(rows.groupBy("a", "b").agg(F.first("embedding").alias("vec"), F.min("id").alias("cls"), F.bool_or("asks").alias("asks")))
    ids = rows.select("a", "b", "id", F.array("id").alias("ids"))
    for level in (10, 20, None):  # the smallest ids of blocks, then of blocks of blocks
        block = F.shiftright("id", level) if level else F.lit(0)
        ids = ids.groupBy("a", "b", block.alias("block")).agg(F.min("id").alias("id"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    members = ids.join(classes.select("a", "b", "cls"), ["a", "b"]).select("cls", "ids")

    n = classes.count()
    m, probes = plan(n, sampled_distances(classes, k) if n else [], tables, width, probes)
    groups = max(1, n // BLOCK)
    how = (tables, m, width, seed, groups)
    source = classes.select("cls", "vec")
    kind = source.schema["vec"].dataType.simpleString()
    sizes = source.transform(in_arrow, _index(*how, False), "grp long").groupBy("grp").agg(F.ceil(F.count("*") / (4 * BLOCK)).alias("parts"))
    index = source.transform(in_arrow, _index(*how, True), f"grp long, bucket long, cls long, vec {kind}").join(sizes, "grp")
    index = index.select("grp", F.pmod(F.xxhash64("cls"), "parts").alias("part"), "bucket", "cls", "vec")
    asked = classes.where("asks").select("cls", "vec").transform(in_arrow, _probe(*how, probes), f"grp long, query long, qvec {kind}, probes array<long>")
    asked = asked.join(sizes, "grp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    found = index.groupBy("grp", "part").cogroup(asked.groupBy("grp", "part")).applyInArrow(_compare(k + 1), _FOUND)
    found = found.groupBy("query", "cls").agg(F.max("score").alias("score"))
    by = lambda *order: F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:]))
    found = found.withColumn("r", by("query", F.desc("score"), "cls")).where(F.col("r") <= k + 1).drop("r")
    queries = rows.where("asks").join(classes.select("a", "b", F.col("cls").alias("query")), ["a", "b"]).select(F.col("id").alias("query_id"), "query")
    each = queries.join(found, "query").join(members, "cls").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    return each.distinct().withColumn("rank", by("query_id", F.desc("score"), "vec_id").cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
