"""Quality rules (operator 7): counts of the base rules, and hashed n-gram logistic regression with calibrated scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.llm.common import batches, held_out, in_arrow, table
from protospark.llm.features import fit_logistic, gram_features, platt, span_hash, sparse_scores
from protospark.llm.text import SPACE, Words, chunks, per_document, rolling

SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
SIZE = 1 << 16
#: A text is rejected if its calibrated probability of good quality is below this.
THRESHOLD = 0.2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Relative frequencies are small; this brings them to the scale of the weights.
_SCALE = 30.0


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base rules' counts for each document of a chunk."""
    n = len(offs) - 1
    total = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offs])
    w = Words(data, offs)
    out = {"n_words": w.count, "word_chars": total(~SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data])}
    # lines
    cut = np.flatnonzero(data == 10)
    start, end = np.sort(np.r_[offs[:-1], cut + 1]), np.sort(np.r_[cut, offs[1:]])
    doc = np.searchsorted(offs, start, "right") - 1
    doc = np.minimum(doc, n - 1)
    solid = np.r_[0, np.cumsum(~SPACE[data])]
    ok = (end > start) & (solid[end] > solid[start])
    h = span_hash(data, start[ok], end[ok])
    _, distinct = per_document(h, doc[ok])
    out["n_dup_lines"] = np.bincount(doc[ok], minlength=n) - np.bincount(distinct, minlength=n)
    # words in repeated windows of five
    g = rolling(w.hashes(), 5)
    at = np.flatnonzero(w.doc[: len(g)] == w.doc[4 : 4 + len(g)])
    order = at[np.lexsort((g[at], w.doc[at]))]
    same = (g[order][1:] == g[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
    again = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    edge = np.zeros(len(w.start) + 6, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 5, -1)
    covered = np.cumsum(edge)[: len(w.start)] > 0
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
    return out


def _sample(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        feats, vals = [], []
        for i, j, data, offs in chunks(batch.column(2)):
            f, d, v = gram_features(data, offs, SIZE)
            key, at = np.unique(d * SIZE + f, return_inverse=True)
            v, d = np.bincount(at, v), key // SIZE
            cut = np.searchsorted(d, np.arange(j - i + 1))
            feats += [(key[cut[k] : cut[k + 1]] % SIZE).astype(np.uint16).tobytes() for k in range(j - i)]
            vals += [(_SCALE * v[cut[k] : cut[k + 1]]).astype(np.float16).tobytes() for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feats, pa.binary()), pa.array(vals, pa.binary())], ["id", "y", "feats", "vals"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept, calibration included, from ``SAMPLE_ROWS`` labelled rows at most (those with the smallest id hashes).

    Of these, rows without a document or of more than ``SAMPLE_CHARS`` characters are left out; of rows that share an id, the
    least text counts. The driver holds four bytes for each feature of a sample text. Four fifths train the weights, the rest calibrates them (Platt). Without labels of both classes every text is good.
    """
    marked = labels.where(~held_out()).where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    few = marked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col("doc_id").alias("id"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(F.broadcast(few), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).select(F.xxhash64("id").alias("id"), "y", "text")
    got = sorted(rows.transform(in_arrow, _sample, "id long, y int, feats binary, vals binary").collect())
    y = np.array([r[1] for r in got], float)
    part = np.arange(len(y)) % 5 == 4
    if not len(y) or len(set(y[~part])) < 2 or len(set(y[part])) < 2:
        return np.zeros(SIZE, np.float32), 4.0
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(r[2]) // 2 for r in got])
    col, val = (np.frombuffer(b"".join(r[k] for r in got), kind) for k, kind in ((2, np.uint16), (3, np.float16)))
    del got
    w, b = fit_logistic(row, col, val, y, SIZE, l2=1e-3, weight=(~part).astype(float))
    z = sparse_scores(row, col, val, w, len(y)) + b
    a, c = platt(z[part], y[part])
    return (a * _SCALE * w).astype(np.float32), float(a * b + c)


def _judge(model):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches_:
            got, scores = {k: [np.zeros(0, np.int64)] for k in names}, [np.zeros(0)]
            for i, j, data, offs in chunks(batch.column(1)):
                for k, v in base_counts(data, offs).items():
                    got[k].append(v)
                f, d, v = gram_features(data, offs, SIZE)
                scores.append(1 / (1 + np.exp(-np.clip(np.bincount(d, v * w[f], j - i) + b, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(got[k]).astype(np.int64)) for k in names), pa.array(np.concatenate(scores))], ["doc_id", *names, "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the base rules' counts, ``base_failed``, ``score`` (calibrated probability of good quality) and ``kept``.

    ``docs`` has ``doc_id`` and ``text``; null and empty texts have no words, so the base rules reject them.
    Repeated ids are judged row by row; null ids are kept as they are; other columns are ignored.
    """
    spark = docs.sparkSession
    batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))
    told = docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, _judge(model), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return told.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= THRESHOLD))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
