"""Toxicity by weak supervision (operator 5): voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from protospark.llm.common import batches, held_out, in_arrow, table
from protospark.llm.features import BLOCK, fit_logistic, word_features
from protospark.llm.text import chunks, mix

#: Bound of the labelled sample on which lexicons, label model and classifier are fitted.
SAMPLE_ROWS = 8000
#: Texts of the sample have at most so many characters; what is scored has no limit.
SAMPLE_CHARS = 50_000
SIZE = 1 << 20
#: A feature is mined into the widest lexicon if seen in so many toxic sample texts, so many standard deviations above its share, and
#: into the narrower two if so large a share of its texts is toxic; the classifier has the features that are ``USUAL`` from their share in either direction.
LEAST_SEEN, MINED, LIKELY, SURE, USUAL = 4, 6.0, 0.75, 0.97, 5.0
#: Besides whole words, the beginnings of so many bytes of longer ones are features.
PREFIXES = (4, 5, 6, 7)
#: Lexicons are mined for each of so many folds from all others, so no vote of theirs has seen the label of its text.
FOLDS = 10

#: Common insults by language (fixed lists).
INSULTS = {
    "en": "idiot moron loser stupid dumb scum trash clown worthless pathetic disgusting ugly filthy vermin imbecile bastard bitch shit fuck crap".split(),
    "de": "idiot trottel depp arschloch dummkopf abschaum versager schwachkopf dreckig widerlich".split(),
    "fr": "idiot imbécile connard salaud abruti crétin ordure débile pourriture".split(),
    "es": "idiota imbécil estúpido basura cabrón tonto escoria payaso asqueroso".split(),
}
_ANY = "|".join(sorted({w for ws in INSULTS.values() for w in ws}))
PATTERNS = {
    **{f"insult_{k}": rf"(?i)\b({'|'.join(v)})\b" for k, v in INSULTS.items()},
    "address": rf"(?i)\b(you|your|they|those)\b\W+(\w+\W+){{0,2}}({_ANY})\b",
    "threat": r"(?i)\b(kill|hurt|destroy|hate)\s+(you|them|him|her)\b",
    "obfuscated": r"(?i)\b[a-z]+[*@#$]{2,}[a-z]*\b",
    "shouting": r"(\b[A-Z]{4,}\b\W+){4,}",
    "outcry": r"!{3,}",
}
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}
VOTERS = ("likely", "likely_twice", "mined_4", "mined_8", "sure", *PATTERNS, "none_likely", "none_sure")


@dataclass
class LabelModel:
    """Voters' class-conditional vote rates, and weights that discount correlated voters."""

    prior: float = 0.5
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 3)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def report(self, votes: np.ndarray) -> list[tuple[float, float]]:
        """Each voter's coverage (share of texts it votes on) and accuracy, as the model estimates it, where it votes."""
        q = self.posterior(votes)[:, None]
        says = votes != 0
        right = np.where(votes > 0, q, 1 - q) * says
        return [(float(c), float(r / n) if n else 0.0) for c, r, n in zip(says.mean(axis=0), right.sum(axis=0), says.sum(axis=0))]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        log = np.log(self.rates[1] / self.rates[0])
        for j in range(votes.shape[1]):
            z += self.weights[j] * log[j, votes[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 25) -> LabelModel:
    """EM over votes in {-1, 0, 1} (rows x voters) from the posteriors ``start``.

    Accuracies are the voters' rates given the class. Correlations are those of the voters' residuals
    within the classes; a voter's evidence is divided by one plus the sum of its positive ones.
    """
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    q, model = np.clip(start, 0.02, 0.98), LabelModel(prior)
    for _ in range(rounds):
        rates = np.stack([(np.einsum("i,ijv->jv", c, hot) + 0.3) / (c.sum() + 0.9) for c in (1 - q, q)])
        expect = np.einsum("ic,cjv->ijv", np.stack([1 - q, q], 1), rates)
        rest = (hot - expect) @ np.array([-1.0, 0.0, 1.0])
        sd = rest.std(axis=0) + 1e-9
        corr = (rest.T @ rest) / len(rest) / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        model = LabelModel(float(np.clip(q.mean(), 0.01, 0.99)), rates, 1 / (1 + np.maximum(corr - 0.1, 0).sum(axis=1)))
        q = model.posterior(votes)
    return model


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    label_model: LabelModel
    #: voter: (coverage, estimated accuracy) on the sample
    voters: dict[str, tuple[float, float]]


def _sample_features(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        feats, votes = [], []
        texts = batch.column(2).to_pylist()
        for i, j, data, offs in chunks(batch.column(2)):
            f, d = word_features(data, offs, SIZE, PREFIXES)
            at = np.searchsorted(d, np.arange(j - i + 1))
            feats += [f[at[k] : at[k + 1]].astype(np.int32).tobytes() for k in range(j - i)]
            votes += [bytes(1 + bool(p.search(texts[i + k] or "")) for p in _PATTERNS.values()) for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feats, pa.binary()), pa.array(votes, pa.binary())], ["id", "y", "feats", "votes"])


def unlike(feats: list[np.ndarray], sketches: int = 4) -> list[int]:
    """Indices of the sample's texts without near copies of earlier ones, whose rare words would look like evidence: those that share no pair of min-hashes, over features of at most a twentieth of the texts, with them."""
    count = np.zeros(SIZE, np.int64)
    for f in feats:
        count[f] += 1  # a text's features are distinct
    seen, kept, often = set(), [], count * 20 > len(feats)
    for i, f in enumerate(feats):
        f = f[~often[f]]
        least = [int(mix(f.astype(np.uint64) + np.uint64(k << 40)).min()) for k in range(sketches)] if len(f) else []
        own = {(j, k, least[j], least[k]) for k in range(len(least)) for j in range(k)}
        if not own & seen:
            kept.append(i)
            seen |= own
    return kept


def excess(row: np.ndarray, col: np.ndarray, q: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each feature, over the texts ``of``: standard deviations above the mean of ``q``, the sum of ``q`` and the number of its texts."""
    toxic, seen, share = np.zeros(SIZE), np.zeros(SIZE), q[of].mean()
    for a in range(0, len(row), BLOCK):
        r, c = row[a : a + BLOCK], col[a : a + BLOCK]
        at = of[r]
        toxic += np.bincount(c[at], q[r[at]], SIZE)
        seen += np.bincount(c[at], minlength=SIZE)
    return (toxic - share * seen) / np.sqrt(np.maximum(share * (1 - share) * seen, 1e-9)), toxic, seen


def hits(row: np.ndarray, col: np.ndarray, lexicon: np.ndarray, n: int) -> np.ndarray:
    """How many features of a lexicon each of ``n`` texts has."""
    return sum((np.bincount(row[a : a + BLOCK][lexicon[col[a : a + BLOCK]]], minlength=n) for a in range(0, len(row), BLOCK)), np.zeros(n))


def lexicon_votes(row: np.ndarray, col: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Votes of the mined lexicons (texts x 5), each fold's mined on the others."""
    fold = np.arange(len(y)) % FOLDS
    found = np.zeros((3, len(y)))
    for k in range(FOLDS):
        if y[fold != k].min(initial=1) == y[fold != k].max(initial=0):
            continue
        away, toxic, seen = excess(row, col, y, fold != k)
        mined = (away >= MINED) & (toxic >= LEAST_SEEN)
        for f, share in zip(found, (0, LIKELY, SURE), strict=True):
            f += hits(row, col, mined & (toxic >= share * seen), len(y)) * (fold == k)
    mined, likely, sure = found
    return np.stack([likely > 0, likely > 1, mined > 3, mined > 7, sure > 0], axis=1).astype(int)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside the held-out fold: the ``SAMPLE_ROWS`` with the smallest id hashes, of an id the least text
    of at most ``SAMPLE_CHARS`` characters.

    Labels serve to mine lexicons (for other folds than their own), nothing else: the label model starts from the voters'
    majority and never sees them, and the classifier learns its posteriors.
    With no labelled rows, or rows of one class only, the model is the constant share of that class (0.5 without rows).
    """
    marked = labels.where(~held_out()).where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    few = marked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col("doc_id").alias("id"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(F.broadcast(few), "id").select("id", "y", "text")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))  # ids that several rows share are one text, so the sample is bounded
    got = rows.transform(in_arrow, _sample_features, "id long, y int, feats binary, votes binary").collect()
    got.sort(key=lambda r: (hashlib.md5(str(r[0]).encode()).digest(), r[0]))
    y = np.array([r[1] for r in got], float)
    flat = LabelModel()
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return Model(np.zeros(SIZE, np.float32), float(np.log(p / (1 - p))), flat, {})
    feats = [np.frombuffer(r[2], np.int32) for r in got]
    single = unlike(feats)
    patterns = np.array([np.frombuffer(got[i][3], np.uint8).astype(int) - 1 for i in single])
    feats, y = [feats[i] for i in single], y[single]
    row, col = np.repeat(np.arange(len(y), dtype=np.int32), [len(f) for f in feats]), np.concatenate(feats)
    del got, feats
    mined = lexicon_votes(row, col, y)
    insult = patterns[:, : len(INSULTS)].any(axis=1)
    none = np.stack([(mined[:, 0] == 0) & ~insult, (mined[:, 4] == 0) & ~insult], axis=1)
    votes = np.concatenate([mined, patterns, -none.astype(int)], axis=1)
    label_model = fit_label_model(votes, 0.1, np.where(votes.sum(axis=1) > 0, 0.98, 0.02))
    target = label_model.posterior(votes)
    away, _, _ = excess(row, col, target, np.ones(len(y), bool))
    usual = (np.abs(away) >= USUAL)[col]
    w, b = fit_logistic(row[usual], col[usual], np.ones(usual.sum()), target, SIZE, l2=2e-5, steps=150)
    return Model(w.astype(np.float32), b, label_model, dict(zip(VOTERS, label_model.report(votes), strict=True)))


def _score(model):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches_:
            out = [np.zeros(0)]
            for i, j, data, offs in chunks(batch.column(batch.num_columns - 1)):
                f, d = word_features(data, offs, SIZE, PREFIXES)
                out.append(1 / (1 + np.exp(-np.clip(np.bincount(d, w[f], j - i) + b, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) of every whole text.

    ``docs`` has ``doc_id`` and ``text``; no other column is read, and a column ``score`` of theirs is replaced. Every row is scored
    by itself, so repeated and null ids keep their rows and texts of any length are read to their end; null and empty texts get the
    model's intercept. Labels without a document, null labels and null ids are not learned from; an id labelled twice counts as
    toxic if either says so.
    """
    spark = docs.sparkSession
    batches(spark)
    model = fit(docs, labels)
    told = spark.sparkContext.broadcast((model.weights, model.bias))
    docs = docs.select(*(c for c in docs.columns if c not in ("score", "text")), "text")
    return docs.transform(in_arrow, _score(told), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
