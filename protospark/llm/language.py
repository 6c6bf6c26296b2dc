"""Language ID of code-switched text by a linear-chain conditional random field over words (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from protospark.llm.common import batches, held_out, in_arrow, table
from protospark.llm.features import span_hash, trimmed
from protospark.llm.text import Words, chunks, mix, points, raw

#: Bound of the training sample: documents (divided among the languages, two of each at least), and characters of each. What is labelled has no limit.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 8_000
SIZE = 1 << 17
EPOCHS, RATE, L2 = 30, 0.15, 1e-6
#: A language's lexicon has the words of so many of its sample documents that are in it for such a share of all their documents.
LEXICON_DOCS, LEXICON_SHARE = 3, 0.8
#: Lines that switch languages, made for training: one for so many sample documents, of so many stretches, of so many words each.
SPLICE_EVERY, SPLICES, SPLICE_WORDS = 2, (3, 7), (2, 12)
#: Lines of more words are chains of so many words.
STRETCH = 256
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass
class Crf:
    """Labels, emission weights of the features seen (``index``: a feature's row, 0 without), of transitions and starts, and the lexicons (sorted word hashes, and the label of each)."""

    labels: list[str]
    index: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, np.int32))
    emit: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    word_labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def word_lists(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of each span: the word itself, its first and last 1 to 4 characters (code points), its 3-grams of them, and a bias."""
    point = points(data)
    first, stop = np.searchsorted(point, start), np.searchsorted(point, end)
    f, at, n = [mix(span_hash(data, start, end)), np.zeros(len(start), np.uint64)], [np.arange(len(start))] * 2, stop - first
    for k in (1, 2, 3, 4):
        some = np.flatnonzero(n >= k)
        for kind, a, b in ((8, start[some], point[first[some] + k]), (16, point[stop[some] - k], end[some])):
            f.append(mix(span_hash(data, a, b) + np.uint64(kind + k)))
            at.append(some)
    some = np.flatnonzero(n >= 3)
    if len(some):
        count = n[some] - 2
        begin = np.cumsum(count) - count
        where = np.repeat(first[some], count) + np.arange(int(count.sum())) - np.repeat(begin, count)
        f.append(mix(span_hash(data, point[where], point[where + 3]) + np.uint64(32)))
        at.append(np.repeat(some, count))
    return (np.concatenate(f) % np.uint64(SIZE)).astype(np.int64), np.concatenate(at)


def members(forms: np.ndarray, words: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, form) for each lexicon that a form is in."""
    low, high = np.searchsorted(words, forms, "left"), np.searchsorted(words, forms, "right")
    n = high - low
    at = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return labels[at], np.repeat(np.arange(len(forms)), n)


class Chains:
    """Sequences laid out by step: the lines of a chunk's documents, longest first."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        size = sizes[self.order]
        self.begin = (np.cumsum(sizes) - sizes)[self.order]
        self.steps = int(size[0]) if len(size) else 0
        self.active = np.searchsorted(-size, -np.arange(self.steps), "left")  # sequences longer than t
        self.last = size - 1

    def marginals(self, e: np.ndarray, move: np.ndarray, start: np.ndarray, pairs: bool = False):
        """Forward-backward on exponentiated scores ``e`` (words x labels): marginals, log likelihood's normaliser and expected transitions."""
        m, k = np.exp(move), e.shape[1]
        alpha, scale = np.empty_like(e), np.ones(len(e))
        now = None
        for t in range(self.steps):
            at = self.begin[: self.active[t]] + t
            now = (np.exp(start) if t == 0 else now[: len(at)] @ m) * e[at]
            c = now.sum(axis=1)
            now = now / c[:, None]
            alpha[at], scale[at] = now, c
        beta, expected = np.empty_like(e), np.zeros((k, k))
        nxt = np.zeros((0, k))
        for t in range(self.steps - 1, -1, -1):
            at = self.begin[: self.active[t]] + t
            b = np.ones((len(at), k))
            if len(nxt):
                after = at[: len(nxt)] + 1
                x = nxt * e[after] / scale[after][:, None]
                b[: len(nxt)] = x @ m.T
                if pairs:
                    expected += m * (alpha[at[: len(nxt)]].T @ x)
            beta[at] = b
            nxt = b
        p = alpha * beta
        return p / p.sum(axis=1, keepdims=True), np.log(scale).sum(), expected


class Lines:
    """The words of a chunk of lower-case texts, cut into lines (long ones into stretches), with their distinct forms' features."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.words = w = Words(data, offs)
        start, end = trimmed(w)
        self.hashes, first, self.form = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
        self.forms = len(self.hashes)
        self.feature, self.of = word_lists(data, start[first], end[first])
        breaks = np.r_[0, np.cumsum(data == 10)]
        line = breaks[w.start] if len(w.start) else np.zeros(0, np.int64)
        new = np.r_[True, (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])] if len(line) else np.zeros(0, bool)
        at = np.arange(len(line))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % STRETCH == 0 if len(line) else False
        self.line_sizes = np.diff(np.r_[np.flatnonzero(new), len(line)]) if len(line) else np.zeros(0, np.int64)
        letters = np.r_[0, np.cumsum(_LETTER[data])]
        self.lettered = letters[w.end] > letters[w.start]

    def scores(self, crf: Crf) -> np.ndarray:
        """Emission scores, forms x labels."""
        label, form = members(self.hashes, crf.words, crf.word_labels)
        row, of = np.r_[crf.index[self.feature], crf.index[SIZE + label]], np.r_[self.of, form]
        return np.stack([np.bincount(of, crf.emit[row, k], self.forms) for k in range(crf.emit.shape[1])], 1)


def lexicons(lines: Lines, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, label): the words of each language's lexicon, from documents of one language each (``y``)."""
    both = np.unique(lines.words.doc.astype(np.int64) * lines.forms + lines.form)
    form, label, k = both % max(lines.forms, 1), y[both // max(lines.forms, 1)], int(y.max(initial=-1)) + 1
    seen = np.stack([np.bincount(form, label == j, lines.forms) for j in range(k)], 1)
    form, label = np.nonzero((seen >= LEXICON_DOCS) & (seen >= LEXICON_SHARE * seen.sum(axis=1, keepdims=True)))
    return lines.hashes[form], label


def splices(texts: list[str], y: np.ndarray, n: int, seed: int = 11) -> tuple[list[str], list[np.ndarray]]:
    """``n`` lines of stretches of several texts, and the label of each of their words."""
    rng, words = np.random.default_rng(seed), [_WORD.findall(t) for t in texts]
    some = [i for i, w in enumerate(words) if w]
    lines, labels = [], []
    for _ in range(n if some else 0):
        line, label = [], []
        for _ in range(int(rng.integers(SPLICES[0], SPLICES[1] + 1))):
            i = some[int(rng.integers(len(some)))]
            size = int(rng.integers(SPLICE_WORDS[0], SPLICE_WORDS[1] + 1))
            begin = int(rng.integers(max(1, len(words[i]) - size + 1)))
            line += words[i][begin : begin + size]
            label += [y[i]] * (len(line) - len(label))
        lines.append(" ".join(line))
        labels.append(np.array(label, np.int64))
    return lines, labels


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def train(texts: list[str], langs: list[str]) -> Crf:
    """Maximum likelihood by Adam over the whole sample: each word of a text carries the text's language, those of lines spliced from several texts their own."""
    labels = sorted(set(langs))
    y = np.searchsorted(labels, langs).astype(np.int64)
    k = len(labels)
    own = Lines(*raw(lowered(pa.array(texts, pa.string()))))
    if not k or not len(own.form):
        return Crf(labels)
    words, word_labels = lexicons(own, y)
    more, more_labels = splices(texts, y, len(texts) // SPLICE_EVERY if k > 1 else 0)
    lines = Lines(*raw(lowered(pa.array([*texts, *more], pa.string()))))
    gold = np.concatenate([y[lines.words.doc[lines.words.doc < len(texts)]], *more_labels])
    label, form = members(lines.hashes, words, word_labels)
    feature, of = np.r_[lines.feature, SIZE + label], np.r_[lines.of, form]
    chains = Chains(lines.line_sizes)
    inside = np.ones(len(gold), bool)
    inside[chains.begin] = False
    seen_move = np.zeros((k, k))
    np.add.at(seen_move, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
    seen_start = np.bincount(gold[chains.begin], minlength=k)
    n = len(gold)
    used, col = np.unique(feature, return_inverse=True)
    seen = np.stack([np.bincount(lines.form, gold == j, lines.forms) for j in range(k)], 1)
    theta = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for t in range(1, EPOCHS + 1):
        s = np.stack([np.bincount(of, theta[0][col, j], lines.forms) for j in range(k)], 1)
        e = np.exp(np.clip(s - s.max(axis=1, keepdims=True), -30, 0))[lines.form]
        p, _, moves = chains.marginals(e, theta[1], theta[2], pairs=True)
        rest = np.stack([np.bincount(lines.form, p[:, j], lines.forms) for j in range(k)], 1) - seen
        grads = [
            np.stack([np.bincount(col, rest[of, j], len(used)) for j in range(k)], 1) / n + L2 * theta[0],
            (moves - seen_move) / n + 1e-3 * theta[1],
            (p[chains.begin].sum(axis=0) - seen_start) / n + 1e-3 * theta[2],
        ]
        for x, g, a, b in zip(theta, grads, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    index = np.zeros(SIZE + k, np.int32)
    index[used] = 1 + np.arange(len(used))
    order = np.argsort(words, kind="stable")
    return Crf(labels, index, np.r_[np.zeros((1, k)), theta[0]].astype(np.float32), theta[1], theta[2], words[order], word_labels[order])


def fit(docs: DataFrame) -> Crf:
    """A CRF of about ``SAMPLE_ROWS`` documents outside the held-out fold: per language those with the smallest hashes of id and text.

    Every language of a row that has text is learned; the model holds weights for each, so their number is taken to be moderate
    (hundreds). Of a text longer than ``SAMPLE_CHARS``, so many characters from a place set by the hash are learned from.
    The table is read twice: once to count the languages, once for the sample, thinned by hash to about twice its size where it is read.
    """
    known = docs.where(~held_out()).where("lang is not null and doc_id is not null and text is not null and text <> ''")
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return train([], [])
    quota = max(2, SAMPLE_ROWS // len(counts))
    share = docs.sparkSession.createDataFrame([(r[0], min(1.0, (2 * quota + 20) / r[1])) for r in counts], "lang string, share double")
    some = known.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text"))).where(F.col("r") <= quota)
    begin = F.lit(1) + F.pmod(F.shiftright("h", 31), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    rows = ranked.select("lang", "r", F.substring("text", begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).orderBy("lang", "r").collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def _label(model):
    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        labels = crf.labels
        names = np.array([*labels, "und"], dtype=object)
        for batch in batches_:
            best, top, spans = [np.zeros(0, np.int64)], [np.zeros(0)], []
            texts = batch.column(1)
            for i, j, data, offs in chunks(lowered(texts), 4 << 20):
                lines = Lines(data, offs)
                w = lines.words
                if not len(w.start) or not crf.emit.shape[1]:
                    best.append(np.full(j - i, -1))
                    top.append(np.zeros(j - i))
                    spans += [0] * (j - i)
                    continue
                s = lines.scores(crf)
                e = np.exp(np.clip(s - s.max(axis=1, keepdims=True), -30, 0))[lines.form]
                p, _, _ = Chains(lines.line_sizes).marginals(e, crf.move, crf.start)
                word = p.argmax(axis=1)
                p = p * lines.lettered[:, None]
                total = np.stack([np.bincount(w.doc, p[:, c], j - i) for c in range(len(labels))], 1)
                some = total.sum(axis=1) > 0
                # bytes over 127 may be signs: such texts are looked at again
                data_letters = np.diff(np.r_[0, np.cumsum((data >= 97) & (data <= 122))][offs])
                for r in np.flatnonzero(some & (data_letters == 0)).tolist():
                    some[r] = any(ch.isalpha() for ch in texts[i + r].as_py())
                best.append(np.where(some, total.argmax(axis=1), -1))
                top.append(np.where(some, total.max(axis=1) / np.maximum(total.sum(axis=1), 1e-12), 0.0))
                switch = (word[1:] != word[:-1]) & (w.doc[1:] == w.doc[:-1])
                spans += (np.bincount(w.doc[1:][switch], minlength=j - i) + (w.count > 0)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.clip(np.concatenate(top), 0, 1)), pa.array(spans, pa.int64())], ["doc_id", "lang_pred", "score", "n_spans"])

    return run


def language(docs: DataFrame) -> DataFrame:
    """``doc_id, lang_pred, score, n_spans``: the language most of a text's words are in by their marginals, its share, and the runs of words of one language.

    ``docs`` has ``doc_id``, ``text`` and ``lang`` (read for learning only). ``und`` with score 0 for texts that are null or have
    no letter, and for all if there is nothing to learn from. Lines are the chains (of ``STRETCH`` words at most); words without
    letters don't count. Every row is labelled by itself, rows with null or repeated ids too; other columns are ignored.
    """
    spark = docs.sparkSession
    batches(spark)
    model = spark.sparkContext.broadcast(fit(docs))
    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, _label(model), "doc_id long, lang_pred string, score double, n_spans long")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")
