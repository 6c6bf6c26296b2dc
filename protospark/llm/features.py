"""Hashed features of Arrow text batches, and logistic regression on a bounded sample of them."""

from __future__ import annotations

import numpy as np

from protospark.llm.text import LOWER, Words, mix, per_document, point_hashes, points, powers, rolling
from protospark.llm.text import _BYTE

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[48:58] = _WORDLIKE[65:91] = _WORDLIKE[97:123] = _WORDLIKE[128:] = True


def trimmed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without ASCII punctuation at either end (all of it may go)."""
    ok = np.flatnonzero(_WORDLIKE[w.data])
    if not len(ok):
        return w.start, w.start
    a = np.searchsorted(ok, w.start)
    b = np.searchsorted(ok, w.end) - 1
    start = np.where(a <= b, ok[np.minimum(a, len(ok) - 1)], w.start)
    return start, np.where(a <= b, ok[np.maximum(b, 0)] + 1, w.start)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for each span; empty spans give 0."""
    size = end - start
    out = np.zeros(len(start), np.uint64)
    some = np.flatnonzero(size > 0)
    if len(some):
        n = size[some]
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(begin, n)
        h = np.add.reduceat(_BYTE[0][data[np.repeat(start[some], n) + at]] * powers(int(n.max()))[at], begin)
        out[some] = mix(h + n.astype(np.uint64))
    return out


def word_features(data: np.ndarray, offs: np.ndarray, size: int, prefixes: tuple[int, ...] = (4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature below ``size``, document): lower-cased words without outer punctuation, and their first bytes."""
    data = LOWER[data]
    w = Words(data, offs)
    start, end = trimmed(w)
    full = end > start
    whole = span_hash(data, start, end)[full]
    h, doc = [whole], [w.doc[full]]
    for k in prefixes:
        long = np.flatnonzero(end - start > k)
        h.append(mix(span_hash(data, start[long], start[long] + k) + np.uint64(k)))
        doc.append(w.doc[long])
    f, d = per_document(np.concatenate(h) % np.uint64(size), np.concatenate(doc))
    return f.astype(np.int64), d


def gram_features(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, document, weight): word 1- and 2-grams and character 3- and 4-grams (of code points), each kind as relative frequency."""
    w = Words(data, offs)
    h = w.hashes()
    n_docs = len(offs) - 1
    at = points(data)
    chars, char_doc = point_hashes(data, at), np.repeat(np.arange(n_docs), np.diff(np.searchsorted(at, offs)))
    out_f, out_d, out_w = [], [], []
    for k, base, doc in ((1, h, w.doc), (2, h, w.doc), (3, chars, char_doc), (4, chars, char_doc)):
        g = rolling(base, k) + np.uint64(k)
        same = doc[: len(g)] == doc[k - 1 : k - 1 + len(g)]
        d = doc[: len(g)][same]
        count = np.bincount(d, minlength=n_docs)
        out_f.append((mix(g[same]) % np.uint64(size)).astype(np.int64))
        out_d.append(d)
        out_w.append((1.0 / np.maximum(count, 1))[d])
    return np.concatenate(out_f), np.concatenate(out_d), np.concatenate(out_w)


#: Entries of a sample that are widened to doubles at once.
BLOCK = 1 << 20


def sparse_scores(row: np.ndarray, col: np.ndarray, val: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The sum of ``val * w[col]`` of each of ``n`` rows, taken block by block."""
    z = np.zeros(n)
    for a in range(0, len(row), BLOCK):
        s = slice(a, a + BLOCK)
        z += np.bincount(row[s], val[s] * w[col[s]], n)
    return z


def fit_logistic(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, size: int, l2: float, steps: int = 200, rate: float = 0.1, weight: np.ndarray | None = None):
    """Weights and intercept for targets ``y`` in [0, 1], by Adam on the whole (bounded) sample; the same input gives the same model."""
    w, b = np.zeros(size), 0.0
    weight = np.ones(len(y)) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    share = min(max((y * weight).sum() / total, 1e-3), 1 - 1e-3)
    b = float(np.log(share / (1 - share)))
    used = np.unique(col)
    index = np.zeros(size, np.int32)
    index[used] = np.arange(len(used))
    col = index[col]
    v = np.zeros(len(used))
    m1, m2, c1, c2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = sparse_scores(row, col, val, v, len(y)) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / total
        g = sparse_scores(col, row, val, r, len(used)) + l2 * v
        gb = r.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        k1, k2 = 1 - 0.9**t, 1 - 0.999**t
        v -= rate * (m1 / k1) / (np.sqrt(m2 / k2) + 1e-9)
        b -= rate * (c1 / k1) / (np.sqrt(c2 / k2) + 1e-9)
    w[used] = v
    return w, b


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """``a, b`` such that sigmoid(a z + b) is calibrated on the targets ``y`` (Newton steps, smoothed targets)."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = p * (1 - p) + 1e-6
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)
