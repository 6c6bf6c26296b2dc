"""Training-data operators: brute force, round trips, held-out accuracy, odd inputs."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protospark.llm import bpe, chat, graph, jaccard_join, language, licences, mixing, neighbours, quality, substring_dedup, template, toxicity
from protospark.llm.common import table
from protospark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, score double, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, repeats, a long text, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 700}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (5, "one two"), (6, long), (7, long + " tail"), (8, "a b c d e f g"), (8, "a b c d e f g"), (9, "é <|endoftext|> [INST] 😀")]
    return spark.createDataFrame([(i, t, None if i % 2 else "s", "en" if i % 3 else None, 0.5, "x") for i, t in rows] + [(None, "null id", "s", "en", 1.0, "y")], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.split('.')[0]} as from '{DATA}/{t}'")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    norm = lambda rows, names: sorted((tuple(round(r[names.index(c)], 9) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in cols) for r in rows), key=str)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), list(want.columns))


def test_neighbours_recall(spark):
    e = table(spark, DATA, "embeddings")
    p = e.toPandas()
    x, ids = np.array(p.embedding.tolist(), float), p.vec_id.to_numpy()
    n = np.linalg.norm(x, axis=1)
    got = neighbours.neighbours(e, F.col("vec_id") % 50 == 0).collect()
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i] / n / n[i]
        s[i] = -9
        want |= {(ids[i], ids[j]) for j in np.lexsort((ids, -s))[:5]}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)


@pytest.mark.parametrize("rows, cosine", [(2000, 0.45), (150000, 0.55), (600000, 0.58), (600000, 0.4), (30000000, 0.65)])
def test_neighbours_probes_grow_with_projections(rows, cosine):
    """Pairs at the cosine that k-th neighbours have in a table of so many rows share a bucket, by the operator's own codes."""
    rng, pairs = np.random.default_rng(3), 600
    q, r = rng.normal(size=(2, pairs, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    r -= (r * q).sum(axis=1, keepdims=True) * q
    x = cosine * q + np.sqrt(1 - cosine**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    m, probes = neighbours.plan(rows, [np.sqrt(2 - 2 * cosine)])
    if cosine > 0.5:
        assert rows < 600000 or m >= 8
    index = neighbours._codes(np.floor(neighbours._projected(x, neighbours.TABLES, m, neighbours.WIDTH, 7)), 64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(pairs)), pa.array(q.tolist())], ["cls", "vec"])
    found = set()
    for b in neighbours._probe(neighbours.TABLES, m, neighbours.WIDTH, 7, 1, probes)(iter([batch])):
        for t, i, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
            if int(index[i, t].view(np.int64)) in codes.as_py():
                found.add(i)
    assert len(found) >= 0.95 * pairs


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(3))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert neighbours.neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_scores_ranks_and_ties(spark):
    """Scores, ranks and order of ties as brute force has them, for the neighbours found; large components don't overflow."""
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    p = e.toPandas()
    x, ids = np.array(p.embedding.tolist(), float), p.vec_id.to_numpy()
    n, at = np.linalg.norm(x, axis=1), {int(i): k for k, i in enumerate(ids)}
    got = {}
    for r in QUERIES["op1_neighbours"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i] / n / n[i]
        s[i] = -9
        best = np.lexsort((ids, -s))[:5]
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(m[2] - s[at[m[1]]]) < 1e-12 for m in mine)
        assert all(a[2] >= b[2] - 1e-12 and (a[2] > b[2] or a[1] < b[1]) for a, b in zip(mine, mine[1:]))
        hits, total = hits + len({m[1] for m in mine} & set(ids[best].tolist())), total + 5
    assert hits >= 0.9 * total
    big = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e200, 2e200]), (2, [3.0, 3.0])], "vec_id long, embedding array<double>")
    told = [(r.vec_id, round(r.score, 12)) for r in neighbours.neighbours(big, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert told == [(2, 1.0), (1, round(3 / np.sqrt(10), 12))]


def test_bpe_as_the_library(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    texts = odd.collect()
    got = bpe.encode(odd, bpe.vocabulary_path(), size=50).collect()
    want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in texts)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    back = bpe.decode(bpe.encode(odd, bpe.vocabulary_path(), size=50), bpe.vocabulary_path())
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in texts)
    assert bpe.encode(empty(spark), bpe.vocabulary_path()).count() == 0


def test_transducer_is_minimal_and_exact(tmp_path):
    words = sorted({a + b for a in (b"walk", b"talk", b"x") for b in (b"", b"s", b"ed", b"ing")})
    (tmp_path / "f").write_bytes(bpe.compile_lexicon(words, np.arange(2 * len(words)), np.full(len(words), 2)))
    lex = bpe.Lexicon(str(tmp_path / "f"))

    def rows(ws):
        size = np.array([len(w) for w in ws])
        return lex.rows(np.frombuffer(b"".join(ws), np.uint8), np.cumsum(size) - size, size).tolist()

    assert rows(words) == list(range(len(words)))
    assert rows([b"wal", b"walks!", b"", b"z"]) == [-1] * 4
    assert lex.ids[lex.lengths[3] : lex.lengths[4]].tolist() == [6, 7]
    assert len(lex.final) <= 11  # walk and talk share all suffixes


def test_bpe_digests_as_the_library(spark):
    """What the query returns, over a whole table: counts and both digests."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe"](spark, "/root/testdata/sf0.01").collect()} == want


def test_bpe_words_of_any_length_and_space(tmp_path):
    """Long words by the heap, pieces by spaces of every kind: as the library, in reasonable time."""
    import random
    import time

    from tokenizers import Tokenizer

    tok, vocab = Tokenizer.from_file(bpe.vocabulary_path()), bpe.Vocabulary(bpe.vocabulary_path())
    rng = random.Random(5)
    for n in (1, 2, 9, 30, 48, 49, 200, 3000):
        word = "".join(rng.choice("abcdeiouth") for _ in range(n))
        assert list(vocab.encode_word(word.encode())) == tok.encode(word, add_special_tokens=False).ids
    began = time.time()
    assert len(vocab.encode_word(b"a" * 50_000 + b"the" * 20_000)) > 100 and time.time() - began < 4
    texts = ["".join(rng.choice(["a", "don't", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\uf8ff", "9", "é", "...", "<|endoftext|>", "\r\n", "😀", "nation"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    (tmp_path / "f").write_bytes(bpe.compile_lexicon([b" nation", b"nation"], *vocab.encode_words([b" nation", b"nation"])))
    n, lists = bpe._Codec(vocab, bpe.Lexicon(str(tmp_path / "f"))).lists(texts)
    assert lists.to_pylist() == [tok.encode(t, add_special_tokens=False).ids for t in texts] and n.tolist() == [len(x) for x in lists.to_pylist()]


def test_bpe_twice_on_a_cluster(tmp_path):
    """Two calls in one application, with executors that share only the checkpoint folder."""
    import subprocess
    import sys

    import pyspark

    code = f"""
from pyspark.sql import SparkSession
from protospark.llm import bpe
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = s.createDataFrame([(i, "the cat sat on the mat " * (i + 1)) for i in range(20)], "doc_id long, text string").repartition(4)
one, two = (sorted(map(tuple, bpe.encode(df, bpe.vocabulary_path(), emit="digests").collect())) for _ in range(2))
assert one == two and len(one) == 20
print("same")
"""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for name in os.listdir(os.path.dirname(pyspark.__file__)):
        if name != "work":
            (home / name).symlink_to(os.path.join(os.path.dirname(pyspark.__file__), name))
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_LOCAL_IP": "127.0.0.1"}
    got = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=170)
    assert "same" in got.stdout, got.stderr[-2000:]


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert r.taken <= 2 * r["size"]
        by[r.source_size] = (r.target, by.get(r.source_size, (0, 0))[1] + r.taken)
    assert sum(t for t, _ in by.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(empty(spark)).count() == 0
    carried = mixing.mix(odd, carry=("text", "lang")).collect()
    assert Counter((r.doc_id, r.taken) for r in carried) == Counter((r.doc_id, r.taken) for r in got)


def test_mixing_rows_without_ids(spark):
    """Null and repeated ids draw by their texts too, so they don't share one key, and the target is met."""
    rows = [(None if i % 2 else 7, f"w{i} " * (1 + i % 5), "a" if i % 3 else "b") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 5


def test_jaccard_odd(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (8, 3, 8)} <= got
    assert {r[2] for r in got if r[0] in (6, 7)} == {6}
    assert (None, 1, None) in got
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_jaccard_bands_against_all_pairs(spark, monkeypatch):
    """Every pair of a list that sizes and ranks allow is met, across bands and blocks; copies under one id have a range of sizes."""
    monkeypatch.setattr(jaccard_join, "LIST", 8)
    rng = np.random.default_rng(7)
    posts = []
    for key in range(3):
        for i in range(120):
            n = int(rng.integers(1, 90))
            posts.append((key, int(rng.integers(0, max(1, n // 4 + 1))), 1000 * key + i, n, n if i % 10 else max(1, n - int(rng.integers(0, 9))), i))

    def fit(x, y):
        (_, r, _, n, low, _), (_, r2, _, n2, low2, _) = x, y
        return 4 * n >= 3 * low2 and 4 * n2 >= 3 * low and 7 * (n - r) >= 3 * (low + low2) and 7 * (n2 - r2) >= 3 * (low + low2)

    want = {(x[2], y[2]) for x in posts for y in posts if x[0] == y[0] and x[2] < y[2] and fit(x, y)}
    df = spark.createDataFrame(posts, "key long, rank int, id long, n long, low long, component long")
    got = {(min(r.id, r.o_id), max(r.id, r.o_id)) for r in jaccard_join._banded(df).collect()}
    assert want and want <= got


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(3, 40)))]
        for _ in range(6):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(5)}"
            rows.append((len(rows), " ".join(words)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * len(sets[i] | sets[j]) and n:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == {i: find(i) for i in sets}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)], "a long, b long")
    assert {r.id: r.component for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_toxicity(spark, odd):
    """On rows not learned from."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    assert set(model.voters) == set(toxicity.VOTERS) and model.voters["sure"][1] > 0.9 and 0 < model.voters["insult_en"][0] < 0.3
    got = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").toPandas()
    assert (got.toxic == 1).sum() > 30
    assert got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() > 0.8
    some = toxicity.score(odd, labels.limit(0))
    assert some.count() == odd.count() and some.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score(empty(spark), labels).count() == 0


def test_toxicity_labels_do_not_vote():
    """Turning the labels of texts that no voter marks changes no vote on them."""
    rng = np.random.default_rng(2)
    n, words = 400, 60
    y = (rng.random(n) < 0.2).astype(float)
    feats = [np.unique(np.r_[rng.integers(0, words, 12), 100 + rng.integers(0, 3, 2) if y[i] else []]).astype(np.int64) for i in range(n)]
    row, col = np.repeat(np.arange(n), [len(f) for f in feats]), np.concatenate(feats)
    for i in (np.flatnonzero(y)[0], np.flatnonzero(y == 0)[0]):
        turned = y.copy()
        turned[i] = 1 - y[i]
        assert (toxicity.lexicon_votes(row, col, turned)[i] == toxicity.lexicon_votes(row, col, y)[i]).all()


def test_label_model_ranks_voters():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    votes = np.stack([np.where(rng.random(2000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.95, 0.8, 0.8, 0.5)], 1)
    m = toxicity.fit_label_model(votes, 0.3, (votes.mean(axis=1) + 1) / 2)
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.9
    assert m.rates[1][0, 2] > m.rates[1][1, 2] > m.rates[1][3, 2]


def test_quality_counts(spark, odd):
    def brute(t):
        w, seen, dup = WORD.findall(t or ""), set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)

    docs = table(spark, DATA, "documents").select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id <> 8"))
    labels = table(spark, DATA, "labels")
    got = quality.quality(docs, labels)
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert Counter(tuple(r[:6]) for r in got.collect()) == want
    assert quality.quality(empty(spark), labels).count() == 0


def test_quality_held_out(spark):
    """On rows neither learned from nor used for calibration."""
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    got = QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.1").where(quality.held_out()).where("not base_failed").join(labels, "doc_id").toPandas()
    assert (got.quality == 1).sum() > 200 and (got.quality == 0).sum() > 10
    assert got[got.quality == 1].kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.2
    assert (got.kept == (got.score >= quality.THRESHOLD)).all()


def test_gram_features_against_brute_force():
    """Relative frequencies of word 1- and 2-grams and of 3- and 4-grams of code points, by their multiset per text."""
    texts = ["", "a", "the cat the cat sat", "éà été été 😀😀😀😀", "x\ty  z\n\nx y", "ß" * 40]
    f, d, w = quality.gram_features(*language.raw(pa.array(texts)), 1 << 62)
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        kinds = [words, list(zip(words, words[1:])), [t[k : k + 3] for k in range(len(t) - 2)], [t[k : k + 4] for k in range(len(t) - 3)]]
        want = sorted(c / len(kind) for kind in kinds for c in Counter(kind).values())
        own = d == i
        _, at = np.unique(f[own], return_inverse=True)
        assert np.allclose(sorted(np.bincount(at, w[own]).tolist()) if own.any() else [], want)


def test_language(spark, odd):
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    und = {r.doc_id: r.lang_pred for r in language.language(odd.select("doc_id", "text", "lang", "score")).collect()}
    assert und[1] == und[2] == und[3] == "und"
    assert language.language(empty(spark)).count() == 0


def word_labels(crf, text):
    lines = language.Lines(*language.raw(language.lowered(pa.array([text]))))
    s = lines.scores(crf)
    p, _, _ = language.Chains(lines.line_sizes).marginals(np.exp(s - s.max(axis=1, keepdims=True))[lines.form], crf.move, crf.start)
    return [crf.labels[i] for i in p.argmax(axis=1)]


def test_language_labels_switched_words():
    crf = language.train(["the cat sat there", "the dog and the cat"] * 4 + ["der hund und die katze", "ein hund lief weg"] * 4, ["en"] * 8 + ["de"] * 8)
    assert word_labels(crf, "the cat and der hund lief") == ["en", "en", "en", "de", "de", "de"]


def test_language_of_words_in_held_out_splices(spark):
    """Word accuracy on lines spliced from texts not learned from."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    crf = language.fit(docs)
    assert len(crf.words) and len(crf.labels) == 4
    held = docs.where(language.held_out()).where("lang is not null and length(text) between 100 and 5000").select("text", "lang").toPandas()
    y = np.array([crf.labels.index(g) for g in held.lang])
    lines, gold = language.splices(list(held.text), y, 200, seed=99)
    told = [word_labels(crf, t) for t in lines]
    right = [crf.labels[g] == w for gs, ws in zip(gold, told, strict=True) for g, w in zip(gs, ws, strict=True)]
    assert np.mean(right) > 0.85


def test_language_odd_texts(spark):
    rows = [(1, "the cat sat there and the dog ran", "en")] * 6 + [(i, "der hund und die katze lief", "de") for i in range(2, 12)]
    rows += [(20, "12 34 --", "en"), (21, "😀 ☂", None), (22, "ÉTÉ", None), (None, "der hund", None), (23, "the cat " * 3000, None), (24, None, "fr"), (25, "", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("h", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.language(df).collect()}
    assert got[20] == got[21] == got[24] == got[25] == ("und", 0.0)
    assert got[22][0] in ("en", "de") and got[None][0] == "de" and got[23][0] == "en"


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "[\\INST] \\ [\\\\/INST]", "", None, "a\n <s> b", "[/ROLE]x"]
    rows = [(1, i, role, t) for i, t in enumerate(texts) for role in ("user", "assistant", "system", None)] + [(None, None, "user", "x"), (2, 0, "odd] [/ROLE] r", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert sorted(chat.read_back(got[1].formatted)) == sorted((r or "", t or "") for _, _, r, t in rows[:24])
    assert chat.read_back(got[2].formatted) == [("odd] [/ROLE] r", "y")]
    loss = [chat.unescape(got[1].formatted[s.start : s.end]) for s in got[1].loss_spans]
    assert loss == [t or "" for t in texts]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_template_folds_and_refuses():
    render = template.compile_template("{% if 'a' == 'b' %}no{% else %}{{ 'x' + 'y' }}!{% endif %}{{ n|trim }}")
    assert render({"n": " z "})[0] == "xy!z"
    assert template.fold(template.parse("{% if false %}x{% endif %}a{{ 'b' + 'c' }}")) == (template.Output(template.Const("abc")),)
    for bad in ("{{ a() }}", "{{ a.b.c }}", "{% import x %}", "{% if a %}", "{{ a | nope }}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)
    with pytest.raises(template.TemplateError):
        template.compile_template("{{ missing }}")({})


def test_substring_odd(spark, odd):
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(odd).collect())
    assert got[6, 30000, 29300] == 1 and got[7, 30001, 30000] == 1
    assert got[1, 0, 0] == 1 and got[8, 7, 0] == 2
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_substring_against_brute_force(spark):
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        a, n, k = int(rng.integers(0, 30)), int(rng.integers(15, 40)), int(rng.integers(0, 60))
        own = [f"d{i}w{j}" for j in range(50)]
        rows.append((i, " ".join(own[:k] + passage[a : a + n] + own[k:])))
    rows += [(100, rows[3][1]), (101, " ".join(["r"] * 45))]
    first, want = {}, {}
    for i, t in rows:
        w = t.split()
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, t in rows:
        w = t.split()
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (i, s) for k in range(s, s + 20)}
        want[i] = (len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df).collect()} == want


def test_substring_rows_without_their_own_id(spark):
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    for shared in (None, 5):
        texts = [text("a", 30), text("b", 25), text("c", 40), text("d", 90) + " " + text("a", 30), text("e", 22), text("e", 22), None]
        df = spark.createDataFrame([(1, texts[0])] + [(shared, t) for t in (texts[0], *texts[1:])], "doc_id long, text string")
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df, texts=True).collect())
        want = [(1, 30, 0, texts[0]), (shared, 30, 30, ""), (shared, 25, 0, texts[1]), (shared, 40, 0, texts[2]), (shared, 120, 30, text("d", 90))]
        assert got == Counter([*want, (shared, 22, 0, texts[4]), (shared, 22, 22, ""), (shared, 0, 0, "")])


def test_licences_odd(spark, odd):
    assert licences.scan(odd).count() == 0 and licences.scan(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "x\nReleased under the  MIT license"), (1, "released UNDER the mit-license.")], "doc_id long, text string")
    assert [(r.licence, r.score, r.n_lines) for r in licences.scan(df).collect()] == [("MIT", 1.0, 2)]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = table(spark, DATA, "documents")
    for _, stage in p.STAGES[:-1]:
        out = p.cut(stage(spark, docs, DATA))
        assert out.columns == list(p.COLUMNS)
        docs = out
        if stage is p.drop_near_copies:
            assert jaccard_join.jaccard_components(out).where("component_id <> doc_id").count() == 0
        if stage is p.drop_repeated_passages:
            assert out.where("n_chars <> length(text)").count() == 0
    assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
    got = p.run(spark, DATA)
    assert got.count() == docs.count() and got.where("n_tokens < 0").count() == 0


def test_pipeline_stages_on_odd_documents(spark, odd):
    """Each stage on nulls, empty and long texts, repeated ids, clashing columns, and on nothing."""
    import corpus_pipeline as p

    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    for part in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, part, DATA)
            rows = out.collect()
            if name != "bpe":
                assert out.columns == list(p.COLUMNS)
            if part is docs:
                ids = Counter(r.doc_id for r in rows)
                if name == "near_duplicates":
                    assert ids == Counter([None, 1, 2, 3, 4, 6, 8, 8, 9])
                if name == "substring_dedup":
                    assert ids[7] == 1 and ids[8] == 2 and ids[None] == 1
                if name == "mixing":
                    assert max(ids.values()) <= 4 and ids.keys() <= {None, *range(1, 10)}
                if name == "bpe":
                    assert len(rows) == 11
            else:
                assert rows == []


def test_licence_notices_within_and_across_lines(spark):
    """Wrapped, inside a sentence, and in long lines, against a plain search over all windows of nearby lengths."""
    notice = licences.TEMPLATES["GPL-3.0"]
    words = notice.split()
    filler = " ".join(f"word{i}" for i in range(60))
    texts = {
        1: " ".join(words[:5]) + "\n" + " ".join(words[5:]), 2: f"{filler} {notice} {filler}", 3: f"# {filler}\n * " + "\n * ".join(words) + f"\n{filler}",
        4: f"{filler} released under the MIT\nlicense {filler}", 5: " ".join(words[:7]) + f" {filler}", 6: "released under the mit something license", 7: notice, 8: None, 9: "",
    }
    norm = lambda s: [w for w in re.split("[^a-z0-9]+", s.lower()) if w]
    grams = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:])]
    want = {}
    for i, t in texts.items():
        for k, v in licences.TEMPLATES.items():
            g, tg = grams(norm(t or "")), set(grams(norm(v)))
            best = max((2 * len(set(g[a : a + n]) & tg) / (len(set(g[a : a + n])) + len(tg)) for a in range(len(g)) for n in range(1, 2 * len(tg))), default=0)
            if best >= 0.9:
                want[i, k] = round(best, 9)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("score", F.lit("x"))
    got = licences.scan(df, texts=[]).collect()
    assert {(r.doc_id, r.licence): round(r.score, 9) for r in got} == want and (1, "GPL-3.0") in want and (4, "MIT") in want
    assert {r.doc_id for r in got if r.n_lines} == {7}


def test_licence_headers_and_texts(spark):
    from pathlib import Path

    at, filler = Path(licences.__file__).parent / "licence_texts", " ".join(f"word{i}" for i in range(300))
    rows = [(p.name, f"{filler}\n{p.read_text()}\n{filler}") for p in sorted(at.glob("*.txt"))]
    mit = (at / "MIT.body.txt").read_text()
    rows += [("one line", 'x\n# Licensed under the Apache License, Version 2.0 (the "License");\ny'), ("edited", "\n".join(mit.replace("software", "fine code", 3).split(". "))), ("half", mit[: len(mit) // 2])]
    got = {}
    for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        got.setdefault(r.doc_id, {})[r.licence] = (r.score, r.n_lines)
    for name, _ in rows[:-3]:
        assert got[name][name.rsplit(".", 2)[0]][0] == 1.0, name
    assert got["one line"] == {"Apache-2.0": (1.0, 1)}
    assert set(got["edited"]) == {"MIT"} and 0.9 <= got["edited"]["MIT"][0] < 1 and "half" not in got
