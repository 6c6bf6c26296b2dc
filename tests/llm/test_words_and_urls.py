"""Periodic runs, spelling variants and URL filters: brute force, odd inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from protospark.llm import runs, spelling, urls

DOCS = "doc_id long, text string, word string, n string"


def rows_of(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], DOCS)


def brute_runs(words, exponent=4, least=6):
    out = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((a, n, q) for (a, n), q in out.items())


def repetitive(rng, size):
    words = []
    while len(words) < size:
        words += [rng.randrange(rng.choice([2, 3, 4])) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
    return words[:size]


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 1), (5, 30)])
def test_runs_don_t_depend_on_stretches(exponent, least):
    rng = random.Random(exponent)
    for _ in range(120):
        words = repetitive(rng, rng.choice([5, 40, 130]))
        want = brute_runs(words, exponent, least)
        for step in (1, 7, 1000):
            catcher = runs.SquareCatcher(exponent, least)
            for a in range(0, len(words), step):
                catcher.append(np.array(words[a : a + step], np.uint64))
            assert catcher.finish() == want, (words, step)


def test_long_periods_and_one_word(monkeypatch):
    for words in (np.ones(50000), np.tile(np.arange(5000), 5)[:24000], np.r_[np.arange(900), np.tile(np.arange(7), 900), np.arange(900)]):
        catcher = runs.SquareCatcher()
        for a in range(0, len(words), 9999):
            catcher.append(words[a : a + 9999].astype(np.uint64))
        got = catcher.finish()
        assert len(got) == 1 and got[0][1] >= 6300


def test_runs_of_documents(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(f"w{x}" for x in repetitive(rng, 90))) for i in range(40)]
    texts += [(50, None), (51, ""), (52, " \n\t"), (53, "a " * 9), (53, "a a a a a a"), (None, "b\nb\tb b b b c"), (None, None), (54, "é é é é é É"), (55, "x"), (56, " ".join(["the end"] * 20000))]
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(rows_of(spark, texts)).collect())
    want = Counter()
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute_runs(words) if i != 56 else [(0, 40000, 2)]
        gone = {x for a, n, q in found for x in range(a + q, a + n)}
        want[i, len(words), tuple(found), " ".join(w for x, w in enumerate(words) if x not in gone)] += 1
    assert got == want
    assert runs.periodic_runs(rows_of(spark, [])).count() == 0
    told = {r.doc_id: r for r in runs.run_digests(runs.periodic_runs(rows_of(spark, [(1, "a a a a a a a b c b c b c b c b c b c"), (2, "one")]))).collect()}
    assert (told[1].start, told[1].length, told[1].period, told[1].exponent_milli, told[1].n_runs) == (0, 7, 1, 7000, 2)
    assert (told[2].start, told[2].length, told[2].period, told[2].exponent_milli, told[2].n_runs) == (None, None, None, None, 0)


def test_planted_repeats(spark):
    texts = [(i, " ".join(f"w{k}" for k in range(i % 60))) for i in range(200)] + [(None, "a b"), (707, None)]
    for r in runs.plant_repeats(rows_of(spark, texts)).collect():
        before = dict(texts)[r.doc_id]
        h = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
        words = (before or "").split()
        if h % 10 or not words:
            assert r.text == before
        else:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.text.split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_variants(counts):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        out[w] = [best if best and counts[best] >= 5 * n else None, n, len(found)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


@pytest.mark.parametrize("tile", [1 << 10, 8, 3])
def test_variants_against_brute_force(spark, monkeypatch, tile):
    """Small tiles deal every group; anagrams, long words, accents, words of one letter repeated, chains of forms."""
    rng = random.Random(tile)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(250)} | {"a" * k for k in range(4, 14)} | {"ß" * 300, "ß" * 301, "x" * 70 + "y", "y" + "x" * 70, "stride", "strides", "tsride", ""}
    for w in sorted(words)[:60]:
        i = rng.randrange(len(w) + 1)
        words |= {w[:i] + "z" + w[i:], w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :]}
    counts = {w: rng.choice([1, 5, 30, 200, 1000, 5000]) for w in words}
    monkeypatch.setattr(spelling, "TILE", tile)
    df = spark.createDataFrame(list(counts.items()) + [(None, 3)], "word string, n long").withColumn("key", F.lit(1))
    got = {r.word: [r.form, r.n, r.n_near, r.root] for r in spelling.spelling_variants(df).collect()}
    assert got == brute_variants(counts)
    forms = [r.form_n == counts[r.form] if r.form else r.form_n is None for r in spelling.spelling_variants(df).collect()]
    assert all(forms)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece, held", [(1 << 20, 1 << 18), (50, 20)])
def test_words_are_counted(spark, piece, held):
    rng = random.Random(piece)
    letters = "abcDÉéÿz×"
    texts = [(i, "".join(rng.choice(letters + " .\n1ē") if rng.random() < 0.2 else rng.choice(letters[:4]) for _ in range(rng.choice([0, 30, 400])))) for i in range(60)]
    texts += [(None, "nothing NOTHING"), (3, None), (3, "abcdef " * 30), (4, "k" * 90 + " " + "k" * 90)]
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 7 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            want[word] += 1
    want = {w: n for w, n in want.items() if n >= 2 and len(w) >= 6}
    old = spelling.PIECE, spelling.HELD
    spelling.PIECE, spelling.HELD = piece, held
    try:  # in this process, as the limits are read by it
        batches = rows_of(spark, texts).select("doc_id", "text").toArrow().to_batches(max_chunksize=9)
        got = Counter()
        for b in spelling._counted(6, 7)(iter(batches)):
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[w] += n
        assert {w: n for w, n in got.items() if n >= 2} == want
    finally:
        spelling.PIECE, spelling.HELD = old
    assert {r.word: r.n for r in spelling.count_words(rows_of(spark, texts), occurrences=2, modulus=7).collect()} == want
    assert spelling.count_words(rows_of(spark, [])).count() == 0


def brute_flow(edges, seeds, rounds):
    both = defaultdict(Counter)
    for (a, b), w in edges.items():
        both[False, a][b] += w
        both[True, b][a] += w
    nodes = {n for e in edges for n in e} | set(seeds)
    for back in (False, True):
        for n in nodes:
            if not both[back, n]:
                both[back, n][n] = 1
    total = [sum(s[k] for s in seeds.values()) for k in (0, 1)]
    start = Counter({(back, n): urls.WHOLE // total[back] * s[back] for n, s in seeds.items() for back in (0, 1) if total[back] and s[back]})
    now = start
    for _ in range(rounds):
        new = Counter({k: v // 100 * (100 - urls.DAMPING) for k, v in start.items()})
        for (back, n), have in now.items():
            out = sum(both[bool(back), n].values())
            for m, w in both[bool(back), n].items():
                new[back, m] += have // 100 * urls.DAMPING // out * w
        now = new
    return {n: (now[False, n], now[True, n]) for n in nodes if now[False, n] or now[True, n]}


@pytest.mark.parametrize("edges", [1 << 16, 2])
def test_trust_against_brute_force(spark, monkeypatch, edges):
    monkeypatch.setattr(urls, "EDGES", edges)
    rng = random.Random(edges)
    links = {(f"h{rng.randrange(12)}", f"h{rng.randrange(15)}"): rng.randint(1, 4) for _ in range(40)} | {("h0", f"h{k}"): 1 for k in range(12)}
    seeds = {f"h{k}": (rng.choice([0, 3]), rng.choice([0, 0, 2])) for k in range(12)}
    got = urls.propagate(spark.createDataFrame([(*k, w) for k, w in links.items()], "src string, dst string, weight long"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, allowed long, blocked long"), 7)
    assert {r.host: (r.trust, r.distrust) for r in got.collect()} == brute_flow(links, seeds, 7)


def test_pages_are_judged(spark):
    link = lambda *hosts: "".join(f'<a HREF = "https://{h}/x">t</a>' for h in hosts) + '<a href="/local">l</a>'
    pages = [(1, "http://bad.net/", link("worse.com")), (2, "http://Bad.NET", ""), (3, "https://a.example.net/en/1?x#y", ""), (4, "http://example.com/de/", None), (5, "http://notexample.com/de/", ""), (6, "x://o.org/fr/a://b", ""),
             (7, None, "<p>"), (8, "no scheme", ""), (9, "://", None), (10, "http://w.org/en?u=/fr/", link("good.org")), (11, "http://good.org/fr/1", link("helped.com"))]
    pages += [(20 + k, "http://helped.com/p", link("helped.com", "helped.com")) for k in range(3)] + [(30 + k, "http://farm.com/p", link("bad.net", "spam.net")) for k in range(3)] + [(40, "http://spam.net/q", ""), (40, "http://spam.net/q", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = Counter(tuple(r) for r in urls.judge(df).collect())
    told = {r[0]: r[1:] for r in got}
    assert sum(got.values()) == len(pages) and got[40, "spam.net", "/q", "net/", "block"] == 2
    assert told[1] == ("bad.net", "/", "net/", "block") and told[2][:3] == ("bad.net", "", None)
    assert told[3] == ("a.example.net", "/en/1", "example.net/en/", "allow") and told[4] == ("example.com", "/de/", "example.com/de/", "block")
    assert told[5][:3] == ("notexample.com", "/de/", None) and told[6] == ("o.org", "/fr/a://b", "org/fr/", "allow")
    assert told[7] == told[8] == told[9] == ("", "", None, "allow")
    assert told[30] == ("farm.com", "/p", None, "block") and told[20] == ("helped.com", "/p", None, "allow")
    assert urls.judge(df.limit(0)).count() == 0
    monkey = urls.BROADCAST_HOSTS
    urls.BROADCAST_HOSTS = 0
    try:
        assert Counter(tuple(r) for r in urls.judge(df).collect()) == got
    finally:
        urls.BROADCAST_HOSTS = monkey


def test_recurring_postings_are_spread(spark):
    """Postings whose key recurs within a task's run go to many buckets, not to that of the smallest key; keys that agree in 64 bits only are told apart."""
    from protospark.llm import shared

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64) * np.uint64(2)

    def keys_of(batch):
        n = batch.num_rows
        return keys[np.arange(n) % 300], np.arange(n), np.zeros(n, np.int64)

    sizes = []
    old = shared.in_arrow
    shared.in_arrow = lambda df, f, schema: sizes.append((f, schema)) or old(df, f, schema)
    try:
        rows = spark.range(4000).select("id")
        got = shared.occurrences(rows.repartition(2), ["id"], keys_of, 6)
        assert got.count() == 4000
        packed = Counter()
        for b in sizes[0][0](iter(rows.toArrow().to_batches())):
            for kind, bucket in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packed[kind, bucket] += 1
        assert len([b for k, b in packed if k == 1]) == 64 and max(n for (k, _), n in packed.items() if k) == 1
    finally:
        shared.in_arrow = old

    def wide(batch):
        n = batch.num_rows
        return np.full(n, 7, np.uint64), np.arange(n), np.zeros(n, np.int64), (batch.column(0).to_numpy() // 2).astype(np.uint32)

    told = shared.occurrences(spark.range(5).select("id").coalesce(1), ["id"], wide, 6, later=True, wide=True).collect()
    assert sorted(r.id for r in told) == [1, 3]
