"""Licence texts: every window by brute force, on edited copies."""

import random
import re
from pathlib import Path

from protospark.llm import licences


def brute(words, template, t):
    """The best Dice over all windows of up to ``(2 - t) / t`` times the template's bigrams."""
    grams, own = list(zip(words, words[1:])), list(zip(template, template[1:]))
    target, longest, best = set(own), int(len(own) * (2 - t) / t + 1e-9), 0.0
    for s in range(len(grams)):
        if grams[s] not in target:
            continue
        seen, hits = set(), 0
        for g in grams[s : s + longest]:
            if g not in seen:
                seen.add(g)
                hits += g in target
            best = max(best, 2 * hits / (len(seen) + len(target)))
    return best


def edited(rng, words):
    """A copy with its beginning cut, blocks put in, words dropped and changed."""
    out = words[rng.choice([0, 0, len(words) // 12, len(words) // 7]) :]
    if rng.random() < 0.6:
        at = rng.randrange(len(out))
        out = out[:at] + [f"new{k}" for k in range(rng.choice([3, len(words) // 12, len(words) // 6]))] + out[at:]
    out = [w if rng.random() > 0.02 else f"x{rng.randrange(99)}" for w in out if rng.random() > rng.choice([0, 0.02])]
    return [f"lead{k}" for k in range(rng.choice([0, 40]))] + out + [f"tail{k}" for k in range(rng.choice([0, 40]))]


def test_no_window_is_missed(spark):
    at, rng = Path(licences.__file__).parent / "licence_texts", random.Random(60)
    split = lambda text: [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    texts = [(p.name.rsplit(".", 2)[0], p.read_text()) for p in sorted(at.glob("*.txt")) if p.name in ("MIT.body.txt", "BSD-3-Clause.body.txt", "GPL-3.0.header.txt", "AGPL-3.0.header.txt", "ISC.body.txt", "LGPL-2.1.header.txt")]
    texts.append(("twice", " ".join(["again and again"] * 12)))  # no bigram of it is found once
    docs = [(i, " ".join(edited(rng, split(texts[i % len(texts)][1])))) for i in range(84)]
    docs += [(1000, " ".join(["the license"] * 300)), (1001, None), (1002, "again and again " * 30)]
    want = {(i, k): round(s, 9) for i, d in docs if d for k, v in texts if (s := brute(split(d), split(v), 0.9)) >= 0.9}
    got = licences._scan_texts(spark.createDataFrame(docs, "doc_id long, text string"), texts, 0.9).collect()
    assert {(r.doc_id, r.licence): round(r.score, 9) for r in got} == want and len(want) > 25


def test_templates_of_a_caller(spark):
    """Templates with signs and repeated words, whose distinct bigrams are fewer than their words."""
    docs = spark.createDataFrame([(1, "go go go go go"), (2, "- free -- as - in - beer -\nother"), (3, "go")], "doc_id long, text string")
    got = licences.scan(docs, {"go": "go go go go go go go go", "beer": "-- free as (in) beer --"}, header_lines={}, texts=[])
    assert {(r.doc_id, r.licence, r.score) for r in got.collect()} == {(1, "go", 1.0), (2, "beer", 1.0)}
