"""License scans by Dice coefficient over word bigrams (operator 6); DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter
from math import ceil, floor
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protospark.llm.common import table

#: Licence notices (fixed values): what a line is compared with.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: First lines of standard file headers, compared with lines like the notices.
HEADER_LINES = {"Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");'}
#: Standard file headers and whole licence texts, compared with windows of whole documents: (licence, text).
TEXTS = [(p.name.rsplit(".", 2)[0], p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
THRESHOLD = 0.9


def words_of(text: Column) -> Column:
    """Normalised words: ASCII letters lower-cased, runs of anything but letters and digits between them."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pair = lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1))
    return F.when(F.size(words) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), pair))).otherwise(F.array().cast("array<string>"))


def _template(licence: str, text: str, t: float) -> tuple:
    """Row of a text: its distinct bigrams, how many of them a window has to hold, the longest window; and words of which any such document has one.

    Dice >= t needs ``a * t / (2 - t)`` of the text's a bigrams, so a document can't lack all words that touch more than the rest.
    """
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    grams = [f"{x} {y}" for x, y in zip(words, words[1:])]
    seen = list(dict.fromkeys(grams))
    need = ceil(len(seen) * t / (2 - t) - 1e-9)
    touch, must = Counter(w for g in seen for w in set(g.split(" "))), []
    for w in sorted(touch, key=lambda w: (len(w) < 6, -touch[w], w)):
        if sum(any(x in must for x in g.split(" ")) for g in seen) > len(seen) - need:
            break
        must.append(w)
    return licence, seen, need, floor(len(grams) * (2 - t) / t + 1e-9), must


def _scan_texts(docs: DataFrame, texts: list[tuple[str, str]], t: float) -> DataFrame:
    """``doc_id, licence, score`` per row and text: the best Dice of the text with windows of the document, if >= ``t``.

    A window is any stretch of neighbouring bigrams of the document, up to ``(2 - t) / t`` times as long as the text; all of them count. One that reaches ``t``
    holds ``need`` of the text's bigrams, and the best begins at one of them, so only bigrams of the text that ``need - 1`` more follow within a window's length
    are starts. From a start on, a running count of distinct bigrams (those whose last place is before the start) gives the Dice of every end.
    """
    rows = [_template(licence, text, t) for licence, text in texts]
    known = docs.sparkSession.createDataFrame(rows, "licence string, t_grams array<string>, need int, longest int, must array<string>")
    musts = sorted({w for r in rows for w in r[-1]})
    once = lambda c: F.explode(F.array(c))  # noqa: E731 - evaluates an expression once
    some = docs.where(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(musts)})(?![a-z0-9])"))
    words = some.select("doc_id", once(words_of(F.col("text"))).alias("words")).where(F.size("words") > 1)
    pair = lambda i: F.concat(F.element_at("words", i), F.lit(" "), F.element_at("words", i + 1))
    words = words.withColumn("some", once(F.array_intersect(F.array(*map(F.lit, musts)), "words")))
    grams = words.select("doc_id", "some", once(F.transform(F.sequence(F.lit(1), F.size("words") - 1), pair)).alias("grams"))
    both = grams.join(F.broadcast(known), F.arrays_overlap("some", "must") & (F.size("grams") >= F.col("need"))).where(F.size(F.array_intersect("grams", "t_grams")) >= F.col("need"))
    both = both.withColumn("own", once(F.transform("grams", lambda g: F.array_contains("t_grams", g))))
    both = both.withColumn("at", once(F.filter(F.sequence(F.lit(1), F.size("grams")), lambda p: F.element_at("own", p))))
    last = lambda i: F.element_at("at", i + F.col("need") - 1)
    from_ = F.filter(F.sequence(F.lit(1), F.greatest(F.size("at") - F.col("need") + 1, F.lit(1))), lambda i: F.when(i + F.col("need") - 1 <= F.size("at"), last(i) - F.element_at("at", i) < F.col("longest")).otherwise(F.lit(False)))
    both = both.withColumn("starts", once(F.transform(from_, lambda i: F.element_at("at", i)))).where(F.size("starts") > 0)
    # each place: is the bigram the text's, and how far back is it last found (0: not within a window's length)
    low = lambda p: F.greatest(p - F.col("longest"), F.lit(1))
    back = lambda p: F.array_position(F.reverse(F.slice("grams", low(p), p - low(p))), F.element_at("grams", p)).cast("int")
    places = F.transform(F.sequence(F.lit(1), F.size("grams")), lambda p: F.struct(p.alias("p"), F.element_at("own", p).alias("own"), back(p).alias("back")))
    both = both.withColumn("places", once(places))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("h"), F.lit(0.0).cast("double").alias("best"))

    def best(s):
        def step(a, x):
            new = (x["back"] == 0) | (x["p"] - x["back"] < s)
            d, h = a["d"] + new.cast("int"), a["h"] + (new & x["own"]).cast("int")
            return F.struct(d.alias("d"), h.alias("h"), F.greatest(a["best"], 2.0 * h / (d + F.size("t_grams"))).alias("best"))

        return F.aggregate(F.slice("places", s, F.col("longest")), start, step, lambda a: a["best"])

    return both.select("doc_id", "licence", once(F.array_max(F.transform("starts", best))).alias("score")).where(F.col("score") >= t)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, header_lines: dict[str, str] = HEADER_LINES, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """``doc_id, licence, score, n_lines``: licences whose notice a line, or whose notice, header or text a part of the text resembles (Dice >= ``threshold``).

    ``score`` is the best one; ``n_lines`` counts lines, and each of ``texts`` found in a row as one more. A notice that only a part
    of a line or of several lines resembles (within a sentence, or wrapped) is found with 0 lines.

    A line of b bigrams can reach the threshold only with a template of a bigrams where ``b`` is within ``a * t / (2 - t)`` and
    ``a * (2 - t) / t``: the templates, listed under each such b, are joined by equality and broadcast (a constant number of rows).
    Of parts of texts, rows that hold enough of the bigrams are compared by all windows of lengths within the same bounds. Null and empty texts, and lines of fewer than two words, match nothing. Repeated ids are one
    document; a null id is one too.
    """
    spark = docs.sparkSession
    lines_of = [(k, v, "") for k, v in sorted(templates.items())] + [(k, v, templates.get(k, "")) for k, v in sorted(header_lines.items())]
    notice = spark.createDataFrame(lines_of, "licence string, notice string, other string")
    notice = notice.select("licence", bigrams_of(words_of(F.col("notice"))).alias("t_grams"), bigrams_of(words_of(F.col("other"))).alias("o_grams"))
    t = threshold
    notice = notice.withColumn("n", F.explode(F.sequence(F.ceil(F.size("t_grams") * t / (2 - t) - 1e-9).cast("int"), F.floor(F.size("t_grams") * (2 - t) / t + 1e-9).cast("int"))))
    sizes = [len({*zip(w, w[1:])}) for _, v, _ in lines_of if (w := [x for x in re.split("[^a-z0-9]+", v.lower()) if x])]
    shortest = min((ceil(n * t / (2 - t) - 1e-9) for n in sizes if n), default=1)
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 2 * shortest)
    lines = lines.select("doc_id", words_of(F.col("line")).alias("words")).where(F.size("words") > shortest // 2)
    grams = lines.select("doc_id", bigrams_of(F.col("words")).alias("grams")).withColumn("n", F.size("grams"))
    both = grams.join(F.broadcast(notice), "n")
    dice = lambda c: 2.0 * F.size(F.array_intersect("grams", c)) / (F.col("n") + F.size(c))
    hits = both.withColumn("score", dice("t_grams")).where(F.col("score") >= t).where(dice("o_grams") < t)  # the notice has counted such a line
    hits = hits.select("doc_id", "licence", "score", F.lit(1).alias("lines"))
    docs = docs.select("doc_id", "text")
    hits = hits.union(_scan_texts(docs, sorted(templates.items()), t).withColumn("lines", F.lit(0)))
    hits = hits.union(_scan_texts(docs, texts, t).withColumn("lines", F.lit(1))) if texts else hits
    return hits.groupBy("doc_id", "licence").agg(F.max("score").alias("score"), F.sum("lines").alias("n_lines"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_ROWS = [_template(k, v, THRESHOLD) for k, v in sorted(TEMPLATES.items())]
_VALUES = ", ".join(f"('{k}', {_sql_list(g)}, {need}, {longest})" for k, g, need, longest, _ in _ROWS)
_GRAMS = "case when len({0}) > 1 then list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]) else []::varchar[] end"
_WORDS = "list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"
#: The notices, in lines and in windows; headers and whole texts are left to tests.
OP6_SQL = rf"""
with t as (select * from (values {_VALUES}) v(licence, tg, need, longest)),
l as (select doc_id, unnest(string_split(text, chr(10))) line from documents),
lw as (select doc_id, {_WORDS.format('line')} w from l),
lg as (select doc_id, list_distinct({_GRAMS.format('w')}) g from lw where len(w) > 1),
s as (select doc_id, licence, 2.0::double * len(list_intersect(g, tg)) / (len(g) + len(tg)) score, 1 n
  from lg join t on len(g) between ceil(len(tg) * 0.9 / 1.1 - 1e-9) and floor(len(tg) * 1.1 / 0.9 + 1e-9) where list_has_any(g, tg)),
dw as (select doc_id, row_number() over () k, {_WORDS.format('text')} w from documents where text is not null),
dg as (select doc_id, k, {_GRAMS.format('w')} g from dw),
m as (select doc_id, licence, g, tg, need, longest from dg join t on list_has_any(g, tg) where len(list_intersect(list_distinct(g), tg)) >= need),
b as (select *, unnest(range(1, len(g) - need + 2)) b from m),
w as (select doc_id, licence, tg, list_distinct(g[b:b + n - 1]) g from (select *, unnest(range(need, longest + 1)) n from b) z),
x as (select doc_id, licence, 2.0::double * len(list_intersect(g, tg)) / (len(g) + len(tg)) score, 0 n from w),
u as (select * from s union all select * from x)
select doc_id, licence, max(score) score, sum(n)::bigint n_lines from u where score >= 0.9 group by 1, 2
"""
