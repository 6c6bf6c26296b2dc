"""Chat formatting with compiled templates and reversible escapes (operator 8)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.llm.common import batches, table
from protospark.llm.template import compile_template

#: Strings that mark turns; they have no space inside, and the template sets spaces between them and texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text }} [/INST]"
    "{% elif m.role == 'assistant' %}<s> {% generation %}{{ m.text }}{% endgeneration %} </s>"
    "{% else %}[ROLE] {{ m.role }} [/ROLE] {{ m.text }} </s>{% endif %}"
    "\n{% endfor %}"
)
_LIKE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]\n|<s> (?P<assistant>.*?) </s>\n|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) </s>\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash more after the first character of each control string, or of one escaped already."""
    return _LIKE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; an error if anything is left over."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn: {formatted[at:at + 60]!r}")
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    return out


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, formatted, loss_spans``: each conversation rendered, and the code point spans that a loss counts.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``. Turns go by ``turn`` (nulls first), ties by role and text;
    repeated rows are turns of their own. Null roles and texts are empty; null ids are one conversation. Other columns are ignored.
    A conversation is one output row, so it has to fit into a task.
    """
    batches(rows.sparkSession)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    convs = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: F.struct(m.role.alias("role"), m.text.alias("text"))).alias("messages"))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, escape)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches_:
            done = [render({"messages": m}) for m in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, span)], ["conv_id", "formatted", "loss_spans"])

    return convs.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back: turns, and the text under the loss mask."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            out = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)))


OP8_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(t, '(<)(\\*(?:s>|/s>))|(\[)(\\*(?:INST\]|/INST\]|ROLE\]|/ROLE\]))', '\1\3\\\2\4', 'g') x from c)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (r = 'assistant'), '')) loss_sha256,
  sum(length(x) + case r when 'user' then 16 when 'assistant' then 10 else length(r) + 22 end)::bigint formatted_chars
from e group by conv_id
"""
