"""SAM lines parsed by column: numpy over the bytes of Arrow batches; no loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What a line gives: ids, flag, 0-based start, sums of the CIGAR's numbers by operation, and the NM tag (0 if absent).
COLUMNS = "spacer_id string, contig_id string, flag int, start long, aligned long, span long, total long, clip long, nm long"
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_OPERATION = np.zeros(256, bool)
_OPERATION[[*range(65, 91), ord("=")]] = True
_KINDS = {"aligned": b"M=X", "span": b"MDN=X", "clip": b"S"}


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in decimal digits between ``start`` and ``end``, and which of them are such (of 1 to 18 digits)."""
    size = end - start
    fine = (size > 0) & (size < 19)
    value = np.zeros(len(start), np.int64)
    for j in range(int(size[fine].max(initial=0))):
        on = np.flatnonzero(fine & (size > j))
        byte = data[start[on] + j]
        fine[on[~_DIGIT[byte]]] = False
        value[on] = value[on] * 10 + (byte - np.uint8(48)).astype(np.int64)
    return value, fine


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offs = np.r_[0, np.cumsum(size)]
    at = np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data[at].tobytes())]).cast(pa.string())


def parse(lines: pa.Array) -> pa.RecordBatch:
    """``COLUMNS`` of the lines that are records: not headers, eleven fields or more, a flag and a position that are numbers, and mapped (flag & 4 = 0).

    A CIGAR operation without a number counts 1 after another operation, and nothing at the beginning. The first NM tag of the optional fields counts, in either case.
    """
    lines = lines.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2], np.uint8)[: offs[-1]] if lines.buffers()[2] and len(lines) else np.zeros(0, np.uint8)
    tabs = np.flatnonzero(data[offs[0] :] == 9) + offs[0] if len(offs) else np.zeros(0, np.int64)
    first = np.searchsorted(tabs, offs)
    head, stop, count = first[:-1], offs[1:], np.diff(first)
    ok = count >= 10
    ok[ok] = data[offs[:-1][ok]] != ord("@")
    row = np.flatnonzero(ok)
    field = lambda k: (tabs[head[row] + k - 1] + 1 if k else offs[:-1][row], tabs[head[row] + k])
    flag, fine = _numbers(data, *field(1))
    place, also = _numbers(data, *field(3))
    keep = fine & also & (flag & 4 == 0)
    row, flag, place = row[keep], flag[keep], place[keep]
    # operations: each byte of a CIGAR that is one, with the digits since the one before
    a, b = field(5)
    size = b - a
    at = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
    who = np.repeat(np.arange(len(row)), size)
    is_op = _OPERATION[data[at]]
    op, owner = at[is_op], who[is_op]
    begins = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    since = np.where(begins, a[owner], np.r_[0, op[:-1] + 1] if len(op) else op)
    number, fine = _numbers(data, since, op)
    number = np.where(fine, number, ((since == op) & ~begins).astype(np.int64))
    sums = {k: np.bincount(owner[m], number[m], len(row)).astype(np.int64) for k, letters in _KINDS.items() if (m := np.isin(data[op], np.frombuffer(letters, np.uint8))) is not None}
    total = np.bincount(owner, number, len(row)).astype(np.int64)
    # tags: fields from the twelfth on
    nm = np.zeros(len(row), np.int64)
    extra = count[row] - 10
    tag = np.repeat(head[row] + 10 - (np.cumsum(extra) - extra), extra) + np.arange(int(extra.sum()))
    mine = np.repeat(np.arange(len(row)), extra)
    end = np.where(tag + 1 < first[1:][row][mine], tabs[np.minimum(tag + 1, len(tabs) - 1)] if len(tabs) else tag, stop[row][mine])
    begin = tabs[tag] + 1 if len(tag) else tag
    named = end - begin > 5
    for j, chars in enumerate((b"Nn", b"Mm", b":", b"i", b":")):
        named[named] = np.isin(data[begin[named] + j], np.frombuffer(chars, np.uint8))
    begin, end, mine = begin[named] + 5, end[named], mine[named]
    size = end - begin
    for j in range(int(size.max(initial=0))):  # digits up to the first other byte
        on = np.flatnonzero(size > j)
        size[on[~_DIGIT[data[begin[on] + j]]]] = j
    value, fine = _numbers(data, begin, begin + size)
    mine, value = mine[fine][::-1], value[fine][::-1]
    nm[mine] = value
    names, refs = field(0), field(2)
    cols = [_strings(data, *names), _strings(data, *refs), pa.array(flag.astype(np.int32)), pa.array(place - 1), pa.array(sums["aligned"]), pa.array(sums["span"]), pa.array(total), pa.array(sums["clip"]), pa.array(nm)]
    return pa.RecordBatch.from_arrays(cols, ["spacer_id", "contig_id", "flag", "start", "aligned", "span", "total", "clip", "nm"])


def sam_records(lines: DataFrame) -> DataFrame:
    """``COLUMNS`` of SAM lines (``value``). Spark's text source splits files at any byte, so each line is one task's; batches bound a task's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield parse(batch.column(0))

    return lines.select("value").mapInArrow(run, COLUMNS)
