"""Which hashed keys of a corpus occur more than once: packed postings, dealt by the key's top bits.

A row per posting would cost several times its 16 bytes in a shuffle, so a map task packs postings,
about a quarter of a million at a time, by bucket (top bits of the key) into one row each. Keys that recur among them
are answered there and go on as one representative, so however common a key is, a reduce task
sees it once per quarter of a million postings and task at most. Answers go back packed by the bucket of their ids. Buckets are sized from a count of the data: their number grows with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from protospark.llm.common import in_arrow
from protospark.llm.text import mix

#: Postings that a bucket holds on average; a bucket is what a reduce task has in memory at once.
BUCKET = 1 << 18
#: Postings that a map task packs together.
RUN = 1 << 18
_PACKED = "kind int, bucket int, body binary"
_FOUND = "id long, pos array<int>, key array<long>"


def _pack(keys, ids, pos, own, more=None) -> bytes:
    """Planes of bytes, so that the zero bytes of small numbers compress. ``more``: 32 bits that lengthen each key."""
    planes = [x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in (ids.view(np.uint64),)]
    return keys.tobytes() + planes[0] + pos.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() + own.astype(np.uint8).tobytes() + (b"" if more is None else more.tobytes())


def _unpack(body: bytes, wide: bool = False):
    n = len(body) // (25 if wide else 21)
    b = np.frombuffer(body, np.uint8)
    keys = b[: 8 * n].view(np.uint64)
    ids = np.ascontiguousarray(b[8 * n : 16 * n].reshape(8, n).T).view(np.int64).ravel()
    pos = np.ascontiguousarray(b[16 * n : 20 * n].reshape(4, n).T).view(np.uint32).ravel()
    return keys, ids, pos, b[20 * n : 21 * n].astype(bool), (np.frombuffer(b[21 * n :].tobytes(), np.uint32) if wide else np.zeros(n, np.uint32))


def _grouped(ids, pos, keys) -> pa.RecordBatch:
    """One row per id with its positions and keys, in order."""
    order = np.lexsort((pos, ids))
    ids, pos, keys = ids[order], pos[order], keys[order]
    at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    offs = pa.array(np.r_[at, len(ids)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[at]), pa.ListArray.from_arrays(offs, pa.array(pos.astype(np.int32))), pa.ListArray.from_arrays(offs, pa.array(keys.view(np.int64)))],
        ["id", "pos", "key"],
    )


def occurrences(rows: DataFrame, columns: list[str], keys_of: Callable, bits: int, later: bool = False, wide: bool = False) -> DataFrame:
    """``(id, pos[], key[])``: the postings whose key occurs more than once, one row per id.

    ``columns[0]`` is a non-null long id; ``keys_of(batch)`` gives (keys, row, pos) of an Arrow batch of ``columns``.
    ``later``: only postings with the key at a smaller ``(id, pos)`` too; those at the smallest are left out.
    ``bits``: log2 of the number of buckets. ``wide``: ``keys_of`` gives 32 bits more of each key last, so that keys are equal by 96 bits.
    """
    shift = np.uint64(64 - bits)

    def by_bucket(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets of ids, with the places of those that each has."""
        where = (mix(ids.view(np.uint64)) >> shift).astype(np.int64) if bits else np.zeros(len(ids), np.int64)
        order = np.argsort(where, kind="stable")
        where = where[order]
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(ids) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(where[a]), order[a:b]

    def pack_run(parts: list[tuple]) -> pa.RecordBatch:
        keys, ids, pos, *more = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((pos, ids, *more, keys))
        keys, ids, pos = keys[order], ids[order], pos[order].astype(np.uint32)
        more = more[0][order] if wide else None
        new = np.r_[True, keys[1:] != keys[:-1]]
        if wide:
            new[1:] |= more[1:] != more[:-1]
        last = np.r_[new[1:], True]
        kind, bucket, body = [], [], []
        head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        found = ((ids != ids[head]) | (pos != pos[head])) if later else ~(new & last)
        if found.any():  # answers, dealt by the bucket of their ids, as they go there next
            for place, some in by_bucket(ids[found]):
                kind.append(1)
                bucket.append(place)
                at = np.flatnonzero(found)[some]
                body.append(_pack(keys[at], ids[at], pos[at], found[at]))
        keys, ids, pos, own = keys[new], ids[new], pos[new], ~last[new]
        more = more[new] if wide else None
        where = (keys >> shift).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            kind.append(0)
            bucket.append(int(where[a]))
            body.append(_pack(keys[a:b], ids[a:b], pos[a:b], own[a:b], more[a:b] if wide else None))
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary())], ["kind", "bucket", "body"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            keys, row, pos, *more = keys_of(batch)
            if len(keys):
                parts.append((keys, batch.column(0).to_numpy(zero_copy_only=False)[row].astype(np.int64), pos.astype(np.int64), *more))
                n += len(keys)
            if n >= RUN:
                yield pack_run(parts)
                parts, n = [], 0
        if parts:
            yield pack_run(parts)

    def answer(parts: list[bytes]) -> tuple:
        keys, ids, pos, own, more = (np.concatenate(x) for x in zip(*(_unpack(p, wide) for p in parts), strict=True))
        order = np.lexsort((pos, ids, more, keys))
        keys, ids, pos, own, more = keys[order], ids[order], pos[order], own[order], more[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])]
        if later:
            head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            found = (ids != ids[head]) | (pos != pos[head])
        else:  # representatives of keys that recur in their batch were answered there
            found = ~(new & np.r_[new[1:], True]) & ~own
        return ids[found], pos[found], keys[found]

    def by_id(parts: list[tuple]) -> pa.RecordBatch:
        """Answers packed anew, by the bucket of their ids."""
        ids, pos, keys = map(np.concatenate, zip(*parts, strict=True))
        own, bucket, body = np.zeros(len(ids), bool), [], []
        for place, some in by_bucket(ids):
            bucket.append(place)
            body.append(_pack(keys[some], ids[some], pos[some], own[some]))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(body, pa.binary())], ["bucket", "body"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, parts, at, held = [], [], None, 0
        for batch in batches:
            for kind, bucket, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and parts:
                    done.append(answer(parts))
                    held += len(done[-1][0])
                    parts = []
                at = bucket
                if kind:
                    k, i, p, *_ = _unpack(body)
                    done.append((i, p, k))
                    held += len(i)
                else:
                    parts.append(body)
                if held > 2 * BUCKET:
                    yield by_id(done)
                    done, held = [], 0
        if parts:
            done.append(answer(parts))
        if done:
            yield by_id(done)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at = [], None

        def out():
            keys, ids, pos, *_ = (np.concatenate(x) for x in zip(*map(_unpack, parts), strict=True))
            return _grouped(ids, pos, keys)

        for batch in batches:
            for bucket, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and parts:
                    yield out()
                    parts = []
                at = bucket
                parts.append(body)
        if parts:
            yield out()

    packed = rows.select(*columns).transform(in_arrow, pack, _PACKED)
    answers = packed.repartition("bucket").sortWithinPartitions("bucket").transform(in_arrow, unpack, "bucket int, body binary")
    return answers.repartition("bucket").sortWithinPartitions("bucket").transform(in_arrow, gather, _FOUND)


def bucket_bits(postings: int) -> int:
    """log2 of the buckets for so many postings."""
    return min(30, max(6, int(np.ceil(np.log2(max(1, postings / BUCKET))))))
