"""BPE encoding and decoding with a minimal acyclic transducer as lexicon (operator 2)."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from protospark.llm.common import batches, cut, in_arrow, table
from protospark.llm.text import raw

#: Words that the transducer holds at most (the most frequent of the corpus), and characters of each.
LEXICON, WORD_CHARS = 1 << 16, 64
#: Characters of consecutive texts that a worker takes at once.
RUN_CHARS = 1 << 23
#: Words of more bytes are merged by a heap of pairs.
LONG = 48
#: The split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
#: A space before a visible character always begins a word, so texts may be cut there, and each piece split by itself.
_SPACE = re.compile(r" (?=\S)")
_WIDE = re.compile(r" (?:\s|$)")
#: Marks the cuts; a text that has it is cut in Python.
_MARK = "\uf8ff"
#: Pieces that are one word for certain.
_ONE_WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


def pieces(text: str) -> list[str]:
    """``text`` cut before each space that a visible character follows."""
    head, *rest = _SPACE.split(text)
    return [head, *(" " + p for p in rest)] if head else [" " + p for p in rest]


def cut_texts(texts: list[str], vocab: Vocabulary | None = None) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, flat, and where each text's begin; with a vocabulary, its special strings are pieces of their own."""
    special = vocab.special if vocab else {}
    plain = [not (_WIDE.search(t) or _MARK in t or any(s in t for s in special)) for t in texts]
    fast = pa.array([t if ok else "" for t, ok in zip(texts, plain, strict=True)], pa.large_string())
    lists = pc.split_pattern(pc.replace_substring(fast, " ", _MARK + " "), _MARK)
    flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.greater(pc.binary_length(flat), 0)
    doc = np.repeat(np.arange(len(texts)), size)[full.to_numpy(zero_copy_only=False)]
    flat, size = flat.filter(full), np.bincount(doc, minlength=len(texts))
    if not all(plain):
        more = {}
        for i in (i for i, ok in enumerate(plain) if not ok):
            parts = vocab.cut.split(texts[i]) if vocab and vocab.cut else [texts[i]]
            more[i] = [x for p in parts if p for x in ([p] if p in special else pieces(p))]
        slow = pa.array([x for xs in more.values() for x in xs], pa.large_string())
        owner = np.r_[doc, np.repeat(np.fromiter(more, np.int64), [len(xs) for xs in more.values()])]
        flat = pa.concat_arrays([flat.cast(pa.large_string()), slow]).take(pa.array(np.argsort(owner, kind="stable")))
        size = np.bincount(owner, minlength=len(texts))
    return flat.cast(pa.large_string()), np.r_[0, np.cumsum(size)]


def split_pieces(distinct: pa.Array, special=()) -> tuple[pa.Array, np.ndarray]:
    """The words of distinct pieces, flat, and how many each has."""
    one = pc.match_substring_regex(distinct, _ONE_WORD).to_numpy(zero_copy_only=False)
    rest = [[p] if p in special else _SPLIT.findall(p) for p in distinct.filter(pa.array(~one)).to_pylist()]
    n = np.ones(len(distinct), np.int64)
    n[~one] = [len(ws) for ws in rest]
    words = pa.concat_arrays([distinct.filter(pa.array(one)), pa.array(list(chain.from_iterable(rest)), pa.large_string())])
    owner = np.repeat(np.r_[np.flatnonzero(one), np.flatnonzero(~one)], np.r_[n[one], n[~one]])
    return words.take(pa.array(np.argsort(owner, kind="stable"))), n


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, ...``: ``n`` numbers from each start."""
    end = np.cumsum(n)
    return np.repeat(start - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)


def _joined(values: pa.Array, begin: np.ndarray, by: str | bytes) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(begin, pa.int64()), values), pa.scalar(by, values.type))


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, by rule: printable Latin-1 as is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file: merges by rank, token bytes, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        back = lambda s: bytes(chars[c] for c in s)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: s.encode() if s in self.special else back(s) for s, i in model["vocab"].items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        ids = {v: k for k, v in self.bytes.items() if k not in self.special.values()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (back(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merge.items())
        self.pair, self.rank, self.merged = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        return tuple(self.encode_words([word])[0].tolist())

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, flat; how many each has): merged by rank, leftmost first, until no pair merges.

        All words of up to ``LONG`` bytes step together.
        """
        some = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        long = {i: self._merge_long([self.single[b] for b in w]) for i, w in enumerate(words) if len(w) > LONG}
        flat = [np.fromiter(chain.from_iterable(long.values()), np.int64)]
        owner = [np.repeat(np.fromiter(long, np.int64, len(long)), [len(x) for x in long.values()])]
        flat += (short := self._merge_short(words, some))[0]
        owner += short[1]
        flat, owner = np.concatenate(flat), np.concatenate(owner).astype(np.int64)
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _merge_short(self, words: list[bytes], some: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if not some:
            return [], []
        out_flat, out_owner, name = [], [], np.array(some)
        size = np.fromiter((len(words[i]) for i in some), np.int64, len(some))
        ids = np.array(self.single, np.int64)[np.frombuffer(b"".join(words[i] for i in some), np.uint8)]
        word = np.repeat(np.arange(len(some)), size)
        none = np.int64(1 << 30)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """Places in the table of pairs in order of their keys, or ``none``."""
            key = left << 32 | right
            at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
            return np.where(self.pair[at] == key, self.rank[at], none) if len(self.pair) else np.full(len(key), none)

        by_rank = np.zeros(len(self.rank) + 1, np.int64)
        by_rank[self.rank] = self.merged
        last = np.r_[word[1:] != word[:-1], True]
        rank = np.where(last, none, ranks(ids, np.r_[ids[1:], 0]))
        while len(ids):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), begin)
            done = best >> 32 == none
            if done.any():
                over = np.repeat(done, np.diff(np.r_[begin, len(ids)]))
                out_flat.append(ids[over])
                out_owner.append(name[word[over]])
                shift = np.cumsum(over)
                best = best[~done]
                best = best - shift[best & 0xFFFFFFFF]
                ids, word, rank = ids[~over], word[~over], rank[~over]
            at = best & 0xFFFFFFFF
            ids[at] = by_rank[best >> 32]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one entry goes from each word before
            ids, word = ids[keep], word[keep]
            rank = rank[keep]
            last = np.r_[word[1:] != word[:-1], True] if len(word) else np.zeros(0, bool)
            rank[at] = np.where(last[at], none, ranks(ids[at], ids[np.minimum(at + 1, len(ids) - 1)]))
            left = at[(at > 0) & (word[np.maximum(at - 1, 0)] == word[at])] - 1
            rank[left] = ranks(ids[left], ids[left + 1])
        return out_flat, out_owner

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap of (rank, place) over a linked list: a word of n bytes takes n log n steps."""
        merge, n = self.merge, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merge[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merge]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = merge[pair][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in merge:
                    heapq.heappush(heap, (merge[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in merge:
                heapq.heappush(heap, (merge[p][0], h, p))
        return tuple(x for x in ids if x >= 0)


def compile_lexicon(words: list[bytes], ids: np.ndarray, n: np.ndarray) -> bytes:
    """The minimal acyclic transducer of sorted distinct ``words``: states share suffixes, arcs carry numbers.

    The numbers on a word's path add up to its row, and the words' token ids (``ids``, flat; ``n`` of each) follow the automaton. Built in one pass
    over the sorted words: what the next word doesn't share is frozen, and equal frozen states become one.
    """
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []  # of frozen states
    finals: list[bool] = []
    counts: list[int] = []
    path: list[list] = [[[], False]]  # [arcs, final] of the states of the last word

    def freeze(state: list) -> int:
        key = (tuple(state[0]), state[1])
        if key not in register:
            register[key] = len(arcs)
            arcs.append(state[0])
            finals.append(state[1])
            counts.append(int(state[1]) + sum(counts[t] for _, t in state[0]))
        return register[key]

    last = b""
    for word in words:
        same = len(os.path.commonprefix([word, last]))
        while len(path) - 1 > same:
            done = freeze(path.pop())
            path[-1][0].append((last[len(path) - 1], done))
        for _ in word[same:]:
            path.append([[], False])
        path[-1][1] = True
        last = word
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][0].append((last[len(path) - 1], done))
    root = freeze(path[0])
    sizes = np.array([len(a) for a in arcs], np.int64)
    label, to, add = (np.zeros(int(sizes.sum()), np.int64) for _ in range(3))
    i = 0
    for s, out in enumerate(arcs):
        total = int(finals[s])
        for c, t in out:
            label[i], to[i], add[i] = c, t, total
            total += counts[t]
            i += 1
    # arcs of a state lie together in order of their labels: (state, label) is sorted
    key = np.repeat(np.arange(len(arcs), dtype=np.int64), sizes) * 256 + label
    lengths = np.r_[0, np.cumsum(n)]
    parts = [key, to, add, np.array(finals, np.int64), lengths, ids]
    kinds = [np.int64, *[np.int32] * 5]
    return np.array([root, *map(len, parts)], np.int64).tobytes() + b"".join(p.astype(k).tobytes() for p, k in zip(parts, kinds, strict=True))


class Lexicon:
    """A compiled transducer, memory-mapped: workers of a machine share its pages, and search in them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int64, 7)
        self.root, at, parts = int(head[0]), 56, []
        for n, kind in zip(head[1:].tolist(), [np.int64, *[np.int32] * 5], strict=True):
            parts.append(np.frombuffer(self.map, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.key, self.to, self.add, self.final, self.lengths, self.ids = parts

    def rows(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The row of each word (``size`` bytes of ``data`` from ``begin`` on) that the transducer accepts, or -1; all words step together."""
        state, row, live = np.full(len(size), self.root, np.int64), np.zeros(len(size), np.int64), np.arange(len(size))
        for t in range(int(size.max(initial=0))):
            live = live[size[live] > t]
            if not len(live) or not len(self.key):
                break
            key = state[live] * 256 + data[begin[live] + t]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[arc] == key
            state[live[~ok]] = -1
            live, arc = live[ok], arc[ok]
            row[live] += self.add[arc]
            state[live] = self.to[arc]
        found = (state >= 0) & (self.final[np.maximum(state, 0)] > 0) & (size > 0)
        return np.where(found & (len(self.key) > 0), row, -1)


def _runs(batches_: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(the first column, texts) of consecutive rows with about ``RUN_CHARS`` characters together; a null text is empty."""
    for batch in batches_:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        at = np.cumsum([0, *map(len, texts)]) // RUN_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.column(0).slice(a, b - a), texts[a:b]


def _count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of runs of texts: pieces are counted first, and words in their distinct ones. Spark adds up a task's rows before the shuffle."""
    for _, texts in _runs(batches_, 0):
        seen = cut_texts(texts)[0].value_counts()
        words, n = split_pieces(seen.field("values"))
        n = np.repeat(seen.field("counts").to_numpy(), n)
        short = pc.less_equal(pc.utf8_length(words), WORD_CHARS)
        yield pa.RecordBatch.from_arrays([words.filter(short).cast(pa.string()), pa.array(n).filter(short)], ["word", "n"])


def _on_this_machine(name: str, body) -> str:
    """The broadcast lexicon as a file in the folder that Spark gives an executor: its first worker writes it, all others map it."""
    path = os.path.join(SparkFiles.getRootDirectory(), name)
    if not os.path.exists(path):
        with open(own := f"{path}.{os.getpid()}", "wb") as f:
            f.write(body.value)
        os.replace(own, path)
    return path


class _Codec:
    """Encodes runs of texts: their distinct pieces, and these pieces' distinct words, are encoded once each."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon):
        self.vocab, self.lexicon = vocab, lexicon
        most = max(vocab.bytes, default=-1) + 1
        self.digits = pa.array([str(i) for i in range(most)], pa.large_string())
        self.raw = pa.array([vocab.bytes.get(i, b"") for i in range(most)], pa.large_binary())

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids somewhere in an array, and for each word where its own begin and how many they are."""
        data, offs = raw(words)
        row = self.lexicon.rows(data, offs[:-1], np.diff(offs))
        unseen = np.flatnonzero(row < 0)
        body = data.tobytes()
        told = [body[offs[i] : offs[i + 1]] for i in unseen.tolist()]
        special = {s.encode(): i for s, i in self.vocab.special.items()}
        ids, n = self.vocab.encode_words(told)
        start = np.zeros(len(row), np.int64)
        count = start.copy()
        known = np.maximum(row, 0)
        if (row >= 0).any():
            start, count = self.lexicon.lengths[known].astype(np.int64), np.diff(self.lexicon.lengths)[known].astype(np.int64)
        start[unseen], count[unseen] = len(self.lexicon.ids) + np.cumsum(n) - n, n
        ids = np.r_[self.lexicon.ids, ids]
        for i, w in zip(unseen.tolist(), told, strict=True):
            if w in special:
                start[i], count[i] = len(ids), 1
                ids = np.r_[ids, special[w]]
        return ids, start, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct pieces and where each one's begin, the texts' pieces and where each text's begin, and the texts' token counts."""
        flat, doc_begin = cut_texts(texts, self.vocab)
        pieces_ = flat.dictionary_encode()
        words, n_words = split_pieces(pieces_.dictionary, self.vocab.special)
        words = words.dictionary_encode()
        ids, start, count = self.words(words.dictionary)
        word = words.indices.to_numpy()
        ids = ids[_ranges(start[word], count[word])]
        ends = np.r_[0, np.cumsum(count[word])]
        piece_begin = ends[np.r_[0, np.cumsum(n_words)]]
        piece = pieces_.indices.to_numpy()
        total = np.r_[0, np.cumsum(np.diff(piece_begin)[piece])]
        return ids, piece_begin, piece, doc_begin, np.diff(total[doc_begin])

    def digests(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
        """Token counts, and digests of the ids and of the text that they decode to."""
        ids, piece_begin, piece, doc_begin, n = self.encode(texts)
        at, take = pa.array(ids), pa.array(piece)
        out = []
        for of_id, by in ((self.digits, ","), (self.raw, b"")):
            of_piece = _joined(of_id.take(at), piece_begin, by)
            out.append(_joined(of_piece.take(take), doc_begin, by))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return n, [sha(x.as_buffer()) for x in out[0]], [sha(bytes(x.as_buffer()).decode("utf-8", "replace").encode()) for x in out[1]]

    def lists(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """Token counts and ids."""
        ids, piece_begin, piece, doc_begin, n = self.encode(texts)
        size = np.diff(piece_begin)[piece]
        flat = ids[_ranges(piece_begin[piece], size)]
        return n, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat.astype(np.int32)))


def _codec(path: str, name: str, body, emit: str):
    """``emit``: ``digests`` or ``ids``."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec(Vocabulary(path), Lexicon(_on_this_machine(name, body)))
        for doc_ids, texts in _runs(batches_, 1):
            if emit == "ids":
                n, lists = codec.lists(texts)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n), lists], ["doc_id", "n_tokens", "ids"])
            else:
                n, ids_sha, text_sha = codec.digests(texts)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def frequent_words(docs: DataFrame, size: int) -> list[str]:
    """The words of all texts that occur at least so often that there are ``size`` of them at most (two times at least).

    How often is read off a histogram, so the driver gets no more than ``size`` words of ``WORD_CHARS`` characters, whatever the number of tasks.
    """
    counts = docs.select("text").transform(in_arrow, _count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = cut(counts.withColumn("level", F.floor(F.log2("n") * 64)))
    least, total = None, 0
    for level, n in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        if total + n > size:
            break
        least, total = level, total + n
    return [] if least is None else [r[0] for r in counts.where(F.col("level") >= least).select("word").collect()]


def lexicon_of(docs: DataFrame, vocab_path: str, size: int = LEXICON) -> bytes:
    """The transducer of the most frequent words of all texts."""
    vocab = Vocabulary(vocab_path)
    words = sorted(w.encode() for w in frequent_words(docs, size) if w not in vocab.special)
    return compile_lexicon(words, *vocab.encode_words(words))


def encode(docs: DataFrame, vocab_path: str, emit: str = "ids", size: int = LEXICON) -> DataFrame:
    """``doc_id, n_tokens`` and token ``ids``, or with ``emit='digests'`` the digests of ids and of the text decoded from them.

    ``docs`` has ``doc_id`` and ``text``; null and empty texts have no tokens. ``vocab_path`` (a byte-level BPE in JSON) must be
    readable on every machine. Special strings in a text become their ids. Frequent words' ids come from the transducer,
    all others are merged. Repeated and null ids are encoded row by row; other columns are ignored.

    The transducer is broadcast (bounded by ``size`` words of ``WORD_CHARS`` characters), kept as a file in each executor's own folder and
    mapped by its workers; a new executor gets it from the broadcast.
    """
    batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    lexicon = lexicon_of(docs, vocab_path, size)
    name = f"lexicon-{hashlib.sha256(lexicon).hexdigest()[:16]}.bin"
    kinds = "ids array<int>" if emit == "ids" else "ids_sha256 string, decoded_sha256 string"
    return docs.transform(in_arrow, _codec(vocab_path, name, docs.sparkSession.sparkContext.broadcast(lexicon), emit), f"doc_id long, n_tokens long, {kinds}")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: the tokens' bytes as UTF-8, bytes that aren't replaced; null ids give an empty text."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Vocabulary(vocab_path).bytes
        for batch in batches_:
            texts = [b"".join(map(of.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").transform(in_arrow, run, "doc_id long, text string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary_path(), emit="digests")
