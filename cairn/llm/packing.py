"""Packing by minimum bin slack: for each window a bitset subset-sum picks the multiset of remaining lengths that
fills it closest to capacity; the multiset comes back by walking the saved bitsets, and counts go down by it.

A null or empty text is a document of the end token alone.  Documents longer than the capacity give full windows and a
remainder; remainders are what is packed.  Every partition packs its own rows, so nothing is shuffled and a lost task
repeats alone with the same result; sequence ids carry the partition's number.  Pools bound a task's memory: what a
pool cannot fill moves to the next pool, and the last of it is cut into sequences whose lengths are powers of two,
which need no padding.  Repeated rows are packed one by one; extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_letters
from .common import claim, joined, load, small_batches, steps

#: Id that ends every document.
END = 1
#: Chunks (between white space) whose ids each worker remembers in each of two generations: when the young one is full
#: it becomes the old one, and what is met again moves on.
REMEMBERED = 650_000
#: Remainders that are packed together.
POOL = 8192

_combining = re.compile("[̀-ͯ]")
_separators = re.compile("[\x1c-\x1f]")
_marked = re.compile(r"([^\W\d_]+)([^\w\s']+)\Z")


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_stop, _alnum, _space = (np.isin(np.arange(256), list(chars)) for chars in (b".,", b"abcdefghijklmnopqrstuvwxyz0123456789", b" \n"))


class ChunkTokenizer:
    """Ids by the tokenizers library, once for each new word, the rest from memory.

    The vocabulary's pre-tokeniser drops white space, never joins across it, and parts letters from other marks, so
    chunks between white space encode alone, and a word alone from the marks behind it.  ASCII letters are lower-cased
    first, which the normaliser does anyway, unless combining marks could compose with them.  New words of letters
    only go to the model many at a time as one sequence, in the letters that stand for their bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.words = Tokenizer(self.model.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.letters = dict(enumerate(byte_letters()))
        self.ids_of: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        known, ends, rest = self.ids_of, {}, []
        if self.old:
            met = chunks & self.old.keys()
            known.update(zip(met, map(self.old.__getitem__, met)))
            chunks -= met
        words = {c for c in chunks if c.isascii() and c.isalpha() and c.islower()}
        for c in chunks - words:
            plain = c.isascii()
            if not plain and unicodedata.normalize("NFC", c) != c:
                rest.append(c)
                continue
            m = None if c.isalpha() else _marked.match(c)
            w = m[1] if m else c
            if not w.isalpha() or "Σ" in w or w.lower() != w:
                rest.append(c)
                continue
            if m:
                ends[c] = m
            if w not in known:
                words.add(w)
        todo = list(words)
        for i in range(0, len(todo), 8192):
            part = todo[i : i + 8192]
            found = self.words.encode(" ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in part]), add_special_tokens=False)
            packed = np.array(found.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(part) + 1))).tolist()
            known.update(zip(part, [packed[x:y] for x, y in zip(cuts, cuts[1:])]))
        for c, m in ends.items():
            marks = known.get(m[2])
            if marks is None:
                marks = known[m[2]] = self.direct(m[2])
            known[c] = known[m[1]] + marks
        for c in rest:
            known[c] = self.direct(c)

    def many(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text (null: empty), without the end token."""
        known = self.ids_of
        if len(known) > REMEMBERED:
            self.old, self.ids_of = known, {}
            known = self.ids_of
        raw, off = joined(texts)
        raw = _lower[raw]
        # a stop or comma between a letter or digit and white space is a piece of its own: part it from the word
        stop = np.flatnonzero(_stop[raw])
        stop = stop[(stop > 0) & (stop < len(raw) - 1)]
        stop = stop[_alnum[raw[stop - 1]] & _space[raw[stop + 1]]]
        off = off + np.searchsorted(stop, off)
        whole = np.insert(raw, stop, 32).tobytes()
        split: list[list[str] | None] = []
        for i, (x, y) in enumerate(zip(off.tolist(), off[1:].tolist())):
            text = whole[x:y].decode()
            if not text.isascii() and _combining.search(text):
                text = texts[i].as_py()  # capitals must stay
            split.append(None if _separators.search(text) or any(s in text for s in self.special) else text.split())
        fresh = set().union(*[c for c in split if c]) - known.keys()
        if fresh:
            self._learn(fresh)
        return [self.direct(texts[i].as_py()) if c is None else b"".join(map(known.__getitem__, c)) for i, c in enumerate(split)]


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def fill(lengths: list[int], count, capacity: int) -> list[int]:
    """The multiset of lengths whose sum is closest to capacity from below, the longest length among it.

    lengths: distinct, ascending; count(x) says how many of x there are.  They are offered from long to short, and the
    search ends as soon as the capacity is met exactly.
    """
    first = lengths[-1]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, saved = 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        x = lengths[k]
        n, step = min(count(x) - (x == first), room // x), 1
        while n > 0 and not reach >> room & 1:  # n copies as powers of two, the rest last
            take = min(step, n)
            saved.append((x, take, reach))
            reach |= reach << (x * take) & mask
            n -= take
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = [first]
    for x, take, before in reversed(saved):
        if not before >> total & 1:
            chosen += [x] * take
            total -= x * take
    return chosen


class Packer:
    """Packs the remainders of one partition; yields rows (piece, skip, length, sequence number, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence, self.held, self.total = capacity, 0, 0, 0
        self.waiting: dict[int, list] = {}
        self.lengths: list[int] = []  # of those waiting, distinct and ascending

    def put(self, length: int, piece: object) -> None:
        pieces = self.waiting.get(length)
        if pieces is None:
            self.waiting[length] = [piece]
            insort(self.lengths, length)
        else:
            pieces.append(piece)
        self.held += 1
        self.total += length

    def take(self, length: int) -> object:
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length], self.lengths[bisect_left(self.lengths, length)]
        self.held -= 1
        self.total -= length
        return piece

    def full_window(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def drain(self, last: bool) -> Iterator[tuple[object, int, int, int, int]]:
        """Fills windows; unless last, ends when no window can be met exactly or few pieces are left."""
        keep = 0 if last else POOL // 8
        while self.held > keep:
            chosen = fill(self.lengths, lambda x: len(self.waiting[x]), self.capacity)
            short = sum(chosen) < self.capacity
            if short and not last:
                return
            if short and self.total < self.capacity:
                yield from self._tail()
                return
            number, at = self.full_window(), 0
            for x in chosen:
                yield self.take(x), 0, x, number, at
                at += x
            while at < self.capacity:  # no exact fit: the front of one more piece, cut there
                x = self.lengths[-1]
                piece, part = self.take(x), min(x, self.capacity - at)
                yield piece, 0, part, number, at
                at += part
                if part < x:
                    self.put(x - part, (piece, part))

    def _tail(self) -> Iterator[tuple[object, int, int, int, int]]:
        """What is left, under one window: sequences of falling powers of two, pieces cut at their ends."""
        rest = [(x, p) for x in sorted(self.waiting, reverse=True) for p in self.waiting[x]]
        left = sum(x for x, _ in rest)
        room, number, at = 0, 0, 0
        for x, piece in rest:
            skip = 0
            while x:
                if not room:
                    room, number, at = 1 << (left.bit_length() - 1), self.full_window(), 0
                take = min(x, room)
                yield piece, skip, take, number, at
                skip, x, room, at, left = skip + take, x - take, room - take, at + take, left - take
        self.waiting.clear()
        self.lengths.clear()
        self.held = self.total = 0


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with keep_ids).

    tokenizer: a tokenizers file that every executor can open; by default the word-end BPE of public_tokenizers there.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        claim("packing", chunk_tokenizer.cache_clear)
        if tokenizer is None:
            import public_tokenizers

            model = chunk_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
        else:
            model = chunk_tokenizer(tokenizer)
        base = TaskContext.get().partitionId() << 33
        packer = Packer(capacity)
        end = np.array([END], "<u4").tobytes()
        rows: list[tuple] = []

        def row(doc: int, packed: bytes, at: int, start: int, length: int, total: int, number: int, offset: int) -> None:
            part = packed[4 * at : 4 * (at + length)]
            rows.append((doc, start, length, zlib.crc32(part), total, base + number, offset, *([np.frombuffer(part, "<u4").astype(np.int32)] if keep_ids else [])))

        def settle(last: bool) -> None:
            for piece, skip, length, number, offset in packer.drain(last):
                while len(piece) == 2:  # the rest of a piece that was cut
                    piece, more = piece
                    skip += more
                doc, packed, start, total = piece
                row(doc, packed, skip, start + skip, length, total, number, offset)

        def flush():
            if rows:
                cols = list(zip(*rows, strict=True))
                rows.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

        for batch in batches:
            texts, docs_ = batch.column("text"), batch.column("doc_id")
            for lo, hi in steps(texts):
                for doc, packed in zip(docs_.slice(lo, hi - lo).to_pylist(), model.many(texts.slice(lo, hi - lo)), strict=True):
                    packed += end
                    total, at = len(packed) // 4, 0
                    while total - at >= capacity:
                        row(doc, packed, at, at, capacity, total, packer.full_window(), 0)
                        at += capacity
                    if at < total:
                        packer.put(total - at, (doc, packed[4 * at :], at, total))
                    if packer.held >= POOL:
                        settle(False)
                        if packer.held >= POOL:
                            settle(True)
                yield from flush()
        settle(True)
        yield from flush()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
