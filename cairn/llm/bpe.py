"""BPE by backtracking: longest token matches from an Aho-Corasick automaton, accepted only where the pair of
neighbouring tokens is one that merging would leave apart; decoding by an offset table into the vocabulary's bytes.

A null text is empty; an empty text has no ids.  Extra columns are ignored, repeated rows are encoded one by one.
Texts of any length are handled whole: pieces between white space are encoded once and remembered (a bounded
memory per Python worker), so memory follows one text, not the table.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import claim, load, small_batches, steps

#: The byte-level pre-tokeniser's pattern (a fixed value of the public format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_first, _second = itemgetter(0), itemgetter(1)
#: Units that each worker remembers in each of two generations: a full young one becomes the old one, and what is met
#: again moves on.
REMEMBERED = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


class BacktrackingBPE(dict):
    """Exact merges in linear time: a sequence is the merges' result if and only if each neighbouring pair is compatible.

    As a dict it remembers units of text: their decimal ids joined by commas, and their ids packed.
    """

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, tuple[str, bytes]] = {}
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        raw = lambda s: bytes(to_byte[c] for c in s)
        # tokens in order of rank: bytes first, then merges; own[i] is the vocabulary's id
        words = [letters[b] for b in range(256)]
        rank = {w: i for i, w in enumerate(words)}
        self.left, self.right, self.pair = list(range(256)), list(range(256)), {}
        for merge in merges:
            x, y = merge.split(" ") if isinstance(merge, str) else merge
            w = x + y
            if w not in rank:
                rank[w] = len(words)
                words.append(w)
                self.left.append(rank[x])
                self.right.append(rank[y])
                self.pair[rank[x], rank[y]] = rank[w]
        self.own = [vocab[w] for w in words]
        self.texts = [raw(w).decode("latin-1") for w in words]
        self.size = [len(t) for t in self.texts]
        known = {t: i for i, t in enumerate(self.texts)}
        self.shorter = []
        for t in self.texts:  # the longest token that is a proper prefix
            n = len(t) - 1
            while n and t[:n] not in known:
                n -= 1
            self.shorter.append(known[t[:n]] if n else -1)
        self.matches = ahocorasick.Automaton()
        for i, t in enumerate(self.texts):
            self.matches.add_word(t, i)
        self.matches.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # offset table: id -> bytes
        top = max([*self.own, *self.special.values()]) + 1
        parts: list[bytes] = [b""] * top
        for i, t in zip(self.own, self.texts, strict=True):
            parts[i] = t.encode("latin-1")
        for t, i in self.special.items():
            parts[i] = t.encode()
        self.offsets = np.zeros(top + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.apart: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PIECES)
        self.spaces = regex.compile(r"\s ")
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def compatible(self, x: int, y: int) -> bool:
        """Whether merging leaves x and y apart: no merge across the border ranks before those that built x and y.

        Unwinds the later-built of the two, one merge at a time, keeping the part that touches the border.
        """
        found = self.apart.get((x, y))
        if found is None:
            a, b, bound, found = x, y, 1 << 60, None
            while found is None:
                if self.pair.get((a, b), 1 << 60) < bound:
                    found = False
                elif a > b:
                    bound, inner = a, self.right[a]
                    if inner == a:
                        found = True
                    a = inner
                else:
                    bound, inner = b + 1, self.left[b]
                    if inner == b:  # a single byte; unwind the other side if it can be
                        bound, inner = a, self.right[a]
                        if inner == a:
                            found = True
                        a = inner
                    else:
                        b = inner
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            self.apart[x, y] = found
        return found

    def encode_piece(self, s: str) -> list[int]:
        """Ranks of one piece given as latin-1 (one letter a byte)."""
        n = len(s)
        longest = [0] * n
        size = self.size
        for end, i in self.matches.iter(s):
            longest[end + 1 - size[i]] = i
        out: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)  # positions not yet found to be dead ends
        pos, token = 0, longest[0]
        while pos < n:
            end = pos + size[token]
            if open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_[pos] = 0
                token = out.pop()
                pos -= size[token]
        return out

    def _one(self, piece: str) -> tuple[str, bytes]:
        ids = [self.own[i] for i in self.encode_piece(piece.encode().decode("latin-1"))]
        return ",".join(map(str, ids)), np.array(ids, "<u4").tobytes()

    def __missing__(self, unit: str) -> tuple[str, bytes]:
        """A unit that is not remembered: its pieces one by one, each of which may be."""
        found = self.old.get(unit)
        if found is None:
            pieces = self.pieces.findall(unit)
            if len(pieces) > 1:
                parts = [self[p] for p in pieces]
                found = ",".join(map(_first, parts)), b"".join(map(_second, parts))
            else:
                found = self._one(unit)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        if len(unit) <= 200:
            self[unit] = found
        return found

    def _encode_plain(self, text: str) -> list[tuple[str, bytes]]:
        # a space that follows no white space always starts a piece, so the parts between are encoded apart
        if self.spaces.search(text):
            return [self[p] if len(p) <= 200 else self._one(p) for p in self.pieces.findall(text)]
        units = text.split(" ")
        units[1:] = [" " + u for u in units[1:]]
        return list(map(self.__getitem__, units if units[0] else units[1:]))

    def encode(self, text: str) -> tuple[str, bytes]:
        """(decimal ids joined by commas, ids as little-endian unsigned 32-bit)."""
        if not text:
            return "", b""
        parts: list[tuple[str, bytes]] = []
        last = 0
        if self.cuts is not None and any(t in text for t in self.special):
            for m in self.cuts.finditer(text):
                if m.start() > last:
                    parts += self._encode_plain(text[last : m.start()])
                i = self.special[m[0]]
                parts.append((str(i), np.array([i], "<u4").tobytes()))
                last = m.end()
        if last < len(text):
            parts += self._encode_plain(text[last:] if last else text)
        return ",".join(map(_first, parts)), b"".join(map(_second, parts))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the ids' tokens, invalid sequences replaced."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        total = int(size.sum())
        first = np.cumsum(size) - size
        raw = self.bytes[np.repeat(start - first, size) + np.arange(total)].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingBPE:
    return BacktrackingBPE(path)


def encode_decode(docs: DataFrame, tokenizer: str | None = None, digests_only: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each document; with digests_only their counts and digests.

    tokenizer: a byte-level BPE file that every executor can open; by default the one of public_tokenizers there.
    """
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests_only else "doc_id long, n_tokens long, ids array<int>, decoded string"

    def run(batches):
        claim("bpe", encoder.cache_clear)
        if tokenizer is None:
            import public_tokenizers

            model = encoder(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            model = encoder(tokenizer)
        for batch in batches:
            ids_, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in steps(texts):
                rows = []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    joined, packed = model.encode(text or "")
                    ids = np.frombuffer(packed, "<u4").astype(np.int64)
                    back = model.decode(ids)
                    rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest()) if digests_only else (len(ids), ids.astype(np.int32), back.decode()))
                n, a, b = zip(*rows, strict=True)
                kind = pa.string() if digests_only else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([ids_.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, kind), pa.array(b, pa.string())], out.replace(" long", "").replace(" array<int>", "").replace(" string", "").split(", "))

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, out)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(load(spark, sf_dir, "documents"), digests_only=True)
