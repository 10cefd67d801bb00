"""Line dedup by a segment-partition edit join.

Lines (parts between \\n, in UTF-8 bytes) within `edits` insertions, deletions and replacements of each other are linked;
of each component of links the first line in order of (doc_id, line number) stays, the others go.  Lines shorter than
`least` bytes, of which two edits may make another word, are linked to equal lines only, and with `short` alone: then
every line with a word counts, and only blank lines are left out.  Without it they are never touched.

A line of n bytes is cut into edits + 1 segments; a line within the distance keeps one of them whole, at a start that
its length bounds.  So a line is indexed under the hashes of its segments, and probes, for each length it can meet, the
few substrings that the multi-match rule leaves.  Hashes go to buckets, many in one row, with a parity sketch of the
line's byte pairs: an edit turns at most four bits of it, which drops most chance meetings without losing a pair.
Candidates are joined to families, the families' lines come from the texts through a Bloom filter of fixed size, and a
banded bit-parallel edit distance decides between lines that are not connected yet.  Equal lines are one node.

A null text is kept as it is, and so is a row without doc_id, whose lines count for nothing.  Rows that repeat a doc_id
count as one document whose lines stay or go alike.  An empty text has one empty line, which stays; a very long text or line
is one row of a step.  Extra columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, Rolling, buckets_for, claim, connected_components, fresh, joined, link_families, load, materialize, mix, small_batches, spanning_forest, steps

EDITS = 2
LEAST = 24
#: Bits of the Bloom filter that picks the families' lines out of the texts.
FILTER_BITS = 1 << 23
#: Entries and probes that a bucket holds, about.
BUCKET = 1 << 21
#: 64-bit words of the sketches that travel with entries, and of those that are made where the lines are at hand (powers of two).
#: Many lines of a corpus are a few words apart, which 32 bits told from two edits too seldom: families grew with the square of the input.
SKETCH, VERIFY = 1, 4
#: Posting lists up to this length are compared position by position, longer ones seed by seed.
SHORT = 24
#: Lines of a family that one task verifies; larger families are dealt to blocks.
FAMILY_ROWS = 16384
#: Entries that a task deals out at a time.
DEAL = 1_000_000


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number within the row of every line of every row (an empty row has one empty line)."""
    breaks = np.flatnonzero(raw == 10)
    n = len(off) - 1
    row_of = np.searchsorted(off, breaks, side="right") - 1
    start = np.concatenate([off[:-1], breaks + 1])
    row = np.concatenate([np.arange(n), row_of])
    end = np.concatenate([breaks, off[1:]])
    end_row = np.concatenate([row_of, np.arange(n)])
    a, b = np.lexsort((start, row)), np.lexsort((end, end_row))
    start, row, end = start[a], row[a], end[b]
    first = np.searchsorted(row, np.arange(n))
    return start, end, row, np.arange(len(row)) - first[row]


def line_nodes(hashes: Rolling, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """63-bit identities of the lines."""
    return (mix(hashes(start, end) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(1)).astype(np.int64)


def _occurrences(least: int, short: bool):
    def run(batches):
        claim("line_dedup")
        for batch in batches:
            texts, docs = batch.column("text"), np.asarray(batch.column("doc_id").fill_null(-1))
            for lo, hi in steps(texts):
                raw, off = joined(texts.slice(lo, hi - lo))
                start, end, row, number = line_spans(raw, off)
                long = end - start >= least
                if short:
                    ink = np.concatenate([[0], np.cumsum(~_SPACE[raw])])
                    long |= ink[end] > ink[start]
                node = line_nodes(Rolling(raw), start[long], end[long])
                yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi][row[long]]), pa.array(number[long]), pa.array(node)], ["doc_id", "line", "node"])

    return run


def segments(n: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of the even segments of lines of n bytes, the shorter ones first."""
    size, longer = n // parts, n % parts
    out, at = [], np.zeros_like(n)
    for i in range(parts):
        length = size + (i >= parts - longer)
        out.append((at, length))
        at = at + length
    return out


def substrings(n: np.ndarray, edits: int):
    """(segment number, target length, start, length, is the line's own segment) of all probes of lines of n bytes."""
    parts = edits + 1
    for d in range(edits + 1):
        for i, (at, length) in enumerate(segments(n - d, parts)):
            for p in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                yield i, n - d, at + p, length, d == 0 and p == 0


@cache
def _bits(words: int) -> np.ndarray:
    """Of each word, the bit that a pair of bytes turns (none in all words but one)."""
    place = mix(np.arange(1 << 16, dtype=np.uint64))
    bit = np.uint64(1) << (place & np.uint64(63))
    return np.stack([np.where(place >> np.uint64(6) & np.uint64(words - 1) == k, bit, np.uint64(0)) for k in range(words)])


def pair_parity(raw: np.ndarray, start: np.ndarray, end: np.ndarray, words: int) -> np.ndarray:
    """Parities of the counts of byte pairs by hash: a row of `words` 64-bit words a line."""
    out = np.zeros((len(start), words), np.uint64)
    if not len(start):
        return out
    pair = raw.astype(np.intp)
    pair[:-1] = (pair[:-1] << 8) + pair[1:]
    last, before = end - 2, start - 1
    for k, bits in enumerate(_bits(words)):
        run = np.take(bits, pair)
        np.bitwise_xor.accumulate(run, out=run)
        out[:, k] = run[last] ^ np.where(start > 0, run[before], np.uint64(0))
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits sketches differ."""
    n = np.bitwise_count(x ^ y)
    return sum(n[..., k].astype(np.int16) for k in range(n.shape[-1]))


def _deal(edits: int, least: int, buckets: int):
    """Rows (bucket, keys, nodes, sketches): index entries and probes of the lines, many in one row."""

    def row_batch(held: list) -> pa.RecordBatch:
        key, own, sign = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = ((key >> np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, own, sign, bucket = key[order], own[order], sign[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = [(int(bucket[a]), key[a:b].tobytes(), own[a:b].tobytes(), sign[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*rows, strict=True))], ["bucket", "key", "node", "sign"])

    def run(batches):
        held, total, seen = [], 0, np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in steps(texts):
                raw, off = joined(texts.slice(lo, hi - lo))
                start, end, _, _ = line_spans(raw, off)
                long = end - start >= least
                start, end = start[long], end[long]
                hashes = Rolling(raw)
                node, one = np.unique(line_nodes(hashes, start, end), return_index=True)
                new = ~np.isin(node, seen)
                node, one = node[new], one[new]
                seen = np.concatenate([seen, node])
                start, end = start[one], end[one]
                if not len(node):
                    continue
                n = end - start
                sign = pair_parity(raw, start, end, SKETCH)
                for i, target, at, length, mine in substrings(n, edits):
                    salt = mix(target.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
                    h = mix(hashes(start + at, start + at + length) ^ salt)
                    # the lowest bit tells index entries, which probe too, from mere probes
                    held.append((h | np.uint64(1) if mine else h & ~np.uint64(1), node, sign))
                    total += len(node)
                if total > DEAL:
                    yield row_batch(held)
                    held, total, seen = [], 0, np.zeros(0, np.int64)
        if total:
            yield row_batch(held)

    return run


def _candidates(edits: int):
    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        key, node, sign = read("key", np.uint64), read("node", np.int64), read("sign", np.uint64).reshape(-1, SKETCH)
        index, key = (key & np.uint64(1)).astype(bool), key >> np.uint64(1)
        order = np.lexsort((~index, node, key))
        key, node, sign, index = key[order], node[order], sign[order], index[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = ~((key[1:] == key[:-1]) & (node[1:] == node[:-1]))
        key, node, sign, index = key[fresh], node[fresh], sign[fresh], index[fresh]
        starts = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))
        length = np.diff(starts, append=len(key))
        place = np.repeat(length, length)
        close = lambda x, y: _apart(x, y) <= 4 * edits
        a, b = [], []
        small = np.flatnonzero((place > 1) & (place <= SHORT))
        for d in range(1, SHORT):
            i = small[small + d < len(key)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                break
            i = i[(index[i] | index[i + d]) & close(sign[i], sign[i + d])]
            a.append(node[i])
            b.append(node[i + d])
        for s, k in zip(starts[length > SHORT], length[length > SHORT], strict=True):
            left = np.arange(s, s + k)
            while len(left) > 1 and index[left].any():  # a seed takes its near ones, they take theirs
                todo, left = [left[0]], left[1:]
                while todo and len(left):
                    x = todo.pop()
                    ok = (index[x] | index[left]) & close(sign[x], sign[left])
                    if ok.any():
                        a.append(np.full(int(ok.sum()), node[x]))
                        b.append(node[left[ok]])
                        todo += left[ok].tolist()
                        left = left[~ok]
        x, y = (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        x, y = spanning_forest(np.maximum(x, y), np.minimum(x, y))
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def within(a: bytes, b: bytes, k: int) -> bool:
    """Whether the edit distance of a and b is at most k: bit-parallel in a band of 2k + 1 diagonals."""
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > k:
        return False
    # what both begin or end with does not count
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x != y[:m])
    head = int(differ[0]) if len(differ) else m
    tail = 0
    if head < m:
        differ = np.flatnonzero(x[head:][::-1] != y[head:][::-1][: m - head])
        tail = int(differ[0]) if len(differ) else m - head
    a, b = a[head : m - tail], b[head : n - tail]
    m, n = len(a), len(b)
    if not m:
        return n <= k
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    width = 2 * k + 1
    mask = (1 << width) - 1
    # bit i of a column j (from 1) stands for row j - k + i; rows below 1 count as matched from above
    plus, minus, score = mask & (mask << k), 0, min(k, m)
    for j in range(1, n + 1):
        shift = j - k - 1
        found = where.get(b[j - 1], 0)
        found = (found >> shift if shift >= 0 else found << -shift) & mask
        diagonal = (((found & plus) + plus) ^ plus | found | minus) & mask
        right = minus | mask & ~(diagonal | plus)
        left = diagonal & plus
        if j + k <= m:  # the band's lowest row moves down with the column
            score += not diagonal >> 2 * k & 1
        else:  # the last row stays
            bit = m - j + k
            score += (right >> bit & 1) - (left >> bit & 1)
        if score > 3 * k:
            return False
        down = diagonal >> 1
        minus = down & right
        plus = (left | mask & ~(down | right)) & mask
    return score <= k


def _family_lines(bloom: np.ndarray, least: int):
    bits = np.uint64(FILTER_BITS - 1)

    def run(batches):
        known = np.unpackbits(bloom).astype(bool)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in steps(texts):
                raw, off = joined(texts.slice(lo, hi - lo))
                start, end, _, _ = line_spans(raw, off)
                long = end - start >= least
                start, end = start[long], end[long]
                node, one = np.unique(line_nodes(Rolling(raw), start, end), return_index=True)
                h = mix(node.astype(np.uint64))
                ok = known[(h & bits).astype(np.int64)] & known[(h >> np.uint64(32) & bits).astype(np.int64)]
                whole = raw.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array([whole[s:e] for s, e in zip(start[one][ok].tolist(), end[one][ok].tolist(), strict=True)], pa.binary())], ["node", "line"])

    return run


def _bloom_part(batches):
    part = np.zeros(FILTER_BITS, bool)
    bits, any_ = np.uint64(FILTER_BITS - 1), False
    for batch in batches:
        h = mix(np.asarray(batch.column("node")).astype(np.uint64))
        part[(h & bits).astype(np.int64)] = part[(h >> np.uint64(32) & bits).astype(np.int64)] = True
        any_ |= len(h) > 0
    if any_:
        packed = np.packbits(part)
        size = len(packed) // 64
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([packed[i * size : (i + 1) * size].tobytes() for i in range(64)], pa.binary())], ["part", "bits"])


def _bloom_merge(batches):
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            mine = found.setdefault(part, np.zeros(len(bits), np.uint8))
            mine |= np.frombuffer(bits, np.uint8)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([b.tobytes() for b in found.values()], pa.binary())], ["part", "bits"])


def bloom_of(nodes: DataFrame) -> np.ndarray:
    """Packed bits of a Bloom filter of FILTER_BITS bits and two hashes; its size does not grow with the nodes."""
    rows = nodes.select("node").mapInArrow(_bloom_part, "part int, bits binary").repartition("part").mapInArrow(_bloom_merge, "part int, bits binary").collect()
    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    size = len(packed) // 64
    for r in rows:
        packed[r["part"] * size : (r["part"] + 1) * size] |= np.frombuffer(r["bits"], np.uint8)
    return packed


def _verify(edits: int):
    def run(table: pa.Table) -> pa.Table:
        lines = dict(zip(table.column("node").to_pylist(), table.column("line").to_pylist(), strict=True))
        order = sorted(lines, key=lambda v: (len(lines[v]), v))
        parent = list(range(len(order)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        text = [lines[v] for v in order]
        raw = np.frombuffer(b"".join(text), np.uint8)
        size = np.array([len(t) for t in text])
        end = np.cumsum(size)
        sign = pair_parity(raw, end - size, end, VERIFY)
        root = np.arange(len(order))
        for i in range(1, len(order)):
            lo = int(np.searchsorted(size, size[i] - edits))
            near = lo + np.flatnonzero(_apart(sign[lo:i], sign[i]) <= 4 * edits)
            while len(near):  # the newest of each other component first; those that it joins need no look
                j = int(near[-1])
                if root[j] == root[i] or not within(text[j], text[i], edits):
                    near = near[:-1]
                    continue
                old, new = root[i], root[j]
                root[root == old] = new
                near = near[root[near] != root[i]]
        for i in range(len(order)):
            parent[i] = int(root[i])
        return pa.table({"node": pa.array(order, pa.int64()), "component": pa.array([order[find(i)] for i in range(len(order))], pa.int64())})

    return run


def removed_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, family_rows: int = FAMILY_ROWS, short: bool = False) -> DataFrame:
    """doc_id and the sorted numbers of the lines of it that go, for documents that lose any; short: copies of lines under `least` bytes go too."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    lines = materialize(docs.filter("doc_id is not null").mapInArrow(_occurrences(least, short), "doc_id long, line long, node long"), "lines")
    total = lines.count()
    probes = sum(1 for _ in substrings(np.array([least]), edits))
    buckets = buckets_for(spark, probes * total, BUCKET)
    dealt = docs.mapInArrow(_deal(edits, least, buckets), "bucket int, key binary, node binary, sign binary")
    edges = dealt.groupBy("bucket").applyInArrow(_candidates(edits), "a long, b long")
    families = connected_components(edges, "line-families")
    texts = docs.mapInArrow(_family_lines(bloom_of(families), least), "node long, line binary")
    whole = texts.join(families, "node").groupBy("node", "component").agg(F.min("line").alias("line"))
    exact = link_families(whole.withColumnRenamed("component", "family"), families.withColumnRenamed("component", "family"), _verify(edits), family_rows, "line-links")
    # one row a node before anything is joined, so that a line's occurrences never meet in one task
    nodes = lines.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes.join(exact, "node", "left").filter("n > 1 or component is not null").select("node", "first", "n", F.coalesce("component", "node").alias("c")), "line-nodes")
    firsts = nodes.groupBy("c").agg(F.min("first").alias("first"), F.sum("n").alias("_n")).filter("_n > 1").select("c", "first")
    marks = materialize(nodes.drop("first").join(firsts, "c").select("node", "first", "n"), "line-marks")
    # a node with a thousandth of all occurrences or more: there are at most a thousand such nodes, which go to the occurrences
    hot = marks.filter(F.col("n") * 1000 >= total).select("node", "first")
    rest = marks.filter(F.col("n") * 1000 < total).select("node", "first")
    placed = lines.join(F.broadcast(hot), "node").union(lines.join(F.broadcast(hot.select("node")), "node", "left_anti").join(rest, "node"))
    gone = placed.filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line") != F.col("first.line")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _without_lines(docs: DataFrame, edits: int, least: int, short: bool) -> tuple[DataFrame, str, str]:
    """docs with the lines gone and two more columns, whose names are given: lines before, lines gone."""
    owner, gone, before, count = (fresh(docs, n) for n in ("_doc", "_gone", "n_lines", "n_removed"))
    lost = removed_lines(docs, edits, least, short=short).toDF(owner, gone)
    j = docs.join(lost.hint("shuffle_hash"), docs["doc_id"] == lost[owner], "left")
    parts = F.split("text", "\n", -1)
    left = F.filter(parts, lambda x, i: ~F.array_contains(gone, i.cast("long")))
    out = j.withColumns({before: F.coalesce(F.size(parts), F.lit(0)).cast("long"), count: F.coalesce(F.size(gone), F.lit(0)).cast("long")})
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out, before, count


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, short: bool = False, emptied: bool = True) -> DataFrame:
    """docs without the lines that go; columns stay, n_chars follows the text.

    Every row stays, or without `emptied` all but those that lost lines and have no word left: what they held is in others.
    """
    out, _, count = _without_lines(docs, edits, least, short)
    if not emptied:
        out = out.filter((F.col(count) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(docs.columns)


def op1_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the kept text (null text: empty) of each document."""
    d, before, count = _without_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), EDITS, LEAST, short=True)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.col(before)).cast("long")
    return d.select("doc_id", n.alias("n_lines"), F.col(count).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
