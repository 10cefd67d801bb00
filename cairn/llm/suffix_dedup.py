"""Removal of repeated byte strings by blockwise suffix sorting with ranks at cover positions.

A byte goes if some string of `width` bytes that covers it also starts earlier (smaller doc_id, or the same document and
an earlier start).  Texts count as UTF-8 bytes; strings lie within one document and are judged on the input.

* Buckets.  Of the `width` - GRAM + 1 grams in a string, the one with the least hash (the first of equals) is its
  anchor.  Equal strings have equal anchors at equal offsets, so a suffix's bucket is its anchor's hash, and one
  occurrence of an anchor stands for a run of suffixes, whose bytes are its context.
* Pruning.  One pass sends the anchors' hashes alone and learns which occur twice, in a filter of fixed size; suffixes
  of other anchors repeat nothing.  A second pass sends the contexts of the rest, equal contexts of a task only once.
* Sorting, one bucket at a time.  All suffixes of a bucket are aligned by their anchor, so every STEP-th column is a
  cover: any two suffixes reach it after the same number of bytes, fewer than STEP.  Ranks of the 64-byte strings at the
  cover columns come first, by doubling; a suffix then sorts by the few bytes before its first cover column, two
  overlapping ranks, and the few bytes after them.  Memory is that of one bucket's contexts, never of the whole text.

Nulls and texts shorter than `width` lose nothing.  Of rows that repeat a doc_id none is earlier than the other; what
one of them loses, the other loses at the same place.  A null doc_id counts as -1.  A very long text is one row of a step.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, buckets_for, joined, load, mix, small_batches, steps

WIDTH = 100
GRAM = 32
STEP = 4
#: Bytes of text that a bucket stands for, about.
BUCKET_BYTES = 1 << 24
#: Bits of the filter of repeated anchors, over all buckets.
FILTER_BITS = 1 << 26
#: Anchors, and bytes of contexts, that a task holds before it deals them out.
HOLD_ANCHORS = 500_000
HOLD_BYTES = 8 << 20


def anchors(texts: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """Bytes, hashes by position, and for each anchor occurrence: position, first and last suffix start, row, row start."""
    raw, off = joined(texts)
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < width:
        return raw, np.zeros(0, np.uint64), none, none, none, none, none
    with np.errstate(over="ignore"):
        h = Rolling(raw).grams(GRAM)
    # least hash in each window, ties to the first position: hash above, position below
    least = h & ~np.uint64(0xFFFFFFFF)
    least |= np.arange(len(h), dtype=np.uint64)
    size, window = 1, width - GRAM + 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + width <= off[1:][row])
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return raw, h, none, none, none, none, none
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    p, j1, j2 = anchor[first], start[first], start[last]
    return raw, h, p, j1, j2, row[j1], off[:-1][row[j1]]


def _anchor_hashes(width: int, buckets: int):
    """Rows (bucket, hashes): each anchor hash of a task once, its lowest bit set if the task has met it twice."""

    def row_batch(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, n, bucket = key[order], n[order], bucket[order]
        key = key << np.uint64(1) | (n > 1).astype(np.uint64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = [(int(bucket[a]), key[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "keys"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in steps(texts):
                _, h, p, *_ = anchors(texts.slice(lo, hi - lo), width)
                if len(p):
                    held.append(h[p] >> np.uint64(1))
                    total += len(p)
                if total > HOLD_ANCHORS:
                    yield row_batch(held)
                    held, total = [], 0
        if total:
            yield row_batch(held)

    return run


def _places(key: np.ndarray, region: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(key ^ np.uint64(0x8CB92BA72F3D8DD7))
    return ((x & np.uint64(0xFFFFFFFF)) % np.uint64(region)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(region)).astype(np.int64)


def _repeated(region: int):
    """A bucket's own part of the filter: bits of the hashes that came twice."""

    def run(table: pa.Table) -> pa.Table:
        key = np.sort(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64))
        same = key[1:] >> np.uint64(1) == key[:-1] >> np.uint64(1)
        twice = (key & np.uint64(1)).astype(bool)
        twice[1:] |= same
        bits = np.zeros(region, bool)
        for place in _places(key[twice] >> np.uint64(1), region):
            bits[place] = True
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return run


def _contexts(width: int, buckets: int, region: int, known: dict[int, bytes]):
    """Rows (bucket, ...) of contexts to sort, and rows (bucket, ..., none) of runs that a task knows to be repeated."""
    names = ["bucket", "doc", "pos", "hash", "far", "near", "bytes", "gone_doc", "gone_first", "gone_last"]
    kinds = [pa.int32(), *[pa.binary()] * 9]

    def row_batch(held: list[tuple]) -> pa.RecordBatch:
        doc, pos, key, far, near, whole = (np.concatenate([x[k] for x in held]) for k in range(6))
        raw = np.concatenate([x[6] for x in held])
        size = far - near + width
        # equal contexts: the earliest stands for all; what starts later is repeated throughout
        order = np.lexsort((pos, doc, whole))
        doc, pos, key, far, near, whole, size = (x[order] for x in (doc, pos, key, far, near, whole, size))
        begin = (np.cumsum(np.concatenate([x[3] - x[4] + width for x in held])) - np.concatenate([x[3] - x[4] + width for x in held]))[order]
        first = np.ones(len(whole), bool)
        first[1:] = whole[1:] != whole[:-1]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        later = ~first & ((doc != doc[lead]) | (pos != pos[lead]))
        cols: list[list] = [[] for _ in names]
        none = b""
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int32)
        stay = np.flatnonzero(first)
        stay = stay[np.argsort(bucket[stay], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[stay], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(stay)], strict=True):
            rows = stay[a:b]
            n = size[rows]
            take = np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            values = (int(bucket[rows[0]]), doc[rows].tobytes(), pos[rows].tobytes(), key[rows].tobytes(), far[rows].astype(np.uint8).tobytes(), near[rows].astype(np.uint8).tobytes(), raw[take].tobytes(), none, none, none)
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        gone = np.flatnonzero(later)
        if len(gone):
            spread = (mix(doc[gone].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            gone = gone[np.argsort(spread, kind="stable")]
            spread = np.sort(spread, kind="stable")
            cuts = np.flatnonzero(np.diff(spread, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(gone)], strict=True):
                rows = gone[a:b]
                values = (int(spread[a]), *[none] * 6, doc[rows].tobytes(), (pos[rows] - far[rows]).tobytes(), (pos[rows] - near[rows]).tobytes())
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches):
        bits = np.zeros((buckets, region // 8), np.uint8)
        for b, packed in known.items():
            bits[b] = np.frombuffer(packed, np.uint8)
        held, total = [], 0
        for batch in batches:
            texts, docs = batch.column("text"), np.asarray(batch.column("doc_id").fill_null(-1))
            for lo, hi in steps(texts):
                raw, h, p, j1, j2, row, row_start = anchors(texts.slice(lo, hi - lo), width)
                if not len(p):
                    continue
                key = h[p] >> np.uint64(1)
                bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
                ok = np.ones(len(p), bool)
                for place in _places(key, region):
                    ok &= (bits[bucket, place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                p, j1, j2, row, row_start, key = (x[ok] for x in (p, j1, j2, row, row_start, key))
                if not len(p):
                    continue
                size = j2 - j1 + width
                whole = mix(Rolling(raw)(j1, j1 + size) ^ (p - j1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                take = np.repeat(j1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                held.append((docs[lo:hi][row], p - row_start, key, p - j1, p - j2, whole, raw[take]))
                total += int(size.sum())
                if total > HOLD_BYTES:
                    yield row_batch(held)
                    held, total = [], 0
        if held:
            yield row_batch(held)

    return run, ", ".join(["bucket int", *(f"{n} binary" for n in names[1:])])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of non-negative integers, each key packed on while it fits 63 bits."""
    rank, top = keys[0].astype(np.int64), int(keys[0].max()) + 1 if len(keys[0]) else 1
    for k in keys[1:]:
        high = int(k.max()) + 1 if len(k) else 1
        if top * high >= 1 << 62:
            rank = np.unique(rank, return_inverse=True)[1]
            top = int(rank.max()) + 1
        rank = rank * high + k
        top *= high
    return np.unique(rank, return_inverse=True)[1]


def _bytes_key(matrix: np.ndarray, a: int, b: int) -> np.ndarray:
    out = np.zeros(len(matrix), np.int64)
    for c in range(a, b):
        out = out << 8 | matrix[:, c]
    return out


def sort_bucket(group: np.ndarray, doc: np.ndarray, pos: np.ndarray, far: np.ndarray, near: np.ndarray, matrix: np.ndarray, width: int) -> np.ndarray:
    """Whether the suffix at offset o before its anchor has an equal, earlier one in its group: rows by far + 1 offsets.

    Rows come in order of (doc, pos); row r of the matrix holds the bytes around its anchor, which is at column `reach`.
    """
    reach = width - GRAM
    columns = range(0, matrix.shape[1] - 63, STEP)
    # ranks at cover columns: 4 bytes, then doubled to 64
    rank = {c: _bytes_key(matrix, c, c + 4) for c in range(0, matrix.shape[1] - 3, STEP)}
    size = 4
    while size < 64:
        rank = {c: _dense(rank[c], rank[c + size]) for c in rank if c + size in rank}
        size *= 2
    assert all(c in rank for c in columns)
    repeated = np.zeros((len(doc), reach + 1), bool)
    for o in range(reach + 1):
        rows = np.flatnonzero((near <= o) & (o <= far))
        if len(rows) < 2:
            continue
        s = reach - o
        c = -(-s // STEP) * STEP
        d = (s + width - 64) // STEP * STEP
        part = matrix[rows]
        k = _dense(group[rows], _bytes_key(part, s, c), rank[c][rows], rank[d][rows], _bytes_key(part, d + 64, s + width))
        first = np.full(int(k.max()) + 1, len(rows))
        np.minimum.at(first, k, np.arange(len(rows)))
        lead = rows[first[k]]
        repeated[rows, o] = (doc[rows] != doc[lead]) | (pos[rows] != pos[lead])
    return repeated


def _sort(width: int):
    reach = width - GRAM

    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        out = [(read("gone_doc", np.int64), read("gone_first", np.int64), read("gone_last", np.int64))]
        doc, pos, key, far, near, raw = read("doc", np.int64), read("pos", np.int64), read("hash", np.uint64), read("far", np.uint8).astype(np.int64), read("near", np.uint8).astype(np.int64), read("bytes", np.uint8)
        if len(doc):
            size = far - near + width
            begin = np.cumsum(size) - size
            group, count = np.unique(key, return_inverse=True, return_counts=True)[1:]
            rows = np.flatnonzero(count[group] > 1)
            rows = rows[np.lexsort((pos[rows], doc[rows]))]
            n = size[rows]
            matrix = np.zeros((len(rows), reach + width), np.uint8)
            flat = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            line = np.repeat(np.arange(len(rows)), n)
            matrix[line, flat + np.repeat(reach - far[rows], n)] = raw[flat + np.repeat(begin[rows], n)]
            doc, pos = doc[rows], pos[rows]
            found = sort_bucket(group[rows], doc, pos, far[rows], near[rows], matrix, width)
            # runs of offsets; a larger offset is an earlier start
            edge = np.zeros((len(rows), reach + 3), np.int8)
            edge[:, 1:-1] = found
            step = np.diff(edge, axis=1)
            r, lo = np.nonzero(step == 1)
            hi = np.nonzero(step == -1)[1] - 1
            out.append((doc[r], pos[r] - hi, pos[r] - lo))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"doc": pa.array(a, pa.int64()), "first": pa.array(b, pa.int64()), "last": pa.array(c, pa.int64())})

    return run


def repeated_starts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, first, last): runs of starts of strings that also start earlier, by byte position."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(spark, size, BUCKET_BYTES)
    region = max(FILTER_BITS // buckets // 8 * 8, 8)
    parts = docs.select("text").mapInArrow(_anchor_hashes(width, buckets), "bucket int, keys binary").groupBy("bucket").applyInArrow(_repeated(region), "bucket int, bits binary")
    known = {r["bucket"]: bytes(r["bits"]) for r in parts.collect()}  # FILTER_BITS bits, however many anchors there are
    run, schema = _contexts(width, buckets, region, known)
    return docs.mapInArrow(run, schema).groupBy("bucket").applyInArrow(_sort(width), "doc long, first long, last long")


def removed_runs(first: np.ndarray, last: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start at first..last."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + width))
        else:
            out.append((a, b + width))
    return out


def dedup_suffixes(docs: DataFrame, width: int = WIDTH, digests_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (their digest with digests_only) of each document."""
    runs = repeated_starts(docs, width).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    whole = docs.select("doc_id", "text").join(runs.hint("shuffle_hash"), F.coalesce("doc_id", F.lit(-1).cast("long")) == F.col("doc"), "left").select("doc_id", "text", "runs")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests_only else "kept"]

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, runs_ in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                raw = (text or "").encode()
                spans = []
                if runs_.is_valid:
                    v = runs_.values
                    spans = removed_runs(np.asarray(v.field("first")), np.asarray(v.field("last")), width)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join(kept) + raw[at:]
                rows.append((i, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest() if digests_only else kept))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string() if digests_only else pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return whole.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {names[-1]} {'string' if digests_only else 'binary'}")


def op8_cover_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(load(spark, sf_dir, "documents"), digests_only=True)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS j FROM d WHERE n >= 100),
k AS (SELECT doc_id, j, md5_number(substr(h, (2 * j + 1)::BIGINT, 200)) AS k FROM w),
r AS (SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY k ORDER BY doc_id, j) AS c FROM k) WHERE c > 1),
i AS (SELECT doc_id, j, CASE WHEN j <= lag(j) OVER (PARTITION BY doc_id ORDER BY j) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, j, sum(fresh) OVER (PARTITION BY doc_id ORDER BY j) AS g FROM i),
s AS (SELECT doc_id, g, min(j) AS a, max(j) + 100 AS b FROM g GROUP BY doc_id, g),
x AS (SELECT doc_id, count(*) AS c, sum(b - a) AS m, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY doc_id),
p AS (SELECT d.doc_id, n, coalesce(c, 0) AS c, coalesce(m, 0) AS m, h, [0] || coalesce(b, []) AS f, coalesce(a, []) || [n] AS t FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, n AS n_bytes, m::BIGINT AS n_removed, c::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(f) + 1), lambda q: substr(h, (2 * f[q] + 1)::BIGINT, (2 * (t[q] - f[q]))::BIGINT)), ''))) AS kept_sha256
FROM p
"""
