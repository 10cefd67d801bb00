"""N-gram Jaccard join over a token-group matrix.

A document's set is its distinct 5-word shingles.  The join never compares all pairs:

1. One pass counts shingles in a sketch of fixed size (all documents, SKETCH counters); shingles in unusually full
   counters are called common.  Any such choice is correct, it only orders the shingles: rare before common, then by hash.
2. Documents that can reach the threshold share a shingle among the first |set| - ceil(t |set|) + 1 in that order.
   These go, many in one row, to buckets by hash; identical sets are one node, and copies merge before they move.  A
   bucket partitions its nodes into similar ones: sharing a shingle, sizes within t, and parity sketches not farther apart
   than links allow.  A token turns one bit of a sketch, so two sets differ in at most as many bits as tokens, and linked
   sets of a and b tokens in at most (1 - t) / (1 + t) of a + b: no link is lost.  Sketches have 128 to 512 bits, by the
   size of the set; a longer one folds to half its length for comparison with a shorter one.
   Sets of more than PART tokens go in parts: the range of hashes is cut into 4, 16, 64 ... of them.  Two sets that are
   linked have a part that both fill and that alone would link them (else their differences would add up to too much), so
   parts are dealt as if they were sets, and long documents are told apart as well as short ones.  A set goes out in the
   parts of its own size and in those of the greatest size that it can be linked with.
3. Each candidate component becomes a token-group matrix: groups of similar documents with the union of their shingles.
   A query document meets a group only if its overlap with the union can reach t |set|; only such groups are opened,
   and exact intersections decide, except between documents that are connected already.

Components follow from links; a lost executor repeats its tasks alone.  Hashes have 64 bits.  Null, empty or white texts
are linked with nothing; rows without doc_id link only as exact copies; repeated rows and ids are copies; of ties the smallest
doc_id stands for its component; a very long text is one row of a step; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, claim, connected_components, link_families, load, materialize, mix, shingles, small_batches, spanning_forest, steps

SKETCH = 1 << 20
CHUNK = 4096
#: Leading shingles that a task deals out at a time.
DEAL = 600_000
#: Tokens up to which a set goes out whole.
PART = 512
#: Leading shingles that a bucket holds, about.
BUCKET = 1 << 19
#: Posting lists up to this length are compared position by position, longer ones seed by seed.
SHORT = 24
#: Documents of a family that one task verifies; larger families are dealt to blocks.
FAMILY_ROWS = 8192
#: Shingles of a family that one task verifies.
FAMILY_TOKENS = 4_000_000


def _digest(tokens: np.ndarray) -> int:
    """A 63-bit digest of a sorted token set."""
    k = np.uint64(0x9E3779B97F4A7C15)
    spread = mix(tokens * k + np.uint64(len(tokens)))
    return int(mix(np.array([spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(spread ^ k))], np.uint64) * np.array([1, 3], np.uint64)).sum(dtype=np.uint64) >> np.uint64(1))


def _survey(batches):
    """Per document its digest and size; per task the counters of its shingles, CHUNK in a row."""
    claim("ngram_join")
    counts = np.zeros(SKETCH, np.uint32)
    shift = np.uint64(64 - SKETCH.bit_length() + 1)
    names = ["doc_id", "n", "digest", "chunk", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in steps(texts):
            n, digest, seen = [], [], set()
            for _, tokens in shingles(texts.slice(lo, hi - lo)):
                n.append(len(tokens))
                digest.append(_digest(tokens) if len(tokens) else None)
                if len(tokens) and digest[-1] not in seen:
                    seen.add(digest[-1])
                    np.add.at(counts, (tokens >> shift).astype(np.int64), np.uint32(1))
            k = hi - lo
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, k), pa.array(n, kinds[1]), pa.array(digest, kinds[2]), pa.nulls(k, kinds[3]), pa.nulls(k, kinds[4])], names)
    rows = [(i, counts[i * CHUNK : (i + 1) * CHUNK]) for i in range(SKETCH // CHUNK)]
    rows = [(i, c.tobytes()) for i, c in rows if c.any()]
    k = len(rows)
    if k:
        yield pa.RecordBatch.from_arrays([pa.nulls(k, kinds[0]), pa.nulls(k, kinds[1]), pa.nulls(k, kinds[2]), pa.array([r[0] for r in rows], kinds[3]), pa.array([r[1] for r in rows], kinds[4])], names)


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            mine = total.setdefault(chunk, np.zeros(CHUNK, np.int64))
            mine += np.frombuffer(counts.as_buffer(), np.uint32)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["chunk", "counts"])


def common_shingles(survey: DataFrame) -> np.ndarray:
    """Packed bits, one a counter: fuller than the mean by six deviations and 64."""
    rows = survey.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_add_up, "chunk int, counts binary").collect()  # SKETCH counters
    counts = np.zeros(SKETCH, np.int64)
    for r in rows:
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(r["counts"], np.int64)
    mean = np.median(counts)
    return np.packbits(counts > mean + 6 * np.sqrt(mean) + 64)


def _words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the sketch of a set of n tokens: 2, 4 or 8."""
    return np.where(n <= 182, 2, np.where(n <= 365, 4, 8))


def _parities(tokens: np.ndarray) -> bytes:
    bits = 64 * int(_words(np.int64(len(tokens))))
    count = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(count & 1, bitorder="little").tobytes()


def _depth(n: int) -> int:
    """How often the range of hashes is cut into four for a set of n tokens."""
    k = 0
    while n > PART << 2 * k:
        k += 1
    return k


def _parts(tokens: np.ndarray, percent: int):
    """(salt of the depth, tokens) of the parts that a set goes out in."""
    for k in range(_depth(len(tokens)), _depth(100 * len(tokens) // percent) + 1):
        edges = np.arange(1, 4**k, dtype=np.uint64) << np.uint64(64 - 2 * k) if k else np.zeros(0, np.uint64)
        for part in np.split(tokens, np.searchsorted(tokens, edges)):
            if len(part):
                yield np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), part


class Sketches:
    """Sizes and parity sketches of sets, and which of them can be linked."""

    def __init__(self, size: np.ndarray, raw: bytes, percent: int):
        self.size, self.percent, self.words = size.astype(np.int64), percent, _words(size)
        self.full, self.half = np.zeros((2, len(size), 8), np.uint64)
        flat, end = np.frombuffer(raw, np.uint64), np.cumsum(self.words)
        for k in (2, 4, 8):
            rows = np.flatnonzero(self.words == k)
            self.full[rows, :k] = flat[(end[rows] - k)[:, None] + np.arange(k)]
            self.half[rows, : k // 2] = self.full[rows, : k // 2] ^ self.full[rows, k // 2 : k]

    def near(self, x, y) -> np.ndarray:
        """Whether the sets x and y (row numbers) may be linked."""
        a, b = self.size[x], self.size[y]
        ok = 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)
        # sizes that fit differ by less than a factor of two for t over a half; sketches farther apart are not compared
        u = np.where((self.words[x] > self.words[y])[..., None], self.half[x], self.full[x])
        v = np.where((self.words[y] > self.words[x])[..., None], self.half[y], self.full[y])
        apart = np.bitwise_count(u ^ v).sum(-1, dtype=np.int64)
        far = (100 + self.percent) * apart > (100 - self.percent) * (a + b)
        return ok & ~(far & (2 * np.minimum(self.words[x], self.words[y]) >= np.maximum(self.words[x], self.words[y])))


def _deal(common: np.ndarray, buckets: int, percent: int):
    """Rows (bucket, nodes, sizes, minhashes, counts, tokens): the leading shingles of a step's documents by bucket."""

    def row_batch(node: list, size: list, signs: list, lead: list) -> pa.RecordBatch:
        tokens = np.concatenate(lead)
        owner = np.repeat(np.arange(len(node)), [len(x) for x in lead])
        bucket = (tokens % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((owner, bucket))
        tokens, owner, bucket = tokens[order], owner[order], bucket[order]
        node_, size_ = np.array(node, np.int64), np.array(size, np.int32)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        cols = [[] for _ in range(6)]
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            own, count = np.unique(owner[a:b], return_counts=True)
            for c, v in zip(cols, (int(bucket[a]), node_[own].tobytes(), size_[own].tobytes(), b"".join([signs[i] for i in own.tolist()]), count.astype(np.uint32).tobytes(), tokens[a:b].tobytes()), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "node", "size", "signs", "count", "tokens"])

    def run(batches):
        is_common = np.unpackbits(common).astype(bool)
        shift = np.uint64(64 - SKETCH.bit_length() + 1)
        held, seen, total = ([], [], [], []), set(), 0
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in steps(texts):
                for _, tokens in shingles(texts.slice(lo, hi - lo)):
                    d = _digest(tokens) if len(tokens) else None
                    if d is None or d in seen:
                        continue
                    seen.add(d)
                    for salt, part in _parts(tokens, percent):
                        n = len(part)
                        p = n - (percent * n + 99) // 100 + 1
                        late = is_common[(part >> shift).astype(np.int64)]
                        first = part[~late][:p]
                        if len(first) < p:
                            first = np.concatenate([first, part[late][: p - len(first)]])
                        for c, v in zip(held, (d, n, _parities(part), first ^ salt), strict=True):
                            c.append(v)
                        total += p
                if total > DEAL:
                    yield row_batch(*held)
                    held, seen, total = ([], [], [], []), set(), 0
        if total:
            yield row_batch(*held)

    return run


def _candidates(percent: int):
    def run(table: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        count = joined("count", np.uint32)
        rep = np.repeat(np.arange(len(count)), count)
        node, tokens = joined("node", np.int64), joined("tokens", np.uint64)
        sketches = Sketches(joined("size", np.int32), b"".join(table.column("signs").to_pylist()), percent)
        order = np.lexsort((node[rep], tokens))
        tokens, who = tokens[order], rep[order]
        own = node[who]
        same = tokens[1:] == tokens[:-1]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = ~(same & (own[1:] == own[:-1]))
        tokens, who, own = tokens[fresh], who[fresh], own[fresh]
        starts = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1)))
        length = np.diff(starts, append=len(tokens))
        place = np.repeat(length, length)
        a, b = [], []
        small = np.flatnonzero((place > 1) & (place <= SHORT))
        for d in range(1, SHORT):
            i = small[small + d < len(tokens)]
            i = i[tokens[i] == tokens[i + d]]
            if not len(i):
                break
            x, y = who[i], who[i + d]
            ok = sketches.near(x, y)
            a.append(own[i[ok]])
            b.append(own[i[ok] + d])
        for s, k in zip(starts[length > SHORT], length[length > SHORT], strict=True):
            left = who[s : s + k]
            while len(left) > 1:  # a seed takes its near ones, they take theirs
                todo, left = [left[0]], left[1:]
                while todo and len(left):
                    x = todo.pop()
                    ok = sketches.near(x, left)
                    if ok.any():
                        a.append(np.full(int(ok.sum()), node[x]))
                        b.append(node[left[ok]])
                        todo += left[ok].tolist()
                        left = left[~ok]
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            pair = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0)
            x, y = spanning_forest(pair[:, 0], pair[:, 1])
        else:
            x = y = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


class TokenGroupMatrix:
    """Groups of similar sets as columns of a bit matrix, tokens as rows; a column is the union of its group's tokens.

    Columns come in pages of 64 that hold the rows of their own tokens alone, so the matrix grows with the tokens of its
    groups.  A set that is put is linked to the sets it reaches; within a group, sets that are connected count as one.
    """

    def __init__(self, percent: int, tokens: int):
        self.percent = percent
        self.sets: list[np.ndarray] = []  # of token numbers, ascending
        self.parent: list[int] = []
        self.pages: list[tuple[np.ndarray, np.ndarray]] = []  # token numbers, ascending, and their bits
        self.groups: list[dict[int, list[int]]] = []  # root -> members
        self.mark = np.zeros(tokens, bool)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _bounds(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each group's union has."""
        out = [np.zeros(0, np.int64)]
        for own, bits in self.pages:
            at = np.searchsorted(own, tokens)
            at = at[own[np.minimum(at, len(own) - 1)] == tokens]
            out.append(np.unpackbits(bits[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64))
        return np.concatenate(out)[: len(self.groups)]

    def _enter(self, tokens: np.ndarray, group: int) -> None:
        bit = np.uint64(1) << np.uint64(group & 63)
        if group >> 6 == len(self.pages):
            self.pages.append((tokens, np.full(len(tokens), bit)))
            return
        own, bits = self.pages[group >> 6]
        at = np.searchsorted(own, tokens)
        have = own[np.minimum(at, len(own) - 1)] == tokens
        bits[at[have]] |= bit
        self.pages[group >> 6] = (np.insert(own, at[~have], tokens[~have]), np.insert(bits, at[~have], bit))

    def put(self, tokens: np.ndarray) -> None:
        me, n = len(self.sets), len(tokens)
        self.sets.append(tokens)
        self.parent.append(me)
        bounds = self._bounds(tokens)
        self.mark[tokens] = True
        for g in np.flatnonzero(100 * bounds >= self.percent * n):  # no other group has a member that shares enough
            self.groups[g] = self._open(self.groups[g], me, n)
        self.mark[tokens] = False
        home = int(bounds.argmax()) if len(bounds) else -1
        if home < 0 or 2 * bounds[home] < n:
            home = len(self.groups)
            self.groups.append({})
        self._enter(tokens, home)
        self.groups[home].setdefault(self.find(me), []).append(me)

    def _open(self, group: dict[int, list[int]], me: int, n: int) -> dict[int, list[int]]:
        """Link `me` (n marked tokens) with the group's members; the group's members by their present roots."""
        out: dict[int, list[int]] = {}
        for root, members in group.items():
            root = self.find(root)
            if root != self.find(me):
                for m in reversed(members):
                    other = self.sets[m]
                    if 100 * min(n, len(other)) >= self.percent * max(n, len(other)):
                        inter = int(self.mark[other].sum())
                        if 100 * inter >= self.percent * (n + len(other) - inter):
                            self.parent[root] = self.find(me)
                            break
            out.setdefault(self.find(root), []).extend(members)
        return out


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        texts = table.column("text").combine_chunks()
        node = table.column("node").to_pylist()
        sets: dict[int, np.ndarray] = {}
        for lo, hi in steps(texts):
            for row, tokens in shingles(texts.slice(lo, hi - lo)):
                row += lo
                if len(tokens) and _digest(tokens) == node[row]:  # the row whose text it was, should an id repeat
                    sets.setdefault(node[row], tokens)
        order = sorted(sets, key=lambda d: (len(sets[d]), d))
        if not order:
            return pa.table({"node": pa.array([], pa.int64()), "component": pa.array([], pa.int64())})
        every, number = np.unique(np.concatenate([sets[d] for d in order]), return_inverse=True)
        number = number.astype(np.int32)
        matrix = TokenGroupMatrix(percent, len(every))
        at = 0
        for d in order:
            matrix.put(number[at : at + len(sets[d])])
            at += len(sets[d])
        return pa.table({"node": pa.array(order, pa.int64()), "component": pa.array([order[matrix.find(i)] for i in range(len(order))], pa.int64())})

    return run


def jaccard_components(docs: DataFrame, percent: int = 80, family_rows: int = FAMILY_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links of Jaccard similarity percent/100 or more)."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    survey = materialize(docs.mapInArrow(_survey, "doc_id long, n long, digest long, chunk int, counts binary"), "survey")
    common = common_shingles(survey)
    rows = survey.filter("chunk is null").select("doc_id", "n", "digest")
    leading = rows.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    buckets = buckets_for(spark, int(leading), BUCKET)
    dealt = docs.mapInArrow(_deal(common, buckets, percent), "bucket int, node binary, size binary, signs binary, count binary, tokens binary")
    edges = dealt.groupBy("bucket").applyInArrow(_candidates(percent), "a long, b long")
    families = connected_components(edges, "families")
    first = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("weight"))
    wanted = families.join(first, families.node == first.digest).select("doc_id", "node", F.col("component").alias("family"), "weight")
    exact = link_families(docs.join(wanted, "doc_id").select("family", "node", "text"), wanted.select("family", "node", "weight"), _verify(percent), family_rows, "links", FAMILY_TOKENS)
    nodes = first.join(exact, first.digest == exact.node, "left").select("digest", "doc_id", F.coalesce("component", "digest").alias("class"))
    least = nodes.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    known = nodes.join(least, "class").select("digest", "component_id")
    return rows.join(known, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that are their component's smallest doc_id, with their columns."""
    gone = jaccard_components(docs, percent).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op9_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * x >= 80 * (p.n + q.n - x)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a) m USING (doc_id)
"""
