"""Helpers shared by the operators: reading, scratch tables, batch slicing, components."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds a Python worker's memory.
STEP_BYTES = 1 << 20


#: Rows that Spark hands to a Python worker at a time; texts may be long, so fewer than its default.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger, for the JVM's and the workers' memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_resident: list = []


def claim(owner: str, clear: Callable[[], object] | None = None) -> None:
    """Called as an operator's task starts in a Python worker: what another operator keeps there between tasks is let go."""
    if _resident and _resident[0] != owner and _resident[1] is not None:
        _resident[1]()
    _resident[:] = [owner, clear]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where none is set in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


#: Scratch tables that still exist, and their sessions.
_written: dict[str, SparkSession] = {}


@atexit.register
def _delete_all() -> None:
    """At the end of the session, remove what is left."""
    for path, spark in list(_written.items()):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the cluster may be gone by then
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cairn-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = spark
    out._scratch = path
    return out


def release(df: DataFrame | None) -> None:
    """Remove the files of a frame that materialize returned, when nothing will read it again."""
    path = getattr(df, "_scratch", None)
    if path and _written.pop(path, None):
        _delete(df.sparkSession, path)


def buckets_for(spark: SparkSession, entries: int, each: int) -> int:
    """Buckets that hold about `each` entries, and four a shuffle partition at least: their number follows the input."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // each))


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about `limit` bytes of text each (one row at least)."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total = np.cumsum(sizes)
    lo = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield lo, hi
        lo = hi


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and row offsets (null: empty)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], dtype=kind, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's): spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Odd base of the polynomial byte hash modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, STEP_BYTES + (1 << 17)), np.uint64)
        have[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if len(have) <= 4 << 20:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Hashes of any substring of a byte buffer, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.inverse = powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = raw.astype(np.uint64)
        terms += np.uint64(1)
        terms *= powers(_BASE, n)
        np.cumsum(terms, out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        """Hashes of the substrings of one size at every position."""
        out = self.sums[size:] - self.sums[:-size]
        out *= self.inverse[: len(out)]
        out += np.uint64(size) * np.uint64(0x2545F4914F6CDD1D)
        return mix(out)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than ASCII white space, cut at row ends), and the first word of each row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | cut[1:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | cut[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def shingles(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct 64-bit hashes of the row's word shingles (A-Z lower-cased).

    A row with fewer words than `width` has the whole sequence as its one shingle; a row without words has none.
    """
    raw, off = joined(texts)
    raw = _LOWER[raw]
    start, end, first = word_spans(raw, off)
    word = Rolling(raw)(start, end) if len(start) else np.zeros(0, np.uint64)
    k = np.uint64(0xD6E8FEB86659FD93)
    run = np.zeros(max(len(word) - width + 1, 0), np.uint64)
    for i in range(width):
        run = run * k + word[i : len(word) - width + 1 + i] if len(run) else run
    run = mix(run)
    for row in range(len(off) - 1):
        a, b = int(first[row]), int(first[row + 1])
        if b - a >= width:
            yield row, np.unique(run[a : b - width + 1])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for i in range(a, b):
                h = h * k + word[i : i + 1]
            yield row, mix(h + np.uint64(b - a))
        else:
            yield row, np.zeros(0, np.uint64)


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, smallest node) connecting just what the edges a-b connect; vectorised min-label propagation."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        new = new[label]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component): smallest node reachable, for every node of an edge table (a, b) of longs.

    Alternates "large star" and "small star" steps until nothing changes, each a grouped minimum and a join;
    every step is written to the shared checkpoint folder.  Partial spanning forests per partition shrink the
    edges before they move.  Nothing is collected but a count per round.
    """

    def forest(batches):
        a, b = [], []
        size = 0
        for batch in batches:
            a.append(np.asarray(batch.column("a")))
            b.append(np.asarray(batch.column("b")))
            size += len(a[-1])
            if size > 4_000_000:
                x, y = spanning_forest(np.concatenate(a), np.concatenate(b))
                a, b, size = [x], [y], len(x)
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                    a, b, size = [], [], 0
        if size:
            x, y = spanning_forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    shrink = lambda e: e.select("a", "b").mapInArrow(forest, "a long, b long")
    # a family meets in many partitions, mostly under the same smallest node: equal edges go before the rounds start
    # (and one Python worker a task is enough: no second one behind the operator that makes the edges)
    now = materialize(shrink(edges.select("a", "b").distinct()), tag)
    while True:
        # every node hands its smallest neighbour to its larger neighbours, and to its smaller ones
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = now.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
        pulled = now.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        large = moved.union(pulled).filter("a <> b")
        nxt = materialize(shrink(large.distinct()), tag)
        done = nxt.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty() and nxt.join(nxt.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        release(now)
        now = nxt
        if done:
            break
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(
        now.select("b", "b").distinct().toDF("node", "component")
    )


def link_families(rows: DataFrame, members: DataFrame, verify: Callable[[pa.Table], pa.Table], limit: int, tag: str, heavy: int = 0) -> DataFrame:
    """(node, component): exact components inside candidate families, no task holding more than about 2 * limit rows
    (nor, with heavy, of more than about 2 * heavy in weight, but for a single row).

    rows: family, node and what `verify` reads; members: family, node and, with heavy, weight, for counting; verify maps a table of rows to (node, component), component being a node
    of the table.  Families over the limit are dealt to blocks.  Blocks are verified alone, then one row of each
    component found is compared with those of the other blocks, which connects a family of real copies; only families
    that are still apart compare every pair of blocks.
    """
    out = "node long, component long"
    load_ = F.count(F.lit(1)) / limit
    if heavy:
        load_ = F.greatest(load_, F.sum("weight") / heavy)
    sizes = members.groupBy("family").agg(F.ceil(load_).cast("int").alias("_blocks")).filter("_blocks > 1")
    if sizes.isEmpty():
        return materialize(rows.groupBy("family").applyInArrow(verify, out), tag)
    rows = materialize(rows, f"{tag}-rows")
    dealt = rows.join(sizes, "family", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    first = materialize(dealt.groupBy("family", "_block").applyInArrow(verify, out), f"{tag}-blocks")
    large = dealt.filter("_blocks > 1")
    # one row of each component of each block
    chosen = large.join(first.select(F.col("component").alias("node")).distinct(), "node", "left_semi").select(rows.columns)
    if chosen.count() < large.count():
        second = link_families(chosen, members.join(chosen.select("node"), "node", "left_semi"), verify, limit, tag, heavy)
    else:  # nothing was linked inside a block, so choosing would not make the families smaller
        second = rows.sparkSession.createDataFrame([], out)
    label = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
    label = materialize(label, tag)
    apart = large.select("family", "node").join(label, "node").groupBy("family").agg(F.count_distinct("component").alias("_n")).filter("_n > 1").select("family")
    pairs = large.join(apart, "family", "left_semi").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).filter("_other <> _block")
    pairs = pairs.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")})
    if apart.isEmpty():
        return label
    more = pairs.groupBy("family", "_i", "_j").applyInArrow(verify, out)
    edges = more.select(F.greatest("node", "component").alias("a"), F.least("node", "component").alias("b")).union(label.select(F.greatest("node", "component"), F.least("node", "component"))).filter("a <> b")
    joined_ = connected_components(edges, f"{tag}-joined").withColumnRenamed("component", "_c")
    return materialize(label.join(joined_, "node", "left").select("node", F.coalesce("_c", "node").alias("component")), tag)
