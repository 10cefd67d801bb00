"""Embedding near-duplicates by NN-descent: a neighbour graph refined through joins of neighbours' neighbours.

Equal vectors are one node with a multiplicity.  Random-projection trees start the graph: a leaf is cut into runs of at
most LEAF nodes along one more projection, so no leaf grows with a hot group.  Each round joins, at every node, its
neighbours and the nodes it is a neighbour of, and compares them pairwise; lists keep the nearest K.  Rounds end when
they hardly add pairs near the threshold.  An audit compares nodes, chosen by hash, with all nodes, AUDIT of them first and
then more until it has seen SEEN links or every node; while the lists hold less than WANTED of its links, more trees and
rounds follow, and after MOST_TREES the audit goes through all nodes, whose links are then complete.  Links that an audit
finds are added.  Then every linked component is compared whole, block by block, with counts instead of pairs as results:
links that the lists miss inside a component count too, and lists that are saturated (all K neighbours over the threshold)
grow to all of it; the audit leaves links inside a saturated component out.
A saturated list may hold nothing but its own family, so trees over the saturated nodes alone follow, in which a node's own
component does not count, until such trees link no more components.

Cosines are computed in double precision; none below the threshold links.  Null vectors, zero vectors and vectors with
null or non-finite components link with nothing, and rows without vec_id are no one's neighbour; vectors of different lengths are not compared.  Repeated rows are
copies, and so are repeated ids; equally near neighbours enter lists by smallest id; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, load, materialize, release, small_batches

K = 8
LEAF = 256
TREES = 3
ROUNDS = 6
AUDIT = 256
WANTED = 0.98
#: Links that an audit has to see before its recall counts, unless it has gone through all nodes.
SEEN = 1000
MOST_TREES = 8 * TREES
#: Bytes of vectors that one pass of the audit sends to every task.
PASS_BYTES = 1 << 22
#: Nodes of a block when a saturated component is compared whole.
BLOCK = 1024


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _prepare(kind: str):
    def run(batches):
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_pylist(), batch.column("embedding")
            flat = np.asarray(pa.array(vectors.flatten()).cast(pa.float64()).fill_null(np.nan)).astype(kind)
            size = np.array([0 if n is None else n for n in pa.compute.list_value_length(vectors).to_pylist()], np.int64)
            end = np.cumsum(size)
            out = []
            for i, a, b in zip(ids, end - size, end, strict=True):
                v = flat[a:b]
                ok = b > a and np.isfinite(v).all() and v.any()
                out.append((i, v.tobytes() if ok else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["vec_id", "x"])

    import pyarrow.compute  # noqa: F401

    return run


def _place(trees: range, depth: int, kind: str):
    """Each node once a tree: its leaf and where it lies on one more projection."""

    def run(batches):
        for batch in batches:
            raw, ids = batch.column("x").to_pylist(), batch.column("node")
            sizes = np.array([len(x) for x in raw])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = unit([raw[i] for i in rows], kind)
                for t in trees:
                    r = np.random.default_rng([t, int(size)]).standard_normal((x.shape[1], depth + 1))
                    p = x @ r
                    leaf = ((p[:, :depth] > 0) @ (1 << np.arange(depth))).astype(np.int64) if depth else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t), pa.int32()), pa.array(np.full(len(x), size), pa.int32()), pa.array(leaf), pa.array(p[:, depth]), *(c.take(pa.array(rows)) for c in (ids, batch.column("component"), batch.column("x")))],
                        ["tree", "size", "leaf", "along", "node", "component", "x"],
                    )

    return run


def _nearest_rows(ids: np.ndarray, of: np.ndarray, s: np.ndarray, k: int):
    """(u, v, s) of each row's k greatest entries of s, those of its own component apart."""
    s[of[:, None] == of] = -2
    k = min(k, len(ids) - 1)
    if k <= 0:
        return None
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(s, top, 1).ravel()
    ok = near > -2
    return np.repeat(ids, k)[ok], ids[top].ravel()[ok], near[ok]


def _table(parts: list) -> pa.RecordBatch:
    u, v, s = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "s"])


def _leaves(kind: str):
    """Rows come sorted by tree, size, leaf and projection; runs of at most LEAF of one leaf are compared pairwise."""

    def run(batches):
        key, ids, of, raw = None, [], [], []

        def close():
            if len(ids) > 1:
                x = unit(raw, kind)
                found = _nearest_rows(np.array(ids), np.array(of), x @ x.T, K)
                if found:
                    yield found

        for batch in batches:
            parts = []
            cols = [batch.column(c).to_pylist() for c in ("tree", "size", "leaf", "node", "component", "x")]
            for t, n, leaf, node, own, x in zip(*cols, strict=True):
                if key != (t, n, leaf) or len(ids) >= LEAF:
                    parts += close()
                    ids, of, raw, key = [], [], [], (t, n, leaf)
                ids.append(node)
                of.append(own)
                raw.append(x)
            if parts:
                yield _table(parts)
        rest = list(close())
        if rest:
            yield _table(rest)

    return run


def _local_join(kind: str):
    """Rows come sorted by centre; what meets at a centre is compared pairwise, and pairs that improve a list stay."""

    def run(batches):
        centre, ids, raw, least = None, [], [], []

        def close():
            if len(ids) > 1:
                x, worst, who = unit(raw, kind), np.array(least), np.array(ids)
                s = x @ x.T
                i, j = np.nonzero(s > worst[:, None])
                off = who[i] != who[j]
                i, j = i[off], j[off]
                if len(i):
                    yield who[i], who[j], s[i, j]

        for batch in batches:
            parts = []
            for c, w, x, t in zip(*(batch.column(n).to_pylist() for n in ("centre", "w", "x", "worst")), strict=True):
                if c != centre:
                    parts += close()
                    centre, ids, raw, least = c, [], [], []
                ids.append(w)
                raw.append(x)
                least.append(t)
            if parts:
                yield _table(parts)
        rest = list(close())
        if rest:
            yield _table(rest)

    return run


def _nearest(edges: DataFrame, k: int, by: str = "u", other: str = "v") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("s"), other)
    return edges.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)


def _descend(nodes: DataFrame, graph: DataFrame, kind: str) -> DataFrame:
    """One round: the graph's lists after joining neighbours of neighbours."""
    worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= K, F.min("s")).otherwise(-2.0).alias("worst"))
    forward = graph.select(F.col("u").alias("centre"), F.col("v").alias("w"))
    backward = _nearest(graph, K, "v", "u").select(F.col("v").alias("centre"), F.col("u").alias("w"))
    met = forward.union(backward).distinct()
    known = nodes.select(F.col("node").alias("w"), "x").join(worst.withColumnRenamed("u", "w"), "w")
    met = met.join(known, "w").repartition("centre").sortWithinPartitions("centre")
    new = met.mapInArrow(_local_join(kind), "u long, v long, s double")
    both = graph.select("u", "v", "s").union(new).groupBy("u", "v").agg(F.max("s").alias("s"))
    return materialize(_nearest(both, K).select("u", "v", "s"), "graph")


def _grow_trees(nodes: DataFrame, trees: range, count: int, kind: str) -> DataFrame:
    """Lists of the K nearest nodes met in a leaf that are of another component."""
    depth = max(0, int(np.ceil(np.log2(max(count, 1) / (LEAF / 2)))))
    placed = nodes.select("node", "component", "x").mapInArrow(_place(trees, depth, kind), "tree int, size int, leaf long, along double, node long, component long, x binary")
    runs = placed.repartitionByRange("tree", "size", "leaf", "along", "node").sortWithinPartitions("tree", "size", "leaf", "along", "node")
    return runs.mapInArrow(_leaves(kind), "u long, v long, s double")


def _truth(labelled: DataFrame, asked: list, kind: str, threshold: float) -> DataFrame:
    """(u, v): links of the asked rows by comparing them with all nodes, but for those inside a saturated component."""
    q = {}
    for r in asked:
        q.setdefault(len(r["x"]), []).append((r["node"], r["component"], r["saturated"], bytes(r["x"])))

    def run(batches):
        units = {n: (*(np.array(c) for c in list(zip(*v, strict=True))[:3]), unit([r[3] for r in v], kind)) for n, v in q.items()}
        for batch in batches:
            ids, of, raw = np.asarray(batch.column("node")), np.asarray(batch.column("component")), batch.column("x").to_pylist()
            sizes = np.array([len(x) for x in raw])
            for n, (who, mine, whole, x) in units.items():
                rows = np.flatnonzero(sizes == n)
                y = unit([raw[i] for i in rows], kind).T if len(rows) else None
                for lo in range(0, len(who) if len(rows) else 0, BLOCK):
                    i, j = np.nonzero(x[lo : lo + BLOCK] @ y >= threshold)
                    i, j = i + lo, rows[j]
                    ok = (who[i] != ids[j]) & ~(whole[i] & (mine[i] == of[j]))
                    yield pa.RecordBatch.from_arrays([pa.array(who[i[ok]], pa.int64()), pa.array(ids[j[ok]], pa.int64())], ["u", "v"])

    return labelled.select("node", "component", "x").mapInArrow(run, "u long, v long")


def _audit(nodes: DataFrame, families: DataFrame, saturated: DataFrame, links: DataFrame, count: int, width: int, kind: str, threshold: float, whole: bool):
    """Links seen (each once a node asked), those among them that `links` holds, and tables (a, b) of the links seen.

    Nodes are dealt to blocks of about AUDIT by hash; blocks are asked until SEEN links are seen, or all of them (whole).
    """
    blocks = max(1, round(count / AUDIT))
    most = max(1, PASS_BYTES // (AUDIT * max(width, 1)))
    marked = families.join(saturated.withColumn("saturated", F.lit(True)), "component", "left")
    labelled = nodes.select("node", "x").join(marked, "node", "left").select(
        "node", "x", F.coalesce("component", "node").alias("component"), F.coalesce("saturated", F.lit(False)).alias("saturated"), F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block")
    )
    labelled = materialize(labelled, "audited")
    seen, found, tables, at, step = 0, 0, [], 0, 1
    while at < blocks and (whole or seen < SEEN):
        step = min(most, step)
        asked = labelled.filter((F.col("block") >= at) & (F.col("block") < at + step)).drop("block").collect()
        at, step = at + step, 2 * step
        truth = _truth(labelled, asked, kind, threshold).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        tables.append(materialize(truth, "audit-links"))
        got = tables[-1].join(links.withColumn("had", F.lit(True)), ["a", "b"], "left").agg(F.count(F.lit(1)).alias("seen"), F.count("had").alias("found")).first()
        seen, found = seen + got["seen"], found + got["found"]
    return seen, found, tables


def _count_components(kind: str, threshold: float):
    """Links inside a component, by multiplicity, of each of its nodes; rows come sorted by component."""

    def run(batches):
        component, ids, mult, raw = None, [], [], []

        def close():
            if ids:
                links = (x := unit(raw, kind)) @ x.T >= threshold
                np.fill_diagonal(links, False)
                yield np.array(ids), links @ np.array(mult)

        for batch in batches:
            parts = []
            for c, w, m, x in zip(*(batch.column(n).to_pylist() for n in ("component", "node", "mult", "x")), strict=True):
                if c != component:
                    parts += close()
                    component, ids, mult, raw = c, [], [], []
                ids.append(w)
                mult.append(m)
                raw.append(x)
            if parts:
                yield _counts(parts)
        rest = list(close())
        if rest:
            yield _counts(rest)

    return run


def _counts(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], ["u", "n"])


def _count_blocks(kind: str, threshold: float):
    """Links between two blocks of one component, as counts (by multiplicity) per node."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, mult, raw = (table.column(c).to_pylist() for c in ("side", "node", "mult", "x"))
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        side, ids, mult = np.array(side), np.array(ids), np.array(mult)
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        x = unit(raw, kind)
        links = x[a] @ x[b].T >= threshold
        if same:
            np.fill_diagonal(links, False)
        u, n = [ids[a]], [links @ mult[b]]
        if not same:
            u.append(ids[b])
            n.append(links.T @ mult[a])
        return pa.table({"u": pa.array(np.concatenate(u), pa.int64()), "n": pa.array(np.concatenate(n), pa.int64())})

    return run


def _families(links: DataFrame, over: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all linked nodes, and the components that have a node whose whole list is over the threshold."""
    families = materialize(connected_components(links, "vector-families"), "families")
    full = over.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= K)
    return families, materialize(full.join(families, full.u == families.node).select("component").distinct(), "saturated")


def _bridges(nodes: DataFrame, links: DataFrame, over: DataFrame, trees: int, kind: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links (a, b) with those between saturated components, by trees from the given number on until these link no more of them; their families."""
    found = links
    while True:
        families, saturated = _families(found, over)
        whole = nodes.join(families.join(saturated, "component"), "node")
        size = whole.agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).first()
        if size["least"] == size["most"]:
            return found, families, saturated
        met = _grow_trees(whole, range(trees, trees + TREES), size["n"], kind).filter(F.col("s") >= threshold)
        more = materialize(met.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "bridges")
        if more.isEmpty():
            return found, families, saturated
        found, trees = materialize(found.union(more), "links"), trees + TREES


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept of each vector.

    report is called after each audit with the links that it saw and those among them that the lists held.
    """
    small_batches(vectors.sparkSession)
    element = dict(vectors.dtypes)["embedding"]
    kind = "<f4" if "float" in element else "<f8"
    rows = vectors.select("vec_id", "embedding").mapInArrow(_prepare(kind), "vec_id long, x binary")
    rows = materialize(rows.withColumn("key", F.sha2("x", 256)), "vectors")
    nodes = rows.filter("x is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("mult"), F.first("x").alias("x"))
    nodes = materialize(nodes, "nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("x")).alias("width")).first()
    count, width = size["n"], size["width"] or 0
    near = F.col("s") >= threshold - 0.05
    trees, graph, links = 0, None, None
    each = nodes.withColumn("component", F.col("node"))
    while True:
        fresh = _grow_trees(each, range(trees, trees + TREES), count, kind)
        fresh = fresh if graph is None else fresh.union(graph)
        graph = materialize(_nearest(fresh.groupBy("u", "v").agg(F.max("s").alias("s")), K).select("u", "v", "s"), "graph")
        trees += TREES
        have = graph.filter(near).count()
        for _ in range(ROUNDS):
            before, graph = graph, _descend(nodes, graph, kind)
            if graph is not before:
                release(before)
            now = graph.filter(near).count()
            if now - have <= 0.001 * max(now, 1):
                break
            have = now
        over = graph.filter(F.col("s") >= threshold)
        known = over.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        known = known if links is None else known.union(links)
        # the numbers of these trees are far from those of the trees above
        links, families, saturated = _bridges(nodes, materialize(known.distinct(), "links"), over, 1000 * trees, kind, threshold)
        seen, found, tables = _audit(nodes, families, saturated, links, count, width, kind, threshold, trees >= MOST_TREES)
        if report:
            report(seen, found)
        if found >= WANTED * seen or trees >= MOST_TREES:
            break
    if found < seen:
        links = materialize(reduce(DataFrame.union, tables, links).distinct(), "links")
        families, saturated = _families(links, over)
    # links are counted inside components, all pairs of them: those of a block at once, larger ones block by block
    sizes = families.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    whole = families.join(sizes, "component").join(nodes, "node").select("component", "node", "mult", "x", "blocks")
    one = whole.filter("blocks = 1").repartition("component").sortWithinPartitions("component", "node")
    counts = one.select("component", "node", "mult", "x").mapInArrow(_count_components(kind, threshold), "u long, n long")
    dealt = whole.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("component", "node", "mult", "x", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("component", "node", "mult", "x", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("block") > F.col("o")).cast("int").alias("side"))
    many = dealt.groupBy("component", "i", "j").applyInArrow(_count_blocks(kind, threshold), "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    counts = counts.union(many)
    table = nodes.select("key", "node", "mult").join(families, "node", "left").join(counts, F.col("node") == F.col("u"), "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    out = rows.select("vec_id", "key").join(table, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a), m AS (SELECT a AS vec_id, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""
