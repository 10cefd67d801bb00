"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon is learned from a bounded sample of labelled rows (SAMPLE rows, by hash of doc_id; none whose crc32 of the
id as text is divisible by FOLDS): whole words, and stems where many words share a beginning, that are toxic beyond
chance.  The trie and the automata run as one lazily determinised automaton, remembered per chunk of text.  Each hit
is weighed by its window: neighbours that are hits too, quotation marks around it, the edit distance.  Boosted trees
turn a document's sums into a score.

Null or empty texts score like texts without hits; without labels every score is 0.  Whole texts are read, no text is
shuffled; a very long one is a row of its own.  Of labels that share a hash the smaller doc_id comes first into the sample.
Repeated rows, rows without doc_id and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import claim, fresh, load, materialize, small_batches, steps

FOLDS = 5
#: Labelled rows that the lexicon and the trees are fitted on, at most.
SAMPLE = 8000
#: Chunks that each worker remembers.
REMEMBERED = 400_000
#: Chunks on either side of a hit that make its window.
WINDOW = 8

_letters = re.compile(r"[^\W\d_]+")
_cores = re.compile(r"[\w@!$]+")
_quotes = "\"'“”„«»‘’`"


class LexiconAutomaton:
    """Terms within their edit distance, and exact stems; a state is a set of (trie node, edits so far)."""

    def __init__(self, words: list[str], stems: dict[str, int]):
        self.child: list[dict[str, int]] = [{}]
        self.allow, self.word, self.stem = [0], [-1], [0]
        for i, w in enumerate(words):
            allow = 0 if len(w) < 5 else 1 if len(w) < 9 else 2
            self.word[self._path(w, allow)] = allow
        for w, kind in stems.items():
            self.stem[self._path(w, 0)] = kind
        self.alphabet = {c for d in self.child for c in d}
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[int] = []  # least distance at which a whole word ends here, 9 if none
        self.stems: list[int] = []
        self.start = self._state(self._close({(0, 0)}))

    def _path(self, w: str, allow: int) -> int:
        node = 0
        self.allow[0] = max(self.allow[0], allow)
        for c in w:
            if c not in self.child[node]:
                self.child[node][c] = len(self.child)
                self.child.append({})
                self.allow.append(0)
                self.word.append(-1)
                self.stem.append(0)
            node = self.child[node][c]
            self.allow[node] = max(self.allow[node], allow)
        return node

    def _close(self, pairs: set) -> frozenset:
        todo, best = list(pairs), {}
        while todo:
            n, e = todo.pop()
            if e <= self.allow[n] and e < best.get(n, 9) or n == 0 == e:
                if best.get(n, 9) <= e:
                    continue
                best[n] = e
                todo += [(k, e + 1) for k in self.child[n].values()]  # a letter left out
            elif e == 0 and n not in best:
                best[n] = 0
        return frozenset(best.items())

    def _state(self, s: frozenset) -> int:
        i = self.number.get(s)
        if i is None:
            i = self.number[s] = len(self.states)
            self.states.append(s)
            self.moves.append({})
            self.ends.append(min((e for n, e in s if self.word[n] >= e), default=9))
            self.stems.append(max((self.stem[n] for n, e in s if e == 0), default=0))
        return i

    def _move(self, i: int, c: str) -> int:
        out = set()
        for n, e in self.states[i]:
            k = self.child[n].get(c)
            if k is not None:
                out.add((k, e))
            out.add((n, e + 1))  # a letter too many
            out.update((k, e + 1) for k in self.child[n].values())  # another letter
        out = {(n, e) for n, e in out if e <= self.allow[n]}
        j = self._state(self._close(out)) if out else -1
        self.moves[i][c] = j
        return j

    def find(self, word: str) -> int:
        """0: none; 1, 2, 3: a whole word at distance 0, 1, 2; 4: begins with a stem; 5: with a doubtful one."""
        i = self.start
        for c in word:
            if c not in self.alphabet:
                c = "\0"
            j = self.moves[i].get(c)
            i = self._move(i, c) if j is None else j
            if i < 0:
                return 0
            if self.stems[i]:
                return self.stems[i]
        return 0 if self.ends[i] == 9 else 1 + self.ends[i]


class Memory(dict):
    """chunk -> kind of hit."""

    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, chunk: str) -> int:
        found = [k for k in map(self.automaton.find, _cores.findall(chunk)) if k]
        kind = (4 if 4 in found and 1 not in found else min(found)) if found else 0  # the surest
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) < 100:
            self[chunk] = kind
        return kind


def features(text: str, memory: Memory) -> list[float]:
    chunks = text.lower().split()
    kinds = list(map(memory.__getitem__, chunks))
    if not any(kinds):
        return [0.0] * 10
    hits = [i for i, k in enumerate(kinds) if k]
    weight = {1: 1.0, 2: 0.5, 3: 0.25, 4: 1.0, 5: 0.5}
    plain, quoted, by, dense = 0.0, 0.0, Counter(), 0.0
    for i in hits:
        k = kinds[i]
        near = sum(weight[kinds[j]] for j in range(max(0, i - WINDOW), min(len(chunks), i + WINDOW + 1)) if kinds[j])
        # quoted: an opening mark starts one of the two chunks before or this one, a closing mark ends this or one of the next two
        opened = any(c[0] in _quotes for c in chunks[max(0, i - 2) : i + 1])
        closed = any(c.rstrip(".,;:!?")[-1:] in _quotes and c.rstrip(".,;:!?") for c in chunks[i : i + 3])
        if opened and closed:
            quoted += weight[k]
        else:
            plain += weight[k]
            dense = max(dense, near)
        by[k] += 1
    return [plain, quoted, dense, by[1], by[2], by[3], by[4], by[5], plain / len(chunks), math.log1p(len(chunks))]


def beyond_chance(tox: Column, non: Column, share: float, trials: int) -> Column:
    """Whether so large a toxic share has a chance below 1 in 100 among so many terms (Chernoff's bound on the binomial tail)."""
    n = tox + non
    p = tox / n
    d = p * F.log(p / share) + F.when(non > 0, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return (tox >= 3) & (p > share) & (n * d > math.log(trials / 0.01))


class ToxicityModel:
    """A lexicon and fitted trees; small, sent to the executors with the tasks."""

    def __init__(self, words: list[str], stems: dict[str, int], trees: BoostedTrees | None):
        self.words, self.stems, self.trees = words, stems, trees

    def memory(self) -> Memory:
        return Memory(LexiconAutomaton(self.words, self.stems))

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(rows))
        return 1 / (1 + np.exp(-self.trees.raw(np.array(rows, float))))


def _count_terms(batches):
    """(term, whole, toxic documents, others) of the sampled rows, whole words and stems: beginnings of 4 to 9 letters, which longer beginnings have too."""
    claim("toxicity")
    counts: dict[tuple[str, bool], list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(_letters.findall((text or "").lower()))
            terms = {(w, True) for w in words if len(w) >= 2} | {(w[:k], False) for w in words for k in range(4, 10) if len(w) > k}
            for t in terms:
                counts.setdefault(t, [0, 0])[0 if toxic else 1] += 1
    if counts:
        yield pa.RecordBatch.from_arrays(
            [pa.array([t[0] for t in counts], pa.string()), pa.array([t[1] for t in counts], pa.bool_()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
            ["term", "whole", "tox", "non"],
        )


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on at most SAMPLE labelled rows outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(fold != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    train = materialize(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "toxic"), "toxic")  # rows: at most SAMPLE of 12 bytes
    total = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_tox, n_non = total.get(1, 0), total.get(0, 0)
    if not n_tox or not n_non:
        return ToxicityModel([], {}, None)
    share = n_tox / (n_tox + n_non)
    counted = train.mapInArrow(_count_terms, "term string, whole boolean, tox long, non long").groupBy("term", "whole").agg(F.sum("tox").alias("tox"), F.sum("non").alias("non"))
    counted = materialize(counted, "terms")
    trials = counted.count()
    # terms of at most SAMPLE texts, and only those that are toxic beyond chance
    found = counted.filter("tox > 2 * non").filter(beyond_chance(F.col("tox"), F.col("non"), share, trials)).orderBy(F.desc("tox"), "term", "whole").collect()
    words = {r["term"]: r["tox"] for r in found if r["whole"]}
    stems: dict[str, int] = {}
    for r in sorted((r for r in found if not r["whole"]), key=lambda r: (len(r["term"]), r["term"])):
        t = r["term"]
        main = max((n for w, n in words.items() if w.startswith(t)), default=0)
        # a stem stands for many words, none of them for most of it
        if main < 0.6 * r["tox"] and r["non"] * 4 <= r["tox"] and not any(t.startswith(s) for s in stems):
            stems[t] = 4 if r["non"] * 20 <= r["tox"] else 5
    model = ToxicityModel(sorted(words), stems, None)

    def measure(batches):
        memory = model.memory()
        for batch in batches:
            x = [features(t or "", memory) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], ["x", "y"])

    fit = train.mapInArrow(measure, "x array<double>, y int").collect()  # at most SAMPLE rows of numbers
    fit.sort(key=lambda r: (r["x"], r["y"]))
    model.trees = BoostedTrees(rounds=40).fit(np.array([r["x"] for r in fit]), np.array([r["y"] for r in fit], float))
    return model


def score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """docs with the score as one more column, of another name if docs have one of that name; every row and column stays."""
    names, column = docs.columns, fresh(docs, column)

    def run(batches):
        claim("toxicity")
        memory = model.memory()
        for batch in batches:
            for lo, hi in steps(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                found = model.scores([features(t or "", memory) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.float64())], [*names, column])

    small_batches(docs.sparkSession)
    schema = docs.schema
    return docs.mapInArrow(run, type(schema)([*schema.fields, *docs.sparkSession.range(0).select(F.lit(0.0).alias(column)).schema.fields]))


def reject_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The documents that score below `at`, with their columns."""
    name = fresh(docs, "_toxicity")
    return score(docs, learn(docs, labels), name).filter(F.col(name) < at).select(docs.columns)


def op5_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, load(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
