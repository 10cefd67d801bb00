"""Quality rules: adaptive thresholds from mergeable quantile sketches, one sketch per language and source.

Everything on the path is a built-in DataFrame function.  One pass over the texts computes the features of each
document inside its row (no shuffle of texts or words); KLL sketches of the features per (lang, source) merge into
sketches per language and of everything, so that a thin group borrows the fences of the next wider level; the fence
table joins back to the features.

A feature's fence follows the tail of its group.  Its reach is the distance from the median to the highest quantile of
RANKS that can be climbed to: each is at most GROWTH times as far as the one before plus the least reach, so that a tail
of junk, which lies far from the rest, does not draw the fence out to itself.  The fence is twice the reach and the least
reach away from the median.

Nulls: a null text has no words; null lang or source is a group of its own.  Empty tables give empty results; extra
columns are ignored; repeated rows and ids are judged one by one.  Features that tie with a fence are kept.  Very long texts
are single rows: a task holds their words, and nothing else grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

SPACES = r"[\x20\x09-\x0D]+"
#: Feature, least reach (so that a constant feature does not reject small deviations), use of the lower fence.
METRICS = (("mean_word", 0.25, True), ("symbol_share", 0.01, False), ("dup_line_share", 0.1, False), ("repeat_share", 0.05, False))
RANKS = (0.75, 0.9, 0.95, 0.99)
GROWTH = 4.0


def _shift(x: Column, by: int) -> Column:
    return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("t"))
    d = d.select(
        "doc_id", "lang", "source",
        F.filter(F.split("t", SPACES), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    pair = lambda x, y: F.xxhash64(x, y)
    d = d.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 8, F.transform("w", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    keep = [c for c in d.columns if c != "h"]
    # hashes of runs of 2, 4 and 8 words, each from two of the run before
    for by in (1, 2, 4):
        d = d.select(*keep, F.zip_with("h", _shift(F.col("h"), by), pair).alias("h"))
    d = d.select(*keep, F.slice("h", 1, F.greatest(F.size("h") - 7, F.lit(0))).alias("h"))
    d = d.select(*keep, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    d = d.select(*keep, "s", F.zip_with("s", _shift(F.col("s"), 1), lambda x, y: F.coalesce(x.h == y.h, F.lit(False))).alias("next"))
    d = d.select(*keep, "s", F.zip_with("next", F.concat(F.array(F.lit(False)), F.col("next")), lambda x, y: F.coalesce(x, F.lit(False)) | y).alias("dup"))
    d = d.select(*keep, F.sort_array(F.filter(F.zip_with("s", "dup", lambda x, y: F.when(y, x.i)), lambda x: x.isNotNull())).alias("at"))
    gaps = F.zip_with("at", _shift(F.col("at"), 1), lambda x, y: F.least(F.coalesce(y - x, F.lit(8)), F.lit(8)).cast("long"))
    return d.select(*keep, F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long")).alias("n_repeat_words"))


def fence(sketch: str, least: float, side: int) -> Column:
    """The upper (side 1) or lower (-1) fence of a sketched feature."""
    quantile = lambda x: F.kll_sketch_get_quantile_double(sketch, F.lit(x))
    far = [side * (quantile(r if side > 0 else round(1 - r, 2)) - quantile(0.5)) for r in RANKS]
    # reach after each rank, and whether every rank so far could be climbed to
    reach, going = far[0], F.lit(True)
    for d in far[1:]:
        going = going & (d <= GROWTH * (reach + least))
        reach = F.when(going, d).otherwise(reach)
    return F.round(quantile(0.5) + side * (2 * reach + least), 2)


def quality_rules(docs: DataFrame, least_group: int = 50, k: int = 400) -> DataFrame:
    """The base columns, base_failed and kept for each document.

    Groups under `least_group` documents use their language's fences, then those of all documents.
    """
    share = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    f = materialize(base_features(docs), "quality")
    f = f.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).withColumns(
        {"mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")}
    )
    names = [m for m, _, _ in METRICS]
    level0 = f.filter("not base_failed").groupBy("lang", "source").agg(*[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in names])
    level1 = level0.groupBy("lang").agg(*[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in names])
    level2 = level1.agg(*[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in names])

    def fences(level: DataFrame, keys: list[str], tag: str) -> DataFrame:
        cols = [F.kll_sketch_get_n_double(names[0]).alias(f"n{tag}")]
        for m, least, lower in METRICS:
            cols.append(fence(m, least, 1).alias(f"{m}_hi{tag}"))
            cols.append((fence(m, least, -1) if lower else F.lit(None).cast("double")).alias(f"{m}_lo{tag}"))
        return level.filter(F.col(names[0]).isNotNull()).select(*keys, *cols)

    by_group = fences(level0, ["lang", "source"], "0").withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    by_lang = fences(level1, ["lang"], "1").withColumnRenamed("lang", "l_lang")
    table = by_group.join(by_lang, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left").join(fences(level2, [], "2"), F.lit(True), "left")
    pick = lambda c: F.when(F.col("n0") >= least_group, F.col(f"{c}0")).when(F.col("n1") >= least_group, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    table = table.select("g_lang", "g_source", *[pick(f"{m}_{e}").alias(f"{m}_{e}") for m in names for e in ("hi", "lo")])
    j = f.join(table, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    verdict = F.lit(True)
    for m in names:
        verdict = verdict & F.coalesce(F.col(m) <= F.col(f"{m}_hi"), F.lit(True)) & F.coalesce(F.col(m) >= F.col(f"{m}_lo"), F.lit(True))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"))
