"""Content fingerprints that do not depend on row order, storage statistics, and comparison of reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_row(df: DataFrame, exclude: Iterable[str] = ()) -> Column:
    """The row as text: each value behind its length, so that neighbouring values cannot run together; null apart from empty."""
    skip = set(exclude)
    parts = []
    for f in df.schema.fields:
        if f.name not in skip:
            c = F.col(f"`{f.name}`")
            text = F.hex(c) if f.dataType.typeName() == "binary" else (F.to_json(c) if f.dataType.typeName() in ("array", "map", "struct") else c.cast("string"))
            parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-1:")))
    if not parts:
        raise ValueError("a table without columns has no fingerprint")
    return F.concat(*parts)


def fingerprint(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """One row: the row count, and a checksum that any change of content but no change of order alters."""
    # 60 bits of each row's digest
    h = df.select(F.conv(F.left(F.md5(canonical_row(df, exclude)), F.lit(15)), 16, 10).cast("long").alias("h"))
    total = F.sum(F.col("h").cast("decimal(20,0)"))
    checksum = F.concat_ws("-", F.bit_xor("h").cast("string"), (total % F.lit(2**61 - 1)).cast("decimal(20,0)").cast("string"))
    return h.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.when(F.count(F.lit(1)) > 0, checksum), F.lit("")).alias("checksum"))


def inventory_stats(objects: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Count, sum, minimum, nearest-rank median and 95th percentile, maximum, and small objects."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by {size})")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return objects.agg(
        F.count(F.lit(1)).alias("object_count"), zero(F.sum(size)).alias("total_bytes"), zero(F.min(size)).alias("min_bytes"), zero(at(0.5)).alias("median_bytes"),
        zero(at(0.95)).alias("p95_bytes"), zero(F.max(size)).alias("max_bytes"), F.count_if(F.col(size) < 1 << 20).alias("objects_under_1_mib"),
    )


def nearest_rank(values: Iterable[float], share: float) -> float:
    """The value at rank ceil(n * share) of the sorted values; 0 of none."""
    ordered = sorted(values)
    if not ordered:
        return 0
    rank = -(-len(ordered) * share // 1)
    return ordered[max(0, int(rank) - 1)]


#: Parts of a report that differ from run to run.
VOLATILE = ("collected_at", "duration_seconds", "run_id")


def stable(report: Any) -> Any:
    if isinstance(report, Mapping):
        return {k: stable(v) for k, v in sorted(report.items()) if k not in VOLATILE}
    return [stable(v) for v in report] if isinstance(report, list | tuple) else report


def differences(before: Any, after: Any, at: str = "") -> list[str]:
    """Paths at which two reports differ in what should not change."""
    before, after = stable(before), stable(after)
    if isinstance(before, dict) and isinstance(after, dict):
        out = []
        for k in sorted(before.keys() | after.keys()):
            path = f"{at}.{k}".lstrip(".")
            if k not in before or k not in after:
                out.append(path)
            else:
                out += differences(before[k], after[k], path)
        return out
    return [] if before == after else [at]


def baseline_checks(report: Mapping[str, Any]) -> dict[str, bool]:
    """Health of a collected baseline, by name of the check."""
    r = report
    grains, tables = r.get("grains", {}), r.get("tables", {})
    return {
        "source_has_rows": sum(r.get("source_counts", {}).values()) > 0,
        "source_has_all_tables": r.get("expected_source_tables", 0) == len(r.get("source_counts", {})),
        "no_consumer_lag": r.get("consumer_lag", 0) == 0,
        "bronze_has_objects": r.get("bronze", {}).get("object_count", 0) > 0,
        "bronze_has_bytes": r.get("bronze", {}).get("total_bytes", 0) > 0,
        "vault_has_objects": r.get("vault", {}).get("object_count", 0) > 0,
        "gold_has_objects": r.get("gold", {}).get("object_count", 0) > 0,
        "reconciliation_has_checks": r.get("reconciliation", {}).get("checks", 0) > 0,
        "reconciliation_passes": r.get("reconciliation", {}).get("failures", 1) == 0,
        "gold_grains_hold": bool(grains) and all(g["rows"] == g["distinct_grain"] for g in grains.values()),
        "fingerprints_present": bool(tables) and all(t.get("checksum") is not None for t in tables.values()),
    }
