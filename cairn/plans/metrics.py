"""Metric samples in the text exposition format, isolated collectors, alert predicates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Sample = tuple[str, dict, float]


def escape(value: object) -> str:
    return str(value).replace("\\", "\\\\").replace("\n", "\\n").replace('"', '\\"')


def render(name: str, value: float, labels: Mapping[str, object] = {}) -> str:  # noqa: B006
    inner = ",".join(f'{k}="{escape(v)}"' for k, v in sorted(labels.items()))
    number = f"{float(value):g}" if float(value) != int(value) else str(int(value))
    return f"{name}{{{inner}}} {number}" if inner else f"{name} {number}"


def collect(collectors: Mapping[str, Callable[[], Iterable[Sample]]]) -> list[str]:
    """All samples; a collector that fails costs its own samples only, and shows in cairn_collector_up."""
    lines = []
    for name, collector in collectors.items():
        try:
            mine = [render(n, v, labels) for n, labels, v in collector()]
            up = 1
        except Exception:  # noqa: BLE001
            mine, up = [], 0
        lines += [*mine, render("cairn_collector_up", up, {"collector": name})]
    return lines


def connector_samples(status: Mapping) -> list[Sample]:
    """State of a change-capture connector and its tasks."""
    name = status["name"]
    out = [("cairn_connector_running", {"connector": name}, float(status["connector"]["state"] == "RUNNING"))]
    for t in status.get("tasks", []):
        out.append(("cairn_connector_task_running", {"connector": name, "task": t["id"]}, float(t["state"] == "RUNNING")))
    return out


def latest_runs(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest run of each pipeline (or pipeline and task)."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return runs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def frame_samples(df: DataFrame, name: str, value: str, labels: list[str]) -> list[Sample]:
    """Rows of a small frame as samples."""
    return [(name, {k: r[k] for k in labels}, float(r[value])) for r in df.select(*labels, value).collect() if r[value] is not None]


def reconciliation_samples(reconciliation: DataFrame, now: float) -> list[Sample]:
    from cairn.plans.kpi import latest_batch_reconciliation

    r = latest_batch_reconciliation(reconciliation).head()
    out = [("cairn_reconciliation_checks", {}, float(r["checks"])), ("cairn_reconciliation_failures", {}, float(r["failures"] or 0))]
    return out if r["checked_at_seconds"] is None else [*out, ("cairn_reconciliation_age_seconds", {}, now - r["checked_at_seconds"])]


def gold_samples(gold: Mapping[str, DataFrame], now: float) -> list[Sample]:
    """Rows, duplicates of the grain and age of each mart, from one job."""
    from functools import reduce

    from cairn.operators.quality import GRAINS

    parts = []
    for t, grain in GRAINS.items():
        loaded = F.max("source_load_datetime") if "source_load_datetime" in gold[t].columns else F.lit(None).cast("timestamp")
        parts.append(gold[t].agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*grain)).alias("d"), F.unix_timestamp(loaded).alias("at")).select(F.lit(t).alias("t"), "n", "d", "at"))
    out = []
    for r in reduce(DataFrame.unionAll, parts).collect():
        labels = {"table": r["t"]}
        out += [("cairn_gold_rows", labels, float(r["n"])), ("cairn_gold_duplicate_rows", labels, float(r["n"] - r["d"]))]
        if r["at"] is not None:
            out.append(("cairn_gold_age_seconds", labels, now - r["at"]))
    return out


# Alert thresholds (fixed values of the service objectives).
MAX_LAG, MAX_TASK_SECONDS, MAX_AGE_SECONDS = 100, 900, 24 * 3600

ALERTS: dict[str, Callable[[str, dict, float], bool]] = {
    "collector_down": lambda n, _, v: n == "cairn_collector_up" and v == 0,
    "connector_down": lambda n, _, v: n == "cairn_connector_running" and v == 0,
    "connector_task_down": lambda n, _, v: n == "cairn_connector_task_running" and v == 0,
    "lag_high": lambda n, _, v: n == "cairn_consumer_lag" and v > MAX_LAG,
    "pipeline_failed": lambda n, labels, v: n == "cairn_run_state" and labels.get("state") == "failed" and v > 0,
    "task_failed": lambda n, labels, v: n == "cairn_task_state" and labels.get("state") == "failed" and v > 0,
    "task_slow": lambda n, _, v: n == "cairn_task_seconds" and v > MAX_TASK_SECONDS,
    "reconciliation_failed": lambda n, _, v: n == "cairn_reconciliation_failures" and v > 0,
    "reconciliation_missing": lambda n, _, v: n == "cairn_reconciliation_checks" and v == 0,
    "reconciliation_stale": lambda n, _, v: n == "cairn_reconciliation_age_seconds" and v > MAX_AGE_SECONDS,
    "gold_stale": lambda n, _, v: n == "cairn_gold_age_seconds" and v > MAX_AGE_SECONDS,
    "gold_grain_broken": lambda n, _, v: n == "cairn_gold_duplicate_rows" and v > 0,
    "gold_empty": lambda n, _, v: n == "cairn_gold_rows" and v == 0,
}


def firing(samples: Iterable[Sample]) -> list[tuple[str, dict]]:
    return [(alert, labels) for name, labels, value in samples for alert, f in ALERTS.items() if f(name, labels, value)]
