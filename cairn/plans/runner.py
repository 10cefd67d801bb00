"""Pipelines as ordered tasks: the bounded change-capture batch, and the full batch rebuild."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession

from cairn.operators import quality, reconcile, star, vault
from cairn.plans import manifest as M
from cairn.plans.control import TASKS, ControlPlane
from cairn.plans.gold import build_gold
from cairn.plans.kpi import KPIS, run_kpi
from cairn.sources import sinks
from cairn.sources.store import MergeResult, TableStore

#: Tasks of the change-capture pipeline; each needs the one before it.
STEPS = ("create_batch", "start_attempt", *TASKS, "publish_batch", "register_tables", "run_gold", "test_gold", "export")
PHASES = dict(zip(TASKS[:3], ("validate", "core", "satellites"), strict=True))


def load_phase(store: TableStore, flat: DataFrame, phase: str, batch_id: str, bounded: bool = True) -> dict[str, MergeResult]:
    """Merge the tables of a phase.  Bounded batches compare with the persisted state; a full history does not."""
    persisted = vault.persisted_applications(store.read_or_none("link_loan_context"), store.read_or_none("hub_loan_application"))
    done = {}
    for name in vault.phase_tables(phase):
        key, entity, state = vault.TABLES[name]
        rows = vault.build(name, flat, persisted)
        if bounded and entity:
            rows = vault.after_persisted(rows, store.read_or_none(name), entity, state, batch_id, name)
        done[name] = store.merge_new(name, rows, key, batch_id)
    return done


def reconcile_batch(store: TableStore, flat: DataFrame, manifest: Mapping, batch_id: str) -> list[dict]:
    """Evidence of a bounded batch: what the batch implies must be in the tables."""
    persisted = vault.persisted_applications(store.read_or_none("link_loan_context"), store.read_or_none("hub_loan_application"))
    candidates = {}
    for name, (_, entity, state) in vault.TABLES.items():
        rows = vault.build(name, flat, persisted)
        candidates[name] = vault.after_persisted(rows, store.read_or_none(name), entity, state, batch_id, name) if entity else rows
    rules = reconcile.bounded_rules(flat, candidates, {t: store.read_or_none(t) for t in candidates}, manifest)
    store.merge_new("cdc_raw_vault_reconciliation", reconcile.report(store.spark, rules, batch_id), "reconciliation_hk", batch_id)
    return rules


def run_batch(spark: SparkSession, store: TableStore, control: ControlPlane, batch_id: str, run_id: str, discover: Callable, read: Callable[[list[str]], DataFrame]) -> dict:
    """One bounded batch from sealing to publishing; a batch without objects needs no scan.  Returns the manifest's payload."""
    doc = control.create_or_get(batch_id, discover)
    payload = M.validate(doc, batch_id=batch_id)
    sha = doc["manifest_sha256"]
    n = control.start(batch_id, run_id)
    try:
        paths = [o["object_key"] for o in payload["objects"]]
        if paths:
            flat = vault.flatten(read(paths), batch_id).persist()
            try:
                for task, phase in PHASES.items():
                    done = load_phase(store, flat, phase, batch_id)
                    control.record_task(batch_id, run_id, task, sha, {t: r.inserted for t, r in done.items()})
                rules = reconcile_batch(store, flat, payload, batch_id)
            finally:
                flat.unpersist()
        else:
            for task in PHASES:
                control.record_task(batch_id, run_id, task, sha, {"objects": 0})
            rules = reconcile.noop_rules(payload)
        audit = M.build_audit(batch_id, n, run_id, sha, payload, reconcile.audit_rules(rules))
        control.record_task(batch_id, run_id, TASKS[-1], sha, {"rules": len(rules)}, audit)
        control.publish(batch_id, run_id)
    except BaseException as e:
        control.fail(run_id, repr(e))
        raise
    return payload


def run_gold(store: TableStore, as_of: Column | None = None) -> dict[str, DataFrame]:
    """Rebuild the marts from the vault into the same store."""
    tables = {t: store.read(t) for t in vault.TABLES if store.exists(t)}

    def keep(name: str, df: DataFrame | list[DataFrame]) -> DataFrame:
        store.overwrite(name, df)
        return store.read(name)

    return build_gold(tables, as_of, keep)


def run_reports(gold: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {k: run_kpi(k, dict(gold)) for k in KPIS}


class TestsFailed(RuntimeError):
    """Data tests returned rows."""


def run_all(spark: SparkSession, store: TableStore, control: ControlPlane, batch_id: str, run_id: str, discover: Callable, read: Callable, export_to: str | None = None, as_of: Column | None = None) -> dict[str, DataFrame]:
    """Every step of the change-capture pipeline, in the order of STEPS; a step that fails stops the rest."""
    run_batch(spark, store, control, batch_id, run_id, discover, read)
    tables = [t for t in vault.TABLES if store.exists(t)]
    store.register("vault", ["hub_customer"], tables)
    gold = run_gold(store, as_of)
    broken = quality.failing(quality.gold_tests({t: store.read(t) for t in tables}, gold))
    if broken:
        raise TestsFailed(", ".join(broken))
    if export_to:
        sinks.export_csv({t: gold[t] for t in sinks.EXPORTED}, export_to)
    return gold


def rebuild_star(clean: Mapping[str, DataFrame], store: TableStore, at: Column | None = None, as_of: Column | None = None) -> dict[str, DataFrame]:
    """Vault and star over cleansed tables; every table is written once and read back."""

    def keep(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        for name, df in tables.items():
            store.overwrite(name, df)
        return {name: store.read(name) for name in tables}

    return keep(star.build_star(keep(star.build_vault(dict(clean), at)), as_of))


def run_rebuild(raw: Mapping[str, DataFrame], store: TableStore, at: Column | None = None, as_of: Column | None = None) -> dict[str, DataFrame]:
    """The batch path: cleanse, rebuild the vault, rebuild the star."""
    clean = star.clean_all(dict(raw))
    for name, df in clean.items():
        store.overwrite(f"clean_{name}", df)
    return rebuild_star({name: store.read(f"clean_{name}") for name in clean}, store, at, as_of)
