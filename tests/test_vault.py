"""Change events to vault, marts and reports, by scenario."""

import json
import os
import time

import os

import pytest
from pyspark.sql import functions as F

from cairn.operators import quality, vault
from cairn.operators.reconcile import history_rules, noop_rules
from cairn.plans.control import ControlError, ControlPlane
from cairn.plans.gold import build_gold, order
from cairn.plans.kpi import measures
from cairn.plans import metrics
from cairn.plans.runner import load_phase, run_all, run_batch, run_gold, run_reports
from cairn.sources.generator import Workload
from cairn.sources.store import TableStore

def as_of():
    return F.lit("2026-06-30").cast("date")


def flat(spark, w, batch="b1", events=None):
    return vault.flatten(w.frame(spark, events), batch)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """A snapshot, then the scenarios of later batches, loaded through the store."""
    store = TableStore(spark, str(tmp_path_factory.mktemp("vault")))
    w = Workload()
    w.snapshot(customers=20, applications=10)
    n = len(w.events)
    first = load_phase(store, flat(spark, w, "b1"), "all", "b1")
    again = load_phase(store, flat(spark, w, "b1"), "all", "b1")
    c1, a1 = w.customer(1), w.application(1, 20)
    w.emit("mms.customers", "u", {"customer_id": 1}, c1 | {"segment_code": "mass "})  # case and blanks only, after another stamp
    w.emit("krd.loan_applications", "u", {"application_id": 1}, a1 | {"branch_code": "IZM001"})
    w.emit("krd.loan_applications", "u", {"application_id": 1}, a1)
    w.emit("mms.customers", "d", {"customer_id": 2}, None, w.customer(2))
    w.emit("mms.customers", "d", {"customer_id": 3}, None, w.customer(3))
    w.emit("mms.customers", "c", {"customer_id": 3}, w.customer(3))
    w.emit("mms.customers", "c", {"customer_id": 99}, w.customer(99, customer_no="  "))
    w.emit("krd.loans", "u", {"loan_id": 1}, w.loan(1, a1, status_code="CLOSED"))
    w.emit("krd.loans", "c", {"loan_id": 77}, w.loan(77, a1 | {"application_id": 12345}))
    second = load_phase(store, flat(spark, w, "b2", w.events[n:]), "all", "b2")
    replay = load_phase(store, flat(spark, w, "b2", w.events[n:]), "all", "b2")
    return store, w, n, first, again, second, replay


def test_replay_inserts_nothing(loaded):
    _, _, _, first, again, second, replay = loaded
    assert first["hub_customer"].inserted == 20
    assert all(r.inserted == 0 for r in again.values())
    assert second["hub_customer"].inserted == 0 and second["cdc_raw_vault_events"].inserted == 1
    assert all(r.inserted == 0 for r in replay.values())


def test_history_of_scenarios(loaded):
    store = loaded[0]
    status = store.read("sat_entity_record_status").orderBy("source_lsn")
    of = lambda bk: [r.record_status for r in status.filter(F.col("entity_business_key") == bk).collect()]
    assert of("C00000002") == ["ACTIVE", "DELETED"]
    assert of("C00000003") == ["ACTIVE", "DELETED", "ACTIVE"]
    key = store.read("hub_loan_application").filter("loan_application_bk = 'A00000001'").head().loan_application_hk
    effectivity = store.read("sat_application_context_effectivity").filter(F.col("loan_application_hk") == key)
    assert effectivity.count() == 3 and effectivity.select("application_context_hk").distinct().count() == 2
    assert store.read("link_application_context").filter(F.col("loan_application_hk") == key).count() == 2


def test_loans_resolve_through_persisted_links_or_drop(loaded):
    store = loaded[0]
    assert store.read("sat_loan_details").filter("load_batch_id = 'b2'").count() == 2  # satellites need no application
    assert store.read("hub_loan").filter("loan_bk = 'L00000077'").count() == 1
    hk = store.read("hub_loan").filter("loan_bk = 'L00000077'").head().loan_hk
    assert store.read("link_loan_context").filter(F.col("loan_hk") == hk).count() == 0


def test_quarantine_reasons(spark):
    w = Workload()
    w.emit("mms.customers", "c", {"customer_id": 1}, w.customer(1, customer_no=""))
    w.emit("mms.customers", "x", {"customer_id": 2}, w.customer(2))
    w.emit("mms.customers", "u", {"customer_id": 3}, None)
    w.emit("mms.customers", "c", {"customer_id": 4}, w.customer(4), event_id=None)
    w.emit("mms.customers", "c", {"customer_id": 5}, w.customer(5), source_schema=None)
    w.emit("mms.customers", "tombstone", {"customer_id": 6}, None)
    rows = vault.build_quarantine(flat(spark, w)).collect()
    assert sorted(r.reason_code for r in rows) == ["MISSING_AFTER_IMAGE", "MISSING_BUSINESS_KEY_CUSTOMER", "MISSING_EVENT_ID", "MISSING_SOURCE_SCHEMA", "UNSUPPORTED_OPERATION"]


def test_no_change_update_adds_no_version(spark):
    w = Workload()
    row = w.customer(1)
    w.emit("mms.customers", "c", {"customer_id": 1}, row)
    w.emit("mms.customers", "u", {"customer_id": 1}, row | {"segment_code": row["segment_code"].lower() + "  "})
    w.emit("mms.customers", "u", {"customer_id": 1}, row | {"segment_code": "OTHER"})
    w.emit("mms.customers", "u", {"customer_id": 1}, row)
    assert vault.build("sat_customer_details", flat(spark, w)).count() == 3
    assert vault.build("hub_customer", flat(spark, w)).count() == 1


def test_out_of_order_batch_is_refused(spark, tmp_path):
    w = Workload()
    w.emit("mms.customers", "c", {"customer_id": 1}, w.customer(1))
    w.emit("mms.customers", "u", {"customer_id": 1}, w.customer(1, segment_code="X"))
    store = TableStore(spark, str(tmp_path))
    load_phase(store, flat(spark, w, "b2", w.events[1:]), "satellites", "b2")
    with pytest.raises(vault.OutOfOrder):
        load_phase(store, flat(spark, w, "b1", w.events[:1]), "satellites", "b1")


def test_gold_and_reports(spark, loaded):
    store = loaded[0]
    gold = run_gold(store, as_of())
    assert order().index("gold_row_lineage") > order().index("fct_loans_current")
    tables = {t: store.read(t) for t in vault.TABLES}
    tests = quality.gold_tests(tables, gold)
    assert quality.failing(tests) == [] and len(tests) > 30
    assert gold["dim_customer_current"].filter("customer_id = 'C00000002'").isEmpty()
    assert not gold["dim_customer_current"].filter("customer_id = 'C00000003'").isEmpty()
    assert gold["dim_customer_current"].filter("age_band = 'UNKNOWN'").count() == 2  # companies
    a1 = gold["fct_loan_applications_current"].filter("application_id = 'A00000001'").head()
    assert a1.branch_code == "ANK001" and a1.is_decided and a1.requested_amount == 27750
    assert gold["fct_loan_applications_current"].filter("application_id = 'A00000002'").isEmpty()  # its customer is deleted
    reports = run_reports(gold)
    assert {k for k, v in reports.items() if v.count() > 0} == set(reports)
    shares = reports["application_funnel"].groupBy("currency_code").agg(F.sum("status_share_pct").alias("s")).collect()
    assert all(abs(r.s - 100) < 0.1 for r in shares)
    m = measures(gold["fct_loan_applications_current"], gold["fct_loans_current"], gold["dim_customer_current"]).head()
    assert m.customers == 19 and 0 < m.approval_rate < 1
    again = build_gold(tables, as_of())
    assert again["gold_row_lineage"].count() == gold["gold_row_lineage"].count()


def test_rebuilt_history_reconciles(spark, loaded):
    store, w = loaded[:2]
    f = flat(spark, w, "all")
    names = ("hub_customer", "link_application_context", "sat_source_record_status", "sat_entity_record_status")
    rules = history_rules(f, {t: vault.build(t, f) for t in names}, {t: store.read(t) for t in names}, {"mms.customers": 20})
    assert [r for r in rules if not r["passed"]] == []


def test_bounded_batches_end_to_end(spark, tmp_path):
    w = Workload()
    w.snapshot(customers=5, applications=5)
    root = tmp_path / "events"

    def write(events):
        for r in w.frame(spark, events).select("_metadata.object_key", F.to_json(F.struct("_metadata", "key", "value")).alias("j")).collect():
            p = root / r.object_key
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(r.j)

    def discover():
        return [{"object_key": str(p), "size_bytes": p.stat().st_size} for p in root.rglob("*.json")]

    def read(paths):
        from cairn.sources.readers import read_bounded_events

        return read_bounded_events(spark, paths)

    write(w.events)
    store, control = TableStore(spark, str(tmp_path / "vault")), ControlPlane(str(tmp_path / "control.db"))
    gold = run_all(spark, store, control, "b1", "r1", discover, read, str(tmp_path / "export"), as_of())
    assert gold["dim_customer_current"].count() == 5 and (tmp_path / "export" / "manifest.json").exists()
    one = json.loads(control.batch("b1")["manifest"])["payload"]
    names = {n for n, _, _ in metrics.gold_samples(gold, 2e9)} | {n for n, _, _ in metrics.reconciliation_samples(store.read("cdc_raw_vault_reconciliation"), 2e9)}
    assert {"cairn_gold_rows", "cairn_gold_age_seconds", "cairn_reconciliation_failures"} <= names
    assert one["interval_object_count"] == len(w.events)
    n = len(w.events)
    w.emit("mms.customers", "u", {"customer_id": 1}, w.customer(1, segment_code="PRIVATE"))
    write(w.events[n:])
    two = run_batch(spark, store, control, "b2", "r2", discover, read)
    assert two["interval_object_count"] == 1
    three = run_batch(spark, store, control, "b3", "r3", discover, read)
    assert three["interval_object_count"] == 0 and all(r["passed"] for r in noop_rules(three))
    history = control.frame(spark, "batch_history").orderBy("batch_id").collect()
    assert [h.state for h in history] == ["PUBLISHED"] * 3 and history[1].interval_object_count == 1
    assert control.start("b3", "r4") == 2  # the latest published batch may be replayed
    with pytest.raises(ControlError):
        control.start("b1", "r5")
    assert store.read("sat_customer_details").count() == 6
    assert store.history("sat_customer_details").count() == 2
    assert os.path.isdir(tmp_path / "vault")


def test_workload_scenarios(spark):
    w = Workload()
    w.snapshot(customers=5, applications=5)
    w.changes()
    for step in ("setup", "delete", "recreate", "relation-b", "relation-a"):
        w.current_state(step)
    f = flat(spark, w).cache()
    ledger = w.ledger_frame(spark)
    from cairn.plans import manifest as M

    seen = {r.txid: r.observed_event_count for r in M.transaction_summary(f).collect()}
    assert seen == {r.txid: r.expected_count for r in ledger.collect()} and len(seen) == 11
    assert M.ledger_through(ledger, f.select("txid").filter("txid <= 103")).count() == 4
    status = vault.build("sat_entity_record_status", f).filter("entity_business_key = 'LIFECYCLE'").orderBy("source_lsn")
    assert [r.record_status for r in status.collect()] == ["ACTIVE", "DELETED", "ACTIVE"]
    key = vault.build("hub_loan_application", f).filter("loan_application_bk = 'RELATION-1'").head().loan_application_hk
    assert vault.build("sat_application_context_effectivity", f).filter(F.col("loan_application_hk") == key).count() == 3
    assert {r.object_name: r.rows for r in vault.current_counts(f).collect()}["mms.customers"] == 7
    events = {(r.table_name, r.operation): r.events for r in M.event_counts(f).collect()}
    assert events["mms.customer_contacts", "d"] == 1 and events["krd.installments", "c"] == 2


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    """A table's shuffle files go with the write, parts of a union are written in turn, and repeated keys are still found."""
    from cairn.sources.store import DuplicateKey

    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    part = lambda k: spark.range(1000).repartition(5, "id").selectExpr(f"{k} as part", "id % 100 as k").groupBy("part", "k").count()
    store, before = TableStore(spark, str(tmp_path)), files()
    assert store.overwrite("t", [part(0), part(1)]) == 200 and store.read("t").count() == 200
    assert [v["operation"] for v in store.all_versions("t")] == ["OVERWRITE"]
    wait = time.time() + 20
    mine = lambda: files() - before
    at_most = 2  # the counts of a write and of the test have a shuffle each
    while len({f.split("_")[1] for f in mine()}) > at_most and time.time() < wait:
        time.sleep(0.2)
    assert len({f.split("_")[1] for f in mine()}) <= at_most
    assert store.merge_new("u", part(0), "k").inserted == 100
    with pytest.raises(DuplicateKey):
        store.merge_new("u", part(0).union(part(1)), "k")


def test_flattened_log_holds_no_column_twice(spark, tmp_path):
    from cairn.warehouse import Warehouse

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    w = Warehouse(spark, sf)
    assert set(w.flat().columns) - set(w.store.read("flat").columns) == {"event_id"}
    assert not {"raw_payload", "payload_sha256"} & set(w.store.read("flat").columns)
    assert w.vault("cdc_raw_vault_events").filter("raw_payload is null").isEmpty() and w.vault("cdc_raw_vault_events").count() > 0
    w.marts()["dim_branch_current"]
    assert not w.store.exists("gold_row_lineage") and not w.store.exists("fct_loans_current")


def test_lineage_queries_write_keys_only_and_agree_with_the_marts(spark):
    """F1 to F4: the lineage queries build no whole vault table, and lineage_unique only what loans need."""
    import __spark_entry__ as entry
    from cairn.warehouse import _open, warehouse

    sf = "/root/testdata/sf0.001"
    _open.pop((spark.sparkContext.applicationId, sf), None)
    queries = entry.queries()
    w = warehouse(spark, sf)
    assert queries["lineage_unique"](spark, sf).count() > 0
    written = lambda: set(w.store.files.names(f"{w.root}/traces"))
    assert written() == {"owed", "present_loan", "latest_loan", "context_loan"}
    queries["lineage_union"](spark, sf).count()
    queries["grain_report"](spark, sf).count()
    queries["lineage_complete"](spark, sf).count()
    assert not w.store.exists("flat") and not w.store.exists("sat_loan_details")

    columns = ["gold_model", "gold_business_key", "lineage_role", "raw_vault_object", "source_event_id"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(w.traces().lineage()) == rows(w.gold("gold_row_lineage"))
    for mart, key in (("fct_loans_current", "loan_id"), ("fct_loan_applications_current", "application_id"), ("dim_customer_current", "customer_id")):
        assert sorted(r[0] for r in w.traces().marts[mart].select(key).collect()) == sorted(r[0] for r in w.gold(mart).select(key).collect())
