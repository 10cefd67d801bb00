"""Expressions, store, landing, policy, manifests, control plane, star, fingerprints, exports, metrics."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import fingerprint as FP
from cairn.operators import policy, quality, star
from cairn.plans import kpi
from cairn.plans import manifest as M
from cairn.plans import metrics
from cairn.plans.control import TASKS, ControlError, ControlPlane, check_move
from cairn.sources import readers, sinks
from cairn.sources.generator import batch_table
from cairn.sources.store import CommitConflict, DuplicateKey, TableStore
from cairn.streaming import landing


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).head()


def test_hash_contracts(spark):
    r = one(spark, a=X.hash_key("CUSTOMER", F.lit(" c1 ")), b=X.hash_key("CUSTOMER", F.lit("C1")), c=X.hash_key("CUSTOMER", F.lit(" ")), d=X.plain_hash(F.lit(" c1 "), F.lit(None)), e=X.plain_hash(F.lit("")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert r.a == r.b == sha("CUSTOMER||C1") and r.c == sha("CUSTOMER||^^")
    assert r.d == sha(" c1 ||^^") and r.e == sha("")


def test_temporals(spark):
    r = one(
        spark, a=X.cdc_date(F.lit("2027-01-05Z")), b=X.cdc_date(F.lit("2027-01-05T10:00:00Z")), c=X.cdc_date(F.lit("31-31-2024")), d=X.cdc_timestamp(F.lit("  ")),
        y=X.full_years(F.lit("1992-02-29").cast("date"), F.lit("2025-02-28").cast("date")), m=X.month_years(F.lit("1992-02-29").cast("date"), F.lit("2025-02-28").cast("date")),
    )
    assert str(r.a) == "2027-01-05" == str(r.b) and r.c is None and r.d is None
    assert (r.y, r.m) == (32, 33)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        one(spark, x=X.cdc_timestamp(F.lit("garbage")))


def test_numbers_bands_masks(spark):
    r = one(spark, a=X.comma_number(F.lit("12,5")), b=X.comma_number(F.lit("1,234.5")), c=X.keep_last_4(F.lit("12345678")), d=X.keep_last_4(F.lit("12")), e=X.keep_first(F.lit("Ada")), f=X.year_only(F.lit("1990-05-06")), g=X.valid_email(F.lit("a@b")), h=X.valid_email(F.lit("a@b.c")), n=X.keep_last_4(F.lit(None).cast("string")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.n) == (12.5, None, "****5678", "12", "A**", "1990-01-01", None, "a@b.c", None)
    assert [x.b for x in spark.createDataFrame([(17,), (18,), (64,), (65,), (None,)], "y int").select(X.age_band("y").alias("b")).collect()] == ["UNDER_18", "18_24", "55_64", "65_PLUS", "UNKNOWN"]
    assert one(spark, k=X.canonical_json_object(F.lit('{"b": 2, "a": "x"}'))).k == '{"a":"x","b":"2"}'


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert store.merge_new("t", df, "k", "b1").inserted == 2
    again = store.merge_new("t", df.unionAll(spark.createDataFrame([(3, "c")], df.schema)), "k", "b2")
    assert (again.candidates, again.inserted) == (3, 1)
    assert store.merge_new("t", df, "k").inserted == 0 and store.merge_new("t", df.limit(0), "k").candidates == 0
    with pytest.raises(DuplicateKey):
        store.merge_new("t", df.unionAll(df), "k")
    assert store.read("t").count() == 3 and store.read("t", 0).count() == 2
    assert [r.operation for r in store.history("t").orderBy("version").collect()] == ["CREATE", "MERGE"]
    store.overwrite("t", df.limit(1))
    assert store.read("t").count() == 1 and store.read("t", 1).count() == 3
    before = store.all_versions("t")
    store.append("t", df)
    late = TableStore(spark, str(tmp_path))
    late.all_versions = lambda table: before  # a writer that has not seen the append
    with pytest.raises(CommitConflict):
        late.append("t", df)
    assert store.read("t").count() == 3
    with pytest.raises(FileNotFoundError):
        store.register("lake", ["missing"])
    store.overwrite("none", df.limit(0))
    assert store.register("lake", ["t"], ["none", "missing"]) == ["t", "none"] == store.register("lake", ["t"], ["none"])
    assert spark.table("lake.t").count() == 3 and spark.table("lake.none").schema == df.schema
    assert readers.describe_columns(spark.table("lake.t")) == [(1, "k", "int"), (2, "v", "string")]


def records(spark, rows):
    return spark.createDataFrame(rows, landing.RECORD.replace("timestamp timestamp", "ms bigint")).select("topic", "partition", "offset", F.timestamp_millis("ms").alias("timestamp"), "key", "value")


def envelope(**after):
    return json.dumps({"before": None, "after": after, "op": "u", "source": {"schema": "MMS", "table": "CUSTOMERS", "ts_ms": 1000, "lsn": 12345, "txId": 9}, "transaction": None}).encode()


def test_landing(spark, tmp_path):
    topic = "bank.core.mms.customers"
    good = [(topic, 0, 7, 1000, b'{"customer_id": 42}', envelope(customer_id=42)), (topic, 0, 8, -1, b'{"customer_id": 42}', None)]
    out = landing.normalize(records(spark, good)).collect()
    assert [r.problem for r in out] == [None, None]
    m = out[0]["_metadata"]
    assert m.event_id == hashlib.sha256(f"{topic}:0:7".encode()).hexdigest() and m.source_schema == "mms" and m.operation == "u" and m.event_timestamp == "1970-01-01T00:00:01.000Z"
    assert m.payload_sha256 == hashlib.sha256(good[0][4] + b"\0" + good[0][5]).hexdigest() and m.object_key.endswith(f"topic={topic}/partition=0/offset={7:020d}.json")
    assert out[1]["_metadata"].operation == "tombstone" and out[1].value is None and out[1]["_metadata"].kafka_timestamp_ms is None
    bad = [(topic, 0, 1, 0, None, b"not json"), (topic, 0, 2, 0, None, b'{"op": "u"}'), ("bank.core.other.t", 0, 3, 0, None, envelope(a=1).replace(b"MMS", b"other")), (topic, 0, 4, 0, None, envelope(a=1).replace(b'"u"', b'"x"'))]
    problems = [r.problem for r in landing.normalize(records(spark, bad)).collect()]
    assert problems == ["value is no JSON object", "envelope is incomplete", "schema is not allowed", "operation is unknown"]
    root = str(tmp_path / "landed")
    src = tmp_path / "src"
    records(spark, good).coalesce(1).write.parquet(str(src))
    for expected in (2, 2):
        q = landing.start_landing(landing.read_record_files(spark, str(src)), root, str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert readers.read_events(spark, root).count() == expected
        records(spark, good).coalesce(1).write.mode("append").parquet(str(src))
    with pytest.raises(landing.InvalidRecord):
        landing.land(landing.normalize(records(spark, bad[:1])), root)
    other = [(topic, 0, 7, 1000, b'{"customer_id": 42}', envelope(customer_id=43))]
    with pytest.raises(landing.IdentityConflict):
        landing.land(landing.normalize(records(spark, other)), root)
    bounds = spark.createDataFrame([(topic, 0, 7)], "topic string, partition int, high long")
    assert readers.read_events(spark, root, bounds).count() == 1
    assert readers.read_events(spark, root).filter(readers.up_to([(topic, 0, 7)])).count() == 1
    with pytest.raises(ValueError):
        readers.read_bounded_events(spark, [])


def key(topic, offset):
    return f"bronze/cdc/source=s/schema=x/table=y/event_date=2026-01-01/topic={topic}/partition=0/offset={offset:020d}.json"


def objects(topic, n, size=100):
    return [{"object_key": key(topic, i), "size_bytes": size + i} for i in range(n)]


def test_manifest():
    topic = "bank.core.mms.customers"
    p = M.build_manifest("b", objects(topic, 4), {(topic, 0): 1}, "now")
    assert p["interval_object_count"] == 2 and p["interval_input_bytes"] == 205
    doc = M.document(p)
    assert M.validate(doc, doc["manifest_sha256"], "b") == p
    two = M.build_manifest("b", objects("bank.core.krd.loans", 3) + objects(topic, 4, 200), {("bank.core.krd.loans", 0): 1, (topic, 0): 2}, "now")
    assert [b["interval_input_bytes"] for b in two["partitions"]] == [102, 203] and two["interval_input_bytes"] == 305
    for change in ({"batch_id": "c"}, {"interval_object_count": 3}, {"objects": p["objects"][::-1]}, {"schema_version": 9}, {"objects": [*p["objects"], {"object_key": key(topic, 9), "size_bytes": 1, "storage_etag": ""}]}, {"partitions": []}):
        with pytest.raises(M.Invalid):
            M.validate(M.document(p | change), batch_id="b")
    with pytest.raises(M.Invalid):
        M.validate(doc | {"payload": p | {"batch_id": "c"}})
    with pytest.raises(M.Invalid):
        M.build_manifest("b", objects(topic, 2), {(topic, 0): 5}, "now")
    with pytest.raises(M.Invalid):
        M.build_manifest("b", objects(topic, 2) * 2, {}, "now")
    ledger = M.build_ledger({1: 2, 2: 1}, {1: 2, 7: 3}, 1, {1: 10, 2: 20})
    assert [t["status"] for t in ledger["transactions"]] == ["PASS", "FAIL"] and ledger["untracked_event_count"] == 4
    M.validate(M.document(M.build_manifest("b", objects(topic, 4), {}, "now", ledger=ledger)))
    assert M.lsn_position("1/A") == (1 << 32) + 10 and M.safe_name("a b/c").startswith("a-b-c-")


def test_write_once(tmp_path):
    path = str(tmp_path / "a" / "m.json")
    digest = M.write_once(path, {"b": 1, "a": 2})
    assert M.write_once(path, {"a": 2, "b": 1}) == digest and M.read_once(path) == ({"a": 2, "b": 1}, digest)
    with pytest.raises(M.Invalid):
        M.write_once(path, {"a": 3})


def test_ledger_and_bounds(spark):
    rows = spark.createDataFrame([(100, 100), (101, 110), (102, 120)], "txid long, lsn_position long")
    through = lambda *t: M.ledger_through(rows, spark.createDataFrame([(x,) for x in t], "txid long")).count()
    assert (through(100), through(100, 102), through(5)) == (1, 3, 0)
    objs = spark.createDataFrame([("t", 0, o, 100 + o) for o in range(4)], "topic string, partition int, offset long, size_bytes long")
    done = spark.createDataFrame([("t", 0, 1)], "topic string, partition int, watermark_high long")
    r = M.bounds_of(objs, done).head()
    assert (r.watermark_low, r.watermark_high, r.interval_object_count, r.interval_input_bytes) == (1, 3, 2, 205)


def rule(expected=1, observed=1, name="x"):
    return {"rule_id": "R", "object_name": name, "scope": "s", "expected_value": expected, "observed_value": observed, "difference": observed - expected, "status": "PASS" if expected == observed else "FAIL", "details": {}}


def finish(control, batch, run, doc, n, rules):
    for t in TASKS[:3]:
        control.record_task(batch, run, t, doc["manifest_sha256"])
    audit = M.build_audit(batch, n, run, doc["manifest_sha256"], doc["payload"], rules)
    control.record_task(batch, run, TASKS[3], doc["manifest_sha256"], audit=audit)


def test_control_plane(spark, tmp_path):
    c = ControlPlane(str(tmp_path / "c.db"))
    topic = "bank.core.mms.customers"
    doc = c.create_or_get("b1", lambda: objects(topic, 3))
    assert c.create_or_get("b1", lambda: []) == doc
    with pytest.raises(ControlError):
        c.create_or_get("b2", lambda: objects(topic, 3))
    n = c.start("b1", "r1")
    with pytest.raises(ControlError):
        c.publish("b1", "r1")
    with pytest.raises(ControlError):
        finish(c, "b1", "r1", doc, n, [rule(1, 2)])
    c.fail("r1", "audit")
    assert c.batch("b1")["state"] == "FAILED"
    n = c.start("b1", "r2")
    assert n == 2 and c.start("b1", "r2") == 2
    finish(c, "b1", "r2", doc, n, [rule()])
    with pytest.raises(ControlError):
        c.record_task("b1", "r2", "nonsense", doc["manifest_sha256"])
    c.publish("b1", "r2")
    assert c.published_highs() == {(topic, 0): 2}
    c.create_or_get("b2", lambda: objects(topic, 5))
    assert json.loads(c.batch("b2")["manifest"])["payload"]["interval_object_count"] == 2
    with pytest.raises(ControlError):
        c.start("b1", "r3")
    c.supersede("b2")
    assert c.frame(spark, "batch_history").count() == 2 and c.frame(spark, "state_change").count() == 6
    with pytest.raises(ControlError):
        check_move("PUBLISHED", "RUNNING")


def test_audit_payload():
    m = M.build_manifest("b", objects("t", 2), {}, "now")
    p = M.build_audit("b", 1, "r", "sha", m, [rule(name="y"), rule(name="x")])
    assert [r["object_name"] for r in p["rules"]] == ["x", "y"] and M.validate_audit(p, "b", 1, "r", "sha") == p
    for broken in (p | {"attempt_number": 2}, p | {"rules": []}, p | {"rules": p["rules"][::-1]}, p | {"rules": [rule() | {"difference": 1}]}, p | {"rules": [rule() | {"status": "FAIL"}]}, p | {"watermark": []}):
        with pytest.raises(M.Invalid):
            M.validate_audit(broken, "b", 1, "r", "sha")


def test_policy(spark):
    assert policy.allowed("analyst", "gold_dbt", "fct_loans_current") and not policy.allowed("analyst", "cdc_raw_vault", "hub_loan")
    assert policy.allowed("dbt-local", "gold_dbt", "x", "INSERT") and not policy.allowed("nobody", "gold_dbt", "x")
    df = spark.createDataFrame([("12345678901", "Ada", "1990-01-02", "IST001"), (None, None, None, "ANK001")], "national_id string, first_name string, date_of_birth string, home_branch_code string")
    r = policy.secure_view(df, "auditor", "cdc_raw_vault", "sat_customer_details").collect()
    assert (r[0].national_id, r[0].first_name, r[0].date_of_birth, r[1].national_id) == ("*******8901", "A**", "1990-01-01", None)
    with pytest.raises(policy.Denied):
        policy.secure_view(df, "branch-analyst", "gold_dbt", "dim_product_current")
    mine = policy.secure_view(df, "branch-analyst", "gold_dbt", "dim_customer_current", policy.rules("IST001"))
    assert mine.count() == 1


def test_star(spark, tmp_path):
    sizes = {"customers": 40, "accounts": 60, "merchants": 10, "transactions": 200}
    raw = {t: batch_table(spark, t, n, sizes=sizes) for t, n in sizes.items()}
    assert raw["customers"].collect() == batch_table(spark, "customers", 40, sizes=sizes).collect()
    clean = star.clean_all(raw)
    counts = {r.table_name: r for r in star.clean_counts(raw, clean).collect()}
    assert counts["customers"].raw == 40 and 0 < counts["transactions"].clean < 200 and counts["transactions"].rejected > 0
    at, as_of = F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-01").cast("date")
    built = star.build_star(star.build_vault(clean, at), as_of)
    assert built["fact_transactions"].count() == counts["transactions"].clean
    assert quality.relationships(built["fact_transactions"], "account_id", built["dim_account"], "account_id").isEmpty()
    assert built["dim_customer"].filter("age is null").count() == clean["customers"].filter("date_of_birth is null").count()
    from cairn.plans.runner import run_rebuild

    stored = run_rebuild(raw, TableStore(spark, str(tmp_path)), at, as_of)
    assert stored["fact_transactions"].count() == built["fact_transactions"].count()


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "k int, s string, d double")
    f = lambda d, **k: FP.fingerprint(d, **k).head()
    assert f(df) == f(df.orderBy(F.desc("k")).repartition(3)) and f(df) != f(df.withColumn("s", F.coalesce("s", F.lit(""))))
    assert f(df.unionAll(df)).checksum != f(df).checksum and f(df.limit(0)).checksum == ""
    assert f(df, exclude=["d"]) == f(df.withColumn("d", F.lit(0.0)), exclude=["d"])
    stats = FP.inventory_stats(spark.createDataFrame([(10,), (20,)], "size_bytes long")).head()
    assert (stats.median_bytes, stats.p95_bytes, FP.nearest_rank([10, 20], 0.5), FP.nearest_rank([10, 20], 0.95)) == (10, 20, 10, 20)
    a = {"tables": {"t": {"checksum": "x"}}, "collected_at": 1}
    assert FP.differences(a, a | {"collected_at": 2}) == [] and FP.differences(a, {"tables": {"t": {"checksum": "y"}}}) == ["tables.t.checksum"]
    assert not all(FP.baseline_checks({}).values())


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "", "x")], "k int, s string, t string")
    m = sinks.export_csv({"t": df}, str(tmp_path / "out"))
    text = (tmp_path / "out" / "t.csv").read_bytes()
    assert text.decode().splitlines() == ["k,s,t", '1,"a,""b""",', '2,"",x'] and m["t"]["rows"] == 2 and m["t"]["sha256"] == hashlib.sha256(text).hexdigest()
    sinks.export_csv({"t": df.limit(1)}, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["tables"]["t"]["rows"] == 1
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_metrics(spark):
    assert metrics.render("m", 1, {"a": 'x"y\n'}) == 'm{a="x\\"y\\n"} 1' and metrics.render("m", 1.5) == "m 1.5"
    lines = metrics.collect({"ok": lambda: [("m", {}, 1)], "bad": lambda: 1 / 0})
    assert lines == ["m 1", 'cairn_collector_up{collector="ok"} 1', 'cairn_collector_up{collector="bad"} 0']
    samples = metrics.connector_samples({"name": "c", "connector": {"state": "RUNNING"}, "tasks": [{"id": 0, "state": "FAILED"}]})
    assert [a for a, _ in metrics.firing([*samples, ("cairn_consumer_lag", {}, 101), ("cairn_consumer_lag", {}, 100)])] == ["connector_task_down", "lag_high"]
    assert len(metrics.ALERTS) == 13


def test_turnaround_percentiles_are_exact(spark):
    """Of more values than a summary of bounded size holds, too."""
    n = 60_011
    apps = spark.range(n).selectExpr("'p' as product_code", "'b' as branch_code", "true as is_decided", "id * 7919 % 60011 as decision_duration_hours")
    more = spark.createDataFrame([("p", "b", False, 10**6), ("p", "b", True, None), ("q", "b", False, 3)], apps.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    p, q = kpi.decision_turnaround(apps.union(more)).collect()
    assert (p.decided_application_count, p.median_decision_hours, p.p95_decision_hours) == (n + 1, 30005, 57010)
    assert p.average_decision_hours == pytest.approx((n - 1) / 2)
    assert tuple(q) == ("q", "b", 0, None, None, None)
    p, _ = kpi.decision_turnaround(apps.union(more), exact=True).collect()
    assert (p.median_decision_hours, p.p95_decision_hours) == (30005, pytest.approx(57009.5))


def test_latest_batch_seconds_are_rounded(spark):
    at = lambda *seconds: spark.createDataFrame([("b", s, True) for s in seconds], "load_batch_id string, checked_at string, passed boolean").withColumn("checked_at", F.col("checked_at").cast("timestamp"))
    seconds = [kpi.latest_batch_reconciliation(at(f"2024-01-01 00:00:{s}")).first().checked_at_seconds - 1704067200 for s in ("01.499", "01.5", "02.5", "02.761702")]
    assert seconds == [1, 2, 2, 3] and kpi.latest_batch_reconciliation(at()).first().checked_at_seconds is None
