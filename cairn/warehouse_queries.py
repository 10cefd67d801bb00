"""The engine's vault, store, marts and reconciliation over the change log of `warehouse`, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import quality, reconcile, vault
from cairn.plans import control
from cairn.plans import manifest as M
from cairn.queries import ORACLES, QUERIES, T, clean_tables, query, text
from cairn.sources import readers
from cairn.sources.schemas import ENTITIES
from cairn.streaming import landing
from cairn.warehouse import AFTER, AS_OF, BATCH, warehouse

# --- the log in SQL --------------------------------------------------------------------------------------------------------


def canon(e: str) -> str:
    return f"case when coalesce(upper(trim(({e})::varchar)), '') = '' then '^^' else upper(trim(({e})::varchar)) end"


def hk(namespace: str, *exprs: str) -> str:
    return f"sha256(concat_ws('||', '{namespace}', {', '.join(canon(e) for e in exprs)}))"


iso = lambda e: f"strftime({e}, '%Y-%m-%dT%H:%M:%SZ')"

LOG = f"""
cu as (select c_custkey::varchar as bk, 'r' as op, c_custkey::bigint as lsn, '2020-01-01 00:00:00' as moment, c_custkey as k, c_mktsegment as seg, 'ACTIVE' as st from customer
 union all select user_id::varchar, case event_type when 'signup' then 'c' when 'error' then 'd' else 'u' end, event_id + {AFTER}, ts::varchar, user_id, event_type, case when value < 50 then 'ACTIVE' else 'PASSIVE' end from events where user_id is not null),
ob as (select o_orderkey as k, o_custkey as c, o_orderpriority as pr, cast(o_totalprice as decimal(18,2)) as amount, o_orderstatus as s, o_orderdate as applied, case when o_orderstatus <> 'O' then o_orderdate + to_hours((o_orderkey % 200)::integer) end as decided from orders),
ap as (select k, c, pr, amount, applied, 'c' as op, 3 * k as lsn, applied as ts, c % 25 as br, 'PENDING' as st, null::timestamp as done from ob
 union all select k, c, pr, amount, applied, 'u', 3 * k + 1, decided, (c + case when k % 7 = 0 then 1 else 0 end) % 25, case when s = 'F' then 'APPROVED' else 'REJECTED' end, decided from ob where decided is not null
 union all select k, c, pr, amount, applied, 'd', 3 * k + 2, applied + interval 400 day, (c + case when k % 7 = 0 then 1 else 0 end) % 25, 'PENDING', null from ob where k % 11 = 0),
ow as (select l_orderkey as k, o_custkey as c, o_orderpriority as pr, sum(cast(l_extendedprice as decimal(18,2))) as principal, max(l_returnflag) as flag, min(l_shipdate) as paid, max(l_shipdate) as due from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3),
lo as (select k, c, pr, principal, paid, due, 'c' as op, 3 * k as lsn, paid as ts, case when flag = 'N' then 'CLOSED' else 'ACTIVE' end as st from ow
 union all select k, c, pr, principal, paid, due, 'u', 3 * k + 1, due + interval 1 day, 'DELINQUENT' from ow where flag = 'R'
 union all select k, c, pr, principal, paid, due, 'd', 3 * k + 2, due + interval 2 day, 'CLOSED' from ow where k % 13 = 0)"""

APP, LOAN = "'a' || k", "'l' || k"
CONTEXT = f"{hk('CUSTOMER', 'c')} as customer_hk, {hk('PRODUCT', 'pr')} as product_hk, {hk('CURRENCY', 'c % 5')} as currency_hk"
APP_CONTEXT = hk("APPLICATION_CONTEXT", APP, "c", "pr", "br", "c % 5")
LOAN_CONTEXT = hk("LOAN_CONTEXT", LOAN, APP, "c", "pr", "c % 25", "c % 5")
DOB = "strftime(date '1950-01-01' + (k * 97 % 20000)::integer, '%Y-%m-%d')"
KIND = "case when k % 10 = 0 then 'CORPORATE' else 'INDIVIDUAL' end"
NONE = "null"
DIFF = {
    "cu": hk("SAT_CUSTOMER_DETAILS_HASHDIFF", KIND, NONE, NONE, NONE, NONE, NONE, DOB, "seg", "st", "k % 25", NONE, NONE),
    "ap": hk("SAT_LOAN_APPLICATION_DETAILS_HASHDIFF", "amount", "12 + k % 48", "st", iso("applied"), iso("done"), NONE, iso("applied")),
    "lo": hk("SAT_LOAN_DETAILS_HASHDIFF", "principal", "'0.0' || (1 + k % 9)", "12", "st", iso("paid"), "strftime(due, '%Y-%m-%d')", NONE, NONE),
}
STATUS = "case when op = 'd' then 'DELETED' else 'ACTIVE' end"

# --- hubs, links, satellites -----------------------------------------------------------------------------------------------


def _register(name: str, f, sql: str) -> None:
    QUERIES[name] = f
    ORACLES[name] = f"with {LOG} {sql}"


HUBS = {
    "customer": f"select {hk('CUSTOMER', 'bk')} as hk, bk, lsn from (select *, row_number() over (partition by bk order by moment, lsn) as n from cu where op <> 'd') where n = 1",
    "loan_application": f"select {hk('LOAN_APPLICATION', APP)} as hk, upper({APP}) as bk, lsn from (select *, row_number() over (partition by k order by ts, lsn) as n from ap where op <> 'd') where n = 1",
    "loan": f"select {hk('LOAN', LOAN)} as hk, upper({LOAN}) as bk, lsn from (select *, row_number() over (partition by k order by ts, lsn) as n from lo where op <> 'd') where n = 1",
    "product": f"select {hk('PRODUCT', 'o_orderpriority')} as hk, upper(trim(o_orderpriority)) as bk, min(o_orderkey)::bigint as lsn from orders group by o_orderpriority",
    "branch": f"select {hk('BRANCH', 'n_nationkey')} as hk, n_nationkey::varchar as bk, n_nationkey::bigint as lsn from nation",
    "currency": f"select {hk('CURRENCY', 'r_regionkey')} as hk, r_regionkey::varchar as bk, r_regionkey::bigint as lsn from region",
}
for _e, _sql in HUBS.items():
    _register(f"hub_{_e}", lambda spark, sf, e=_e: warehouse(spark, sf).vault(f"hub_{e}").select(F.col(f"{e}_hk").alias("hk"), F.col(f"{e}_bk").alias("bk"), F.col("kafka_offset").alias("lsn")), _sql)

for _e, _t, _key, _ns in (("customer", "cu", "bk", "CUSTOMER"), ("loan_application", "ap", APP, "LOAN_APPLICATION"), ("loan", "lo", LOAN, "LOAN")):
    _register(
        f"sat_{_e}_details",
        lambda spark, sf, e=_e: warehouse(spark, sf).vault(f"sat_{e}_details").select(F.col(f"{e}_hk").alias("hk"), "hashdiff", "record_operation", F.col("source_lsn").alias("lsn")),
        f", h as (select *, {DIFF[_t]} as hashdiff from {_t} where op <> 'd'), l as (select *, lag(hashdiff) over (partition by k order by lsn) as before from h) select {hk(_ns, _key)} as hk, hashdiff, op as record_operation, lsn::bigint as lsn from l where hashdiff is distinct from before",
    )

FIRST_CONTEXT = f"select {APP_CONTEXT} as application_context_hk, {hk('LOAN_APPLICATION', APP)} as loan_application_hk, {hk('BRANCH', 'br')} as branch_hk, {CONTEXT}, lsn::bigint as lsn from (select *, row_number() over (partition by k, br order by ts, lsn) as n from ap where op <> 'd') where n = 1"
_register("link_application_context", lambda spark, sf: warehouse(spark, sf).vault("link_application_context").select("application_context_hk", "loan_application_hk", "branch_hk", "customer_hk", "product_hk", "currency_hk", F.col("kafka_offset").alias("lsn")), FIRST_CONTEXT)
_register(
    "link_loan_context",
    lambda spark, sf: warehouse(spark, sf).vault("link_loan_context").select("loan_context_hk", "loan_hk", "loan_application_hk", "customer_hk", "product_hk", "currency_hk", F.col("kafka_offset").alias("lsn")),
    f"select {LOAN_CONTEXT} as loan_context_hk, {hk('LOAN', LOAN)} as loan_hk, {hk('LOAN_APPLICATION', APP)} as loan_application_hk, {CONTEXT}, lsn::bigint as lsn from (select *, row_number() over (partition by k order by ts, lsn) as n from lo where op <> 'd') where n = 1",
)
for _e, _t, _key, _context, _ns in (("application", "ap", APP, APP_CONTEXT, "LOAN_APPLICATION"), ("loan", "lo", LOAN, LOAN_CONTEXT, "LOAN")):
    _register(
        f"sat_{_e}_context_effectivity",
        lambda spark, sf, e=_e, h=f"{_ns.lower()}_hk": warehouse(spark, sf).vault(f"sat_{e}_context_effectivity").select(F.col(h).alias("hk"), F.col(f"{e}_context_hk").alias("context_hk"), "record_status", "is_deleted", "effectivity_hashdiff", F.col("source_lsn").alias("lsn")),
        f", s as (select *, {_context} as context_hk, {STATUS} as record_status from {_t}), d as (select *, {hk(f'{_e.upper()}_EFFECTIVITY', 'context_hk', 'record_status')} as effectivity_hashdiff from s), l as (select *, lag(effectivity_hashdiff) over (partition by k order by lsn) as before from d)"
        f" select {hk(_ns, _key)} as hk, context_hk, record_status, op = 'd' as is_deleted, effectivity_hashdiff, lsn::bigint as lsn from l where effectivity_hashdiff is distinct from before",
    )


@query(f"with {LOG} select {hk('LOAN', LOAN)} as loan_hk, upper({APP}) as application_no, lsn::bigint as lsn from lo where op = 'u'")
def loans_resolved_through_persisted(spark, sf):
    """Loans of a batch without applications find theirs in the persisted links."""
    w = warehouse(spark, sf)
    persisted = vault.persisted_applications(w.vault("link_loan_context"), w.vault("hub_loan_application"))
    rows, keys = vault.resolve_loans(w.flat().filter("source_table = 'loans' and operation = 'u'"), False, persisted)
    return rows.select(F.col("_loan_hk").alias("loan_hk"), F.col(keys["loan_application"]).alias("application_no"), F.col("source_lsn").alias("lsn"))


EVERY = f"""every as (select 'mms' as sch, 'customers' as tbl, 'customer_no' as f, 'CUSTOMER' as ns, bk, op, moment, lsn from cu
 union all select 'mms', 'customers', 'customer_no', null, ' ', 'u', ts::varchar, event_id + {3 * AFTER} from events where user_id is not null and event_id % 97 = 3
 union all select 'krd', 'loan_applications', 'application_no', 'LOAN_APPLICATION', {APP}, op, ts::varchar, lsn from ap
 union all select 'krd', 'loans', 'loan_no', 'LOAN', {LOAN}, op, ts::varchar, lsn from lo
 union all select 'prm', 'products', 'product_code', 'PRODUCT', o_orderpriority, 'c', '2020-01-01 00:00:00', min(o_orderkey) from orders group by o_orderpriority
 union all select 'prm', 'branches', 'branch_code', 'BRANCH', n_nationkey::varchar, 'c', '2020-01-01 00:00:00', n_nationkey from nation
 union all select 'prm', 'branches', 'branch_code', 'BRANCH', n_nationkey::varchar, 'd', '2020-01-01 00:00:00', n_nationkey + {AFTER} from nation where n_nationkey = 24
 union all select 'prm', 'currencies', 'currency_code', 'CURRENCY', r_regionkey::varchar, 'c', '2020-01-01 00:00:00', r_regionkey from region
 union all select 'mms', 'customer_contacts', 'customer_no', null, user_id::varchar, 'u', ts::varchar, event_id + {2 * AFTER} from events where user_id is not null and event_id % 97 = 1)"""


@query(f"""with {LOG}, {EVERY}, s as (select *, {STATUS} as record_status from every), l as (select *, lag(record_status) over (partition by tbl, bk order by lsn) as before from s)
select sha256(concat_ws('||', 'SOURCE_RECORD', upper(sch), upper(tbl), upper('{{"' || f || '":"' || bk || '"}}'))) as source_record_hk, record_status, op as record_operation, lsn::bigint as lsn from l where before is null or before <> record_status""")
def source_record_tracking(spark, sf):
    return warehouse(spark, sf).vault("sat_source_record_status").select("source_record_hk", "record_status", "record_operation", F.col("source_lsn").alias("lsn"))


@query(f"""with {LOG}, {EVERY}, s as (select *, {STATUS} as record_status from every where ns is not null), l as (select *, lag(record_status) over (partition by ns, bk order by lsn) as before from s)
select ns as entity_type, sha256(concat_ws('||', ns, upper(trim(bk)))) as entity_hk, upper(trim(bk)) as entity_business_key, record_status, op = 'd' as is_deleted, lsn::bigint as lsn from l where record_status is distinct from before""")
def entity_status_transitions(spark, sf):
    return warehouse(spark, sf).vault("sat_entity_record_status").select("entity_type", "entity_hk", "entity_business_key", "record_status", "is_deleted", F.col("source_lsn").alias("lsn"))


BROKEN = f"""b as (select event_id, case event_id % 97 when 0 then 'UNSUPPORTED_OPERATION' when 1 then 'MISSING_AFTER_IMAGE' when 2 then 'MISSING_EVENT_ID' else 'MISSING_BUSINESS_KEY_CUSTOMER' end as reason_code,
 case event_id % 97 when 2 then sha256('customer_contacts|' || (event_id + {2 * AFTER})) when 3 then 'customers-' || (event_id + {3 * AFTER}) else 'bad-' || event_id end as identity from events where user_id is not null and event_id % 97 < 4)"""


@query(f"with {BROKEN} select sha256(concat_ws('||', identity, reason_code)) as quarantine_hk, reason_code from b")
def quarantine_reasons(spark, sf):
    return warehouse(spark, sf).vault("cdc_raw_vault_events").select("quarantine_hk", "reason_code")


@query(f"with {LOG}, {EVERY} select sch || '.' || tbl as object_name, count(*) as rows from (select *, row_number() over (partition by tbl, bk order by moment desc, lsn desc) as n from every) where n = 1 and op <> 'd' group by 1")
def source_current_counts(spark, sf):
    return vault.current_counts(warehouse(spark, sf).flat())


# --- bounded batches ---------------------------------------------------------------------------------------------------------

CUT = f"(select max(event_id) * 7 // 10 + {AFTER} from events)"


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers' satellite rows of the log up to a position, as an earlier batch, and those of the rest."""
    cut = T(spark, sf, "events").agg(F.expr(f"max(event_id) * 7 div 10 + {AFTER}").alias("cut")).scalar()
    flat = warehouse(spark, sf).flat().filter("source_table = 'customers'")
    old = vault.build_satellite(flat.filter(F.col("source_lsn") <= cut).withColumn("load_batch_id", F.lit("B0")), ENTITIES["customer"])
    return old, vault.build_satellite(flat.filter(F.col("source_lsn") > cut), ENTITIES["customer"])


HALVES = f"h as (select *, {DIFF['cu']} as hashdiff, lsn <= {CUT} as old from cu where op <> 'd')"


@query(f"""with {LOG}, {HALVES}, p as (select bk, hashdiff as was from (select *, row_number() over (partition by bk order by lsn desc) as n from h where old) where n = 1),
c as (select *, lag(hashdiff) over (partition by bk order by lsn) as before, row_number() over (partition by bk order by lsn) as n from h where not old)
select {hk('CUSTOMER', 'bk')} as customer_hk, lsn::bigint as lsn from c left join p using (bk) where hashdiff is distinct from before and (n > 1 or was is null or was <> hashdiff)""")
def bounded_persisted_compare(spark, sf):
    old, new = _halves(spark, sf)
    return vault.after_persisted(new, old, "customer_hk", "hashdiff", BATCH, "sat_customer_details").select("customer_hk", F.col("source_lsn").alias("lsn"))


@query(f"with {LOG}, {HALVES} select {hk('CUSTOMER', 'bk')} as customer_hk, min(lsn) filter (old)::bigint as lsn from h group by bk having min(lsn) filter (old) is not null and max(lsn) filter (not old) is not null")
def out_of_order_rows(spark, sf):
    """The halves the other way round: every customer in both starts before what is persisted."""
    old, new = _halves(spark, sf)
    return vault.against_persisted(old, new, "customer_hk", "hashdiff", "B0").filter("_late").select("customer_hk", F.col("source_lsn").alias("lsn"))


@query(f"with {LOG} select {hk('CUSTOMER', 'bk')} as customer_hk, case when min(lsn) <= {CUT} then 'B0' else 'B1' end as load_batch_id from cu where op <> 'd' group by bk")
def insert_only_merge_result(spark, sf):
    """A hub after two merges: rows of the first stay as they are."""
    w = warehouse(spark, sf)
    cut = T(spark, sf, "events").agg(F.expr(f"max(event_id) * 7 div 10 + {AFTER}").alias("cut")).scalar()
    flat = w.flat().filter("source_table = 'customers'")
    w.store.merge_new("merged_hub", vault.build_hub(flat.filter(F.col("source_lsn") <= cut).withColumn("load_batch_id", F.lit("B0")), ENTITIES["customer"]), "customer_hk", "B0")
    w.store.merge_new("merged_hub", vault.build_hub(flat, ENTITIES["customer"]), "customer_hk", BATCH)
    return w.store.read("merged_hub").select("customer_hk", "load_batch_id")


@query("select 0::bigint as version, 'CREATE' as operation, count(*) as rows_inserted from nation union all select 1, 'MERGE', count(*) from customer union all select 2, 'OVERWRITE', count(*) from region")
def store_history(spark, sf):
    w = warehouse(spark, sf)
    table = f"history-{uuid.uuid4().hex}"
    keys = lambda t, c: T(spark, sf, t).select(F.concat_ws("-", F.lit(t), c).alias("k"))
    w.store.merge_new(table, keys("nation", "n_nationkey"), "k")
    w.store.merge_new(table, keys("nation", "n_nationkey"), "k")  # nothing new: no version
    w.store.merge_new(table, keys("nation", "n_nationkey").unionAll(keys("customer", "c_custkey")), "k")
    w.store.overwrite(table, keys("region", "r_regionkey"))
    assert w.store.read(table, 0).count() == T(spark, sf, "nation").count()
    return w.store.history(table).select("version", "operation", "rows_inserted")


RULES = f"""n as (select (select count(*) from every) + (select count(*) from events where user_id is not null and event_id % 97 in (0, 2)) as events, (select count(*) from events where user_id is not null and event_id % 97 < 4) as bad),
rules as (select 'MANIFEST_TO_BRONZE_EVENT_COUNT' as check_scope, 'bronze_batch' as object_name, events as expected_count, events as actual_count from n
 union all select 'MANIFEST_TO_UNIQUE_KAFKA_COORDINATES', 'bronze_batch', events, events from n
 union all select 'BRONZE_CLASSIFICATION_CONSERVATION', 'accepted_plus_quarantine', events, events from n
 union all select 'BOUNDED_BATCH_TO_TARGET_MISSING_KEYS', 'hub_customer', 0, count(distinct bk) filter (bk like '%7') from cu where op <> 'd'
 union all select 'BOUNDED_BATCH_TO_TARGET_MISSING_KEYS', 'hub_branch', 0, 0)"""


@query(f"with {LOG}, {EVERY}, {RULES} select check_scope, object_name, expected_count::bigint as expected_count, actual_count::bigint as actual_count, (actual_count - expected_count)::bigint as difference, expected_count = actual_count as passed from rules")
def conservation_counts(spark, sf):
    """Evidence of a batch, with a hub that lost every customer whose number ends in 7."""
    w = warehouse(spark, sf)
    flat = w.flat()
    targets = {"hub_customer": w.vault("hub_customer").filter("customer_bk not like '%7'"), "hub_branch": w.vault("hub_branch")}
    rules = reconcile.bounded_rules(flat, {t: vault.build(t, flat) for t in targets}, targets, {"interval_object_count": flat.count()})
    return reconcile.report(spark, rules, BATCH).select("check_scope", "object_name", "expected_count", "actual_count", "difference", "passed")


@query(f"with {LOG}, {EVERY} select case when ns is null then 'SOURCE_TO_BRONZE_CURRENT_STATE' else 'BRONZE_TO_HUB_HISTORICAL_KEYS' end as check_scope, name as object_name, n::bigint as expected_count, n::bigint as actual_count from (select null as ns, 'prm.currencies' as name, (select count(*) from region) as n union all select ns, 'hub_' || lower(ns), count(distinct bk) from every where ns is not null and op <> 'd' group by ns)")
def history_rules(spark, sf):
    w = warehouse(spark, sf)
    hubs = [t for t in vault.TABLES if t.startswith("hub_")]
    rules = reconcile.history_rules(w.flat(), {t: vault.build(t, w.flat()) for t in hubs}, {t: w.vault(t) for t in hubs}, {"prm.currencies": T(spark, sf, "region").count()})
    return reconcile.report(spark, rules, BATCH).select("check_scope", "object_name", "expected_count", "actual_count")


@query(f"with {LOG} select {LOAN} as bk, op, lsn::bigint as lsn from lo where lsn <= (select max(k) * 2 from ow)")
def bounded_scan(spark, sf):
    """Landed objects of one topic up to a high mark, read back and flattened."""
    w = warehouse(spark, sf)
    root = f"{w.store.root}/bronze-{uuid.uuid4().hex}"
    w.events().filter("_metadata.source_table = 'loans'").write.json(root)
    high = w.flat().filter("source_table = 'loans'").agg(F.expr("cast(max(source_lsn div 3) * 2 as bigint)").alias("high"))
    bounds = high.select(F.lit("krd.loans").alias("topic"), F.lit(0).alias("partition"), "high")
    rows = vault.rows_of(vault.flatten(readers.read_events(spark, root, bounds), BATCH), "krd", "loans", deletes=True)
    return rows.select(F.get_json_object("key", "$.loan_no").alias("bk"), F.col("operation").alias("op"), F.col("source_lsn").alias("lsn"))


@query(f"""with {LOG}, {EVERY}, r as (select sch, tbl, op, lsn from every where tbl in ('branches', 'customer_contacts') union all select 'mms', 'customer_contacts', 'x', event_id + {2 * AFTER} from events where user_id is not null and event_id % 97 in (0, 2))
select sha256(sch || '.' || tbl || ':0:' || lsn) as event_id, op as operation, 'bronze/cdc/source=core_banking/schema=' || sch || '/table=' || tbl || '/event_date=1970-01-01/topic=' || sch || '.' || tbl || '/partition=0/offset=' || lpad(lsn::varchar, 20, '0') || '.json' as object_key,
 case when op = 'x' then 'operation is unknown' end as problem from r""")
def normalized_records(spark, sf):
    e = warehouse(spark, sf).events().filter("_metadata.source_table in ('branches', 'customer_contacts')")
    m = F.col("_metadata")
    body = F.to_json(F.col("value"), {"ignoreNullFields": "false"})
    records = e.select(m["kafka_topic"].alias("topic"), m["kafka_partition"].alias("partition"), m["kafka_offset"].alias("offset"), F.timestamp_millis(F.lit(0).cast("long")).alias("timestamp"), F.col("key").cast("binary").alias("key"), body.cast("binary").alias("value"))
    out = landing.normalize(records)
    return out.select("_metadata.event_id", "_metadata.operation", "_metadata.object_key", "problem")


# --- marts -------------------------------------------------------------------------------------------------------------------

GOLD = f"""{LOG}, live as (select bk from (select *, row_number() over (partition by bk order by lsn desc) as n from cu) where n = 1 and op <> 'd'),
dc as (select d.*, {KIND} as customer_type, date_sub('year', date '1950-01-01' + (k * 97 % 20000)::integer, date '{AS_OF}') as y from (select *, row_number() over (partition by bk order by moment desc, lsn desc) as n from cu where op <> 'd') d join live using (bk) where n = 1),
fa as (select a.*, {STATUS} as state from (select *, row_number() over (partition by k order by lsn desc) as n from ap where op <> 'd') a join live on bk = c::varchar where n = 1 and k % 11 <> 0 and br <> 24),
fl as (select l.* from (select *, row_number() over (partition by k order by lsn desc) as n from lo where op <> 'd') l join live on bk = c::varchar where n = 1 and k % 13 <> 0 and c % 25 <> 24)"""
money = lambda c: F.col(c).cast("double").alias(c)


def _mart(name: str, mart: str, columns: Callable[[], list], sql: str) -> None:
    QUERIES[name] = lambda spark, sf: warehouse(spark, sf).gold(mart).select(*columns())  # columns need a session
    ORACLES[name] = f"with {GOLD} {sql}"


BANDS = "case when y is null then 'UNKNOWN' when y < 18 then 'UNDER_18' when y < 25 then '18_24' when y < 35 then '25_34' when y < 45 then '35_44' when y < 55 then '45_54' when y < 65 then '55_64' else '65_PLUS' end"
_mart("dim_customer_current", "dim_customer_current", lambda: ["customer_id", "customer_type", "segment_code", "status_code", "home_branch_code", "age_band", "is_active"], f"select bk as customer_id, customer_type, seg as segment_code, st as status_code, (k % 25)::varchar as home_branch_code, {BANDS} as age_band, st = 'ACTIVE' as is_active from dc")
_mart("dim_product_current", "dim_product_current", lambda: ["product_code", "product_type", "default_currency_code", "is_active"], "select upper(o_orderpriority) as product_code, 'LOAN' as product_type, '0' as default_currency_code, min(o_orderkey) % 2 = 0 as is_active from orders group by o_orderpriority")
_mart("dim_branch_current", "dim_branch_current", lambda: ["branch_code", "branch_name", "city", "is_active"], "select n_nationkey::varchar as branch_code, n_name as branch_name, left(n_name, 3) as city, true as is_active from nation where n_nationkey <> 24")
_mart("dim_currency_current", "dim_currency_current", lambda: ["currency_code", "currency_name", "minor_unit", "is_active"], "select r_regionkey::varchar as currency_code, r_name as currency_name, 2::integer as minor_unit, false as is_active from region")
_mart(
    "fct_applications", "fct_loan_applications_current",
    lambda: ["application_id", "application_context_hk", "customer_id", "product_code", "branch_code", "currency_code", money("requested_amount"), "term_months", "application_status_code", F.col("decision_duration_hours").cast("long").alias("decision_duration_hours"), "is_decided", "is_approved"],
    f"select upper({APP}) as application_id, {APP_CONTEXT} as application_context_hk, c::varchar as customer_id, upper(pr) as product_code, br::varchar as branch_code, (c % 5)::varchar as currency_code, amount::double as requested_amount, (12 + k % 48)::integer as term_months, st as application_status_code, date_sub('hour', applied, done)::bigint as decision_duration_hours, st in ('APPROVED', 'REJECTED') as is_decided, st = 'APPROVED' as is_approved from fa",
)
_mart(
    "fct_loans", "fct_loans_current",
    lambda: ["loan_id", "application_id", "loan_context_hk", "customer_id", "product_code", "branch_code", "currency_code", money("principal_amount"), money("annual_interest_rate"), "loan_status_code", text("disbursed_at").alias("disbursed_at"), text("maturity_date").alias("maturity_date"), "is_active", "is_delinquent"],
    f"select upper({LOAN}) as loan_id, upper({APP}) as application_id, {LOAN_CONTEXT} as loan_context_hk, c::varchar as customer_id, upper(pr) as product_code, (c % 25)::varchar as branch_code, (c % 5)::varchar as currency_code, principal::double as principal_amount, (1 + k % 9) / 100.0 as annual_interest_rate, st as loan_status_code, paid::varchar as disbursed_at, strftime(due, '%Y-%m-%d') as maturity_date, st = 'ACTIVE' as is_active, st = 'DELINQUENT' as is_delinquent from fl",
)
PORTFOLIO = "pf as (select c::varchar as customer_id, (c % 5)::varchar as currency_code, count(*) as loan_count, count(*) filter (st = 'ACTIVE') as active_loan_count, count(*) filter (st = 'DELINQUENT') as delinquent_loan_count, count(*) filter (st = 'CLOSED') as closed_loan_count, sum(principal)::double as total_principal_amount, round(sum(1 + k % 9) / 100.0 / count(*), 6)::double as average_annual_interest_rate, min(paid)::varchar as first_disbursed_at, max(paid)::varchar as latest_disbursed_at from fl group by c)"
_mart(
    "portfolio_agg", "agg_customer_loan_portfolio",
    lambda: ["customer_id", "customer_type", "segment_code", "currency_code", "loan_count", "active_loan_count", "delinquent_loan_count", "closed_loan_count", money("total_principal_amount"), F.round(F.col("average_annual_interest_rate").cast("double"), 6).alias("average_annual_interest_rate"), text("first_disbursed_at").alias("first_disbursed_at"), text("latest_disbursed_at").alias("latest_disbursed_at")],
    f", {PORTFOLIO} select pf.*, customer_type, seg as segment_code from pf join dc on bk = customer_id",
)
TRACED = f"""traced as (select 'dim_customer_current' as gold_model, bk as gold_business_key, 'current_attributes' as lineage_role from dc
 union all select 'dim_product_current', upper(o_orderpriority), 'current_attributes' from orders group by o_orderpriority
 union all select 'dim_branch_current', n_nationkey::varchar, 'current_attributes' from nation where n_nationkey <> 24
 union all select 'dim_currency_current', r_regionkey::varchar, 'current_attributes' from region
 union all select 'fct_loan_applications_current', upper({APP}), unnest(['current_attributes', 'business_context']) from ob where k % 11 <> 0
 union all select 'fct_loans_current', upper({LOAN}), unnest(['current_attributes', 'business_context']) from ow where k % 13 <> 0
 union all select 'agg_customer_loan_portfolio', c::varchar || '||' || (c % 5), 'contributing_loan' from fl
 union all select distinct 'agg_customer_loan_portfolio', c::varchar || '||' || (c % 5), 'customer_classification' from fl)"""


@query(f"with {GOLD}, {TRACED} select gold_model, lineage_role, gold_business_key, count(*) as rows from traced group by 1, 2, 3")
def lineage_union(spark, sf):
    return warehouse(spark, sf).traces().lineage().groupBy("gold_model", "lineage_role", "gold_business_key").agg(F.count(F.lit(1)).alias("rows"))


@query(f"with {GOLD}, {TRACED} select 'fct_loans_current' as gold_model, gold_business_key, 'any' as lineage_role, count(*) as rows from traced where gold_model = 'fct_loans_current' group by 2")
def lineage_unique(spark, sf):
    """With roles and sources blurred, every loan appears twice."""
    blurred = warehouse(spark, sf).traces().lineage("fct_loans_current").withColumns({"lineage_role": F.lit("any"), "source_event_id": F.lit("any")})
    return quality.lineage_unique(blurred).select("gold_model", "gold_business_key", "lineage_role", "rows")


@query(f"with {GOLD}, {TRACED} select gold_model, gold_business_key from traced where gold_model like 'dim_%' and gold_business_key like '%7'")
def lineage_complete(spark, sf):
    """Mart rows whose lineage is taken away: dimension keys that end in 7."""
    t = warehouse(spark, sf).traces()
    kept = t.marts["gold_row_lineage"].filter("gold_model not like 'dim_%' or gold_business_key not like '%7'")
    return quality.lineage_complete(kept, t.marts).select("gold_model", "gold_business_key")


@query(f"with {LOG} select 'CUSTOMER' as entity_type, {hk('CUSTOMER', 'bk')} as entity_hk from (select *, row_number() over (partition by bk order by lsn desc) as n from cu) where n = 1 and op = 'd'")
def deleted_still_present(spark, sf):
    """A customer dimension that kept everyone who was ever there."""
    w = warehouse(spark, sf)
    return quality.deleted_in_gold(w.vault("sat_entity_record_status"), w.marts(dim_customer_current=w.vault("hub_customer")))


@query(f"with {LOG}, a as (select a.k, a.c, a.pr, a.br as old_br, b.br from ap a join ap b using (k) where a.op = 'c' and b.op = 'u' and a.br <> b.br and k % 11 <> 0) select 'LOAN_APPLICATION' as entity_type, {hk('LOAN_APPLICATION', APP)} as entity_hk, {hk('APPLICATION_CONTEXT', APP, 'c', 'pr', 'old_br', 'c % 5')} as gold_context_hk, {APP_CONTEXT} as expected_context_hk from a")
def stale_context_theta(spark, sf):
    """A fact with every context that its applications ever had."""
    w = warehouse(spark, sf)
    return quality.stale_context(w.marts(fct_loan_applications_current=w.vault("link_application_context")))


@query(f"with {GOLD}, {TRACED} select table_name, n as rows, n as distinct_grain, true as valid from (select 'dim_customer_current' as table_name, count(*) as n from dc union all select 'dim_branch_current', count(*) from nation where n_nationkey <> 24 union all select 'fct_loan_applications_current', count(*) from fa union all select 'fct_loans_current', count(*) from fl union all select 'agg_customer_loan_portfolio', count(distinct c) from fl union all select 'gold_row_lineage', count(*) from traced)")
def grain_report(spark, sf):
    t = warehouse(spark, sf).traces()
    names = ("dim_customer_current", "dim_branch_current", "fct_loan_applications_current", "fct_loans_current", "agg_customer_loan_portfolio", "gold_row_lineage")
    return quality.grain_report({n: t.marts[n] for n in names})


@query(f"with {LOG}, h as (select bk, {DIFF['cu']} as hashdiff, lsn from cu where op <> 'd'), l as (select *, lag(hashdiff) over (partition by bk order by lsn) as before from h) select max(n)::bigint as most_versions, count(*)::bigint as keys from (select bk, count(*) as n from l where hashdiff is distinct from before group by bk)")
def multiversion_max(spark, sf):
    return quality.deepest(warehouse(spark, sf).vault("sat_customer_details"), "customer_hk")


# --- the batch path ------------------------------------------------------------------------------------------------------------


def _star(spark, sf, name: str) -> DataFrame:
    return warehouse(spark, sf).star(clean_tables(spark, sf), name)


@query("""
select l_orderkey::varchar as transaction_id, o_custkey::varchar as customer_id, min(l_suppkey)::varchar as merchant_id, sum(cast(l_extendedprice as decimal(18,2)))::double as amount,
 strftime(max(l_shipdate), '%Y-%m-%d') as transaction_date, hour(max(l_shipdate))::integer as transaction_hour, strftime(max(l_shipdate), '%Y-%m') as transaction_month
from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey group by l_orderkey, o_custkey
""")
def fact_transactions(spark, sf):
    """The whole batch path: cleanse, vault, star."""
    return _star(spark, sf, "fact_transactions").select("transaction_id", "customer_id", "merchant_id", "amount", F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"), "transaction_hour", "transaction_month")


@query(f"select c_custkey::varchar as customer_id, 'A ' || c_name as customer_full_name, case when regexp_matches(c_name || '@x.org', '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then c_name || '@x.org' end as email, date_sub('year', date '1990-02-28', date '{AS_OF}')::integer as age, c_mktsegment as customer_segment from customer")
def dim_customer(spark, sf):
    return _star(spark, sf, "dim_customer").select("customer_id", "customer_full_name", "email", "age", "customer_segment")


@query("select o_orderkey::varchar as account_id, o_custkey::varchar as customer_id, o_orderpriority as account_type, o_orderstatus as account_status, o_totalprice as credit_limit, o_orderdate::varchar as opened_at from orders join customer on c_custkey = o_custkey")
def dim_account(spark, sf):
    return _star(spark, sf, "dim_account").select("account_id", "customer_id", "account_type", "account_status", "credit_limit", text("opened_at").alias("opened_at"))


@query("select s_suppkey::varchar as merchant_id, s_nationkey as risk_score, case when s_nationkey >= 80 then 'high' when s_nationkey >= 50 then 'medium' else 'low' end as risk_band from supplier")
def dim_merchant(spark, sf):
    return _star(spark, sf, "dim_merchant").select("merchant_id", "risk_score", "risk_band")


@query("select sha256(o_custkey::varchar || '||' || o_orderkey) as customer_account_hk, sha256(o_custkey::varchar) as customer_hk, sha256(o_orderkey::varchar) as account_hk from orders join customer on c_custkey = o_custkey")
def link_customer_account(spark, sf):
    return _star(spark, sf, "link_customer_account").select("customer_account_hk", "customer_hk", "account_hk")


@query("with t as (select distinct l_orderkey as k, o_custkey as c, c_custkey as known from lineitem join orders on l_orderkey = o_orderkey left join customer on c_custkey = o_custkey) select 'transactions' as table_name, count(*) as raw, count(known) as clean, count(*) - count(known) as rejected from t union all select 'customers', count(*), count(*), 0 from customer union all select 'accounts', count(*), count(c_custkey), count(*) - count(c_custkey) from orders left join customer on c_custkey = o_custkey union all select 'merchants', count(*), count(*), 0 from supplier")
def clean_counts(spark, sf):
    from cairn.operators import star

    raw = clean_tables(spark, sf)
    _star(spark, sf, "fact_transactions")
    return star.clean_counts(raw, {t: warehouse(spark, sf).batch.read(f"clean_{t}") for t in raw})


# --- control -------------------------------------------------------------------------------------------------------------------


@query("""
select n_name as batch_id, (select count(*) from customer c where c.c_nationkey = n_nationkey)::bigint as partition_count, (select coalesce(sum(c.c_custkey), 0) from customer c where c.c_nationkey = n_nationkey)::bigint as interval_object_count,
 (select coalesce(max(s.s_suppkey), 0) from supplier s where s.s_nationkey = n_nationkey)::bigint as latest_attempt_number from nation
""")
def batch_history(spark, sf):
    """The control plane's history of batches, over nations as batches, customers as partitions and suppliers as attempts."""
    n = T(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("batch_id"))
    parts = T(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("batch_id", F.col("c_custkey").alias("interval_object_count"), F.lit(0).cast("long").alias("interval_input_bytes"))
    tries = T(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("batch_id", F.col("s_suppkey").alias("attempt_number"))
    return control.batch_history(n.select("batch_id"), parts, tries).select("batch_id", "partition_count", "interval_object_count", "latest_attempt_number")


INTERVALS = "i as (select event_type as topic, event_id // 200 as batch, min(event_id) - 1 as low, max(event_id) + case when event_id // 200 % 7 = 0 then 25 else 0 end as high from events group by 1, 2)"


@query(f"with {INTERVALS} select a.topic, a.batch::bigint as batch_a, b.batch::bigint as batch_b from i a join i b on a.topic = b.topic and a.batch < b.batch and a.low < b.high and b.low < a.high")
def published_interval_overlap(spark, sf):
    e = T(spark, sf, "events").withColumn("batch_id", F.expr("event_id div 200"))
    i = e.groupBy(F.col("event_type").alias("topic"), F.lit(0).alias("partition"), "batch_id").agg((F.min("event_id") - 1).alias("watermark_low"), (F.max("event_id") + F.when(F.col("batch_id") % 7 == 0, 25).otherwise(0)).alias("watermark_high"))
    return control.overlapping(i).select("topic", F.col("batch_id").alias("batch_a"), F.col("other_batch_id").alias("batch_b"))


@query(f"with {LOG}, {EVERY} select lsn // 10 as txid, count(*)::bigint as observed_event_count, min(lsn)::bigint as event_lsn_low, max(lsn)::bigint as event_lsn_high, false as untracked from every where tbl = 'loans' group by 1")
def txn_summary(spark, sf):
    return M.transaction_summary(warehouse(spark, sf).flat().filter("source_table = 'loans'"))


@query(f"with {LOG}, {EVERY} select sch || '.' || tbl as table_name, op as operation, count(*) as events from every where tbl <> 'customer_contacts' group by 1, 2")
def event_counts(spark, sf):
    return M.event_counts(warehouse(spark, sf).flat().filter("source_table <> 'customer_contacts'"))


FINGERPRINTED = ("customer", "orders", "part", "supplier", "nation", "region", "lineitem", "events")


def _fingerprint_sql(table: str, columns: list[str]) -> str:
    cells = " || ".join(f"coalesce(length({c}::varchar)::varchar || ':' || {c}::varchar, '-1:')" for c in columns)
    return f"select '{table}' as table_name, count(*) as row_count, bit_xor(h)::varchar || '-' || (sum(h) % {2**61 - 1})::varchar as checksum from (select ('0x' || left(md5({cells}), 15))::bigint as h from {table})"


STAR_COLUMNS = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "nation": "n_nationkey n_name n_regionkey", "region": "r_regionkey r_name",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
}


@query(" union all ".join(_fingerprint_sql(t, STAR_COLUMNS[t].split()) for t in FINGERPRINTED))
def fingerprint(spark, sf):
    """Rows and checksum of every star table."""
    from cairn.operators import fingerprint as FP

    parts = [FP.fingerprint(T(spark, sf, t).select(*STAR_COLUMNS[t].split())).withColumn("table_name", F.lit(t)) for t in FINGERPRINTED]
    return reduce(DataFrame.unionByName, parts)
