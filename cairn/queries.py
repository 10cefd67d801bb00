"""The engine's operators over the driver's tables: a query, and the same result in DuckDB SQL.  Vault, store and marts are in
`warehouse_queries`, over a change log of the same tables.

Roles: customer -> customer, part -> product, nation/supplier -> branch, region -> currency, orders -> application,
lineitem -> loan (summed per order, as its own key is not unique), events -> change-event log.
Hash and time columns are text on both sides, counts are longs, ratios doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import fingerprint as FP
from cairn.operators import policy, quality
from cairn.operators.history import changes_by, latest_attributes, latest_state, source_history, top_by
from cairn.operators.reconcile import missing_keys
from cairn.operators.vault import not_after
from cairn.plans import kpi
from cairn.plans import manifest as M
from cairn.streaming.landing import consumer_lag

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-06-30"
#: Events up to this share of the highest id count as persisted, the rest as the batch.
SPLIT = "(select max(event_id) * 7 // 10 from events)"
#: Change-event view of `events` in SQL.
E = "e as (select user_id, event_id, ts, event_type, value, props, case event_type when 'signup' then 'c' when 'error' then 'd' else 'u' end as op from events)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:  # noqa: N802
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(c: str):
    return F.col(c).cast("string")


def long(c):
    return c.cast("long")


def cdc(spark: SparkSession, sf: str) -> DataFrame:
    """events with the positions and audit columns of a change log."""
    e = T(spark, sf, "events")
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return e.select(
        "user_id", "event_id", "ts", "event_type", "value", "props", op.alias("op"), F.col("ts").alias("load_datetime"), F.col("ts").alias("effective_from"), F.lit("events").alias("kafka_topic"),
        F.lit(0).alias("kafka_partition"), F.col("event_id").alias("kafka_offset"), F.col("event_id").alias("source_lsn"), text("event_id").alias("source_event_id"),
    )


def mark(df: DataFrame, tenths: int):
    """The id below which so many tenths of the id range lie: a scalar subquery, so the scan can be pruned by it."""
    return df.agg(F.expr(f"max(event_id) * {tenths} div 10").alias("cut")).scalar()


# --- hubs, links, satellites -------------------------------------------------------------------------------------------


@query(f"with {E}, r as (select *, row_number() over (partition by user_id order by ts, event_id) as n from e) select sha256(concat_ws('||', 'CUSTOMER', user_id::varchar)) as hk, user_id::varchar as bk, ts::varchar as load_datetime, event_id as kafka_offset from r where n = 1")
def hub_first_arrival_events(spark, sf):
    from cairn.operators.history import first_arrival

    first = top_by(cdc(spark, sf), ["user_id"], first_arrival())
    return first.select(X.hash_key("CUSTOMER", "user_id").alias("hk"), text("user_id").alias("bk"), text("ts").alias("load_datetime"), "kafka_offset")


HASHDIFF = "sha256(concat_ws('||', 'SAT_EVENT_HASHDIFF', upper(trim(event_type)), case when trim(coalesce(props, '')) = '' then '^^' else upper(trim(props)) end))"


@query(f"with {E}, h as (select *, {HASHDIFF} as hashdiff from e), l as (select *, lag(hashdiff) over (partition by user_id order by event_id, ts) as before from h) select event_id, user_id, op, hashdiff from l where before is null or before <> hashdiff")
def sat_change_capture(spark, sf):
    rows = cdc(spark, sf).withColumn("hashdiff", X.hash_key("SAT_EVENT_HASHDIFF", "event_type", "props"))
    return changes_by(rows, ["user_id"], source_history(), "hashdiff").select("event_id", "user_id", "op", "hashdiff")


STATUS = "case when op = 'd' then 'DELETED' else 'ACTIVE' end"


@query(f"""
with {E}, s as (select *, sha256(concat_ws('||', 'CONTEXT', user_id::varchar, upper(event_type))) as context_hk, {STATUS} as record_status from e),
d as (select *, sha256(concat_ws('||', 'EFFECTIVITY', upper(context_hk), record_status)) as hashdiff from s),
l as (select *, lag(hashdiff) over (partition by user_id order by event_id, ts) as before from d)
select user_id, context_hk, record_status, event_id from l where hashdiff is distinct from before
""")
def effectivity_aba(spark, sf):
    rows = cdc(spark, sf).select("*", X.hash_key("CONTEXT", "user_id", "event_type").alias("context_hk"), F.when(F.col("op") == "d", "DELETED").otherwise("ACTIVE").alias("record_status"))
    rows = rows.withColumn("hashdiff", X.hash_key("EFFECTIVITY", "context_hk", "record_status"))
    return changes_by(rows, ["user_id"], source_history(), "hashdiff").select("user_id", "context_hk", "record_status", "event_id")


@query(f"with {E}, r as (select *, row_number() over (partition by user_id order by event_id desc, ts desc) as n from e) select user_id, event_id, event_type from r where n = 1 and op <> 'd'")
def current_state_active(spark, sf):
    return top_by(cdc(spark, sf), ["user_id"], latest_state()).filter("op <> 'd'").select("user_id", "event_id", "event_type")


@query(f"with {E}, r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from e) select user_id, event_id, event_type, value, ts::varchar as effective_from from r where n = 1")
def latest_attributes_by_user(spark, sf):
    return top_by(cdc(spark, sf), ["user_id"], latest_attributes()).select("user_id", "event_id", "event_type", "value", text("ts").alias("effective_from"))


@query("select distinct c_custkey as user_id from customer where not exists (select 1 from events where user_id = c_custkey)")
def missing_target_keys(spark, sf):
    return missing_keys(T(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), T(spark, sf, "events"), "user_id")


# --- manifests, control --------------------------------------------------------------------------------------------------


@query(f"""
with p as (select event_type as topic, max(event_id) as low from events where event_id <= {SPLIT} group by 1)
select event_type as topic, 0 as partition, coalesce(low, -1)::bigint as watermark_low, max(event_id)::bigint as watermark_high,
 count(*) filter (event_id > coalesce(low, -1))::bigint as interval_object_count, coalesce(sum(length(props)) filter (event_id > coalesce(low, -1)), 0)::bigint as interval_input_bytes
from events left join p on p.topic = event_type group by event_type, low
""")
def manifest_bounds(spark, sf):
    e = T(spark, sf, "events")
    objects = e.select(F.col("event_type").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.length("props").alias("size_bytes"))
    old = e.filter(F.col("event_id") <= mark(e, 7))
    published = old.groupBy(F.col("event_type").alias("topic"), F.lit(0).alias("partition")).agg(F.max("event_id").alias("watermark_high"))
    out = M.bounds_of(objects, published)
    return out.select("topic", "partition", "watermark_low", "watermark_high", "interval_object_count", "interval_input_bytes")


@query(f"select event_id, event_type from events where event_id > {SPLIT} and event_id <= (select max(event_id) * 9 // 10 from events)")
def bounded_interval(spark, sf):
    e = T(spark, sf, "events")
    return e.filter((F.col("event_id") > mark(e, 7)) & (F.col("event_id") <= mark(e, 9))).select("event_id", "event_type")


@query("with l as (select user_id as txid, max(event_id) as lsn_position, count(*) as n from events group by 1), o as (select distinct user_id as txid from events where event_type = 'error') select txid, lsn_position::bigint as lsn_position, n::bigint as n from l where lsn_position <= (select max(lsn_position) from l join o using (txid))")
def ledger_boundary(spark, sf):
    e = T(spark, sf, "events")
    ledger = e.groupBy(F.col("user_id").alias("txid")).agg(F.max("event_id").alias("lsn_position"), F.count(F.lit(1)).alias("n"))
    return M.ledger_through(ledger, e.filter("event_type = 'error'").select(F.col("user_id").alias("txid")))


@query("select user_id as topic_id, greatest(max(event_id) - coalesce(max(event_id) filter (event_type = 'purchase'), 0), 0)::bigint as lag from events group by 1")
def consumer_lag_by_user(spark, sf):
    e = T(spark, sf, "events").select(F.col("user_id").alias("topic"), F.lit(0).alias("partition"), "event_id", "event_type")
    high = e.groupBy("topic", "partition").agg(F.max("event_id").alias("high"))
    done = e.filter("event_type = 'purchase'").groupBy("topic", "partition").agg(F.max("event_id").alias("committed"))
    return consumer_lag(high, done).select(F.col("topic").alias("topic_id"), "lag")


# --- cleansing, expressions ----------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem where l_quantity > 30 and exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F') and exists (select 1 from part where p_partkey = l_partkey and p_size > 25) and exists (select 1 from supplier where s_suppkey = l_suppkey and s_acctbal > 0)")
def clean_semi_join(spark, sf):
    from cairn.operators.star import conform

    rows = T(spark, sf, "lineitem").filter("l_quantity > 30").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    orders = T(spark, sf, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    parts = T(spark, sf, "part").filter("p_size > 25").withColumnRenamed("p_partkey", "l_partkey")
    suppliers = T(spark, sf, "supplier").filter("s_acctbal > 0").withColumnRenamed("s_suppkey", "l_suppkey")
    return conform(rows, (orders, ["l_orderkey"]), (parts, ["l_partkey"]), (suppliers, ["l_suppkey"]))


@query("select o_orderkey, o_custkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')")
def semi_orders(spark, sf):
    c = T(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return T(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi")


@query("select c_custkey, c_name from customer where not exists (select 1 from events where user_id = c_custkey)")
def anti_customers(spark, sf):
    return T(spark, sf, "customer").select("c_custkey", "c_name").join(T(spark, sf, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti")


@query("select user_id, event_type, ts::varchar as ts, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) where n = 1 and user_id is not null")
def dedup_required(spark, sf):
    return top_by(T(spark, sf, "events"), ["user_id", "event_type"], [F.asc("event_id")]).dropna(subset=["user_id"]).select("user_id", "event_type", text("ts").alias("ts"), "event_id")


@query("select p_partkey, try_cast(replace(regexp_extract(p_name, '[0-9]+', 0), ',', '.') as double) as number, try_cast(p_brand as integer)::double as brand, try_cast(p_size::varchar as integer) as size from part")
def try_cast_cleanse(spark, sf):
    digits = F.regexp_extract("p_name", "[0-9]+", 0)
    return T(spark, sf, "part").select("p_partkey", X.comma_number(digits).alias("number"), F.col("p_brand").try_cast("int").cast("double").alias("brand"), text("p_size").try_cast("int").alias("size"))


@query(r"select c_custkey, case when regexp_matches(a, '^[^@\s]+@[^@\s]+\.[^@\s]+$') then a end as email from (select c_custkey, case when c_acctbal < 0 then replace(c_name, '#', '@') else replace(c_name, '#', '@') || '.example' end as a from customer)")
def email_like_regex(spark, sf):
    at = F.translate("c_name", "#", "@")
    rows = T(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, at).otherwise(F.concat(at, F.lit(".example"))).alias("a"))
    return rows.select("c_custkey", X.valid_email("a").alias("email"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_field(spark, sf):
    return T(spark, sf, "events").select("event_id", X.image_field("k", "props").alias("k"))


@query("select event_id, coalesce(json_extract_string(case when event_type = 'error' then null else props end, '$.k'), json_extract_string(props, '$.k')) as k from events")
def image_fallback(spark, sf):
    rows = T(spark, sf, "events").withColumns({"after": F.when(F.col("event_type") != "error", F.col("props")), "before": F.col("props")})
    return rows.select("event_id", X.change_field("k").alias("k"))


@query("select c_custkey, case when s >= 80 then 'high' when s >= 50 then 'medium' when s is not null then 'low' else 'unknown' end as risk_band from (select c_custkey, case when c_acctbal < 0 then null else c_acctbal / 100 end as s from customer)")
def risk_band(spark, sf):
    return T(spark, sf, "customer").select("c_custkey", X.risk_band(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100)).alias("risk_band"))


@query(f"select o_orderkey, case when y is null then 'UNKNOWN' when y < 18 then 'UNDER_18' when y < 25 then '18_24' when y < 35 then '25_34' when y < 45 then '35_44' when y < 55 then '45_54' when y < 65 then '55_64' else '65_PLUS' end as age_band, y::integer as years from (select o_orderkey, date_sub('year', o_orderdate::date - (o_custkey % 60 * 366)::integer, date '{AS_OF}') as y from orders)")
def age_band_buckets(spark, sf):
    born = F.date_sub(F.to_date("o_orderdate"), (F.col("o_custkey") % 60 * 366).cast("int"))
    years = X.full_years(born, F.lit(AS_OF).cast("date"))
    return T(spark, sf, "orders").select("o_orderkey", X.age_band(years).alias("age_band"), years.alias("years"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as event_date, hour(ts)::integer as event_hour, strftime(ts, '%Y-%m') as event_month from events")
def fact_date_parts(spark, sf):
    return T(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("event_date"), F.hour("ts").alias("event_hour"), F.date_format("ts", "yyyy-MM").alias("event_month"))


@query("select c_custkey, sha256(concat_ws('||', coalesce(c_name, '^^'), coalesce(c_nationkey::varchar, '^^'), coalesce(c_mktsegment, '^^'))) as hashdiff from customer")
def sat_customer_hashdiff(spark, sf):
    return T(spark, sf, "customer").select("c_custkey", X.plain_hash("c_name", "c_nationkey", "c_mktsegment").alias("hashdiff"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'Z' as raw, strftime(o_orderdate, '%Y-%m-%d') as parsed from orders")
def cdc_date_parsing(spark, sf):
    rows = T(spark, sf, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("Z")).alias("raw"))
    return rows.select("o_orderkey", "raw", X.cdc_date("raw").cast("string").alias("parsed"))


@query("""
select c_custkey, lpad(right(c_name, 4), length(c_name)::integer, '*') as last_4, rpad(left(c_name, 1), length(c_name)::integer, '*') as first_letter, '2024-01-01' as year_only, repeat('*', greatest(length(c_custkey::varchar) - 4, 0)::integer) || right(c_custkey::varchar, 4) as id_last_4 from customer
""")
def mask_views(spark, sf):
    day = F.lit("2024-06-30")
    return T(spark, sf, "customer").select("c_custkey", X.keep_last_4("c_name").alias("last_4"), X.keep_first("c_name").alias("first_letter"), X.year_only(day).alias("year_only"), X.keep_last_4(text("c_custkey")).alias("id_last_4"))


@query("select c_custkey, c_nationkey as branch_code from customer where c_nationkey = 7")
def row_filter_view(spark, sf):
    rule = policy.Rule("branch-analyst", "gold", "customers", ("SELECT",), "branch_code = 7")
    rows = T(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("branch_code"))
    return policy.secure_view(rows, "branch-analyst", "gold", "customers", [rule])


# --- marts ---------------------------------------------------------------------------------------------------------------

APPS = f"""
apps as (select o_orderkey as application_id, o_custkey as customer_id, c_mktsegment as product_code, n_name as branch_code, r_name as currency_code, cast(o_totalprice as decimal(18,2)) as requested_amount,
 case o_orderstatus when 'F' then 'APPROVED' when 'O' then 'PENDING' else 'REJECTED' end as application_status_code, o_orderdate as applied_at,
 case when o_orderstatus <> 'O' then o_orderdate + to_hours((o_orderkey % 200)::integer) end as decision_at
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
LOANS = """
loans as (select l_orderkey as loan_id, o_custkey as customer_id, c_mktsegment as product_code, n_name as branch_code, r_name as currency_code, sum(cast(l_extendedprice as decimal(18,2))) as principal_amount,
 case when max(l_returnflag) = 'R' then 'DELINQUENT' when max(l_linestatus) = 'O' then 'ACTIVE' else 'CLOSED' end as loan_status_code, min(l_shipdate) as disbursed_at, max(l_shipdate) as maturity_date
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3, 4, 5)"""


def _places(spark, sf) -> DataFrame:
    """Customers with their branch and currency: small tables join first, so the large side meets one join."""
    geo = T(spark, sf, "nation").join(T(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("branch_code"), F.col("r_name").alias("currency_code"))
    return T(spark, sf, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("product_code"), "branch_code", "currency_code")


def applications(spark, sf) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("REJECTED")
    decided = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_orderkey") % 200))
    o = T(spark, sf, "orders").select(
        F.col("o_orderkey").alias("application_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("requested_amount"), status.alias("application_status_code"),
        F.col("o_orderdate").alias("applied_at"), decided.alias("decision_at"),
    )
    hours = F.timestamp_diff("HOUR", F.col("applied_at"), F.col("decision_at"))
    code = F.col("application_status_code")
    return o.join(_places(spark, sf), "customer_id").withColumns({"decision_duration_hours": hours, "is_decided": code.isin("APPROVED", "REJECTED"), "is_approved": code == "APPROVED", "product_hk": F.col("product_code"), "product_name": F.initcap("product_code")})


def loans(spark, sf) -> DataFrame:
    status = F.when(F.max("l_returnflag") == "R", "DELINQUENT").when(F.max("l_linestatus") == "O", "ACTIVE").otherwise("CLOSED")
    lines = T(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("loan_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("principal_amount"), status.alias("loan_status_code"), F.min("l_shipdate").alias("disbursed_at"), F.max("l_shipdate").alias("maturity_date"))
    owner = T(spark, sf, "orders").select(F.col("o_orderkey").alias("loan_id"), F.col("o_custkey").alias("customer_id")).join(_places(spark, sf), "customer_id")
    code = F.col("loan_status_code")
    return lines.join(owner, "loan_id").withColumns({"is_active": code == "ACTIVE", "is_delinquent": code == "DELINQUENT", "product_hk": F.col("product_code"), "customer_hk": F.col("customer_id"), "branch_hk": F.col("branch_code"), "currency_hk": F.col("currency_code")})


def money(c: str):
    return F.col(c).cast("double").alias(c)


PORTFOLIO = """portfolio as (select customer_id, currency_code, count(*) as loan_count, count(*) filter (loan_status_code = 'ACTIVE') as active_loan_count, count(*) filter (loan_status_code = 'DELINQUENT') as delinquent_loan_count,
 count(*) filter (loan_status_code = 'CLOSED') as closed_loan_count, sum(principal_amount) as total_principal_amount, min(disbursed_at) as first_disbursed_at, max(disbursed_at) as latest_disbursed_at from loans group by 1, 2)"""


def portfolio(spark, sf) -> DataFrame:
    of = lambda s: F.count_if(F.col("loan_status_code") == s)
    return loans(spark, sf).groupBy("customer_id", "currency_code").agg(
        F.count(F.lit(1)).alias("loan_count"), of("ACTIVE").alias("active_loan_count"), of("DELINQUENT").alias("delinquent_loan_count"), of("CLOSED").alias("closed_loan_count"),
        F.sum("principal_amount").alias("total_principal_amount"), F.min("disbursed_at").alias("first_disbursed_at"), F.max("disbursed_at").alias("latest_disbursed_at"),
    )


@query(f"with {LOANS}, {PORTFOLIO}, f as (select currency_code, count(*) as n, sum(principal_amount) as s from loans where loan_status_code <> 'CLOSED' group by 1), p as (select currency_code, sum(loan_count) as n, sum(total_principal_amount) as s from portfolio group by 1) select coalesce(f.currency_code, p.currency_code) as currency_hk, f.n::bigint as fact_loan_count, p.n::bigint as portfolio_loan_count from f full outer join p on f.currency_code = p.currency_code where f.n is null or p.n is null or f.n <> p.n or f.s <> p.s")
def portfolio_reconcile_full_outer(spark, sf):
    """Open loans against the whole portfolio: the totals differ by the closed ones."""
    facts = loans(spark, sf).filter("loan_status_code <> 'CLOSED'")
    whole = portfolio(spark, sf).withColumn("currency_hk", F.col("currency_code"))
    out = quality.portfolio_reconciles(facts, whole)
    return out.select("currency_hk", "fact_loan_count", "portfolio_loan_count")


@query(f"with {LOANS} select customer_id as customer_hk, currency_code as currency_hk, count(*) as rows from loans group by 1, 2 having count(*) > 1")
def grain_check(spark, sf):
    return quality.portfolio_grain(loans(spark, sf))


# --- data tests ----------------------------------------------------------------------------------------------------------


@query("select user_id, event_id from events where user_id is not null and not exists (select 1 from customer where c_custkey = user_id and c_mktsegment <> 'BUILDING')")
def relationships_test(spark, sf):
    return quality.relationships(T(spark, sf, "events").select("user_id", "event_id"), "user_id", T(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'"), "c_custkey")


@query("select event_type, count(*) as rows from events where event_type not in ('view', 'click') group by 1")
def accepted_values_test(spark, sf):
    return quality.accepted_values(T(spark, sf, "events"), "event_type", ("view", "click"))


@query("select event_id from events where json_extract_string(props, '$.none') is null and value > 100")
def not_null_test(spark, sf):
    rows = T(spark, sf, "events").filter("value > 100").withColumn("none", X.image_field("none", "props"))
    return quality.not_null(rows, "none").select("event_id")


@query("select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def unique_test(spark, sf):
    return quality.unique(T(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"""with {LOANS} select loan_id from loans where principal_amount <= 0 or disbursed_at is null or maturity_date::date < disbursed_at::date or (loan_status_code = 'ACTIVE') <> (principal_amount > 100000)""")
def business_rules_test(spark, sf):
    rows = loans(spark, sf).withColumns({"annual_interest_rate": F.lit(0.1), "term_months": F.lit(12), "is_active": F.col("principal_amount") > 100000})
    return quality.any_of(rows, quality.loan_rules()).select("loan_id")


@query(f"""with {APPS} select application_id from apps where requested_amount <= 0 or decision_at < applied_at or (application_status_code = 'PENDING' and requested_amount > 200000)""")
def application_rules_test(spark, sf):
    rows = applications(spark, sf).withColumns({"term_months": F.lit(12), "decision_at": F.when((F.col("application_status_code") == "PENDING") & (F.col("requested_amount") > 200000), F.col("applied_at")).otherwise(F.col("decision_at"))})
    return quality.any_of(rows, quality.application_rules()).select("application_id")


# --- reports -------------------------------------------------------------------------------------------------------------


@query(f"with {APPS} select currency_code, application_status_code, count(*) as application_count, sum(requested_amount)::double as requested_amount, round(100.0 * count(*) / sum(count(*)) over (partition by currency_code), 2)::double as status_share_pct from apps group by 1, 2")
def kpi_funnel_share(spark, sf):
    return kpi.application_funnel(applications(spark, sf)).withColumn("requested_amount", F.col("requested_amount").cast("double"))


@query(f"with {APPS} select product_code, currency_code, count(*) as application_count, count(*) filter (application_status_code = 'APPROVED') as approved_application_count, round(100.0 * count(*) filter (application_status_code = 'APPROVED') / nullif(count(*), 0), 2)::double as approval_rate_pct, sum(requested_amount)::double as requested_amount from apps group by 1, 2")
def kpi_approval(spark, sf):
    products = T(spark, sf, "customer").select(F.col("c_mktsegment").alias("product_hk"), F.initcap("c_mktsegment").alias("product_name")).distinct()
    return kpi.product_approval(applications(spark, sf).drop("product_name"), products).drop("product_name").withColumn("requested_amount", F.col("requested_amount").cast("double"))


@query(f"with {LOANS} select product_code, currency_code, count(*) as loan_count, count(*) filter (loan_status_code = 'DELINQUENT') as delinquent_loan_count, round(100.0 * count(*) filter (loan_status_code = 'DELINQUENT') / nullif(count(*), 0), 2)::double as delinquency_rate_pct, sum(principal_amount)::double as principal_amount from loans group by 1, 2")
def kpi_exposure(spark, sf):
    products = T(spark, sf, "customer").select(F.col("c_mktsegment").alias("product_hk"), F.initcap("c_mktsegment").alias("product_name")).distinct()
    return kpi.product_exposure(loans(spark, sf), products).drop("product_name").withColumn("principal_amount", F.col("principal_amount").cast("double"))


@query(f"with {LOANS} select c.c_mktsegment as segment_code, case when c_custkey % 10 = 0 then 'CORPORATE' else 'INDIVIDUAL' end as customer_type, currency_code, count(distinct customer_id) as customer_count, count(*) as loan_count, count(*) filter (loan_status_code = 'DELINQUENT') as delinquent_loan_count, sum(principal_amount)::double as principal_amount from loans join customer c on customer_id = c_custkey group by 1, 2, 3")
def kpi_segment(spark, sf):
    kind = F.when(F.col("c_custkey") % 10 == 0, "CORPORATE").otherwise("INDIVIDUAL")
    customers = T(spark, sf, "customer").select(F.col("c_custkey").alias("customer_hk"), kind.alias("customer_type"), F.col("c_mktsegment").alias("segment_code"))
    return kpi.segment_portfolio(loans(spark, sf), customers).withColumn("principal_amount", F.col("principal_amount").cast("double"))


@query(f"with {LOANS} select branch_code, upper(branch_code) as branch_name, left(branch_code, 3) as city, currency_code, count(*) as loan_count, count(*) filter (loan_status_code = 'DELINQUENT') as delinquent_loan_count, sum(principal_amount)::double as principal_amount from loans group by 1, 2, 3, 4")
def kpi_branch(spark, sf):
    branches = T(spark, sf, "nation").select(F.col("n_name").alias("branch_hk"), F.upper("n_name").alias("branch_name"), F.left("n_name", F.lit(3)).alias("city"))
    return kpi.branch_lending(loans(spark, sf), branches).withColumn("principal_amount", F.col("principal_amount").cast("double"))


@query(f"""with {APPS}, h as (select *, date_sub('hour', applied_at, decision_at) as hours, application_status_code <> 'PENDING' as decided from apps)
select product_code, branch_code, count(*) filter (decided) as decided_application_count, round(avg(hours) filter (decided), 6) as average_decision_hours, quantile_disc(hours, 0.5) filter (decided)::double as median_decision_hours, quantile_disc(hours, 0.95) filter (decided)::double as p95_decision_hours from h group by 1, 2""")
def kpi_turnaround(spark, sf):
    out = kpi.decision_turnaround(applications(spark, sf))
    return out.withColumns({"average_decision_hours": F.round("average_decision_hours", 6), "median_decision_hours": F.col("median_decision_hours").cast("double"), "p95_decision_hours": F.col("p95_decision_hours").cast("double")})


@query("select count(*) as checks, count(*) filter (value > 50) as failures, epoch(max(ts))::bigint as checked_at_seconds from events where user_id = (select user_id from events order by ts desc nulls last, user_id desc limit 1)")
def latest_batch_metrics(spark, sf):
    checks = T(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("checked_at"), F.col("user_id").alias("load_batch_id"), (F.coalesce(F.col("value"), F.lit(0.0)) <= 50).alias("passed"))
    return kpi.latest_batch_reconciliation(checks)


@query("select count(*) as rows, count(distinct user_id) as distinct_grain, max(ts)::varchar as latest_load from events")
def gold_grain_freshness(spark, sf):
    return kpi.grain_and_freshness(T(spark, sf, "events"), ["user_id"], "ts").withColumn("latest_load", text("latest_load"))


@query(f"""with {APPS}, {LOANS}, a as (select count(*) as applications, count(*) filter (application_status_code = 'APPROVED') as approved_applications, round(avg(date_sub('hour', applied_at, decision_at)), 6) as average_decision_hours, sum(requested_amount)::double as requested_amount from apps),
l as (select count(*) as loans, count(*) filter (loan_status_code = 'DELINQUENT') as delinquent_loans, sum(principal_amount)::double as principal_amount from loans)
select a.*, l.*, (select count(*) from customer) as customers, round(approved_applications / applications, 6) as approval_rate, round(delinquent_loans / loans, 6) as delinquency_rate from a, l""")
def report_measures(spark, sf):
    m = kpi.measures(applications(spark, sf), loans(spark, sf), T(spark, sf, "customer"))
    rounded = {c: F.round(c, 6) for c in ("average_decision_hours", "approval_rate", "delinquency_rate")}
    return m.withColumns({**rounded, "requested_amount": F.col("requested_amount").cast("double"), "principal_amount": F.col("principal_amount").cast("double")})


@query("select event_type, user_id, event_id from (select *, row_number() over (partition by event_type, user_id order by ts desc nulls last, event_id desc) as n from events) where n = 1")
def latest_runs(spark, sf):
    from cairn.plans.metrics import latest_runs as latest

    e = T(spark, sf, "events")
    return latest(e.withColumn("o", F.struct("ts", "event_id")), ["event_type", "user_id"], "o").select("event_type", "user_id", "event_id")


@query("select count(*) as object_count, sum(length(props))::bigint as total_bytes, min(length(props))::bigint as min_bytes, quantile_disc(length(props), 0.5)::bigint as median_bytes, quantile_disc(length(props), 0.95)::bigint as p95_bytes, max(length(props))::bigint as max_bytes, count(*) filter (length(props) < 1048576) as objects_under_1_mib from events")
def inventory_stats(spark, sf):
    return FP.inventory_stats(T(spark, sf, "events").select(F.length("props").cast("long").alias("size_bytes")))


@query("select count(distinct (o_custkey, o_orderstatus)) as distinct_pairs, count(distinct o_custkey) as distinct_customers, count(*) as rows from orders")
def composite_grain(spark, sf):
    return T(spark, sf, "orders").agg(F.count_distinct(F.struct("o_custkey", "o_orderstatus")).alias("distinct_pairs"), F.count_distinct("o_custkey").alias("distinct_customers"), F.count(F.lit(1)).alias("rows"))


@query("select event_type as object_name, count(*) as rows from (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) as n from events) where n = 1 and event_type <> 'error' group by 1")
def current_bronze_counts(spark, sf):
    from cairn.operators.history import bronze_current

    e = cdc(spark, sf).withColumn("event_timestamp", F.col("ts"))
    return top_by(e, ["event_type", "user_id"], bronze_current()).filter("op <> 'd'").groupBy(F.col("event_type").alias("object_name")).agg(F.count(F.lit(1)).alias("rows"))


def clean_tables(spark, sf) -> dict[str, DataFrame]:
    """The batch path's four inputs out of the star tables."""
    c = T(spark, sf, "customer").select(text("c_custkey").alias("customer_id"), F.lit("A").alias("first_name"), F.col("c_name").alias("last_name"), F.concat("c_name", F.lit("@x.org")).alias("email"), F.lit(None).cast("string").alias("phone_number"), F.lit("1990-02-28").alias("date_of_birth"), F.lit("c").alias("city"), F.lit("n").alias("country"), F.col("c_mktsegment").alias("customer_segment"), F.lit("2020-01-01T00:00:00Z").alias("created_at"))
    a = T(spark, sf, "orders").select(text("o_orderkey").alias("account_id"), text("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("account_type"), F.col("o_orderstatus").alias("account_status"), F.lit("n").alias("card_network"), F.lit("m").alias("masked_card_number"), text("o_totalprice").alias("credit_limit"), text("o_orderdate").alias("opened_at"))
    m = T(spark, sf, "supplier").select(text("s_suppkey").alias("merchant_id"), F.col("s_name").alias("merchant_name"), F.lit("c").alias("merchant_category"), F.lit("c").alias("city"), F.lit("n").alias("country"), F.lit("2020-01-01T00:00:00Z").alias("onboarded_at"), text("s_nationkey").alias("risk_score"))
    lines = T(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("x"), F.max("l_returnflag").alias("r"), F.max("l_shipdate").alias("d"))
    t = lines.join(T(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(text("l_orderkey").alias("transaction_id"), text("l_orderkey").alias("account_id"), text("o_custkey").alias("customer_id"), text("s").alias("merchant_id"), text("x").alias("amount"), F.lit("TRY").alias("currency"), F.col("r").alias("transaction_status"), F.lit("pos").alias("transaction_channel"), text("d").alias("transaction_timestamp"))
    return {"customers": c, "accounts": a, "merchants": m, "transactions": t}
