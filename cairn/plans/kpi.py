"""Reports over the marts.  Amounts never add up across currencies."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import ratio_percent

def rows() -> Column:
    return F.count(F.lit(1))


def application_funnel(applications: DataFrame) -> DataFrame:
    """Applications by currency and status, with the status's share of its currency (an aggregate over aggregates)."""
    by = applications.groupBy("currency_code", "application_status_code").agg(rows().alias("application_count"), F.sum("requested_amount").alias("requested_amount"))
    whole = F.sum("application_count").over(Window.partitionBy("currency_code"))
    return by.withColumn("status_share_pct", ratio_percent(F.col("application_count"), whole)).orderBy("currency_code", "application_status_code")


def _by_product(facts: DataFrame, products: DataFrame, flag: str, counted: str, matched: str, rate: str, amount: str, total: str) -> DataFrame:
    named = facts.join(products.select("product_hk", "product_name"), "product_hk")
    out = named.groupBy("product_code", "product_name", "currency_code").agg(rows().alias(counted), F.count_if(flag).alias(matched), ratio_percent(F.count_if(flag), rows()).alias(rate), F.sum(amount).alias(total))
    return out.orderBy("currency_code", "product_code")


def product_approval(applications: DataFrame, products: DataFrame) -> DataFrame:
    return _by_product(applications, products, "is_approved", "application_count", "approved_application_count", "approval_rate_pct", "requested_amount", "requested_amount")


def product_exposure(loans: DataFrame, products: DataFrame) -> DataFrame:
    return _by_product(loans, products, "is_delinquent", "loan_count", "delinquent_loan_count", "delinquency_rate_pct", "principal_amount", "principal_amount")


def segment_portfolio(loans: DataFrame, customers: DataFrame) -> DataFrame:
    named = loans.join(customers.select("customer_hk", "customer_type", "segment_code"), "customer_hk")
    out = named.groupBy("customer_type", "segment_code", "currency_code").agg(
        F.count_distinct("customer_hk").alias("customer_count"), rows().alias("loan_count"), F.count_if("is_delinquent").alias("delinquent_loan_count"), F.sum("principal_amount").alias("principal_amount")
    )
    return out.orderBy("currency_code", "customer_type", "segment_code")


def branch_lending(loans: DataFrame, branches: DataFrame) -> DataFrame:
    named = loans.join(branches.select("branch_hk", "branch_name", "city"), "branch_hk")
    out = named.groupBy("branch_code", "branch_name", "city", "currency_code").agg(rows().alias("loan_count"), F.count_if("is_delinquent").alias("delinquent_loan_count"), F.sum("principal_amount").alias("principal_amount"))
    return out.orderBy("currency_code", "branch_code")


def decision_turnaround(applications: DataFrame, exact: bool = False) -> DataFrame:
    """Hours to a decision by product and branch; pending applications are left out of the durations.

    A percentile is the least duration that at least that share of the decided applications do not exceed; with `exact` it
    interpolates between two.  Both come from counts by duration, so that no task holds a group's values.
    """
    group = ["product_code", "branch_code"]
    hours = F.when(F.col("is_decided"), F.col("decision_duration_hours"))
    by = applications.groupBy(*group, hours.alias("_hours")).agg(F.count_if("is_decided").alias("_decided"), F.count(hours).alias("_n"))
    w = Window.partitionBy(*group)
    ranked = by.withColumns({"_upto": F.sum("_n").over(w.orderBy(F.asc_nulls_first("_hours"))), "_all": F.sum("_n").over(w)})
    least = lambda q: F.min(F.when(F.col("_upto") >= F.ceil(F.lit(Decimal(q)) * F.col("_all")), F.col("_hours")))
    middle = lambda q: F.percentile("_hours", float(q), F.col("_n")) if exact else least(q)
    total = F.sum(F.col("_hours").cast("double") * F.col("_n"))
    out = ranked.groupBy(*group).agg(
        F.sum("_decided").alias("decided_application_count"), F.try_divide(total, F.sum("_n")).alias("average_decision_hours"), middle("0.5").alias("median_decision_hours"), middle("0.95").alias("p95_decision_hours")
    )
    return out.orderBy(*group)


KPIS = {
    "application_funnel": (application_funnel, ("fct_loan_applications_current",)),
    "product_approval": (product_approval, ("fct_loan_applications_current", "dim_product_current")),
    "product_exposure": (product_exposure, ("fct_loans_current", "dim_product_current")),
    "segment_portfolio": (segment_portfolio, ("fct_loans_current", "dim_customer_current")),
    "branch_lending": (branch_lending, ("fct_loans_current", "dim_branch_current")),
    "decision_turnaround": (decision_turnaround, ("fct_loan_applications_current",)),
}


def run_kpi(name: str, gold: dict[str, DataFrame]) -> DataFrame:
    f, needs = KPIS[name]
    return f(*[gold[n] for n in needs])


def measures(applications: DataFrame, loans: DataFrame, customers: DataFrame) -> DataFrame:
    """The report's nine measures in one row."""
    a = applications.agg(rows().alias("applications"), F.count_if("is_approved").alias("approved_applications"), F.avg("decision_duration_hours").alias("average_decision_hours"), F.sum("requested_amount").alias("requested_amount"))
    b = loans.agg(rows().alias("loans"), F.count_if("is_delinquent").alias("delinquent_loans"), F.sum("principal_amount").alias("principal_amount"))
    c = customers.agg(rows().alias("customers"))
    one = a.join(b, F.lit(True)).join(c, F.lit(True))  # single rows
    return one.withColumns({"approval_rate": F.try_divide("approved_applications", "applications"), "delinquency_rate": F.try_divide("delinquent_loans", "loans")})


def latest_batch_reconciliation(reconciliation: DataFrame) -> DataFrame:
    """Counts and freshness of the batch checked last, in seconds rounded to the nearest (halves to even, as SQL's cast does)."""
    seconds = F.rint(F.unix_micros(F.max("checked_at")) / 1e6).cast("long")
    last = reconciliation.orderBy(F.desc_nulls_last("checked_at"), F.desc("load_batch_id")).limit(1).select("load_batch_id")
    return reconciliation.join(last, "load_batch_id", "left_semi").agg(rows().alias("checks"), F.count_if(~F.col("passed")).alias("failures"), seconds.alias("checked_at_seconds"))


def grain_and_freshness(df: DataFrame, grain: list[str], loaded: str) -> DataFrame:
    return df.agg(rows().alias("rows"), F.count_distinct(F.struct(*grain)).alias("distinct_grain"), F.max(loaded).alias("latest_load"))
