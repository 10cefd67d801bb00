"""Declarative data tests.  Each returns the failing rows; an empty result passes.  Comparisons with null pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.history import latest_state, top_by

def n() -> Column:
    return F.count(F.lit(1))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(n().alias("copies")).filter("copies > 1")


def relationships(df: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Values of a column that the parent's field lacks."""
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(field).alias(column)), column, "left_anti")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(~F.col(column).isin(*values)).groupBy(column).agg(n().alias("rows"))


def any_of(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break any rule; a rule that is null for a row is not broken."""
    return df.filter(reduce(or_, rules.values()))


def application_rules() -> dict[str, Column]:
    c, code = F.col, F.col("application_status_code")
    decided = code.isin("APPROVED", "REJECTED")
    return {
        "requested_amount": c("requested_amount") <= 0,
        "term_months": c("term_months") <= 0,
        "decided_before_applied": c("decision_at") < c("applied_at"),
        "is_decided": c("is_decided") != decided,
        "is_approved": c("is_approved") != (code == "APPROVED"),
        "decided_without_time": decided & c("decision_at").isNull(),
        "pending_with_time": (code == "PENDING") & c("decision_at").isNotNull(),
    }


def loan_rules() -> dict[str, Column]:
    c, code = F.col, F.col("loan_status_code")
    return {
        "principal_amount": c("principal_amount") <= 0,
        "annual_interest_rate": c("annual_interest_rate") < 0,
        "term_months": c("term_months") <= 0,
        "disbursed_at": c("disbursed_at").isNull(),
        "matures_before_disbursed": c("maturity_date") < c("disbursed_at").cast("date"),
        "is_active": c("is_active") != (code == "ACTIVE"),
        "is_delinquent": c("is_delinquent") != (code == "DELINQUENT"),
    }


def portfolio_grain(portfolio: DataFrame) -> DataFrame:
    return portfolio.groupBy("customer_hk", "currency_hk").agg(n().alias("rows")).filter("rows > 1")


def portfolio_reconciles(loans: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Currencies whose totals differ between the loans and the portfolio, or that one of them lacks."""
    fact = loans.groupBy("currency_hk").agg(n().alias("fact_loan_count"), F.sum("principal_amount").alias("fact_principal_amount"))
    whole = portfolio.groupBy("currency_hk").agg(F.sum("loan_count").alias("portfolio_loan_count"), F.sum("total_principal_amount").alias("portfolio_principal_amount"))
    both = fact.join(whole, "currency_hk", "full_outer")
    return both.filter("fact_loan_count is null or portfolio_loan_count is null or fact_loan_count <> portfolio_loan_count or fact_principal_amount <> portfolio_principal_amount")


CURRENT = {"CUSTOMER": "dim_customer_current", "PRODUCT": "dim_product_current", "BRANCH": "dim_branch_current", "CURRENCY": "dim_currency_current", "LOAN_APPLICATION": "fct_loan_applications_current", "LOAN": "fct_loans_current"}


def deleted_in_gold(sat_entity_record_status: DataFrame, gold: dict[str, DataFrame]) -> DataFrame:
    gone = top_by(sat_entity_record_status, ["entity_type", "entity_hk"], latest_state()).filter("record_status = 'DELETED'").select("entity_type", "entity_hk")
    present = reduce(DataFrame.unionAll, [gold[t].select(F.lit(e).alias("entity_type"), F.col(f"{e.lower()}_hk").alias("entity_hk")) for e, t in CURRENT.items()])
    return present.join(gone, ["entity_type", "entity_hk"], "left_semi")


def lineage_unique(lineage: DataFrame) -> DataFrame:
    return lineage.groupBy("gold_model", "gold_business_key", "lineage_role", "source_event_id").agg(n().alias("rows")).filter("rows > 1")


def lineage_complete(lineage: DataFrame, gold: dict[str, DataFrame]) -> DataFrame:
    """Mart rows without a lineage row."""
    keys = {"dim_customer_current": "customer_id", "dim_product_current": "product_code", "dim_branch_current": "branch_code", "dim_currency_current": "currency_code", "fct_loan_applications_current": "application_id", "fct_loans_current": "loan_id"}
    parts = [gold[t].select(F.lit(t).alias("gold_model"), F.col(k).alias("gold_business_key")) for t, k in keys.items()]
    parts.append(gold["agg_customer_loan_portfolio"].select(F.lit("agg_customer_loan_portfolio").alias("gold_model"), F.concat_ws("||", "customer_id", "currency_code").alias("gold_business_key")))
    return reduce(DataFrame.unionAll, parts).join(lineage, ["gold_model", "gold_business_key"], "left_anti")


def stale_context(gold: dict[str, DataFrame]) -> DataFrame:
    """Facts whose relationship is not the current one."""
    out = []
    for e, fact, view, hk, ctx in (("LOAN_APPLICATION", "fct_loan_applications_current", "int_current_application_context", "loan_application_hk", "application_context_hk"), ("LOAN", "fct_loans_current", "int_current_loan_context", "loan_hk", "loan_context_hk")):
        expected = gold[view].select(hk, F.col(ctx).alias("expected_context_hk"))
        j = gold[fact].select(hk, F.col(ctx).alias("gold_context_hk")).join(expected, hk).filter("gold_context_hk <> expected_context_hk")
        out.append(j.select(F.lit(e).alias("entity_type"), F.col(hk).alias("entity_hk"), "gold_context_hk", "expected_context_hk"))
    return reduce(DataFrame.unionByName, out)


#: Grain of each mart.
GRAINS = {
    "dim_customer_current": ("customer_hk",), "dim_product_current": ("product_hk",), "dim_branch_current": ("branch_hk",), "dim_currency_current": ("currency_hk",),
    "fct_loan_applications_current": ("loan_application_hk",), "fct_loans_current": ("loan_hk",), "agg_customer_loan_portfolio": ("customer_hk", "currency_hk"),
    "gold_row_lineage": ("gold_model", "gold_business_key", "lineage_role", "source_event_id"),
}

#: Accepted values (fixed lists of the data contract).
ACCEPTED = {
    ("dim_customer_current", "customer_type"): ("INDIVIDUAL", "CORPORATE"),
    ("dim_customer_current", "age_band"): ("UNKNOWN", "UNDER_18", "18_24", "25_34", "35_44", "45_54", "55_64", "65_PLUS"),
    ("fct_loan_applications_current", "application_status_code"): ("PENDING", "APPROVED", "REJECTED"),
    ("fct_loans_current", "loan_status_code"): ("ACTIVE", "DELINQUENT", "CLOSED"),
}


def grain_report(gold: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows, distinct_grain and whether they agree, for every mart."""
    parts = [gold[t].agg(n().alias("rows"), F.count_distinct(F.struct(*g)).alias("distinct_grain")).select(F.lit(t).alias("table_name"), "rows", "distinct_grain", (F.col("rows") == F.col("distinct_grain")).alias("valid")) for t, g in GRAINS.items() if t in gold]
    return reduce(DataFrame.unionAll, parts)


def gold_tests(vault: dict[str, DataFrame], gold: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """Every test of the marts by name; calling one gives its failing rows."""
    tests: dict[str, Callable[[], DataFrame]] = {
        "portfolio_grain": lambda: portfolio_grain(gold["agg_customer_loan_portfolio"]),
        "portfolio_reconciles": lambda: portfolio_reconciles(gold["fct_loans_current"], gold["agg_customer_loan_portfolio"]),
        "deleted_absent": lambda: deleted_in_gold(vault["sat_entity_record_status"], gold),
        "lineage_complete": lambda: lineage_complete(gold["gold_row_lineage"], gold),
        "lineage_unique": lambda: lineage_unique(gold["gold_row_lineage"]),
        "current_context": lambda: stale_context(gold),
        "application_rules": lambda: any_of(gold["fct_loan_applications_current"], application_rules()),
        "loan_rules": lambda: any_of(gold["fct_loans_current"], loan_rules()),
    }
    for t, g in GRAINS.items():
        tests[f"unique:{t}"] = lambda t=t, g=g: unique(gold[t], *g)
        for c in g:
            tests[f"not_null:{t}.{c}"] = lambda t=t, c=c: not_null(gold[t], c)
    for (t, c), values in ACCEPTED.items():
        tests[f"accepted:{t}.{c}"] = lambda t=t, c=c, v=values: accepted_values(gold[t], c, v)
    for fact in ("fct_loan_applications_current", "fct_loans_current"):
        for e in ("customer", "product", "branch", "currency"):
            tests[f"relationship:{fact}.{e}_hk"] = lambda f=fact, e=e: relationships(gold[f], f"{e}_hk", gold[f"dim_{e}_current"], f"{e}_hk")
    return tests


def failing(tests: dict[str, Callable[[], DataFrame]]) -> list[str]:
    return [name for name, t in tests.items() if not t().isEmpty()]


def deepest(history: DataFrame, key: str) -> DataFrame:
    """The most versions that any key has, and the number of keys."""
    return history.groupBy(key).agg(n().alias("versions")).agg(F.max("versions").alias("most_versions"), n().alias("keys"))


def audit_vault(vault: dict[str, DataFrame], reconciliation: DataFrame | None = None, versions: int = 2) -> list[str]:
    """What the vault breaks: event identity, history depth, recorded deletes, the latest reconciliation."""
    broken = []
    tracked = vault["sat_source_record_status"]
    if not unique(tracked, "source_event_id").isEmpty():
        broken.append("event identity is not unique")
    for table, key in (("sat_customer_details", "customer_hk"), ("sat_loan_application_details", "loan_application_hk"), ("sat_loan_details", "loan_hk")):
        if (deepest(vault[table], key).first()["most_versions"] or 0) < versions:
            broken.append(f"{table} has no row of {versions} versions")
    if tracked.filter("is_deleted").isEmpty():
        broken.append("no delete is recorded")
    if reconciliation is not None:
        last = reconciliation.orderBy(F.desc_nulls_last("checked_at")).limit(1).select("load_batch_id")
        if not reconciliation.join(last, "load_batch_id", "left_semi").filter("not passed").isEmpty():
            broken.append("the latest reconciliation has failures")
    return broken
