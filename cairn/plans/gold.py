"""Current-state marts over the vault: status views, dimensions, facts, portfolio, row lineage.

Every model is a function of the vault's tables and of earlier models; `build_gold` runs them in dependency order and
hands each one the frames it names as parameters.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce, wraps
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from cairn.functions.exprs import age_band, cdc_date, cdc_timestamp, filled, full_years
from cairn.operators.history import latest_attributes, latest_state, top_by
from cairn.sources.schemas import ENTITIES

Model = Callable[..., DataFrame]
MODELS: dict[str, Model] = {}
#: Models that are inlined in others and not stored.
VIEWS = ("int_current_entity_status", "int_current_application_context", "int_current_loan_context")


def model(f: Model) -> Model:
    MODELS[f.__name__] = f
    return f


def latest_of(sat: DataFrame, entity: str) -> DataFrame:
    return top_by(sat, [f"{entity}_hk"], latest_attributes())


def active(df: DataFrame, keys: list[str]) -> DataFrame:
    """The latest state of each key where that is active; the filter comes after the ranking."""
    return top_by(df, keys, latest_state()).filter("record_status = 'ACTIVE' and not is_deleted")


def _status(status: DataFrame, entity: str) -> DataFrame:
    return status.filter(F.col("entity_type") == entity.upper()).select(F.col("entity_hk").alias(f"{entity}_hk"))


def _present(hub: DataFrame, status: DataFrame, entity: str) -> DataFrame:
    return hub.select(f"{entity}_hk", f"{entity}_bk").join(_status(status, entity), f"{entity}_hk", "left_semi")


#: The business keys' names in dimensions.
CODES = {"customer": "customer_id", "product": "product_code", "branch": "branch_code", "currency": "currency_code"}


def dimension(present: DataFrame, details: DataFrame, entity: str) -> DataFrame:
    return present.withColumnRenamed(f"{entity}_bk", CODES[entity]).join(details, f"{entity}_hk")


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)).alias("is_active")


def _amount(c: str, kind: str) -> Column:
    return filled(c).try_cast(kind).alias(c)


def _provenance() -> list[Column]:
    return [cdc_timestamp("updated_at").alias("source_updated_at"), F.col("effective_from").alias("source_effective_from"), F.col("load_datetime").alias("source_load_datetime")]


@model
def int_current_entity_status(sat_entity_record_status: DataFrame) -> DataFrame:
    return active(sat_entity_record_status, ["entity_type", "entity_hk"]).select("entity_type", "entity_hk", "entity_business_key", "record_status", "effective_from", "load_datetime", "source_event_id")


@model
def int_current_application_context(sat_application_context_effectivity: DataFrame) -> DataFrame:
    return active(sat_application_context_effectivity, ["loan_application_hk"])


@model
def int_current_loan_context(sat_loan_context_effectivity: DataFrame) -> DataFrame:
    return active(sat_loan_context_effectivity, ["loan_hk"])


@model
def dim_customer_current(hub_customer: DataFrame, sat_customer_details: DataFrame, int_current_entity_status: DataFrame, as_of: Column) -> DataFrame:
    details = latest_of(sat_customer_details, "customer").select(
        "customer_hk", "customer_type", "segment_code", "status_code", "home_branch_code",
        age_band(full_years(cdc_date("date_of_birth"), as_of)).alias("age_band"), (F.col("status_code") == "ACTIVE").alias("is_active"), *_provenance(),
    )
    return dimension(_present(hub_customer, int_current_entity_status, "customer"), details, "customer")


@model
def dim_product_current(hub_product: DataFrame, sat_product_details: DataFrame, int_current_entity_status: DataFrame) -> DataFrame:
    details = latest_of(sat_product_details, "product").select("product_hk", "product_name", "product_type", "default_currency_code", _flag("is_active"), *_provenance())
    return dimension(_present(hub_product, int_current_entity_status, "product"), details, "product")


@model
def dim_branch_current(hub_branch: DataFrame, sat_branch_details: DataFrame, int_current_entity_status: DataFrame) -> DataFrame:
    details = latest_of(sat_branch_details, "branch").select("branch_hk", "branch_name", "city", _flag("is_active"), *_provenance())
    return dimension(_present(hub_branch, int_current_entity_status, "branch"), details, "branch")


@model
def dim_currency_current(hub_currency: DataFrame, sat_currency_details: DataFrame, int_current_entity_status: DataFrame) -> DataFrame:
    details = latest_of(sat_currency_details, "currency").select("currency_hk", "currency_name", _amount("minor_unit", "int"), _flag("is_active"), *_provenance())
    return dimension(_present(hub_currency, int_current_entity_status, "currency"), details, "currency")


def _with_dimensions(facts: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Facts with the business keys of their dimensions, which are given in the order of CODES."""
    for (e, code), dim in zip(CODES.items(), dimensions, strict=True):
        facts = facts.join(dim.select(f"{e}_hk", code), f"{e}_hk")
    return facts


def application_facts(present: DataFrame, details: DataFrame, context: DataFrame, *dimensions: DataFrame) -> DataFrame:
    out = present.join(details, "loan_application_hk").join(context, "loan_application_hk")
    return _with_dimensions(out, *dimensions).withColumnRenamed("loan_application_bk", "application_id")


def loan_facts(present: DataFrame, details: DataFrame, context: DataFrame, hub_loan_application: DataFrame, *dimensions: DataFrame) -> DataFrame:
    # the application comes from its hub: a loan outlives the application's current state
    application = hub_loan_application.select("loan_application_hk", F.col("loan_application_bk").alias("application_id"))
    out = present.join(details, "loan_hk").join(context, "loan_hk").join(application, "loan_application_hk")
    return _with_dimensions(out, *dimensions).withColumnRenamed("loan_bk", "loan_id")


def by_portfolio(loans: DataFrame, customers: DataFrame) -> GroupedData:
    return loans.join(customers.select("customer_hk", "customer_type", "segment_code"), "customer_hk").groupBy("customer_hk", "customer_id", "customer_type", "segment_code", "currency_hk", "currency_code")


CONTEXT_TIMES = {"effective_from": "context_effective_from", "load_datetime": "context_load_datetime"}


@model
def fct_loan_applications_current(
    hub_loan_application: DataFrame, sat_loan_application_details: DataFrame, int_current_entity_status: DataFrame, int_current_application_context: DataFrame,
    dim_customer_current: DataFrame, dim_product_current: DataFrame, dim_branch_current: DataFrame, dim_currency_current: DataFrame,
) -> DataFrame:
    applied, decided = cdc_timestamp("applied_at"), cdc_timestamp("decision_at")
    details = latest_of(sat_loan_application_details, "loan_application").select(
        "loan_application_hk", _amount("requested_amount", "decimal(18,2)"), _amount("term_months", "int"), F.col("status_code").alias("application_status_code"),
        applied.alias("applied_at"), decided.alias("decision_at"), F.timestamp_diff("HOUR", applied, decided).alias("decision_duration_hours"),
        F.col("status_code").isin("APPROVED", "REJECTED").alias("is_decided"), (F.col("status_code") == "APPROVED").alias("is_approved"), *_provenance(),
    )
    context = int_current_application_context.withColumnsRenamed(CONTEXT_TIMES).select("loan_application_hk", "application_context_hk", "customer_hk", "product_hk", "branch_hk", "currency_hk", *CONTEXT_TIMES.values())
    present = _present(hub_loan_application, int_current_entity_status, "loan_application")
    return application_facts(present, details, context, dim_customer_current, dim_product_current, dim_branch_current, dim_currency_current)


@model
def fct_loans_current(
    hub_loan: DataFrame, hub_loan_application: DataFrame, sat_loan_details: DataFrame, int_current_entity_status: DataFrame, int_current_loan_context: DataFrame,
    dim_customer_current: DataFrame, dim_product_current: DataFrame, dim_branch_current: DataFrame, dim_currency_current: DataFrame,
) -> DataFrame:
    details = latest_of(sat_loan_details, "loan").select(
        "loan_hk", _amount("principal_amount", "decimal(18,2)"), _amount("annual_interest_rate", "decimal(9,6)"), _amount("term_months", "int"),
        F.col("status_code").alias("loan_status_code"), cdc_timestamp("disbursed_at").alias("disbursed_at"), cdc_date("maturity_date").alias("maturity_date"),
        (F.col("status_code") == "ACTIVE").alias("is_active"), (F.col("status_code") == "DELINQUENT").alias("is_delinquent"), *_provenance(),
    )
    context = int_current_loan_context.withColumnsRenamed(CONTEXT_TIMES).select("loan_hk", "loan_context_hk", "loan_application_hk", "customer_hk", "product_hk", "branch_hk", "currency_hk", *CONTEXT_TIMES.values())
    present = _present(hub_loan, int_current_entity_status, "loan")
    return loan_facts(present, details, context, hub_loan_application, dim_customer_current, dim_product_current, dim_branch_current, dim_currency_current)


@model
def agg_customer_loan_portfolio(fct_loans_current: DataFrame, dim_customer_current: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("loan_status_code") == s)
    return by_portfolio(fct_loans_current, dim_customer_current).agg(
        F.count(F.lit(1)).alias("loan_count"), of("ACTIVE").alias("active_loan_count"), of("DELINQUENT").alias("delinquent_loan_count"), of("CLOSED").alias("closed_loan_count"),
        F.sum("principal_amount").alias("total_principal_amount"), F.avg("annual_interest_rate").alias("average_annual_interest_rate"),
        F.min("disbursed_at").alias("first_disbursed_at"), F.max("disbursed_at").alias("latest_disbursed_at"),
    )


POSITION = ("source_event_id", "source_position", "record_source", "bronze_object_key", "kafka_topic", "kafka_partition", "kafka_offset", "source_lsn", "load_batch_id")


def traced(present: Mapping[str, DataFrame], latest: Mapping[str, DataFrame], contexts: Mapping[str, DataFrame], marts: Mapping[str, DataFrame], columns: Sequence[Column | str], models: Collection[str] | None = None) -> list[DataFrame]:
    """The parts of the lineage, of all models or of some, with these columns of the source events beside what is traced.

    present, latest and contexts are by entity: the keys of the active ones, their latest details and relationships.
    What no asked part needs is not looked at.
    """
    asked = lambda m: models is None or m in models

    def part(df: DataFrame, name: str, key: Column, role: str, source: str) -> DataFrame:
        return df.select(F.lit(name).alias("gold_model"), key.alias("gold_business_key"), F.lit(role).alias("lineage_role"), F.lit(source).alias("raw_vault_object"), *columns)

    parts = []
    for e in [e for e in CODES if asked(f"dim_{e}_current")]:
        parts.append(part(present[e].join(latest[e], f"{e}_hk"), f"dim_{e}_current", F.col(f"{e}_bk"), "current_attributes", ENTITIES[e].satellite))
    for e, name, sat in (("loan_application", "fct_loan_applications_current", "sat_application_context_effectivity"), ("loan", "fct_loans_current", "sat_loan_context_effectivity")):
        if not asked(name):
            continue
        parts.append(part(present[e].join(latest[e], f"{e}_hk"), name, F.col(f"{e}_bk"), "current_attributes", ENTITIES[e].satellite))
        parts.append(part(present[e].join(contexts[e], f"{e}_hk"), name, F.col(f"{e}_bk"), "business_context", sat))
    if not asked("agg_customer_loan_portfolio"):
        return parts
    key = F.concat_ws("||", "customer_id", "currency_code")
    lent = marts["fct_loans_current"].select("loan_hk", "customer_id", "currency_code").join(latest["loan"], "loan_hk")
    parts.append(part(lent, "agg_customer_loan_portfolio", key, "contributing_loan", "sat_loan_details"))
    groups = marts["agg_customer_loan_portfolio"].select("customer_hk", "customer_id", "currency_code").join(latest["customer"], "customer_hk")
    parts.append(part(groups, "agg_customer_loan_portfolio", key, "customer_classification", "sat_customer_details"))
    return parts


def lineage_parts(
    hub_customer: DataFrame, hub_product: DataFrame, hub_branch: DataFrame, hub_currency: DataFrame, hub_loan_application: DataFrame, hub_loan: DataFrame,
    sat_customer_details: DataFrame, sat_product_details: DataFrame, sat_branch_details: DataFrame, sat_currency_details: DataFrame,
    sat_loan_application_details: DataFrame, sat_loan_details: DataFrame, int_current_entity_status: DataFrame,
    int_current_application_context: DataFrame, int_current_loan_context: DataFrame, fct_loans_current: DataFrame, agg_customer_loan_portfolio: DataFrame,
) -> list[DataFrame]:
    """Which source event stands behind each mart row, by role: frames of the same columns, whose union is the lineage."""
    given = locals()
    present = {e: _present(given[f"hub_{e}"], int_current_entity_status, e) for e in ENTITIES}
    latest = {e: latest_of(given[ENTITIES[e].satellite], e).select(f"{e}_hk", *POSITION, "effective_from") for e in ENTITIES}
    contexts = {"loan_application": int_current_application_context, "loan": int_current_loan_context}
    return traced(present, latest, contexts, given, [*POSITION, F.col("effective_from").alias("source_effective_from")])


@wraps(lineage_parts)
def gold_row_lineage(**needs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, lineage_parts(**needs))


MODELS["gold_row_lineage"] = gold_row_lineage  # its parameters, which tell what it needs, are those of the parts
#: Models that are unions: a store may write the parts one after the other, so that their shuffles need not lie side by side.
PARTS = {"gold_row_lineage": lineage_parts}


def dependencies(name: str) -> list[str]:
    return [p for p in inspect.signature(MODELS[name]).parameters if p != "as_of"]


def order() -> list[str]:
    graph = {n: [d for d in dependencies(n) if d in MODELS] for n in MODELS}
    return list(TopologicalSorter(graph).static_order())


def build_gold(vault: dict[str, DataFrame], as_of: Column | None = None, store: Callable[[str, DataFrame | list[DataFrame]], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All models; store (name, frame or the frames of PARTS) -> frame may write each table and hand back what later models read."""
    as_of = F.current_date() if as_of is None else as_of
    done = dict(vault)
    for name in order():
        args = {p: (as_of if p == "as_of" else done[p]) for p in inspect.signature(MODELS[name]).parameters}
        df = (PARTS if store and name in PARTS else MODELS)[name](**args)
        done[name] = store(name, df) if store and name not in VIEWS else df
    return {n: done[n] for n in MODELS}
