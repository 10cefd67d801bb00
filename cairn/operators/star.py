"""The batch path: typed cleansing with referential filters, a rebuilt vault, and a star over it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import comma_number, month_years, plain_hash, risk_band, valid_email
from cairn.operators.history import top_by

#: Column casts that give null where the text does not parse.
CASTS = {
    "text": lambda c: F.col(c).cast("string"),
    "email": lambda c: valid_email(c),
    "date": lambda c: F.col(c).cast("string").try_cast("date"),
    "time": lambda c: F.col(c).cast("string").try_cast("timestamp"),
    "number": lambda c: comma_number(c),
    "int": lambda c: F.col(c).cast("string").try_cast("int"),
}


@dataclass(frozen=True)
class Cleanse:
    """Columns by cast, the key rows are unique by, and the columns that must not be null."""

    columns: dict[str, str]
    key: str
    required: tuple[str, ...]

    def __call__(self, df: DataFrame) -> DataFrame:
        typed = df.select(*[CASTS[kind](c).alias(c) for c, kind in self.columns.items()])
        # a total order makes the surviving row of a repeated key the same in every run
        unique = top_by(typed, [self.key], [F.asc_nulls_last(c) for c in self.columns])
        return unique.dropna(subset=list(self.required))


def _columns(spec: str) -> dict[str, str]:
    return {c: kind or "text" for c, _, kind in (part.partition(":") for part in spec.split())}


CLEANSE = {
    "customers": Cleanse(_columns("customer_id first_name last_name email:email phone_number date_of_birth:date city country customer_segment created_at:time"), "customer_id", ("customer_id",)),
    "accounts": Cleanse(_columns("account_id customer_id account_type account_status card_network masked_card_number credit_limit:number opened_at:time"), "account_id", ("account_id", "customer_id")),
    "merchants": Cleanse(_columns("merchant_id merchant_name merchant_category city country onboarded_at:time risk_score:int"), "merchant_id", ("merchant_id",)),
    "transactions": Cleanse(
        _columns("transaction_id account_id customer_id merchant_id amount:number currency transaction_status transaction_channel transaction_timestamp:time"),
        "transaction_id", ("transaction_id", "account_id", "customer_id", "merchant_id", "amount", "transaction_timestamp"),
    ),
}


def conform(df: DataFrame, *parents: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Rows that refer to existing rows of every parent."""
    for parent, keys in parents:
        df = df.join(parent.select(*keys), list(keys), "left_semi")
    return df


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    customers = CLEANSE["customers"](raw["customers"])
    accounts = conform(CLEANSE["accounts"](raw["accounts"]), (customers, ["customer_id"]))
    merchants = CLEANSE["merchants"](raw["merchants"])
    transactions = conform(CLEANSE["transactions"](raw["transactions"]), (accounts, ["account_id", "customer_id"]), (customers, ["customer_id"]), (merchants, ["merchant_id"]))
    return {"customers": customers, "accounts": accounts, "merchants": merchants, "transactions": transactions}


def clean_counts(raw: dict[str, DataFrame], clean: dict[str, DataFrame]) -> DataFrame:
    """table_name, raw, clean and rejected row counts, in one job over all tables."""
    one = lambda name, df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n")
    parts = [one(n, df, s) for s, frames in (("raw", raw), ("clean", clean)) for n, df in frames.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    out = every.groupBy("table_name").pivot("side", ["raw", "clean"]).agg(F.first("n"))
    return out.select("table_name", "raw", "clean", (F.col("raw") - F.col("clean")).alias("rejected"))


def _audit(df: DataFrame, source: str, at: Column) -> DataFrame:
    return df.withColumns({"load_datetime": at, "record_source": F.lit(f"bronze.{source}")})


#: Entity (singular): its table and satellite, and the satellite's attributes.
DETAILS = {
    "customer": ("customers", "sat_customer_profile", "first_name last_name email phone_number date_of_birth city country customer_segment created_at"),
    "account": ("accounts", "sat_account_details", "account_type account_status card_network masked_card_number credit_limit opened_at"),
    "merchant": ("merchants", "sat_merchant_details", "merchant_name merchant_category city country onboarded_at risk_score"),
    "transaction": ("transactions", "sat_transaction_details", "amount currency transaction_status transaction_channel transaction_timestamp"),
}


def build_hub(df: DataFrame, entity: str, at: Column) -> DataFrame:
    return _audit(df.select(plain_hash(f"{entity}_id").alias(f"{entity}_hk"), f"{entity}_id"), DETAILS[entity][0], at)


def build_link(df: DataFrame, name: str, entities: Sequence[str], source: str, at: Column) -> DataFrame:
    ids = [f"{e}_id" for e in entities]
    hks = [plain_hash(i).alias(f"{e}_hk") for e, i in zip(entities, ids, strict=True)]
    return _audit(df.select(plain_hash(*ids).alias(f"{name}_hk"), *hks).dropDuplicates([f"{name}_hk"]), source, at)


def build_satellite(df: DataFrame, entity: str, at: Column) -> DataFrame:
    source, _, attributes = DETAILS[entity]
    names = attributes.split()
    return _audit(df.select(plain_hash(f"{entity}_id").alias(f"{entity}_hk"), *names, plain_hash(*names).alias("hashdiff")), source, at)


def build_vault(clean: dict[str, DataFrame], at: Column | None = None) -> dict[str, DataFrame]:
    at = F.current_timestamp() if at is None else at
    out = {}
    for entity, (source, satellite, _) in DETAILS.items():
        out[f"hub_{entity}"] = build_hub(clean[source], entity, at)
        out[satellite] = build_satellite(clean[source], entity, at)
    out["link_customer_account"] = build_link(clean["accounts"], "customer_account", ("customer", "account"), "accounts", at)
    out["link_transaction_context"] = build_link(clean["transactions"], "transaction_context", ("transaction", "customer", "account", "merchant"), "transactions", at)
    return out


def _latest(vault: dict[str, DataFrame], entity: str) -> DataFrame:
    return top_by(vault[DETAILS[entity][1]], [f"{entity}_hk"], [F.desc("load_datetime"), F.asc("hashdiff")]).drop("load_datetime", "record_source", "hashdiff")


def _ids(vault: dict[str, DataFrame], entity: str) -> DataFrame:
    return vault[f"hub_{entity}"].select(f"{entity}_hk", f"{entity}_id")


def _keyed_dimensions(vault: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """The dimensions by entity, each with its hash key in front."""
    customer = _ids(vault, "customer").join(_latest(vault, "customer"), "customer_hk").select(
        "customer_hk", "customer_id", F.concat_ws(" ", "first_name", "last_name").alias("customer_full_name"), "email", "phone_number", "date_of_birth",
        month_years("date_of_birth", as_of).alias("age"), "city", "country", "customer_segment", "created_at",
    )
    owners = vault["link_customer_account"].select("account_hk", "customer_hk").join(_ids(vault, "customer"), "customer_hk")
    account = _ids(vault, "account").join(owners, "account_hk").join(_latest(vault, "account"), "account_hk").select(
        "account_hk", "account_id", "customer_id", "account_type", "account_status", "card_network", "masked_card_number", "credit_limit", "opened_at"
    )
    merchant = _ids(vault, "merchant").join(_latest(vault, "merchant"), "merchant_hk").select(
        "merchant_hk", "merchant_id", "merchant_name", "merchant_category", "city", "country", "risk_score", risk_band("risk_score").alias("risk_band"), "onboarded_at"
    )
    return {"customer": customer, "account": account, "merchant": merchant}


def build_star(vault: dict[str, DataFrame], as_of: Column | None = None) -> dict[str, DataFrame]:
    """Dimensions, and the transactions whose customer, account and merchant are in them."""
    dims = _keyed_dimensions(vault, F.current_date() if as_of is None else as_of)
    fact = vault["link_transaction_context"].select("transaction_hk", "customer_hk", "account_hk", "merchant_hk").join(_ids(vault, "transaction"), "transaction_hk").join(_latest(vault, "transaction"), "transaction_hk")
    for e, dim in dims.items():  # a dimension gives the id and keeps out what it lacks in one join
        fact = fact.join(dim.select(f"{e}_hk", f"{e}_id"), f"{e}_hk")
    when = F.col("transaction_timestamp")
    fact = fact.select(
        "transaction_id", "customer_id", "account_id", "merchant_id", "amount", "currency", "transaction_status", "transaction_channel", "transaction_timestamp",
        F.to_date(when).alias("transaction_date"), F.hour(when).alias("transaction_hour"), F.date_format(when, "yyyy-MM").alias("transaction_month"),
    )
    return {**{f"dim_{e}": dim.drop(f"{e}_hk") for e, dim in dims.items()}, "fact_transactions": fact}
