"""Who sees what: the first matching rule grants privileges, filters rows and masks columns; no rule, no access."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import keep_first, keep_last_4, year_only

READ, WRITE = ("SELECT",), ("SELECT", "INSERT", "DELETE", "UPDATE", "OWNERSHIP")
MASKS: dict[str, Callable[[str], Column]] = {"keep_last_4": keep_last_4, "keep_first_character": keep_first, "year_only": year_only}


class Denied(PermissionError):
    """No rule gives the principal this privilege."""


@dataclass(frozen=True)
class Rule:
    users: str
    schema: str
    table: str
    privileges: tuple[str, ...]
    row_filter: str | None = None
    masks: dict[str, str] = field(default_factory=dict)

    def matches(self, user: str, schema: str, table: str) -> bool:
        return all(re.fullmatch(p, x) for p, x in ((self.users, user), (self.schema, schema), (self.table, table)))


def rules(branch: str = "BR001") -> list[Rule]:
    """The table rules, in order; `branch` is the code that branch analysts are confined to."""
    personal = {"national_id": "keep_last_4", "tax_id": "keep_last_4", "first_name": "keep_first_character", "last_name": "keep_first_character", "date_of_birth": "year_only"}
    return [
        Rule("lakehouse-admin|data-engineer", ".*", ".*", WRITE),
        Rule("dbt-local", "cdc_raw_vault", ".*", READ),
        Rule("dbt-local", "gold_dbt", ".*", WRITE),
        Rule("openmetadata-ingestion", "cdc_raw_vault|gold_dbt", ".*", READ),
        Rule("branch-analyst", "gold_dbt", "dim_customer_current", READ, f"home_branch_code = '{branch}'"),
        Rule("branch-analyst", "gold_dbt", "fct_loans_current", READ, f"branch_code = '{branch}'"),
        Rule("analyst|bi-service", "gold|gold_dbt", ".*", READ),
        Rule("auditor", "cdc_raw_vault", "sat_customer_details", READ, masks=personal),
        Rule("auditor", ".*", ".*", READ),
    ]


def rule_for(user: str, schema: str, table: str, book: list[Rule] | None = None) -> Rule | None:
    return next((r for r in (rules() if book is None else book) if r.matches(user, schema, table)), None)


def allowed(user: str, schema: str, table: str, privilege: str = "SELECT", book: list[Rule] | None = None) -> bool:
    r = rule_for(user, schema, table, book)
    return r is not None and privilege in r.privileges


def mask(df: DataFrame, masks: dict[str, str]) -> DataFrame:
    return df.withColumns({c: MASKS[m](c) for c, m in masks.items() if c in df.columns})


def secure_view(df: DataFrame, user: str, schema: str, table: str, book: list[Rule] | None = None) -> DataFrame:
    """What the principal sees of a table.  The filter applies before the masks."""
    r = rule_for(user, schema, table, book)
    if r is None or "SELECT" not in r.privileges:
        raise Denied(f"{user} may not read {schema}.{table}")
    if r.row_filter:
        df = df.filter(F.expr(r.row_filter))
    return mask(df, r.masks)


#: Access by role and layer (a fixed contract): principal, then bronze, silver, gold, audit.
MATRIX = {
    "platform_admin": ("lakehouse-admin", "none", "admin", "admin", "admin"),
    "data_engineer": ("data-engineer", "read_write", "read_write", "read_write", "read"),
    "transformation_service": ("dbt-local", "none", "read", "read_write", "none"),
    "metadata_service": ("openmetadata-ingestion", "none", "read_for_metadata_ingestion", "read_for_metadata_ingestion", "none"),
    "analyst": ("analyst", "none", "none", "read", "none"),
    "branch_analyst": ("branch-analyst", "none", "none", "filtered_read", "none"),
    "auditor": ("auditor", "read", "masked_read", "read", "read"),
    "bi_service": ("bi-service", "none", "none", "read", "none"),
}
