"""Schemas of events, sources and audit columns.  Names and types here are the data contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

def _struct(spec: str, **nested: T.StructType) -> T.StructType:
    kinds = {"": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}
    fields = [T.StructField(name, kinds[kind]) for name, _, kind in (f.partition(":") for f in spec.split())]
    return T.StructType(fields + [T.StructField(n, t) for n, t in nested.items()])


#: A change event as landed: images stay raw JSON text, so that any mix of tables and tombstones reads under one schema.
ENVELOPE = T.StructType([
    T.StructField("_metadata", _struct(
        "event_id source_system source_schema source_table operation kafka_topic kafka_partition:int kafka_offset:long kafka_timestamp_ms:long "
        "event_timestamp ingested_at payload_sha256 consumer_group object_key"
    )),
    T.StructField("key", T.StringType()),
    T.StructField("value", _struct("before after op", source=_struct("schema table ts_ms:long lsn:long txId:long"), transaction=_struct("id total_order:long"))),
])

#: Appended to every vault row.
AUDIT = ("load_datetime", "effective_from", "record_source", "source_event_id", "source_position", "kafka_topic", "kafka_partition", "kafka_offset", "source_lsn", "bronze_object_key", "load_batch_id")
AUDIT_DDL = "load_datetime timestamp, effective_from timestamp, record_source string, source_event_id string, source_position string, kafka_topic string, kafka_partition int, kafka_offset bigint, source_lsn bigint, bronze_object_key string, load_batch_id string"

LIVE = ("r", "c", "u")
CHANGES = (*LIVE, "d")
OPERATIONS = (*CHANGES, "tombstone")


@dataclass(frozen=True)
class Entity:
    """A business entity: where its rows come from, its key, and what its satellite holds."""

    name: str
    schema: str
    table: str
    key: str
    payload: tuple[str, ...]

    @property
    def namespace(self) -> str:
        return self.name.upper()

    @property
    def hk(self) -> str:
        return f"{self.name}_hk"

    @property
    def bk(self) -> str:
        return f"{self.name}_bk"

    @property
    def hub(self) -> str:
        return f"hub_{self.name}"

    @property
    def satellite(self) -> str:
        return f"sat_{self.name}_details"


def _entity(name: str, source: str, key: str, payload: str) -> Entity:
    schema, table = source.split(".")
    return Entity(name, schema, table, key, (*payload.split(), "created_at", "updated_at"))


ENTITIES = {
    e.name: e
    for e in (
        _entity("customer", "mms.customers", "customer_no", "customer_type first_name last_name legal_name national_id tax_id date_of_birth segment_code status_code home_branch_code"),
        _entity("loan_application", "krd.loan_applications", "application_no", "requested_amount term_months status_code applied_at decision_at"),
        _entity("loan", "krd.loans", "loan_no", "principal_amount annual_interest_rate term_months status_code disbursed_at maturity_date"),
        _entity("product", "prm.products", "product_code", "product_name product_type default_currency_code is_active"),
        _entity("branch", "prm.branches", "branch_code", "branch_name city is_active"),
        _entity("currency", "prm.currencies", "currency_code", "currency_name minor_unit is_active"),
    )
}

#: Business-key fields of the dimensions that applications and loans refer to.
CONTEXT = {"customer": "customer_no", "product": "product_code", "branch": "branch_code", "currency": "currency_code"}

SOURCE_TABLES = tuple(
    f"{schema}.{table}"
    for schema, tables in {
        "mms": "customers customer_addresses customer_contacts customer_relations",
        "krd": "loan_applications loans installments collaterals",
        "prm": "currencies branches products status_codes rate_parameters",
    }.items()
    for table in tables.split()
)
