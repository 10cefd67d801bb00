"""Insert-only vault tables from change events: hubs, links, satellites, status and effectivity history, quarantine.

Events are flattened once (`flatten`); every builder is a projection of that frame with one grouped operator behind it,
so that a cached or written flat frame serves all tables with a single parse of the images.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import DELIMITER, canonical, canonical_json_object, change_field, digest, hash_key, image_field, is_plain, valid_key
from cairn.operators.history import changes_by, first_arrival, latest_state, source_history, top_by
from cairn.sources.schemas import AUDIT, CHANGES, CONTEXT, ENTITIES, LIVE, OPERATIONS, Entity


class OutOfOrder(RuntimeError):
    """A batch starts at or before the source position that is already persisted."""


def flatten(events: DataFrame, batch_id: str) -> DataFrame:
    """One row an event: images, identity and the audit columns side by side."""
    m = lambda f: F.col(f"_metadata.{f}")
    return events.select(
        "key", F.col("value.before").alias("before"), F.col("value.after").alias("after"),
        m("event_id").alias("event_id"), m("source_schema").alias("source_schema"), m("source_table").alias("source_table"),
        m("operation").alias("operation"), m("payload_sha256").alias("payload_sha256"), m("event_timestamp").alias("event_timestamp"),
        F.to_json(F.struct("key", "value")).alias("raw_payload"), F.col("value.source.txId").alias("txid"),
        m("ingested_at").cast("timestamp").alias("load_datetime"),
        m("event_timestamp").cast("timestamp").alias("effective_from"),
        F.concat_ws(".", m("source_system"), m("source_schema"), m("source_table")).alias("record_source"),
        m("event_id").alias("source_event_id"),
        F.format_string("%s:%d:%d", m("kafka_topic"), m("kafka_partition"), m("kafka_offset")).alias("source_position"),
        m("kafka_topic").alias("kafka_topic"), m("kafka_partition").cast("int").alias("kafka_partition"), m("kafka_offset").cast("long").alias("kafka_offset"),
        F.col("value.source.lsn").cast("long").alias("source_lsn"), m("object_key").alias("bronze_object_key"),
        F.lit(batch_id).alias("load_batch_id"), *(_fields(events) if is_plain() else ()),
    )


def _fields(events: DataFrame) -> list[Column]:
    """The image fields that builders ask for, of events that hold them as columns; a field that no image has is null."""
    names = dict.fromkeys([*[f for e in ENTITIES.values() for f in (e.key, *e.payload)], *CONTEXT.values(), "application_id"])
    return [(F.col(c) if c in events.columns else F.lit(None).cast("string")).alias(c) for n in names for c in (f"before_{n}", f"after_{n}")]


def rows_of(flat: DataFrame, schema: str, table: str, deletes: bool = False) -> DataFrame:
    """Live images of one source table, or all its changes."""
    of = flat.filter((F.col("source_schema") == schema) & (F.col("source_table") == table))
    return of.filter(F.col("operation").isin(*CHANGES)) if deletes else of.filter(F.col("operation").isin(*LIVE) & F.col("after").isNotNull())


def status() -> list[Column]:
    gone = F.col("operation") == "d"
    return [F.when(gone, "DELETED").otherwise("ACTIVE").alias("record_status"), gone.alias("is_deleted")]


def joined(*cols: Column | str) -> Column:
    """The canonical values in one text: what `hash_key` hashes, but for the namespace.

    Builders group and compare by such texts and hash the rows that stay: hashes are longer than most keys and do not
    compress, so they do not go through a shuffle.
    """
    return F.concat_ws(DELIMITER, *[canonical(c) for c in cols])


def build_hub(flat: DataFrame, e: Entity) -> DataFrame:
    key = image_field(e.key)
    rows = rows_of(flat, e.schema, e.table).withColumn("_bk", key).filter(valid_key("_bk"))
    return top_by(rows.select(canonical("_bk").alias(e.bk), *AUDIT), [e.bk], first_arrival()).select(digest(e.namespace, e.bk).alias(e.hk), e.bk, *AUDIT)


def build_satellite(flat: DataFrame, e: Entity) -> DataFrame:
    rows = rows_of(flat, e.schema, e.table).select("operation", image_field(e.key).alias("_bk"), *[image_field(f).alias(f) for f in e.payload], *AUDIT).filter(valid_key("_bk"))
    changed = changes_by(rows.withColumn("_bk", canonical("_bk")), ["_bk"], source_history(), joined, parts=e.payload)
    return changed.select(
        digest(e.namespace, "_bk").alias(e.hk), hash_key(f"{e.satellite.upper()}_HASHDIFF", *e.payload).alias("hashdiff"),
        F.col("operation").alias("record_operation"), *e.payload, *AUDIT,
    )


def _context(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows with the canonical business keys of a relationship, taken from columns that hold them (name -> column), and all of them in `_context`."""
    return rows.select(*[canonical(c).alias(f"_{n}_key") for n, c in keys.items()], joined(*keys.values()).alias("_context"), "operation", *AUDIT)


def _context_keys(namespace: str, keys: dict[str, str]) -> list[Column]:
    """Hash keys of the relationship and of its ends, from rows of `_context`."""
    context = digest(f"{namespace}_CONTEXT", "_context")
    return [context.alias(f"{namespace.lower()}_context_hk"), *[digest(n.upper(), f"_{n}_key").alias(f"{n}_hk") for n in keys]]


def _link(rows: DataFrame, namespace: str, keys: dict[str, str]) -> DataFrame:
    return top_by(_context(rows, keys), ["_context"], first_arrival()).select(*_context_keys(namespace, keys), *AUDIT)


def _effectivity(rows: DataFrame, namespace: str, keys: dict[str, str]) -> DataFrame:
    """The changes of the first end's relationship and status."""
    states = _context(rows, keys).withColumns(dict(zip(("record_status", "is_deleted"), status(), strict=True)))
    changed = changes_by(states, [f"_{next(iter(keys))}_key"], source_history(), joined, parts=("_context", "record_status"))
    out = changed.select(*_context_keys(namespace, keys), "record_status", "is_deleted", F.col("operation").alias("record_operation"), *AUDIT)
    return out.withColumn("effectivity_hashdiff", hash_key(f"{namespace}_EFFECTIVITY", F.col(f"{namespace.lower()}_context_hk"), F.col("record_status")))


def _application_rows(flat: DataFrame, deletes: bool) -> tuple[DataFrame, dict[str, str]]:
    field = change_field if deletes else image_field
    keys = {"loan_application": "application_no", **CONTEXT}
    rows = rows_of(flat, "krd", "loan_applications", deletes).withColumns({f"_{k}": field(c) for k, c in keys.items()})
    cols = {k: f"_{k}" for k in keys}
    return rows.filter(valid_key(*cols.values())), cols


def build_application_link(flat: DataFrame) -> DataFrame:
    rows, keys = _application_rows(flat, deletes=False)
    return _link(rows, "APPLICATION", keys)


def build_application_effectivity(flat: DataFrame) -> DataFrame:
    rows, keys = _application_rows(flat, deletes=True)
    return _effectivity(rows, "APPLICATION", keys)


def persisted_applications(loan_links: DataFrame | None, application_hub: DataFrame | None) -> DataFrame | None:
    """(loan_hk, application_no) by the latest persisted link of each loan."""
    if loan_links is None or application_hub is None:
        return None
    latest = top_by(loan_links, ["loan_hk"], latest_state())
    return latest.join(application_hub, "loan_application_hk").select("loan_hk", F.col("loan_application_bk").alias("_persisted_no"))


def resolve_loans(flat: DataFrame, deletes: bool, persisted: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Loan rows with the application number behind their application id: the batch's own, else the persisted one; others drop out."""
    field = change_field if deletes else image_field
    wanted = {"loan": "loan_no", "application_id": "application_id", **CONTEXT}
    loans = rows_of(flat, "krd", "loans", deletes).withColumns({f"_{k}": field(c) for k, c in wanted.items()})
    loans = loans.filter(valid_key(*[f"_{k}" for k in wanted]))
    seen = rows_of(flat, "krd", "loan_applications", True).select(
        change_field("application_id").alias("_application_id"), change_field("application_no").alias("_batch_no"), "source_lsn", "kafka_partition", "kafka_offset"
    ).filter(valid_key("_application_id", "_batch_no"))
    order = [F.desc_nulls_last("source_lsn"), F.desc_nulls_last("kafka_partition"), F.desc_nulls_last("kafka_offset")]
    out = loans.join(top_by(seen, ["_application_id"], order).select("_application_id", "_batch_no"), "_application_id", "left")
    out = out.withColumn("_loan_hk", hash_key("LOAN", "_loan"))
    if persisted is None:
        out = out.withColumn("_loan_application", F.col("_batch_no"))
    else:
        out = out.join(persisted.withColumnRenamed("loan_hk", "_loan_hk"), "_loan_hk", "left").withColumn("_loan_application", F.coalesce("_batch_no", "_persisted_no"))
    return out.filter(valid_key("_loan_application")), {"loan": "_loan", "loan_application": "_loan_application", **{k: f"_{k}" for k in CONTEXT}}


def build_loan_link(flat: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    rows, keys = resolve_loans(flat, False, persisted)
    return _link(rows, "LOAN", keys)


def build_loan_effectivity(flat: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    rows, keys = resolve_loans(flat, True, persisted)
    return _effectivity(rows, "LOAN", keys)


def build_record_tracking(flat: DataFrame) -> DataFrame:
    rows = flat.filter(F.col("operation").isin(*CHANGES) & F.col("key").isNotNull()).withColumn("source_record_key", F.coalesce(canonical_json_object("key"), F.col("key")))
    staged = rows.select(
        hash_key("SOURCE_RECORD", "source_schema", "source_table", "source_record_key").alias("source_record_hk"),
        "source_record_key", "source_schema", "source_table", *status(), F.col("operation").alias("record_operation"), *AUDIT,
    )
    return changes_by(staged, ["source_record_hk"], source_history(), "record_status")


def build_entity_status(flat: DataFrame) -> DataFrame:
    """Status history of all entities.  One pass: the entity of a row follows from its source table."""
    pick = lambda f: F.coalesce(*[F.when((F.col("source_schema") == e.schema) & (F.col("source_table") == e.table), f(e)) for e in ENTITIES.values()])
    rows = flat.filter(F.col("operation").isin(*CHANGES)).withColumns({"entity_type": pick(lambda e: F.lit(e.namespace)), "_bk": pick(lambda e: change_field(e.key))})
    key = F.sha2(F.concat_ws(DELIMITER, "entity_type", "entity_business_key"), 256)
    return _status_changes(rows.filter(F.col("entity_type").isNotNull()), ["entity_type", "entity_business_key"], key)


def build_status_of(flat: DataFrame, e: Entity) -> DataFrame:
    """The part of `build_entity_status` that is of one entity."""
    rows = rows_of(flat, e.schema, e.table, deletes=True).withColumns({"entity_type": F.lit(e.namespace), "_bk": change_field(e.key)})
    return _status_changes(rows, ["entity_business_key"], digest(e.namespace, "entity_business_key"))


def _status_changes(rows: DataFrame, keys: list[str], hk: Column) -> DataFrame:
    staged = rows.filter(valid_key("_bk")).select("entity_type", canonical("_bk").alias("entity_business_key"), *status(), F.col("operation").alias("record_operation"), *AUDIT)
    changed = changes_by(staged, keys, source_history(), "record_status")
    return changed.select("entity_type", hk.alias("entity_hk"), "entity_business_key", "record_status", "is_deleted", "record_operation", *AUDIT)


def quarantine_reason() -> Column:
    op = F.col("operation")
    return (
        F.when(F.col("event_id").isNull(), "MISSING_EVENT_ID")
        .when(F.col("source_schema").isNull(), "MISSING_SOURCE_SCHEMA")
        .when(F.col("source_table").isNull(), "MISSING_SOURCE_TABLE")
        .when(op.isNull(), "MISSING_OPERATION")
        .when(~op.isin(*OPERATIONS), "UNSUPPORTED_OPERATION")
        .when(op.isin(*LIVE) & F.col("after").isNull(), "MISSING_AFTER_IMAGE")
    )


def reason_codes() -> Column:
    """Why an event is no use, as a list: breaches of the contract, and live images without their business key."""
    missing = F.coalesce(*[
        F.when((F.col("source_schema") == e.schema) & (F.col("source_table") == e.table) & F.col("operation").isin(*LIVE) & F.col("after").isNotNull() & ~valid_key(image_field(e.key)), F.lit(f"MISSING_BUSINESS_KEY_{e.namespace}"))
        for e in ENTITIES.values()
    ])
    return F.array_compact(F.array(quarantine_reason(), missing))


def build_quarantine(flat: DataFrame) -> DataFrame:
    """One pass over the events, one row a reason."""
    both = flat.withColumn("reason_code", F.explode(reason_codes()))
    identity = F.coalesce("event_id", "payload_sha256", "bronze_object_key", F.sha2("raw_payload", 256))
    out = both.select(
        F.sha2(F.concat_ws(DELIMITER, identity, "reason_code"), 256).alias("quarantine_hk"), "reason_code", "source_event_id", "source_schema", "source_table",
        F.col("operation").alias("record_operation"), "bronze_object_key", "raw_payload", F.current_timestamp().alias("detected_at"), "load_batch_id",
    )
    return out.dropDuplicates(["quarantine_hk"])


def after_persisted(staged: DataFrame, target: DataFrame | None, entity_key: str, state: str, batch_id: str, name: str = "target") -> DataFrame:
    """The rows of a bounded batch that change what is persisted.

    The first row of an entity drops out if it repeats the persisted state; it must come after the persisted source
    position.  Rows of the batch itself do not count as persisted, so a retry gives the same result.
    """
    if target is None:
        return staged
    ranked = against_persisted(staged, target, entity_key, state, batch_id)
    if not ranked.filter("_late").isEmpty():
        raise OutOfOrder(f"a source position of {name} is not after the persisted one")
    return ranked.filter("_changed").select(staged.columns)


def against_persisted(staged: DataFrame, target: DataFrame, entity_key: str, state: str, batch_id: str) -> DataFrame:
    """staged with `_late` (an entity's first row that is not after its persisted position) and `_changed` (not a repeat of the persisted state)."""
    last = top_by(target.filter(F.col("load_batch_id") != batch_id), [entity_key], latest_state()).select(
        entity_key, F.col(state).alias("_state"), F.col("source_lsn").alias("_lsn"), F.col("kafka_topic").alias("_topic"), F.col("kafka_partition").alias("_partition"), F.col("kafka_offset").alias("_offset")
    )
    from pyspark.sql import Window

    ranked = staged.withColumn("_rank", F.row_number().over(Window.partitionBy(entity_key).orderBy(*source_history()))).join(last, entity_key, "left")
    late = (F.col("_rank") == 1) & F.col("_state").isNotNull() & not_after()
    changed = (F.col("_rank") > 1) | F.col("_state").isNull() | ~F.col(state).eqNullSafe(F.col("_state"))
    return ranked.withColumns({"_late": F.coalesce(late, F.lit(False)), "_changed": changed})


def not_after() -> Column:
    """Whether a row's position is at or before the persisted one (_lsn, _topic, _partition, _offset)."""
    same = (F.col("kafka_topic") == F.col("_topic")) & (F.col("kafka_partition") == F.col("_partition")) & (F.col("kafka_offset") <= F.col("_offset"))
    known = F.col("source_lsn").isNotNull() & F.col("_lsn").isNotNull()
    return F.when(known, (F.col("source_lsn") < F.col("_lsn")) | ((F.col("source_lsn") == F.col("_lsn")) & same)).otherwise(same)


def current_counts(flat: DataFrame) -> DataFrame:
    """(object_name, rows) of the source tables as the events leave them."""
    rows = flat.filter(F.col("operation").isin(*CHANGES) & F.col("key").isNotNull()).select(
        F.concat_ws(".", "source_schema", "source_table").alias("object_name"), F.coalesce(canonical_json_object("key"), F.col("key")).alias("_key"), "operation", "event_timestamp", "source_lsn", "kafka_offset"
    )
    order = [F.desc_nulls_last("event_timestamp"), F.desc_nulls_last("source_lsn"), F.desc_nulls_last("kafka_offset")]
    return top_by(rows, ["object_name", "_key"], order).filter("operation <> 'd'").groupBy("object_name").agg(F.count(F.lit(1)).alias("rows"))


#: Table, its merge key, and for change history the entity key and state that the boundary check compares.
TABLES: dict[str, tuple[str, str | None, str | None]] = {
    **{e.hub: (e.hk, None, None) for e in ENTITIES.values()},
    "link_application_context": ("application_context_hk", None, None),
    "link_loan_context": ("loan_context_hk", None, None),
    **{e.satellite: ("source_event_id", e.hk, "hashdiff") for e in ENTITIES.values()},
    "sat_source_record_status": ("source_event_id", "source_record_hk", "record_status"),
    "sat_entity_record_status": ("source_event_id", "entity_hk", "record_status"),
    "sat_application_context_effectivity": ("source_event_id", "loan_application_hk", "effectivity_hashdiff"),
    "sat_loan_context_effectivity": ("source_event_id", "loan_hk", "effectivity_hashdiff"),
    "cdc_raw_vault_events": ("quarantine_hk", None, None),
}


def build(name: str, flat: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    """The candidate rows of one vault table."""
    for e in ENTITIES.values():
        if name == e.hub:
            return build_hub(flat, e)
        if name == e.satellite:
            return build_satellite(flat, e)
    if name == "link_loan_context":
        return build_loan_link(flat, persisted)
    if name == "sat_loan_context_effectivity":
        return build_loan_effectivity(flat, persisted)
    return {
        "link_application_context": build_application_link,
        "sat_source_record_status": build_record_tracking,
        "sat_entity_record_status": build_entity_status,
        "sat_application_context_effectivity": build_application_effectivity,
        "cdc_raw_vault_events": build_quarantine,
    }[name](flat)


def phase_tables(phase: str) -> Sequence[str]:
    """Tables of a phase: validate, core, satellites, current-state or all."""
    current = ("sat_entity_record_status", "sat_application_context_effectivity", "sat_loan_context_effectivity")
    phases = {
        "validate": ("cdc_raw_vault_events",),
        "core": tuple(t for t in TABLES if t.startswith(("hub_", "link_"))),
        "satellites": tuple(t for t in TABLES if t.startswith("sat_")),
        "current-state": current,
    }
    return tuple(TABLES) if phase == "all" else phases[phase]
