"""Immutable batch boundaries: canonical JSON, manifests of offset intervals, audit evidence, write-once files."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Mapping
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.readers import COORDINATES

# Fixed values of the formats.
INTERVALS = "(watermark_low, watermark_high]"
WHOLE_READER, BOUNDED_READER = "legacy_recursive_filter", "bounded_object_list"
LEDGER_CONTRACT = "postgres-workload-ledger-v1"


class Invalid(ValueError):
    """A document breaks its contract."""


def canonical_json(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":")).encode()


def checksum(value: Any) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def coordinate(key: str) -> tuple[str, int, int] | None:
    m = COORDINATES.search(key)
    return (m["topic"], int(m["partition"]), int(m["offset"])) if m else None


def bounds_of(objects: DataFrame, published: DataFrame) -> DataFrame:
    """Interval of each (topic, partition): from its last published high (or -1) to its highest offset, with counts and bytes.

    objects: topic, partition, offset, size_bytes; published: topic, partition, watermark_high.
    """
    last = published.groupBy("topic", "partition").agg(F.max("watermark_high").alias("low"))
    placed = objects.join(last, ["topic", "partition"], "left").withColumn("watermark_low", F.coalesce("low", F.lit(-1).cast("long")))
    new = F.col("offset") > F.col("watermark_low")
    return placed.groupBy("topic", "partition", "watermark_low").agg(
        F.max("offset").alias("watermark_high"), F.count_if(new).alias("interval_object_count"), F.coalesce(F.sum(F.when(new, F.col("size_bytes"))), F.lit(0)).cast("long").alias("interval_input_bytes")
    )


def build_manifest(batch_id: str, objects: Iterable[Mapping], published: Mapping[tuple[str, int], int], created_at: str, adapter: str = "postgres-debezium", contract: str = "cdc-envelope-v1", ledger: Mapping | None = None) -> dict:
    """The payload that seals a batch: every object above the published marks, in order of its coordinates."""
    placed = []
    for o in objects:
        at = coordinate(o["object_key"])
        if at is None:
            raise Invalid(f"no coordinates in {o['object_key']}")
        placed.append((*at, o["object_key"], int(o["size_bytes"]), str(o.get("storage_etag", ""))))
    if not placed:
        raise Invalid("a manifest needs objects")
    placed.sort()
    bounds, chosen = [], []
    for (topic, partition), group in groupby(placed, key=lambda p: p[:2]):
        rows = list(group)
        offsets = [r[2] for r in rows]
        if len(set(offsets)) < len(offsets):
            raise Invalid(f"repeated offsets in {topic}/{partition}")
        low, high = int(published.get((topic, partition), -1)), offsets[-1]
        if high < low:
            raise Invalid(f"high mark of {topic}/{partition} went back: {high} < {low}")
        new = [r for r in rows if r[2] > low]
        chosen += new
        bounds.append({"topic": topic, "partition": partition, "watermark_low": low, "watermark_high": high, "interval_object_count": len(new), "interval_input_bytes": sum(r[4] for r in new)})
    payload = {
        "schema_version": 2 if ledger is None else 3, "batch_id": batch_id, "source_adapter": adapter, "schema_contract_version": contract, "created_at": created_at,
        "interval_semantics": INTERVALS, "reader_mode": BOUNDED_READER, "partitions": bounds,
        "objects": [{"object_key": r[3], "size_bytes": r[4], "storage_etag": r[5]} for r in chosen],
        "interval_object_count": len(chosen), "interval_input_bytes": sum(r[4] for r in chosen),
    }
    return payload if ledger is None else payload | {"source_control": dict(ledger)}


def document(payload: Mapping) -> dict:
    return {"manifest_sha256": checksum(payload), "payload": dict(payload)}


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise Invalid(what)


def _whole(x: Any, least: int | None = None) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and (least is None or x >= least)


def validate(doc: Mapping, sha256: str | None = None, batch_id: str | None = None) -> dict:
    """The payload of a manifest document, if everything in it agrees."""
    _need(set(doc) == {"manifest_sha256", "payload"} and isinstance(doc["payload"], dict), "a manifest holds its checksum and its payload")
    p = doc["payload"]
    _need(doc["manifest_sha256"] == checksum(p), "the checksum does not match the payload")
    _need(sha256 is None or sha256 == doc["manifest_sha256"], "the checksum is not the expected one")
    _need(batch_id is None or p.get("batch_id") == batch_id, "the batch is not the expected one")
    version = p.get("schema_version")
    _need(version in (1, 2, 3), "unknown schema version")
    _need(p.get("interval_semantics") == INTERVALS, "unknown interval semantics")
    parts = p.get("partitions")
    _need(isinstance(parts, list) and bool(parts) and all(isinstance(b, dict) for b in parts), "partitions are missing")
    for b in parts:
        _need(isinstance(b.get("topic"), str) and bool(b["topic"]) and _whole(b.get("partition"), 0), "a partition needs a topic and a number")
        _need(_whole(b.get("watermark_low")) and _whole(b.get("watermark_high")) and b["watermark_low"] <= b["watermark_high"], "a partition's marks are invalid")
    ids = [(b["topic"], b["partition"]) for b in parts]
    _need(ids == sorted(set(ids)), "partitions must be unique and sorted")
    _need(p.get("reader_mode") == (WHOLE_READER if version == 1 else BOUNDED_READER), "the reader mode does not fit the version")
    if version == 1:
        return dict(p)
    objects = p.get("objects")
    _need(isinstance(objects, list) and all(isinstance(o, dict) for o in objects), "objects are missing")
    seen: dict[tuple, list[int]] = {i: [0, 0] for i in ids}
    places = []
    marks = {(b["topic"], b["partition"]): b for b in parts}
    for o in objects:
        _need(isinstance(o.get("object_key"), str) and _whole(o.get("size_bytes"), 0) and isinstance(o.get("storage_etag"), str), "an object needs a key, a size and a tag")
        at = coordinate(o["object_key"])
        b = marks.get(at[:2]) if at else None
        _need(b is not None and b["watermark_low"] < at[2] <= b["watermark_high"], f"{o['object_key']} is outside the batch")
        places.append((*at, o["object_key"]))
        seen[at[:2]][0] += 1
        seen[at[:2]][1] += o["size_bytes"]
    _need(places == sorted(places), "objects must be sorted by coordinates")
    _need(len({x[3] for x in places}) == len(places) == len({x[:3] for x in places}), "objects must be unique")
    for i, b in marks.items():
        _need([b.get("interval_object_count"), b.get("interval_input_bytes")] == seen[i], "a partition's counts do not match its objects")
    _need(p.get("interval_object_count") == len(objects) and p.get("interval_input_bytes") == sum(o["size_bytes"] for o in objects), "the totals do not match the objects")
    if version == 3:
        validate_ledger(p.get("source_control"))
    return dict(p)


def validate_ledger(ledger: Any) -> None:
    """The source's own account of a batch's transactions."""
    _need(isinstance(ledger, dict) and ledger.get("contract_version") == LEDGER_CONTRACT, "unknown ledger contract")
    txns = ledger.get("transactions")
    _need(isinstance(txns, list) and _whole(ledger.get("untracked_event_count"), 0), "the ledger lacks transactions or untracked events")
    ids = []
    for t in txns:
        _need(all(_whole(t.get(k), 0) for k in ("source_txid", "expected_event_count", "observed_event_count")), "a transaction needs its id and counts")
        _need(t.get("status") == ("PASS" if t["expected_event_count"] == t["observed_event_count"] else "FAIL"), "a transaction's status contradicts its counts")
        ids.append(t["source_txid"])
    _need(len(set(ids)) == len(ids), "transactions must be unique")


def transaction_summary(flat: DataFrame) -> DataFrame:
    """Events, first and last position of each source transaction; a null id counts as untracked."""
    return flat.groupBy("txid").agg(F.count(F.lit(1)).alias("observed_event_count"), F.min("source_lsn").alias("event_lsn_low"), F.max("source_lsn").alias("event_lsn_high")).withColumn("untracked", F.col("txid").isNull())


def event_counts(flat: DataFrame) -> DataFrame:
    return flat.groupBy(F.concat_ws(".", "source_schema", "source_table").alias("table_name"), "operation").agg(F.count(F.lit(1)).alias("events"))


def ledger_through(rows: DataFrame, observed: DataFrame) -> DataFrame:
    """Ledger rows (txid, lsn_position, ...) up to the highest position of any observed transaction."""
    top = rows.join(observed.select("txid").distinct(), "txid", "left_semi").agg(F.max("lsn_position").alias("top"))
    return rows.join(top, F.col("lsn_position") <= F.col("top")).drop("top")


def build_ledger(expected: Mapping[int, int], observed: Mapping[int, int], untracked: int, positions: Mapping[int, int]) -> dict:
    """Match the ledger's transactions with the observed ones; observed ones that the ledger lacks are untracked."""
    txns = [
        {"source_txid": t, "expected_event_count": n, "observed_event_count": observed.get(t, 0), "source_boundary_position": positions[t], "status": "PASS" if n == observed.get(t, 0) else "FAIL"}
        for t, n in sorted(expected.items())
    ]
    return {"contract_version": LEDGER_CONTRACT, "transactions": txns, "untracked_event_count": untracked + sum(n for t, n in observed.items() if t not in expected)}


def lsn_position(text: str) -> int:
    """A log position written as two hexadecimal halves."""
    high, low = text.split("/")
    return (int(high, 16) << 32) + int(low, 16)


def safe_name(batch_id: str) -> str:
    """A file name for a batch: readable, and unique by a digest."""
    readable = re.sub(r"[^A-Za-z0-9._-]+", "-", batch_id).strip("-.")[:80] or "batch"
    return f"{readable}-{hashlib.sha256(batch_id.encode()).hexdigest()[:16]}"


def write_once(path: str, value: Any) -> str:
    """Write canonical JSON to a new file; the same bytes again are fine, other bytes are an error.  Returns the digest."""
    content = canonical_json(value) + b"\n"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    try:
        with open(path, "xb") as f:
            f.write(content)
    except FileExistsError:
        pass
    with open(path, "rb") as f:
        if f.read() != content:
            raise Invalid(f"{path} holds something else") from None
    return hashlib.sha256(content).hexdigest()


def read_once(path: str, check: Callable[[Any], Any] = lambda x: x) -> tuple[Any, str]:
    with open(path, "rb") as f:
        content = f.read()
    value = json.loads(content)
    _need(content == canonical_json(value) + b"\n", f"{path} is not canonical")
    return check(value), hashlib.sha256(content).hexdigest()


AUDIT_SCHEMA, AUDIT_RULES = 1, "point-in-time-v1"


def build_audit(batch_id: str, attempt: int, run_id: str, manifest_sha256: str, manifest: Mapping, rules: Iterable[Mapping]) -> dict:
    keep = ("topic", "partition", "watermark_low", "watermark_high")
    return {
        "schema_version": AUDIT_SCHEMA, "rule_version": AUDIT_RULES, "batch_id": batch_id, "attempt_number": attempt, "run_id": run_id, "manifest_sha256": manifest_sha256,
        "watermark": [{k: b[k] for k in keep} for b in manifest["partitions"]], "source_control": manifest.get("source_control"),
        "rules": sorted((dict(r) for r in rules), key=lambda r: (r["rule_id"], r["object_name"])),
    }


def validate_audit(payload: Mapping, batch_id: str, attempt: int, run_id: str, manifest_sha256: str) -> dict:
    expected = {"schema_version": AUDIT_SCHEMA, "rule_version": AUDIT_RULES, "batch_id": batch_id, "attempt_number": attempt, "run_id": run_id, "manifest_sha256": manifest_sha256}
    for k, v in expected.items():
        _need(payload.get(k) == v, f"{k} of the evidence is not the attempt's")
    _need(isinstance(payload.get("watermark"), list) and bool(payload["watermark"]), "the evidence lacks its marks")
    rules = payload.get("rules")
    _need(isinstance(rules, list) and bool(rules) and all(isinstance(r, dict) for r in rules), "the evidence lacks rules")
    for r in rules:
        _need(all(isinstance(r.get(k), str) and r[k] for k in ("rule_id", "object_name")), "a rule needs an id and an object")
        _need(all(_whole(r.get(k)) for k in ("expected_value", "observed_value", "difference")), "a rule's values must be whole numbers")
        _need(r["difference"] == r["observed_value"] - r["expected_value"] and r.get("status") == ("PASS" if r["difference"] == 0 else "FAIL"), "a rule contradicts itself")
    ids = [(r["rule_id"], r["object_name"]) for r in rules]
    _need(ids == sorted(set(ids)), "rules must be unique and sorted")
    return dict(payload)
