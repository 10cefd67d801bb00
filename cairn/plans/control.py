"""The control plane: batches, attempts, evidence and published intervals in one transactional file.

SQLite's immediate transactions stand where a database server's locks would: one writer at a time decides.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterable, Mapping
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans import manifest as M

# The tasks of an attempt, in order, and the legal moves of a batch.
TASKS = ("validate_bronze_and_quarantine", "load_incremental_hubs_links", "load_satellite_and_delete_history", "reconcile_source_bronze_silver")
MOVES = {
    "CREATED": {"RUNNING", "SUPERSEDED"},
    "FAILED": {"RUNNING", "SUPERSEDED"},
    "RUNNING": {"VALIDATED", "FAILED"},
    "VALIDATED": {"PUBLISHED"},
}
UNFINISHED = ("CREATED", "RUNNING", "FAILED", "VALIDATED")

SCHEMA = """
create table if not exists batch (batch_id text primary key, state text not null, manifest text not null, manifest_sha256 text not null, source_adapter text, schema_contract_version text, created_at text not null, published_at text);
create unique index if not exists one_unfinished on batch ((1)) where state in ('CREATED', 'RUNNING', 'FAILED', 'VALIDATED');
create table if not exists batch_partition (batch_id text references batch, topic text, partition integer check (partition >= 0), watermark_low integer, watermark_high integer, interval_object_count integer, interval_input_bytes integer, primary key (batch_id, topic, partition), check (watermark_high >= watermark_low));
create table if not exists batch_object (batch_id text references batch, object_key text, size_bytes integer check (size_bytes >= 0), storage_etag text, primary key (batch_id, object_key));
create table if not exists source_transaction (batch_id text references batch, source_txid integer, expected_event_count integer, observed_event_count integer, source_boundary_position integer, status text, primary key (batch_id, source_txid));
create table if not exists attempt (batch_id text references batch, attempt_number integer, run_id text unique, state text not null, started_at text, finished_at text, error text, primary key (batch_id, attempt_number));
create table if not exists task_evidence (batch_id text, attempt_number integer, task text, manifest_sha256 text, details text, recorded_at text, primary key (batch_id, attempt_number, task));
create table if not exists audit_result (batch_id text, attempt_number integer, rule_id text, object_name text, expected_value integer, observed_value integer, difference integer, status text check (status in ('PASS', 'FAIL')), evidence_sha256 text, primary key (batch_id, attempt_number, rule_id, object_name));
create table if not exists state_change (batch_id text, from_state text, to_state text, at text);
create table if not exists published_interval (batch_id text references batch, topic text, partition integer, watermark_low integer, watermark_high integer, primary key (batch_id, topic, partition), check (watermark_high > watermark_low));
"""
TABLES = ("batch", "batch_partition", "batch_object", "source_transaction", "attempt", "task_evidence", "audit_result", "state_change", "published_interval")


def batch_history(batches: DataFrame, partitions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each batch with the size of its sealed interval and its latest attempt, zeros where it has none."""
    sealed = partitions.groupBy("batch_id").agg(F.count(F.lit(1)).alias("partition_count"), F.sum("interval_object_count").alias("interval_object_count"), F.sum("interval_input_bytes").alias("interval_input_bytes"))
    tried = attempts.groupBy("batch_id").agg(F.max("attempt_number").alias("latest_attempt_number"))
    counts = [c for df in (sealed, tried) for c in df.columns if c != "batch_id"]
    return batches.join(sealed, "batch_id", "left").join(tried, "batch_id", "left").fillna(0, counts)


def overlapping(intervals: DataFrame) -> DataFrame:
    """(topic, partition, batch_id, other_batch_id) of half-open intervals (low, high] that share an offset, each pair once.

    An interval that overlaps any other overlaps one that starts at or before it, so a running maximum of the ends tells
    in one sort which rows overlap at all; only those are joined.
    """
    before = Window.partitionBy("topic", "partition").orderBy("watermark_low", "watermark_high", "batch_id")
    after = Window.partitionBy("topic", "partition").orderBy("watermark_low", "watermark_high", "batch_id").rowsBetween(1, Window.unboundedFollowing)
    reach = F.max("watermark_high").over(before.rowsBetween(Window.unboundedPreceding, -1))
    suspect = intervals.withColumns({"_reach": reach, "_next": F.min("watermark_low").over(after)})
    suspect = suspect.filter((F.col("_reach") > F.col("watermark_low")) | (F.col("_next") < F.col("watermark_high")))
    a, b = suspect.alias("a"), suspect.alias("b")
    same = (F.col("a.topic") == F.col("b.topic")) & (F.col("a.partition") == F.col("b.partition")) & (F.col("a.batch_id") < F.col("b.batch_id"))
    shared = (F.col("a.watermark_low") < F.col("b.watermark_high")) & (F.col("b.watermark_low") < F.col("a.watermark_high"))
    return a.join(b, same & shared).select("a.topic", "a.partition", "a.batch_id", F.col("b.batch_id").alias("other_batch_id"))


class ControlError(RuntimeError):
    """The control plane refuses a step."""


def check_move(before: str, after: str) -> None:
    if after not in MOVES.get(before, ()):
        raise ControlError(f"a batch cannot go from {before} to {after}")


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds")


class ControlPlane:
    def __init__(self, path: str):
        self.db = sqlite3.connect(path, isolation_level=None, timeout=60)
        self.db.row_factory = sqlite3.Row
        self.db.executescript(SCHEMA)

    @contextmanager
    def _transaction(self):
        self.db.execute("begin immediate")
        try:
            yield self.db
        except BaseException:
            self.db.execute("rollback")
            raise
        self.db.execute("commit")

    def _one(self, sql: str, *args):
        return self.db.execute(sql, args).fetchone()

    def batch(self, batch_id: str) -> sqlite3.Row:
        row = self._one("select * from batch where batch_id = ?", batch_id)
        if row is None:
            raise ControlError(f"unknown batch {batch_id}")
        return row

    def _move(self, batch_id: str, after: str) -> None:
        before = self.batch(batch_id)["state"]
        check_move(before, after)
        self.db.execute("update batch set state = ?, published_at = case when ? = 'PUBLISHED' then ? else published_at end where batch_id = ?", (after, after, _now(), batch_id))
        self.db.execute("insert into state_change values (?, ?, ?, ?)", (batch_id, before, after, _now()))

    def published_highs(self) -> dict[tuple[str, int], int]:
        return {(r[0], r[1]): r[2] for r in self.db.execute("select topic, partition, max(watermark_high) from published_interval group by 1, 2")}

    def last_boundary(self) -> int | None:
        return self._one("select max(t.source_boundary_position) from source_transaction t join batch b using (batch_id) where b.state = 'PUBLISHED'")[0]

    def create_or_get(self, batch_id: str, discover: Callable[[], Iterable[Mapping]], ledger: Callable[[list[dict]], Mapping] | None = None) -> dict:
        """The sealed manifest document of a batch.  The same id gives the same document; another batch must be finished first."""
        with self._transaction():
            known = self._one("select manifest from batch where batch_id = ?", batch_id)
            if known:
                return json.loads(known[0])
            open_ = self._one(f"select batch_id, state from batch where state in {UNFINISHED!r}")
            if open_:
                raise ControlError(f"batch {open_['batch_id']} is {open_['state']}")
            objects = list(discover())
            payload = M.build_manifest(batch_id, objects, self.published_highs(), _now())
            if ledger is not None:
                payload = payload | {"schema_version": 3, "source_control": dict(ledger(payload["objects"]))}
            doc = M.document(payload)
            M.validate(doc, batch_id=batch_id)
            self.db.execute("insert into batch values (?, 'CREATED', ?, ?, ?, ?, ?, null)", (batch_id, json.dumps(doc, sort_keys=True), doc["manifest_sha256"], payload["source_adapter"], payload["schema_contract_version"], payload["created_at"]))
            self.db.executemany("insert into batch_partition values (?, ?, ?, ?, ?, ?, ?)", [(batch_id, *(b[k] for k in ("topic", "partition", "watermark_low", "watermark_high", "interval_object_count", "interval_input_bytes"))) for b in payload["partitions"]])
            self.db.executemany("insert into batch_object values (?, ?, ?, ?)", [(batch_id, o["object_key"], o["size_bytes"], o["storage_etag"]) for o in payload["objects"]])
            for t in payload.get("source_control", {}).get("transactions", ()):
                self.db.execute("insert into source_transaction values (?, ?, ?, ?, ?, ?)", (batch_id, *(t.get(k) for k in ("source_txid", "expected_event_count", "observed_event_count", "source_boundary_position", "status"))))
            return doc

    def start(self, batch_id: str, run_id: str) -> int:
        """A new attempt's number.  Only the batch that was published last may be replayed, which leaves its state."""
        with self._transaction():
            again = self._one("select batch_id, attempt_number from attempt where run_id = ?", run_id)
            if again:
                if again["batch_id"] != batch_id:
                    raise ControlError(f"run {run_id} belongs to {again['batch_id']}")
                return again["attempt_number"]
            state = self.batch(batch_id)["state"]
            if state == "PUBLISHED":
                last = self._one("select batch_id from batch where state = 'PUBLISHED' order by published_at desc, rowid desc limit 1")[0]
                if last != batch_id or self._one(f"select 1 from batch where state in {UNFINISHED!r}"):
                    raise ControlError("only the latest published batch can be replayed")
            else:
                self._move(batch_id, "RUNNING")
            n = self._one("select coalesce(max(attempt_number), 0) + 1 from attempt where batch_id = ?", batch_id)[0]
            self.db.execute("insert into attempt values (?, ?, ?, 'RUNNING', ?, null, null)", (batch_id, n, run_id, _now()))
            return n

    def _running(self, batch_id: str, run_id: str) -> sqlite3.Row:
        row = self._one("select * from attempt where batch_id = ? and run_id = ?", batch_id, run_id)
        if row is None or row["state"] != "RUNNING":
            raise ControlError(f"no running attempt of {batch_id} by {run_id}")
        return row

    def record_task(self, batch_id: str, run_id: str, task: str, sha256: str, details: Mapping | None = None, audit: Mapping | None = None) -> None:
        """Evidence that a task succeeded; the last task brings the audit.  The same evidence again is fine, other evidence is not."""
        if task not in TASKS:
            raise ControlError(f"unknown task {task}")
        with self._transaction():
            a = self._running(batch_id, run_id)
            if sha256 != self.batch(batch_id)["manifest_sha256"]:
                raise ControlError("the task worked on another manifest")
            if task == TASKS[-1]:
                if audit is None:
                    raise ControlError("the last task needs audit evidence")
                M.validate_audit(audit, batch_id, a["attempt_number"], run_id, sha256)
                digest = M.checksum(audit)
                for r in audit["rules"]:
                    row = (batch_id, a["attempt_number"], *(r[k] for k in ("rule_id", "object_name", "expected_value", "observed_value", "difference", "status")), digest)
                    self.db.execute("insert into audit_result values (?, ?, ?, ?, ?, ?, ?, ?, ?) on conflict do nothing", row)
                    kept = self._one("select * from audit_result where batch_id = ? and attempt_number = ? and rule_id = ? and object_name = ?", *row[:4])
                    if tuple(kept) != row:
                        raise ControlError(f"evidence of {r['rule_id']} contradicts what is recorded")
            self.db.execute(
                "insert into task_evidence values (?, ?, ?, ?, ?, ?) on conflict (batch_id, attempt_number, task) do update set details = excluded.details, recorded_at = excluded.recorded_at",
                (batch_id, a["attempt_number"], task, sha256, json.dumps(details or {}, sort_keys=True), _now()),
            )
            failed = self._one("select count(*) from audit_result where batch_id = ? and attempt_number = ? and status = 'FAIL'", batch_id, a["attempt_number"])[0]
        if task == TASKS[-1] and failed:
            raise ControlError(f"{failed} audit rules failed")

    def publish(self, batch_id: str, run_id: str) -> None:
        """All tasks on one manifest and a clean audit make the batch's intervals public."""
        with self._transaction():
            a = self._running(batch_id, run_id)
            sha = self.batch(batch_id)["manifest_sha256"]
            done = {r["task"] for r in self.db.execute("select task from task_evidence where batch_id = ? and attempt_number = ? and manifest_sha256 = ?", (batch_id, a["attempt_number"], sha))}
            if done != set(TASKS):
                raise ControlError(f"tasks are missing: {sorted(set(TASKS) - done)}")
            checks, failed = self._one("select count(*), coalesce(sum(status = 'FAIL'), 0) from audit_result where batch_id = ? and attempt_number = ?", batch_id, a["attempt_number"])
            if not checks or failed:
                raise ControlError("the audit has not passed")
            if self.batch(batch_id)["state"] != "PUBLISHED":
                self._move(batch_id, "VALIDATED")
                for p in self.db.execute("select topic, partition, watermark_low, watermark_high from batch_partition where batch_id = ? and watermark_high > watermark_low", (batch_id,)).fetchall():
                    clash = self._one("select batch_id from published_interval where topic = ? and partition = ? and watermark_low < ? and ? < watermark_high", p["topic"], p["partition"], p["watermark_high"], p["watermark_low"])
                    if clash:
                        raise ControlError(f"interval of {p['topic']}/{p['partition']} overlaps batch {clash[0]}")
                    self.db.execute("insert into published_interval values (?, ?, ?, ?, ?)", (batch_id, *tuple(p)))
                self._move(batch_id, "PUBLISHED")
            self.db.execute("update attempt set state = 'SUCCEEDED', finished_at = ? where batch_id = ? and attempt_number = ?", (_now(), batch_id, a["attempt_number"]))

    def fail(self, run_id: str, error: str) -> None:
        with self._transaction():
            a = self._one("select * from attempt where run_id = ?", run_id)
            if a is None or a["state"] != "RUNNING":
                return
            self.db.execute("update attempt set state = 'FAILED', finished_at = ?, error = ? where run_id = ?", (_now(), error[:2000], run_id))
            if self.batch(a["batch_id"])["state"] == "RUNNING":
                self._move(a["batch_id"], "FAILED")

    def supersede(self, batch_id: str) -> None:
        with self._transaction():
            self._move(batch_id, "SUPERSEDED")

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        """A control table or the view batch_history as a DataFrame, to join with vault and marts."""
        if table == "batch_history":
            batches = self.frame(spark, "batch").select("batch_id", "state", "manifest_sha256", "created_at", "published_at")
            return batch_history(batches, self.frame(spark, "batch_partition"), self.frame(spark, "attempt"))
        if table not in TABLES:
            raise ControlError(f"unknown table {table}")
        info = self.db.execute(f"pragma table_info({table})").fetchall()
        kinds = {"INTEGER": "long"}
        schema = ", ".join(f"{c['name']} {kinds.get(c['type'].upper(), 'string')}" for c in info)
        return spark.createDataFrame([tuple(r) for r in self.db.execute(f"select * from {table}")], schema)
