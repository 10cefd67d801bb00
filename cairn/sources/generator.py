"""Deterministic inputs: dirty batch tables, and a workload of change events with scenarios.

Batch tables come from spark.range and hashes of the row number, so any size is made in parallel and twice alike.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.schemas import ENVELOPE

DIRTY_SHARE = 0.25


def _draw(seed: int, tag: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), F.col("id")), F.lit(n)).cast("int")


def _pick(seed: int, tag: str, values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values.split()]), _draw(seed, tag, len(values.split())) + 1)


def _day(seed: int, tag: str, first: str, days: int) -> Column:
    return F.date_format(F.date_add(F.lit(first).cast("date"), _draw(seed, tag, days)), "yyyy-MM-dd")


def _clock(seed: int, tag: str, first: str, days: int) -> Column:
    seconds = F.unix_timestamp(F.lit(first).cast("timestamp")) + _draw(seed, tag, days * 86400)
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _id(prefix: str, c: Column | str = "id") -> Column:
    return F.format_string(prefix + "-%08d", F.col(c) if isinstance(c, str) else c)


def batch_table(spark: SparkSession, name: str, rows: int = 10_000, seed: int = 42, sizes: dict[str, int] | None = None) -> DataFrame:
    """customers, accounts, merchants or transactions; the first quarter of the rows has one damaged field each."""
    sizes = sizes or {}
    ref = lambda table, prefix, tag: _id(prefix, _draw(seed, tag, sizes.get(table, rows)).cast("long"))
    d, p = (lambda t, n: _draw(seed, name + t, n)), (lambda t, v: _pick(seed, name + t, v))
    specs: dict[str, dict[str, Column]] = {
        "customers": {
            "customer_id": _id("CUS"), "first_name": p("f", "Ada Alan Grace Edsger Barbara Donald"), "last_name": p("l", "North South East West Hill Lake"),
            "email": F.concat(F.lit("user"), F.col("id"), F.lit("@example.com")), "phone_number": F.format_string("+9055%08d", d("p", 10**8)), "date_of_birth": _day(seed, "dob", "1950-01-01", 20000),
            "city": p("c", "Ankara Izmir Bursa Konya"), "country": F.lit("TR"), "customer_segment": p("s", "mass affluent private"), "created_at": _clock(seed, "cc", "2020-01-01", 1500),
        },
        "accounts": {
            "account_id": _id("ACC"), "customer_id": ref("customers", "CUS", "ac"), "account_type": p("t", "checking savings credit"), "account_status": p("s", "active closed frozen"), "card_network": p("n", "visa mastercard troy"),
            "masked_card_number": F.format_string("**** **** **** %04d", d("m", 10**4)), "credit_limit": F.format_string("%.2f", d("cl", 10**6) / 100), "opened_at": _clock(seed, "ao", "2020-01-01", 1500),
        },
        "merchants": {
            "merchant_id": _id("MER"), "merchant_name": F.concat(F.lit("Shop "), F.col("id")), "merchant_category": p("c", "grocery travel fuel books"), "city": p("y", "Ankara Izmir Bursa Konya"), "country": F.lit("TR"),
            "onboarded_at": _clock(seed, "mo", "2019-01-01", 1500), "risk_score": d("r", 101).cast("string"),
        },
        "transactions": {
            "transaction_id": _id("TRX"), "account_id": ref("accounts", "ACC", "ta"), "customer_id": _id("CUS", F.pmod(F.xxhash64(F.lit(seed), F.lit("ac"), _draw(seed, "ta", sizes.get("accounts", rows)).cast("long")), F.lit(sizes.get("customers", rows))).cast("int").cast("long")),
            "merchant_id": ref("merchants", "MER", "tm"), "amount": F.format_string("%.2f", (d("a", 10**6) + 1) / 100), "currency": p("u", "TRY USD EUR"), "transaction_status": p("s", "approved declined reversed"),
            "transaction_channel": p("h", "pos web atm"), "transaction_timestamp": _clock(seed, "tt", "2024-01-01", 365),
        },
    }
    damage = {
        "customers": {"customer_id": None, "email": "no-at-sign", "date_of_birth": "31-31-2024"},
        "accounts": {"account_id": None, "customer_id": None, "credit_limit": "a lot", "opened_at": "yesterday-ish"},
        "merchants": {"merchant_id": None, "onboarded_at": "soon", "risk_score": "high"},
        "transactions": {"transaction_id": None, "account_id": None, "customer_id": None, "merchant_id": None, "amount": "1,234.5", "transaction_timestamp": "noon"},
    }[name]
    which = _draw(seed, name + "damage", len(damage))
    cols = specs[name]
    for i, (c, bad) in enumerate(damage.items()):
        cols[c] = F.when((F.col("id") < int(rows * DIRTY_SHARE)) & (which == i), F.lit(bad)).otherwise(cols[c])
    return spark.range(rows).select(*[c.cast("string").alias(n) for n, c in cols.items()])


class Workload:
    """Change events in order, as envelopes with their coordinates; every call appends."""

    def __init__(self, base: str = "2026-01-15T00:00:00", source: str = "core_banking"):
        self.now, self.source, self.events = datetime.fromisoformat(base), source, []
        self.offsets: dict[str, int] = {}
        self.lsn = 1000
        self.txid = 100
        #: What the source says it committed: event_key, expected_count, txid, lsn_position.
        self.ledger: list[tuple[str, int, int, int]] = []
        self._committed = 0

    def emit(self, table: str, op: str, key: dict, after: dict | None, before: dict | None = None, **override) -> dict:
        """One event of schema.table; override sets envelope metadata."""
        schema, name = table.split(".")
        topic = f"bank.core.{table}"
        offset = self.offsets.get(topic, -1) + 1
        self.offsets[topic] = offset
        self.lsn += 10
        self.now += timedelta(seconds=1)
        ms = int((self.now - datetime(1970, 1, 1)).total_seconds() * 1000)
        dump = lambda x: None if x is None else json.dumps(x)
        value = None if op == "tombstone" else (dump(before), dump(after), op, (schema, name, ms, self.lsn, self.txid), None)
        stamp = self.now.isoformat(timespec="milliseconds") + "Z"
        meta = {
            "event_id": hashlib.sha256(f"{topic}:0:{offset}".encode()).hexdigest(), "source_system": self.source, "source_schema": schema, "source_table": name, "operation": op, "kafka_topic": topic,
            "kafka_partition": 0, "kafka_offset": offset, "kafka_timestamp_ms": ms, "event_timestamp": stamp, "ingested_at": stamp,
            "payload_sha256": hashlib.sha256(json.dumps([key, after, before, op]).encode()).hexdigest(), "consumer_group": "cairn",
            "object_key": f"bronze/cdc/source={self.source}/schema={schema}/table={name}/event_date={stamp[:10]}/topic={topic}/partition=0/offset={offset:020d}.json",
        } | override
        event = (tuple(meta[f.name] for f in ENVELOPE["_metadata"].dataType), dump(key), value)
        self.events.append(event)
        return meta

    def commit(self, event_key: str = "snapshot") -> None:
        """End the transaction: its events and last position go to the ledger with it."""
        self.ledger.append((event_key, len(self.events) - self._committed, self.txid, self.lsn))
        self._committed = len(self.events)
        self.txid += 1

    def ledger_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.ledger, "event_key string, expected_count long, txid long, lsn_position long")

    def stamps(self) -> dict:
        t = self.now.isoformat() + "Z"
        return {"created_at": t, "updated_at": t}

    def snapshot(self, customers: int = 100, applications: int = 40) -> None:
        """Reference data, customers (every tenth a company), applications, and a loan for each approved application."""
        for code, name in (("TRY", "Turkish Lira"), ("USD", "US Dollar"), ("EUR", "Euro")):
            self.emit("prm.currencies", "r", {"currency_code": code}, {"currency_code": code, "currency_name": name, "minor_unit": 2, "is_active": True} | self.stamps())
        for i, (code, name, city) in enumerate((("IST001", "Istanbul Main", "Istanbul"), ("ANK001", "Ankara Main", "Ankara"), ("IZM001", "Izmir Main", "Izmir")), 1):
            self.emit("prm.branches", "r", {"branch_id": i}, {"branch_id": i, "branch_code": code, "branch_name": name, "city": city, "is_active": True} | self.stamps())
        for i, (code, kind) in enumerate((("PL-CONSUMER", "CONSUMER"), ("PL-MORTGAGE", "MORTGAGE"), ("PL-SME", "SME")), 1):
            self.emit("prm.products", "r", {"product_id": i}, {"product_id": i, "product_code": code, "product_name": code.title(), "product_type": kind, "default_currency_code": "TRY", "is_active": True} | self.stamps())
        for i in range(1, customers + 1):
            self.emit("mms.customers", "r", {"customer_id": i}, self.customer(i))
        for i in range(1, applications + 1):
            row = self.application(i, customers)
            self.emit("krd.loan_applications", "r", {"application_id": i}, row)
            if row["status_code"] == "APPROVED":
                self.emit("krd.loans", "r", {"loan_id": i}, self.loan(i, row))
        self.commit()

    def customer(self, i: int, **change) -> dict:
        company = i % 10 == 0
        return {
            "customer_id": i, "customer_no": f"C{i:08d}", "customer_type": "CORPORATE" if company else "INDIVIDUAL", "first_name": None if company else f"First{i}", "last_name": None if company else f"Last{i}",
            "legal_name": f"Company {i}" if company else None, "national_id": None if company else f"{10000000000 + i}", "tax_id": f"{1000000000 + i}" if company else None,
            "date_of_birth": None if company else f"{1960 + i % 45}-0{1 + i % 9}-15Z", "segment_code": ("MASS", "AFFLUENT", "SME")[i % 3], "status_code": "ACTIVE", "home_branch_code": ("IST001", "ANK001", "IZM001")[i % 3],
        } | self.stamps() | change

    def application(self, i: int, customers: int = 100, **change) -> dict:
        status = "REJECTED" if i % 5 == 0 else "PENDING" if i % 4 == 0 else "APPROVED"
        applied = self.now.isoformat() + "Z"
        decided = None if status == "PENDING" else (self.now + timedelta(hours=24 + i)).isoformat() + "Z"
        return {
            "application_id": i, "application_no": f"A{i:08d}", "customer_no": f"C{1 + (i - 1) % customers:08d}", "product_code": ("PL-CONSUMER", "PL-MORTGAGE", "PL-SME")[i % 3], "branch_code": ("IST001", "ANK001", "IZM001")[i % 3],
            "requested_amount": f"{25000 + 2750 * i}.00", "currency_code": ("TRY", "USD", "EUR")[i % 3], "term_months": 12 + i % 24, "status_code": status, "applied_at": applied, "decision_at": decided,
        } | self.stamps() | change

    def loan(self, i: int, application: dict, **change) -> dict:
        keep = {k: application[k] for k in ("application_id", "customer_no", "product_code", "branch_code", "currency_code", "term_months")}
        return {"loan_id": i, "loan_no": f"L{i:08d}", **keep, "principal_amount": application["requested_amount"], "annual_interest_rate": "0.250000", "status_code": ("ACTIVE", "DELINQUENT", "CLOSED")[i % 3], "disbursed_at": application["decision_at"], "maturity_date": "2029-01-05Z"} | self.stamps() | change

    def installment(self, i: int, loan_id: int, **change) -> dict:
        return {"installment_id": i, "loan_id": loan_id, "installment_no": 1, "due_date": "2026-03-01Z", "principal_amount": "1000.00", "interest_amount": "250.00", "paid_amount": "0.00", "status_code": "PENDING", "paid_at": None} | self.stamps() | change

    def changes(self) -> None:
        """Five transactions after a snapshot: a customer's move, a contact's end, an approval, a missed instalment, a new rate."""
        address = {"address_id": 1, "customer_id": 1, "address_type": "HOME", "address_line": "Street 1", "city": "Istanbul", "is_primary": True, "valid_from": "2026-01-15Z", "valid_to": None}
        self.emit("mms.customers", "u", {"customer_id": 1}, self.customer(1, status_code="PASSIVE", segment_code="REVIEW_REQUIRED"), self.customer(1))
        self.emit("mms.customer_addresses", "u", {"address_id": 1}, address | {"is_primary": False, "valid_to": "2026-01-15Z"} | self.stamps(), address | self.stamps())
        self.emit("mms.customer_addresses", "c", {"address_id": 2}, address | {"address_id": 2, "address_line": "Street 2", "valid_from": "2026-01-16Z"} | self.stamps())
        self.commit("customer_address_status_change")
        contact = {"contact_id": 2, "customer_id": 1, "contact_type": "PHONE", "contact_value": "+905550000001", "is_primary": False, "is_verified": True}
        self.emit("mms.customer_contacts", "d", {"contact_id": 2}, None, contact | self.stamps())
        self.commit("secondary_contact_delete")
        before = self.application(4)
        approved = before | {"status_code": "APPROVED", "decision_at": (self.now + timedelta(hours=30)).isoformat() + "Z"} | self.stamps()
        self.emit("krd.loan_applications", "u", {"application_id": 4}, approved, before)
        self.emit("krd.loans", "c", {"loan_id": 4}, self.loan(4, approved, status_code="ACTIVE"))
        for k in (41, 42):
            self.emit("krd.installments", "c", {"installment_id": k}, self.installment(k, 4))
        self.commit("loan_application_approval")
        self.emit("krd.installments", "u", {"installment_id": 41}, self.installment(41, 4, status_code="PAID", paid_amount="1250.00", paid_at=self.now.isoformat() + "Z"))
        self.emit("krd.installments", "u", {"installment_id": 42}, self.installment(42, 4, status_code="OVERDUE"))
        self.emit("krd.loans", "u", {"loan_id": 4}, self.loan(4, approved, status_code="DELINQUENT"))
        self.commit("installment_payment_and_delinquency")
        rate = {"rate_parameter_id": 1, "product_code": "PL-CONSUMER", "rate_type": "BASE", "annual_rate": "0.250000", "effective_from": "2026-01-01Z", "effective_to": None}
        self.emit("prm.rate_parameters", "u", {"rate_parameter_id": 1}, rate | {"effective_to": "2026-01-16Z"} | self.stamps(), rate | self.stamps())
        self.emit("prm.rate_parameters", "c", {"rate_parameter_id": 4}, rate | {"rate_parameter_id": 4, "annual_rate": "0.275000", "effective_from": "2026-01-17Z"} | self.stamps())
        self.commit("base_rate_change")

    def current_state(self, step: str) -> None:
        """One step of a life cycle: setup, delete, recreate a customer; relation-b, relation-a move an application's branch and back."""
        gone, stays = self.customer(901, customer_no="LIFECYCLE"), self.customer(902, customer_no="RELATION")
        app = self.application(901, customer_no="RELATION", application_no="RELATION-1", branch_code="IST001", status_code="PENDING", decision_at=None)
        if step == "setup":
            self.emit("mms.customers", "c", {"customer_id": 901}, gone)
            self.emit("mms.customers", "c", {"customer_id": 902}, stays)
            self.emit("krd.loan_applications", "c", {"application_id": 901}, app)
        elif step == "delete":
            self.emit("mms.customers", "d", {"customer_id": 901}, None, gone)
        elif step == "recreate":
            self.emit("mms.customers", "c", {"customer_id": 903}, gone | {"customer_id": 903, "last_name": "Recreated"})
        elif step in ("relation-b", "relation-a"):
            a, b = ("IST001", "ANK001") if step == "relation-b" else ("ANK001", "IST001")
            self.emit("krd.loan_applications", "u", {"application_id": 901}, app | {"branch_code": b}, app | {"branch_code": a})
        else:
            raise ValueError(f"unknown step {step}")
        self.commit(step)

    def frame(self, spark: SparkSession, events: Iterable | None = None) -> DataFrame:
        return spark.createDataFrame(list(self.events if events is None else events), ENVELOPE)
