"""Sinks: JSON lines, CSV exports with a manifest, write-once objects."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame

#: Tables that the report export writes.
EXPORTED = ("dim_customer_current", "dim_product_current", "dim_branch_current", "dim_currency_current", "fct_loan_applications_current", "fct_loans_current", "agg_customer_loan_portfolio")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_csv(tables: Mapping[str, DataFrame], folder: str) -> dict:
    """One CSV with a header for each table, and manifest.json with row counts and digests; the folder appears at once.

    Rows stream to the driver partition by partition, as an export is read from one file anyway.
    """
    os.makedirs(os.path.dirname(os.path.abspath(folder)), exist_ok=True)
    work = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(folder)))
    entries = {}
    try:
        for name, df in tables.items():
            path, digest, rows = os.path.join(work, f"{name}.csv"), hashlib.sha256(), 0
            with open(path, "wb") as f:
                lines = df.select([df[c].cast("string") for c in df.columns]).toLocalIterator(prefetchPartitions=True)
                for row in _csv([df.columns]):
                    f.write(row)
                    digest.update(row)
                for r in lines:
                    row = next(_csv([list(r)]))
                    f.write(row)
                    digest.update(row)
                    rows += 1
            entries[name] = {"file": f"{name}.csv", "rows": rows, "sha256": digest.hexdigest()}
        with open(os.path.join(work, "manifest.json"), "w") as f:
            json.dump({"tables": entries}, f, sort_keys=True, indent=1)
        if os.path.isdir(folder):
            shutil.rmtree(folder)
        os.replace(work, folder)
    except BaseException:
        shutil.rmtree(work, ignore_errors=True)
        raise
    return entries


def _csv(rows):
    for row in rows:
        yield (",".join('""' if v == "" else "" if v is None else '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v for v in row) + "\n").encode()
