"""Column functions: hash contracts, key validity, CDC temporals, bands, masks, JSON images.

All are built-in expressions, so they stay inside generated code and push through projections.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash contracts.
DELIMITER = "||"
NULL_TOKEN = "^^"

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
#: Upper bounds (exclusive) and names of the age bands, then the name of the rest.
AGE_BANDS = ((18, "UNDER_18"), (25, "18_24"), (35, "25_34"), (45, "35_44"), (55, "45_54"), (65, "55_64"))
AGE_REST, AGE_UNKNOWN = "65_PLUS", "UNKNOWN"


_plain: ContextVar[bool] = ContextVar("plain", default=False)


@contextmanager
def plain_log() -> Iterator[None]:
    """Frames that are built inside take keys as the texts that are hashed elsewhere, and images as a column a field (after_status_code), not as JSON.

    Such keys are equal where hashes are.  For results that hold no hash: plans are then made of a source's own columns, so
    that those not needed are never made, and rows that lie by a business key lie by the key that is made of it.
    """
    token = _plain.set(True)
    try:
        yield
    finally:
        _plain.reset(token)


def is_plain() -> bool:
    return _plain.get()


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(c: Column | str) -> Column:
    """Text, trimmed and in upper case; the null token for null or blank."""
    text = F.upper(F.trim(as_column(c).cast("string")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(NULL_TOKEN)).otherwise(text)


def digest(namespace: str, *cols: Column | str) -> Column:
    """The hash key of values that are canonical already."""
    if is_plain():
        return as_column(cols[0]) if len(cols) == 1 else F.concat_ws(DELIMITER, *cols)
    return F.sha2(F.concat_ws(DELIMITER, F.lit(namespace), *cols), 256)


def hash_key(namespace: str, *cols: Column | str) -> Column:
    """SHA-256 (lower-case hex) of the namespace and the canonical values."""
    return digest(namespace, *[canonical(c) for c in cols])


def plain_hash(*cols: Column | str) -> Column:
    """SHA-256 of the values as text; the null token for null only."""
    return F.sha2(F.concat_ws(DELIMITER, *[F.coalesce(as_column(c).cast("string"), F.lit(NULL_TOKEN)) for c in cols]), 256)


def valid_key(*cols: Column | str) -> Column:
    """Whether every business key is neither null nor blank."""
    return reduce(and_, [F.coalesce(F.trim(as_column(c).cast("string")) != "", F.lit(False)) for c in cols])


def filled(c: Column | str) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(as_column(c)), F.lit(""))


def cdc_timestamp(c: Column | str) -> Column:
    """ISO-8601 text to timestamp; blank is null, garbage raises."""
    return filled(c).cast("timestamp")


def cdc_date(c: Column | str) -> Column:
    """ISO date text, with or without a trailing Z or a time part, to date; null if neither reading works."""
    text = filled(c)
    plain = F.regexp_replace(text, "Z$", "")
    return F.coalesce(plain.try_cast("date"), text.try_cast("timestamp").cast("date"))


def full_years(since: Column | str, until: Column | str) -> Column:
    """Complete years between two dates (29 February counts as reached on 1 March)."""
    return F.timestamp_diff("YEAR", as_column(since), as_column(until)).cast("int")


def month_years(since: Column | str, until: Column | str) -> Column:
    """Years by month distance: twelfths of months_between, rounded down."""
    return F.floor(F.months_between(as_column(until), as_column(since)) / 12).cast("int")


def banded(value: Column | str, bounds, rest: str, unknown: str) -> Column:
    value = as_column(value)
    out = F.when(value.isNull(), unknown)
    for top, name in bounds:
        out = out.when(value < top, name)
    return out.otherwise(rest)


def age_band(years: Column | str) -> Column:
    return banded(years, AGE_BANDS, AGE_REST, AGE_UNKNOWN)


def risk_band(score: Column | str) -> Column:
    score = as_column(score)
    return F.when(score >= 80, "high").when(score >= 50, "medium").when(score.isNotNull(), "low").otherwise("unknown")


def valid_email(c: Column | str) -> Column:
    """The value if it looks like an address, else null."""
    c = as_column(c)
    return F.when(c.rlike(EMAIL), c)


def comma_number(c: Column | str) -> Column:
    """Double from text whose commas count as points; null if that is no number."""
    return F.regexp_replace(as_column(c).cast("string"), ",", ".").try_cast("double")


def keep_last_4(c: Column | str) -> Column:
    c = as_column(c)
    return F.lpad(F.substring(c, -4, 4), F.length(c), "*")


def keep_first(c: Column | str) -> Column:
    c = as_column(c)
    return F.rpad(F.substring(c, 1, 1), F.length(c), "*")


def year_only(c: Column | str) -> Column:
    return F.concat(F.substring(as_column(c).cast("string"), 1, 4), F.lit("-01-01"))


def image_field(field: str, image: Column | str = "after") -> Column:
    """A field of a raw JSON row image."""
    if is_plain():
        return F.col(f"{image}_{field}")
    return F.get_json_object(as_column(image), f"$.{field}")


def change_field(field: str, after: Column | str = "after", before: Column | str = "before") -> Column:
    """A field of the after image, else of the before image."""
    return F.coalesce(image_field(field, after), image_field(field, before))


def canonical_json_object(c: Column | str) -> Column:
    """A flat JSON object with its entries in order of their names."""
    entries = F.map_entries(F.from_json(as_column(c), "map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def ratio_percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * part, whole.cast("double")), 2)
