"""Amounts, durations, sizes and retry schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP status of each error type; 500 for all others.
STATUS = {
    "CONFIGURATION_ERROR": 500, "PRESET_NOT_FOUND": 400, "API_KEY_INVALID": 401, "FILE_NOT_FOUND": 404, "FILE_ACCESS_ERROR": 403, "FILE_WRITE_ERROR": 500,
    "API_REQUEST_FAILED": 502, "RATE_LIMIT_EXCEEDED": 429, "TIMEOUT_ERROR": 504, "VALIDATION_ERROR": 400, "INVALID_INPUT": 400, "SCHEMA_VALIDATION_FAILED": 400,
    "BUSINESS_RULE_VIOLATION": 422, "PROCESSING_ERROR": 500, "SECURITY_VIOLATION": 403, "UNAUTHORIZED_ACCESS": 401, "SYSTEM_ERROR": 500, "UNKNOWN_ERROR": 500,
}
#: Currency signs.
CURRENCY = {"€": "EUR", "$": "USD", "£": "GBP"}


def half_up(x: Column, places: int = 0) -> Column:
    """Rounded half up by flooring, alike in every engine."""
    scale = 10**places
    return F.floor(x * scale + 0.5) / scale


def card_salary(text: Column) -> Column:
    """Struct of ``min``, ``max`` (-1 where missing or zero) and ``currency`` from a text such as ``$65,000 - $90,000``."""
    found = F.regexp_extract_all(text, F.lit("([0-9,.]+)"), 1)
    amount = lambda k: F.regexp_extract(F.regexp_replace(F.get(found, F.lit(k)), ",", ""), r"^(\d*\.?\d+|\d+)", 1).try_cast("double")
    value = lambda k: F.coalesce(F.when(amount(k) > 0, amount(k)), F.lit(-1.0))
    sign = F.substring(F.trim(text), 1, 1)
    code = F.lit("")
    for s, c in CURRENCY.items():
        code = F.when(sign == s, c).otherwise(code)
    return F.struct(value(0).alias("min"), value(1).alias("max"), F.coalesce(code, F.lit("")).alias("currency"))


def text_salary(text: Column) -> Column:
    """Mean of all lower and of all upper amounts in a text, rounded half up; null without a number."""
    pattern = F.lit(r"(\d+(?:,\d+)?)(?:\s*-\s*(\d+(?:,\d+)?))?")
    low = F.regexp_extract_all(text, pattern, 1)
    high = F.zip_with(low, F.regexp_extract_all(text, pattern, 2), lambda a, b: F.when(b == "", a).otherwise(b))
    mean = lambda xs: half_up(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.regexp_replace(x, ",", "").cast("double")) / F.size(xs)).cast("long")
    return F.when(F.size(low) > 0, F.struct(mean(low).alias("min"), mean(high).alias("max"), F.lit("USD").alias("currency")))


def compensation(salary_range: Column, low: Column, high: Column, currency: Column, remote: Column) -> Column:
    amount = F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), low.cast("long").cast("string"), F.lit(" - "), high.cast("long").cast("string"))
    text = F.coalesce(F.nullif(salary_range, F.lit("")), F.when((low > 0) & (high > 0), F.trim(amount)), F.lit("Not specified"))
    return F.concat(text, F.when(remote, " (Remote OK)").otherwise(""))


def format_duration(ms: Column) -> Column:
    seconds = F.floor(ms / 1000).cast("long")
    minutes = F.floor(seconds / 60).cast("long")
    rest, millis = seconds % 60, (ms % 1000).cast("long")
    return F.concat_ws(
        " ",
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"))),
        F.when((rest > 0) | (minutes == 0), F.concat(rest.cast("string"), F.lit("s"))),
        F.when((millis > 0) & (minutes == 0) & (rest == 0), F.concat(millis.cast("string"), F.lit("ms"))),
    )


def format_bytes(size: Column) -> Column:
    value, unit = size.cast("double"), F.lit("GB")
    for power, name in ((2, "MB"), (1, "KB"), (0, "B")):
        unit = F.when(size < 1024 ** (power + 1), name).otherwise(unit)
    for power in (1, 2, 3):
        value = F.when(size >= 1024**power, size / 1024**power).otherwise(value)
    return F.concat(F.format_string("%.2f", half_up(value, 2)), F.lit(" "), unit)


def format_date(ts: Column, style: str = "date") -> Column:
    """Styles: ``stamp`` (20240131_235959), ``time`` (2024-01-31 23:59:59) and ``date``."""
    return F.date_format(ts, {"stamp": "yyyyMMdd_HHmmss", "time": "yyyy-MM-dd HH:mm:ss"}.get(style, "yyyy-MM-dd"))


def to_utc_date(c: Column, now: Column) -> Column:
    """``yyyy-mm-dd`` as an ISO instant of that midnight; ``now`` (a timestamp) where missing or empty, null where it is no date."""
    day = F.try_to_timestamp(F.nullif(c, F.lit("")), F.lit("yyyy-M-d"))
    at = F.when(F.length(c) > 0, day).otherwise(now)
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def backoff(attempt: Column, base: float = 1000, factor: float = 2, most: float = 30000) -> Column:
    """Milliseconds before an attempt, counted from 0."""
    return F.least(base * F.pow(F.lit(float(factor)), attempt), F.lit(float(most)))


def is_retryable(status: Column) -> Column:
    return (status >= 500) | status.isin(408, 429)


def error_status(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(500))


def preferred(*columns: Column) -> Column:
    """Command line, then preset, then default: the first that is not null."""
    return F.coalesce(*columns)
