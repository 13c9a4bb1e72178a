"""Reports as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluation_sections(passed: DataFrame, title: Column, company: Column, compensation: Column, confidence: Column, rationale: Column, url: Column, key: str) -> DataFrame:
    """One Markdown section for each listing that passed."""
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.coalesce(title, F.lit("Unknown")), F.lit(" at "), F.coalesce(company, F.lit("Unknown"))),
        F.concat(F.lit("- Compensation: "), compensation),
        F.concat(F.lit("- Confidence: "), F.floor(confidence * 100 + 0.5).cast("long").cast("string"), F.lit("%")),
        F.concat(F.lit("- Rationale: "), F.coalesce(rationale, F.lit(""))),
        F.concat(F.lit("- Link: "), F.coalesce(url, F.lit(""))),
    )
    return passed.select(key, text.alias("section"))


def totals_header(totals: DataFrame) -> DataFrame:
    """The head of the report from :func:`verdicts.judge_totals`."""
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    return totals.select(F.concat_ws("\n", F.lit("# Evaluation report"), line("Judged", "total"), line("Passed", "passed"), line("Failed", "failed"), line("Duplicates", "dupes"), line("Success", "success_percent")).alias("header"))


def metric_rows(summary: DataFrame) -> DataFrame:
    """A one-row summary as rows of ``metric`` and ``value``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in summary.columns])
    return summary.select(F.explode(pairs).alias("m")).select("m.*")


def as_csv(rows: DataFrame) -> DataFrame:
    """Lines of CSV; values with a comma, a quote or a line break are quoted."""
    return rows.select(csv_line(*rows.columns).alias("line"))


def csv_line(*columns: str) -> Column:
    def cell(name: str) -> Column:
        c = F.col(name).cast("string")
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))

    return F.concat_ws(",", *map(cell, columns))


#: The rows of an exported summary, by column.
SUMMARY_ROWS = (
    ("command", "Command"), ("session", "Session ID"), ("start", "Start Time"), ("end", "End Time"), ("duration", "Duration (ms)"),
    ("execution", "Total Execution Time (ms)"), ("memory_peak", "Peak Memory Usage (bytes)"), ("memory_mean", "Average Memory Usage (bytes)"), ("memory_delta", "Memory Delta (bytes)"),
    ("cpu", "CPU Time (ms)"), ("collections", "Garbage Collections"),
    ("operations", "Total Operations"), ("successful", "Successful Operations"), ("failed", "Failed Operations"), ("warnings", "Warnings"), ("success_rate", "Success Rate (%)"),
    ("files_opened", "Files Opened"), ("files_read", "Files Read"), ("files_written", "Files Written"), ("files_deleted", "Files Deleted"),
    ("connections", "Network Connections"), ("timeouts", "Network Timeouts"), ("network_retries", "Network Retries"),
    ("calls", "API Total Calls"), ("calls_ok", "API Successful Calls"), ("calls_failed", "API Failed Calls"), ("retries", "API Retries"), ("trips", "API Circuit Breaker Trips"),
    ("response_time", "API Average Response Time (ms)"), ("error_rate", "API Error Rate (%)"),
    ("records", "Records Processed"), ("filtered", "Records Filtered"), ("duplicates", "Duplicates Removed"), ("files", "Files Processed"),
)


def summary_rows(summary: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """All fixed rows of a one-row summary, 0 where it has no such column, then one for each ``category`` of ``errors`` (``n``); ``place`` is their order."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0")) if c in summary.columns else F.lit("0")
    fixed = F.array(*[F.struct(F.lit(k).cast("long").alias("place"), F.lit(label).alias("metric"), value(c).alias("value")) for k, (c, label) in enumerate(SUMMARY_ROWS)])
    out = summary.select(F.explode(fixed).alias("m")).select("m.*")
    if errors is not None:
        out = out.unionByName(errors.select(F.lit(len(SUMMARY_ROWS)).cast("long").alias("place"), F.concat(F.lit("Errors - "), F.col("category")).alias("metric"), F.col("n").cast("string").alias("value")))
    return out


def link_list(passed: DataFrame, title: Column, company: Column, url: Column, key: str) -> DataFrame:
    """One Markdown link for each listing that passed."""
    return passed.select(key, F.concat(F.lit("- ["), title, F.lit(" at "), company, F.lit("]("), url, F.lit(")")).alias("link"))


def as_markdown(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *rows.columns), F.lit(" |")).alias("line"))


def as_json(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("line"))


def first_errors(log: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` errors of the log."""
    return log.where("kind = 'error'").orderBy(order).limit(n)


def materials(parts: dict[str, Column]) -> Column:
    """A document of titled parts in a fixed order."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"# {name}\n"), F.coalesce(c, F.lit(""))) for name, c in parts.items()])
