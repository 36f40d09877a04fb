"""Redaction of secrets and personal data in text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, pattern, what stays of a match; applied in this order, each on what the ones before left.
PATTERNS = (
    ("sql_string_literal", r"'[^']*+(?:''[^']*+){0,500}'", ""),  # written so that the matcher needs no stack for long texts
    ("sql_numeric_param", r"(?i)((?:<=|>=|<>|!=|=|<|>|\bIN\b|\bBETWEEN\b|\bVALUES\b)\s*\(?\s*)-?\d+(?:\.\d+)?", "$1"),
    ("json_value_string", r'("[A-Za-z_][A-Za-z0-9_\-]{0,64}"\s*:\s*")[^"\\\n]{0,256}(?=")', "$1"),
    ("python_locals_block", r"(?i)(\b(?:kwargs|locals|vars|self|args)\s*=\s*\{)[^{}]{0,2048}(?=\})", "$1"),
    ("ipv4_address", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?![0-9.])", ""),
    # only the beginning of a run is tried, so a long run costs one pass
    ("email_address", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", ""),
)
SECRETS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", ""),
    ("bearer_token", r"(?i)(\bbearer\s+)[A-Za-z0-9._\-]{16,}", "$1"),
    ("assigned_secret", r"(?i)(\b(?:api[_-]?key|secret|password|passwd|token)\b\s*[:=]\s*[\"']?)[A-Za-z0-9_\-./+]{12,}", "$1"),
)


def redact(text: Column, patterns: Sequence[tuple[str, str, str]] = PATTERNS) -> Column:
    """The text with every match of the patterns replaced by its label. Null stays null."""
    for label, pattern, keep in patterns:
        text = F.regexp_replace(text, pattern, f"{keep}[REDACTED:{label}]")
    return text


def with_redaction(df: DataFrame, column: str, patterns: Sequence[tuple[str, str, str]] = PATTERNS) -> DataFrame:
    """``df`` with the column redacted and fired, a map of how often each pattern did, counted before it replaces."""
    out, counts = df.withColumn("__r", F.col(column)), []
    for i, (label, pattern, keep) in enumerate(patterns):
        out = out.withColumn(f"__n{i}", F.coalesce(F.regexp_count("__r", F.lit(pattern)), F.lit(0))).withColumn("__r", F.regexp_replace("__r", pattern, f"{keep}[REDACTED:{label}]"))
        counts += [F.lit(label), F.col(f"__n{i}")]
    fired = F.map_filter(F.create_map(*counts), lambda _, n: n > 0)
    return out.withColumn(column, F.col("__r")).withColumn("fired", fired).drop("__r", *(f"__n{i}" for i in range(len(patterns))))


def redaction_counts(df: DataFrame, column: str, by: Sequence[str], patterns: Sequence[tuple[str, str, str]] = PATTERNS) -> DataFrame:
    """by, pattern, n: how often each pattern fired."""
    rows = with_redaction(df, column, patterns)
    return rows.select(*by, F.explode("fired").alias("pattern", "c")).groupBy(*by, "pattern").agg(F.sum("c").alias("n"))
