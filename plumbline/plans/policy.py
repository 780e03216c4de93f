"""Rule algebra over findings: selection, severity overrides, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error")


def overridden(findings: DataFrame, severity: dict[str, str]) -> DataFrame:
    """Findings with severities replaced by check; ``metadata`` (a JSON text) keeps the original one."""
    if not severity:
        return findings
    new = F.coalesce(*[F.when(F.col("check_name") == k, F.lit(v)) for k, v in severity.items()])
    inner = F.expr("substring(metadata, 2, length(metadata) - 2)")
    kept = F.concat(F.lit("{"), inner, F.when(inner != "", F.lit(",")).otherwise(F.lit("")), F.lit('"original_severity":"'), F.col("severity"), F.lit('"}'))
    changed = new.isNotNull() & (new != F.col("severity"))
    return findings.withColumn("metadata", F.when(changed, kept).otherwise(F.col("metadata"))).withColumn("severity", F.coalesce(new, F.col("severity")))


def should_fail(counts: dict[str, int], fail_on: str) -> bool:
    """Whether counts by severity trip a gate: error, warning (or worse) or any."""
    at = {"error": 2, "warning": 1, "any": 0}[fail_on]
    return any(counts.get(s, 0) for s in SEVERITIES[at:])
