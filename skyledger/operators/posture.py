"""Compliance posture: latest state per rule and resource, pass rates, drift and rule coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import percent
from skyledger.functions.joins import checked_broadcast
from skyledger.functions.ordered import with_previous


def posture_latest(findings: DataFrame, keep: list[str], tie: list[str]) -> DataFrame:
    """The latest finding of each rule on each resource; a map-side combined maximum, not a sort."""
    latest = F.max_by(F.struct("ts", *keep), F.struct("ts", *tie))
    return findings.groupBy("rule_id", "resource_id").agg(latest.alias("f")).select("rule_id", "resource_id", "f.*")


def posture_score(latest: DataFrame, levels: list[str]) -> DataFrame:
    """Passed, failed and pass rate for each level of the hierarchy and in total."""
    out = latest.rollup(*levels).agg(
        F.count_if(F.col("evaluation") == "passed").alias("passed"), F.count_if(F.col("evaluation") == "failed").alias("failed"),
        F.grouping_id().alias("level"),
    )
    return out.withColumn("pass_rate", percent(F.col("passed"), F.col("passed") + F.col("failed")))


def posture_rule_join(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with their rule's metadata."""
    return findings.join(checked_broadcast(rules), "rule_id", "left")


def rules_never_evaluated(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Rules without a single finding."""
    return rules.join(findings.select("rule_id").distinct(), "rule_id", "left_anti")


def posture_drift(findings: DataFrame, tie: list[str]) -> DataFrame:
    """Changes from passed to failed of a rule on a resource."""
    seen = with_previous(findings, ["rule_id", "resource_id"], "ts", ["evaluation", "ts"], tie, chunk_seconds=30 * 86400)
    turned = (F.col("prev_evaluation") == "passed") & (F.col("evaluation") == "failed")
    return seen.filter(turned).select("rule_id", "resource_id", F.col("prev_ts").alias("passed_at"), F.col("ts").alias("failed_at"))


# Event provider by posture type.
PROVIDERS = {"cspm": "elastic_cspm", "kspm": "elastic_kspm"}


def finding_map(findings: DataFrame) -> DataFrame:
    """Evaluation as outcome and level, posture type as provider."""
    failed = F.col("evaluation") == "failed"
    return findings.withColumns({
        "outcome": F.when(failed, "failure").otherwise("success"),
        "level": F.when(failed, "warn").otherwise("info"),
        "provider": F.when(F.col("posture_type") == "cspm", PROVIDERS["cspm"]).otherwise(PROVIDERS["kspm"]),
    })
