"""Target stream names from vendor, index prefix and dataset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VENDOR_PREFIXES = ("aws.", "gcp.", "azure.")


def _cross_cloud(dataset: Column) -> Column:
    return ~dataset.rlike(r"^(aws|gcp|azure)\.")


def bulk_target(vendor: Column, prefix: Column, dataset: Column) -> Column:
    """Stream of a run's own dataset."""
    logs = F.concat(F.lit("logs-"), dataset, F.lit("-default"))
    named = lambda text: F.concat(prefix, F.lit("."), text, F.lit("-default"))
    aws = (
        F.when(dataset == "aws.xray", "traces-aws.xray-default")
        .when(dataset.startswith("aws."), named(F.regexp_replace(dataset, r"^aws\.", "")))
        .when(_cross_cloud(dataset), logs)
        .otherwise(named(dataset))
    )
    other = F.when(_cross_cloud(dataset), logs).otherwise(named(F.regexp_replace(dataset, r"^(gcp|azure)\.", "")))
    return F.when(vendor == "aws", aws).otherwise(other)


def document_target(vendor: Column, prefix: Column, tagged: Column) -> Column:
    """Stream of a row that names its own dataset: traces, fully qualified streams, then the vendor's rule."""
    logs = F.concat(F.lit("logs-"), tagged, F.lit("-default"))
    qualified = tagged.rlike("^(logs|metrics|traces)-")
    own_aws = (vendor == "aws") & tagged.startswith("aws.")
    return (
        F.when(tagged == "apm", "traces-apm-default")
        .when(qualified, F.concat(tagged, F.lit("-default")))
        .when(own_aws, bulk_target(vendor, prefix, tagged))
        .otherwise(logs)
    )


def route_target(vendor: Column, prefix: Column, dataset: Column, tagged: Column | None = None) -> Column:
    """The row's own tag decides when present, else the run's dataset."""
    own = bulk_target(vendor, prefix, dataset)
    return own if tagged is None else F.when(tagged.isNotNull(), document_target(vendor, prefix, tagged)).otherwise(own)


def o365_metrics_target(dataset: Column) -> Column:
    return F.concat(F.lit("metrics-o365_metrics."), F.regexp_replace(dataset, r"^o365_metrics\.", ""), F.lit("-default"))


def stream_parts(target: Column) -> dict[str, Column]:
    """Signal, dataset and namespace of a stream name."""
    return {
        "signal": F.regexp_extract(target, r"^([^-]+)-", 1),
        "dataset": F.regexp_extract(target, r"^[^-]+-(.+)-[^-]+$", 1),
        "namespace": F.regexp_extract(target, r"-([^-]+)$", 1),
    }
