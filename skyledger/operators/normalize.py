"""Log normalisation: raw cloud log rows to ECS columns.

Columns carry dotted ECS names (``event.action``) while steps run and are folded into structs by ``nest`` at the end.
A missing column and a NULL mean the same.  All steps are projections: one scan, no shuffle.  "Fill" never overwrites.

Working columns: ``message`` raw line, ``svc_group`` service group, ``vendor``, ``parsed`` the JSON object of the line as
text values, ``fields`` the service's own namespace, ``vendor_fields`` its copy under the vendor namespace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import fixed_values as fx
from skyledger.functions.columns import field, fill, ipv4_number, nest
from skyledger.functions.joins import checked_broadcast, lookup_map
from skyledger.session import scratch_path

_MAP = "map<string,string>"


def _parsed(df: DataFrame, key: str) -> Column:
    return F.try_element_at(field(df, "parsed", _MAP), F.lit(key))


def _set(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def set_ecs_version(df: DataFrame) -> DataFrame:
    return _set(df, {"ecs.version": F.lit(fx.ECS_VERSION_NORMALISED)})


def preserve_original(df: DataFrame) -> DataFrame:
    """The raw line moves to ``event.original``; ``message`` goes away."""
    return _set(df, {"event.original": fill(field(df, "event.original"), field(df, "message"))}).drop("message")


def parse_json(df: DataFrame) -> DataFrame:
    """Top-level JSON object of the line as a map of text values; NULL for any other line."""
    return _set(df, {"parsed": F.from_json(field(df, "event.original"), _MAP)})


def rename_first_wins(df: DataFrame, target: str, *sources: str) -> DataFrame:
    """Aliases among the parsed keys fill one target; the first non-null wins."""
    return _set(df, {target: fill(field(df, target), *[_parsed(df, s) for s in sources])})


def _extract(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def grok_log4j_fallback(df: DataFrame) -> DataFrame:
    """Log level of log4j lines, for groups that emit them and only where the line was no JSON."""
    text = field(df, "event.original")
    with_class = rf"{fx.ISO_TIMESTAMP}[,.]?(?:[+-]?[0-9]+)? ({fx.LOG_LEVEL}) \[.*?\] {fx.JAVA_CLASS}: "
    plain = rf"{fx.ISO_TIMESTAMP} ({fx.LOG_LEVEL}) "
    level = F.coalesce(_extract(text, with_class, 1), _extract(text, plain, 1))
    use = field(df, "parsed", _MAP).isNull() & field(df, "svc_group").isin(*fx.LOG4J_GROUPS)
    return _set(df, {"log.level": fill(field(df, "log.level"), F.when(use, level))})


def _entries(values: dict[str, Column]) -> Column:
    """Key and value pairs; the value of a pair may be NULL."""
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])


def _put_entries(df: DataFrame, entries: Column) -> DataFrame:
    """Fill keys of the service namespace from pairs; NULL pairs and keys already there change nothing."""
    have = field(df, "fields", _MAP)
    new = F.map_from_entries(F.filter(entries, lambda e: e.getField("value").isNotNull()))
    merged = F.map_concat(have, F.map_filter(new, lambda k, _: ~F.map_contains_key(have, k)))
    empty = F.create_map().cast(_MAP)
    return _set(df, {"fields": F.when(entries.isNull(), F.coalesce(have, empty)).when(F.coalesce(F.size(have), F.lit(0)) > 0, merged).otherwise(new)})


def put_fields(df: DataFrame, values: dict[str, Column], on: Column | None = None) -> DataFrame:
    """Fill keys of the service namespace; keys already there keep their value."""
    entries = _entries(values)
    return _put_entries(df, entries if on is None else F.when(on, entries))


LAMBDA_REPORT = (
    r"^REPORT RequestId: (.*?)\s+Duration: ([0-9.]+) ms\s+Billed Duration: ([0-9.]+) ms\s+"
    r"Memory Size: ([0-9]+) MB\s+Max Memory Used: ([0-9]+) MB$"
)
LAMBDA_START = r"^START RequestId: (.*?)\s+Version: (.*?)$"
LAMBDA_END = r"^END RequestId: (.*?)$"


def grok_lambda_report(df: DataFrame, on: Column | None = None) -> DataFrame:
    """REPORT / START / END lines of the function runtime, on all rows or those of one kind."""
    text = field(df, "event.original") if on is None else F.when(on, field(df, "event.original"))
    request = F.coalesce(_extract(text, LAMBDA_REPORT, 1), _extract(text, LAMBDA_START, 1), _extract(text, LAMBDA_END, 1))
    found = {
        "request_id": request,
        "version": _extract(text, LAMBDA_START, 2),
        "duration_ms": _extract(text, LAMBDA_REPORT, 2).try_cast("double"),
        "billed_duration_ms": _extract(text, LAMBDA_REPORT, 3).try_cast("double"),
        "memory_size_mb": _extract(text, LAMBDA_REPORT, 4).try_cast("int"),
        "max_memory_used_mb": _extract(text, LAMBDA_REPORT, 5).try_cast("int"),
    }
    return _set(df, {f"lambda.{k}": fill(field(df, f"lambda.{k}", t), v) for (k, v), t in zip(
        found.items(), ["string", "string", "double", "double", "int", "int"], strict=True)})


def lambda_billed_duration(df: DataFrame) -> DataFrame:
    """Billed milliseconds as ``event.duration`` in nanoseconds."""
    nanos = (field(df, "lambda.billed_duration_ms", "double") * 1_000_000).try_cast("bigint")
    return _set(df, {"event.duration": fill(field(df, "event.duration", "bigint"), nanos)})


def lambda_memory_pct(df: DataFrame) -> DataFrame:
    """Used share of the memory size in percent, two decimals."""
    size, used = field(df, "lambda.memory_size_mb", "int"), field(df, "lambda.max_memory_used_mb", "int")
    pct = F.floor(used * 10000.0 / size + 0.5) / 100.0
    return _set(df, {"lambda.memory_utilization_pct": F.when(size > 0, pct)})


def lambda_extract(df: DataFrame, on: Column | None = None) -> DataFrame:
    """Function runtime lines: parse, convert, and add to the service namespace."""
    out = lambda_memory_pct(lambda_billed_duration(grok_lambda_report(df, on)))
    names = ["request_id", "version", "duration_ms", "billed_duration_ms", "memory_size_mb", "max_memory_used_mb", "memory_utilization_pct"]
    return put_fields(out, {n: F.col(f"`lambda.{n}`") for n in names}, on).drop(*[f"lambda.{n}" for n in names])


ATHENA_FIELDS = {
    "queryId": "query_id", "workgroup": "workgroup", "database": "database", "state": "state", "durationSeconds": "duration_seconds",
}


def athena_extract(df: DataFrame, on: Column | None = None) -> DataFrame:
    """Query id, workgroup, database, state and run time of query-service rows; seconds become nanoseconds."""
    out = put_fields(df, {target: _parsed(df, source) for source, target in ATHENA_FIELDS.items()}, on)
    text = F.try_element_at(F.col("fields"), F.lit("duration_seconds"))
    seconds = (text if on is None else F.when(on, text)).try_cast("double")
    return _set(out, {"event.duration": fill(field(out, "event.duration", "bigint"), (seconds * 1_000_000_000).try_cast("bigint"))})


# ---- identity -------------------------------------------------------------------------------------------------


def _fill_on(df: DataFrame, on: Column | None, targets: dict[str, list[Column]]) -> DataFrame:
    gate = (lambda c: c) if on is None else (lambda c: F.when(on, c))
    return _set(df, {t: fill(field(df, t), *[gate(s) for s in sources]) for t, sources in targets.items()})


def identity_azure(df: DataFrame, on: Column | None = None) -> DataFrame:
    """Principal claim, caller address, operation, category and level of activity rows."""
    claims = field(df, "identity.claims", _MAP)
    return _fill_on(df, on, {
        "user.email": [F.try_element_at(claims, F.lit(fx.UPN_CLAIM))],
        "source.ip": [field(df, "callerIpAddress")],
        "event.action": [field(df, "operationName")],
        "azure.log.category": [field(df, "category")],
        "log.level": [field(df, "level")],
    })


def identity_gcp(df: DataFrame, on: Column | None = None) -> DataFrame:
    """Principal, caller address and method from the parsed line first, from the row itself second."""
    inner, outer = _parsed(df, "protoPayload"), field(df, "protoPayload")
    both = lambda path: [F.get_json_object(inner, path), F.get_json_object(outer, path)]
    return _fill_on(df, on, {
        "user.email": both("$.authenticationInfo.principalEmail"),
        "source.ip": both("$.requestMetadata.callerIp"),
        "event.action": both("$.methodName"),
        "log.level": [field(df, "severity")],
    })


def identity_aws(df: DataFrame, on: Column | None = None) -> DataFrame:
    """Caller address, user, call and agent of audit rows."""
    return _fill_on(df, on, {
        "source.ip": [field(df, "aws.cloudtrail.sourceIPAddress")],
        "user.name": [field(df, "aws.cloudtrail.userIdentity.userName")],
        "event.action": [field(df, "aws.cloudtrail.eventName")],
        "user_agent.original": [field(df, "aws.cloudtrail.userAgent")],
    })


# ---- group fields ---------------------------------------------------------------------------------------------

# Targets that hold whole numbers.
_WHOLE_NUMBERS = ("source.port", "destination.port", "source.bytes", "destination.bytes")


def _group_table() -> dict[str, dict[str, list[str]]]:
    """Group -> target -> ordered sources."""
    table: dict[str, dict[str, list[str]]] = {}
    for group, pairs in fx.GROUP_FIELDS.items():
        for source, target in pairs:
            table.setdefault(group, {}).setdefault(target, []).append(source)
    return table


def group_extract(df: DataFrame) -> DataFrame:
    """Group-specific keys of the parsed line move to ECS targets or to the service namespace.

    A row evaluates its own group's keys only.
    """
    group = field(df, "svc_group")
    own: Column | None = None
    by_target: dict[str, dict[tuple[str, ...], list[str]]] = {}
    for name, targets in _group_table().items():
        mine = {t[1:]: F.coalesce(*[_parsed(df, s) for s in sources]) for t, sources in targets.items() if t.startswith(".")}
        if mine:
            own = F.when(group == name, _entries(mine)) if own is None else own.when(group == name, _entries(mine))
        for t, sources in targets.items():
            if not t.startswith("."):
                by_target.setdefault(t, {}).setdefault(tuple(sources), []).append(name)
    ecs: dict[str, Column] = {}
    for target, by_sources in by_target.items():
        found = F.coalesce(*[
            F.when(group.isin(*groups), F.coalesce(*[_parsed(df, s) for s in sources])) for sources, groups in by_sources.items()
        ])
        whole = target in _WHOLE_NUMBERS
        ecs[target] = fill(field(df, target, "bigint" if whole else "string"), found.try_cast("bigint") if whole else found)
    # A moved severity is no longer there for the level step.
    kept = F.map_filter(F.col("parsed"), lambda k, _: k != "severity")
    had = F.coalesce(F.map_contains_key(field(df, "fields", _MAP), F.lit("severity")), F.lit(False))
    parsed = F.when((group == "security") & ~had, kept).otherwise(F.col("parsed"))
    moved = _set(df, {**ecs, "__parsed": parsed})
    return _set(_put_entries(moved, own), {"parsed": F.col("__parsed")}).drop("__parsed")


def error_extract(df: DataFrame) -> DataFrame:
    """Error code, message and type under either spelling."""
    return _set(df, {
        f"error.{n}": fill(field(df, f"error.{n}"), _parsed(df, f"error{n.capitalize()}"), _parsed(df, f"error_{n}"))
        for n in ("code", "message", "type")
    })


def level_normalise(df: DataFrame) -> DataFrame:
    """Level under its three spellings, lower-cased."""
    level = fill(field(df, "log.level"), _parsed(df, "level"), _parsed(df, "logLevel"), _parsed(df, "severity"))
    return _set(df, {"log.level": F.lower(level)})


def vendor_promote(df: DataFrame, on: Column | None = None) -> DataFrame:
    """Copy the service namespace under the vendor namespace without overwriting its keys."""
    have = field(df, "vendor_fields", _MAP)
    own = F.coalesce(field(df, "fields", _MAP), F.create_map().cast(_MAP))
    both = F.map_concat(have, F.map_filter(own, lambda k, _: ~F.map_contains_key(have, k)))
    merged = F.when(have.isNull(), own).otherwise(both)
    return _set(df, {"vendor_fields": merged if on is None else F.when(on, merged).otherwise(field(df, "vendor_fields", _MAP))})


def ecs_category(df: DataFrame) -> DataFrame:
    """Kind, category and type by service group, where not set."""
    group = F.coalesce(field(df, "svc_group"), F.lit("misc"))
    known = F.when(group.isin(*fx.GROUP_ECS), group).otherwise("misc")
    listed = lambda i: F.create_map(*[c for g, v in fx.GROUP_ECS.items() for c in (F.lit(g), F.array(*[F.lit(x) for x in v[i]]))])
    return _set(df, {
        "event.kind": fill(field(df, "event.kind"), lookup_map({g: v[0] for g, v in fx.GROUP_ECS.items()}, known)),
        "event.category": fill(field(df, "event.category", "array<string>"), F.try_element_at(listed(1), known)),
        "event.type": fill(field(df, "event.type", "array<string>"), F.try_element_at(listed(2), known)),
    })


def outcome_type(df: DataFrame) -> DataFrame:
    """A failed outcome makes the type an error, whatever it was."""
    failed = field(df, "event.outcome") == "failure"
    return _set(df, {"event.type": F.when(failed, F.array(F.lit("error"))).otherwise(field(df, "event.type", "array<string>"))})


def duration_ns(df: DataFrame) -> DataFrame:
    """The first duration key present, in nanoseconds, when positive."""
    parsed = field(df, "parsed", _MAP)
    chosen = None
    for key, unit in fx.DURATION_KEYS:
        here = F.map_contains_key(parsed, F.lit(key))
        value = (F.try_element_at(parsed, F.lit(key)).try_cast("double") * unit).try_cast("bigint")
        chosen = F.when(here, value) if chosen is None else chosen.when(here, value)
    return _set(df, {"event.duration": fill(field(df, "event.duration", "bigint"), F.when(chosen > 0, chosen))})


# ---- enrichment -----------------------------------------------------------------------------------------------


#: Addresses of one row of the interval index.
GEO_BLOCK = 65536


def geo_index(ranges: DataFrame) -> DataFrame:
    """An interval index of disjoint ranges (ip_start, ip_end, ...): per block of 65,536 addresses the sorted lower bounds and what starts there.

    It is written to the shared folder, so Spark knows its bytes and broadcasts it only if it is small.
    """
    values = F.struct(*[F.col(c) for c in ranges.columns if c not in ("ip_start", "ip_end")])
    blocks = F.explode(F.sequence(F.floor(F.col("ip_start") / GEO_BLOCK), F.floor(F.col("ip_end") / GEO_BLOCK)))
    parts = ranges.filter("ip_start <= ip_end").withColumn("__block", blocks)
    low = F.greatest(F.col("ip_start"), F.col("__block") * GEO_BLOCK).alias("low")
    sorted_parts = F.array_sort(F.collect_list(F.struct(low, F.col("ip_end").alias("high"), values.alias("geo"))))
    index = parts.groupBy("__block").agg(sorted_parts.alias("__spans"))
    index = index.select("__block", F.col("__spans.low").alias("__lows"), F.transform("__spans", lambda s: s.dropFields("low")).alias("__spans"))
    path = scratch_path(ranges.sparkSession, "geo-index")
    index.write.parquet(path)
    return ranges.sparkSession.read.schema(index.schema).parquet(path)


def _search(lows: Column, number: Column) -> Column:
    """How many of the sorted bounds are at most ``number``, by halving."""
    def halve(state: Column, _: Column) -> Column:
        low, high = state.getField("low"), state.getField("high")
        middle = F.floor((low + high) / 2).cast("int")
        right = F.get(lows, middle) <= number
        step = F.struct(F.when(right, middle + 1).otherwise(low).alias("low"), F.when(right, high).otherwise(middle).alias("high"))
        return F.when(low < high, step).otherwise(state)

    rounds = F.array(*[F.lit(i) for i in range(GEO_BLOCK.bit_length())])
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(lows).alias("high")), halve, lambda state: state.getField("low"))


def geo_enrich(df: DataFrame, ranges: DataFrame, ip_columns: tuple[str, ...] = ("source.ip", "client.ip", "destination.ip")) -> DataFrame:
    """Geography of each address column, as ``<side>.geo.<column>``; unknown addresses stay NULL.

    Rows are read once, also as a stream: each address meets the one row of its block in the interval index and is found there by binary
    search.  A large index shuffles rows by block, where adaptive execution splits busy blocks.
    """
    present = [c for c in ip_columns if c in df.columns]
    if not present:
        return df
    index = geo_index(ranges)
    geo_cols = [c for c in ranges.columns if c not in ("ip_start", "ip_end")]
    out = df
    for c in present:
        side = c.rsplit(".", 1)[0]
        out = out.withColumn("__num", ipv4_number(F.col(f"`{c}`"))).withColumn("__of", F.floor(F.col("__num") / GEO_BLOCK))
        out = out.join(index, F.col("__of") == F.col("__block"), "left")
        out = out.withColumn("__span", F.get("__spans", _search(F.col("__lows"), F.col("__num")) - 1))
        hit = F.when(F.col("__num") <= F.col("__span.high"), F.col("__span.geo"))
        out = out.withColumns({f"{side}.geo.{g}": hit.getField(g) for g in geo_cols}).drop("__num", "__of", "__block", "__lows", "__spans", "__span")
    return out


def user_agent_enrich(df: DataFrame, agents: list[tuple[str, str]], source: str = "user_agent.original") -> DataFrame:
    """Agent family by the first matching pattern of a short list (name, regex); no pattern reads as Other."""
    text = field(df, source)
    name = F.coalesce(*[F.when(text.rlike(pattern), F.lit(family)) for family, pattern in agents], F.lit("Other"))
    return _set(df, {"user_agent.name": fill(field(df, "user_agent.name"), F.when(text.isNotNull(), name))})


def related_fields(df: DataFrame, wide: bool = False) -> DataFrame:
    """Distinct addresses, users and hosts named anywhere in the row, appended to what is there; ``wide`` adds server and host addresses."""
    def gather(old: str, single: list[str], many: list[str]) -> Column:
        have = F.coalesce(field(df, old, "array<string>"), F.array().cast("array<string>"))
        lists = [F.coalesce(field(df, m, "array<string>"), F.array().cast("array<string>")) for m in many]
        joined = F.array_distinct(F.array_compact(F.concat(have, F.array(*[field(df, s) for s in single]), *lists)))
        return F.when(F.size(joined) > 0, joined)

    return _set(df, {
        "related.ip": gather("related.ip", ["source.ip", "destination.ip", "client.ip", *(["server.ip"] if wide else [])], ["host.ip"] if wide else []),
        "related.user": gather("related.user", ["user.name", "user.email", *([] if wide else ["user.id"])], []),
        "related.hosts": gather("related.hosts", [] if wide else ["host.name", "host.hostname"], []),
    })


# Envelope fields dropped once their ECS target is set (None: always).
MAPPED_ENVELOPE = {
    "azure": (
        ("callerIpAddress", "source.ip"), ("identity.claims", "user.email"), ("operationName", "event.action"), ("level", "log.level"),
        ("category", "azure.log.category"), ("resultType", None), ("resultSignature", None),
    ),
    "gcp": (("severity", "log.level"), ("insertId", None)),
    "aws": (("aws.cloudtrail.sourceIPAddress", "source.ip"), ("aws.cloudtrail.userAgent", "user_agent.original")),
}


def cleanup(df: DataFrame) -> DataFrame:
    """Drop the parsed object and blank the vendor envelope fields that now live in ECS fields."""
    out: dict[str, Column] = {}
    for vendor, pairs in MAPPED_ENVELOPE.items():
        for source, target in pairs:
            if source in df.columns:
                gone = F.col("vendor") == vendor
                if target is not None:
                    gone = gone & field(df, target).isNotNull()
                out[source] = F.when(~gone | gone.isNull(), F.col(f"`{source}`"))
    return _set(df, out).drop("parsed")


def tag_on_error(df: DataFrame) -> DataFrame:
    """Tag rows that carry an error message, once."""
    have = F.coalesce(field(df, "tags", "array<string>"), F.array().cast("array<string>"))
    tagged = F.array_union(have, F.array(F.lit("preserve_original_event")))
    return _set(df, {"tags": F.when(field(df, "error.message").isNotNull(), tagged).otherwise(field(df, "tags", "array<string>"))})


def normalise(df: DataFrame, geo_ranges: DataFrame | None = None, agents: list[tuple[str, str]] | None = None) -> DataFrame:
    """The whole chain in its fixed order, for rows of any vendor and group, with nested ECS columns as the result."""
    vendor, dataset = F.col("vendor"), field(df, "dataset")
    out = parse_json(preserve_original(set_ecs_version(df)))
    out = grok_log4j_fallback(out)
    out = identity_aws(identity_gcp(identity_azure(out, vendor == "azure"), vendor == "gcp"), vendor == "aws")
    out = lambda_extract(out, dataset == "aws.lambda_logs")
    out = athena_extract(out, dataset == "aws.athena")
    out = level_normalise(error_extract(group_extract(out)))
    out = duration_ns(outcome_type(ecs_category(vendor_promote(out, vendor == "aws"))))
    if geo_ranges is not None:
        out = geo_enrich(out, geo_ranges)
    if agents:
        out = user_agent_enrich(out, agents)
    return nest(tag_on_error(cleanup(related_fields(out))))


def only_for(condition: Column, step: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Apply a step to the rows of one kind and leave the others as they were, in one pass."""

    def apply(df: DataFrame) -> DataFrame:
        before = {c: F.col(f"`{c}`") for c in df.columns}
        marked = df.withColumns({"__old": F.struct(*[v.alias(c) for c, v in before.items()]), "__on": F.coalesce(condition, F.lit(False))})
        done = step(marked)
        names = [c for c in done.columns if c not in ("__old", "__on")]
        old = F.col("__old")
        pick = lambda c: F.when(F.col("__on"), F.col(f"`{c}`")).otherwise(old.getField(c) if c in before else F.lit(None))
        return done.select(*[pick(c).alias(c) for c in names])

    return apply


# ---- routing by ingestion metadata ----------------------------------------------------------------------------


def service_route_map(datasets: DataFrame) -> DataFrame:
    """Slug to dataset, with and without the ``_logs`` suffix; one row per slug."""
    suffix = F.regexp_replace("dataset", r"^aws\.", "")
    slug = F.regexp_replace(suffix, "_logs$", "")
    rows = datasets.filter(F.col("dataset").startswith("aws.")).select(
        F.explode(F.array_distinct(F.array(slug, suffix))).alias("slug"), "dataset"
    )
    return rows.groupBy("slug").agg(F.max("dataset").alias("dataset"))


def _route(df: DataFrame, routes: DataFrame, slug: Column, out: str) -> DataFrame:
    named = checked_broadcast(routes).select(F.col("slug").alias("__slug"), F.col("dataset").alias(out))
    return df.withColumn("__key", slug).join(named, F.col("__key") == F.col("__slug"), "left").drop("__key", "__slug")


def log_group_slug(df: DataFrame, simple: bool = False) -> list[Column]:
    """Candidate slugs of a log group, best first."""
    group = field(df, "log_group")
    service = _extract(group, r"^/aws/([^/]+)", 1)
    if simple:
        return [service]
    other = F.when(group.startswith("/ecs/"), "fargate").when(group.startswith("aws-cloudtrail-logs-"), None).when(
        group.startswith("aws-waf-logs-"), "wafv2"
    )
    return [service, other]


def object_key_slug(df: DataFrame) -> Column:
    """Service folder of a delivered log object."""
    return F.lower(_extract(field(df, "s3_key"), r"AWSLogs/[0-9]+/([^/]+)/", 1))


def _first_route(df: DataFrame, routes: DataFrame, slugs: list[Column]) -> DataFrame:
    out = df
    for i, slug in enumerate(slugs):
        out = _route(out, routes, slug, f"__d{i}")
    names = [f"__d{i}" for i in range(len(slugs))]
    return out.withColumn("target_dataset", F.coalesce(*names)).drop(*names)


def reroute_by_log_group(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Dataset of a log group: its service folder, a container group or a firewall group; trail groups stay."""
    return _first_route(df, routes, log_group_slug(df))


def reroute_by_s3_key(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Dataset of a delivered log object."""
    return _first_route(df, routes, [object_key_slug(df)])


def reroute_firehose(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Log group first, object key second."""
    return _first_route(df, routes, [*log_group_slug(df, simple=True), object_key_slug(df)])


def resolve_dataset(service: Column, source: Column) -> Column:
    """A service's own dataset, else the generic one of the ingestion source."""
    generic = F.coalesce(lookup_map(fx.GENERIC_DATASETS, source), F.lit(fx.DEFAULT_DATASET))
    return F.coalesce(lookup_map(fx.DEDICATED_DATASETS, service), generic)


def normalise_dataset(dataset: Column, source: Column, overridden: Column) -> Column:
    """Correct stale names; real datasets pass; an explicit source switches the others to its generic stream."""
    given = F.when(dataset != "", dataset)
    corrected = F.coalesce(lookup_map(fx.STALE_DATASETS, given), given)
    real = corrected.isin(*sorted({*fx.DEDICATED_DATASETS.values(), *fx.OTHER_REAL_DATASETS}))
    generic = lookup_map(fx.GENERIC_DATASETS, source)
    switched = F.when(overridden & (generic != fx.DEFAULT_DATASET), generic)
    chosen = F.when(real, corrected).otherwise(F.coalesce(switched, corrected))
    return F.when(given.isNull(), F.coalesce(generic, F.lit(fx.DEFAULT_DATASET))).otherwise(chosen)


def foreign(tagged_dataset: Column, vendor: str) -> Column:
    """Rows tagged for another integration."""
    return F.coalesce((tagged_dataset != "apm") & ~tagged_dataset.startswith(f"{vendor}."), F.lit(False))


def skip_foreign(df: DataFrame, vendor: str, step: Callable[[DataFrame], DataFrame], tag: str = "__dataset") -> DataFrame:
    """Apply an enrichment step to all rows but those of another integration."""
    return only_for(~foreign(field(df, tag), vendor), step)(df)


def level_from_outcome(df: DataFrame) -> DataFrame:
    """A missing level reads error after a failure and info otherwise."""
    derived = F.when(field(df, "event.outcome") == "failure", "error").otherwise("info")
    return _set(df, {"log.level": fill(field(df, "log.level"), derived)})


def enrich_defaults(df: DataFrame, module: str = "aws", signal: str = "logs") -> DataFrame:
    """Stream, module, dataset, service and version defaults; logs take the resolved dataset, other signals keep theirs."""
    dataset = field(df, "dataset")
    own = field(df, "event.dataset")
    event_dataset = dataset if signal == "logs" else fill(own, dataset)
    stream_dataset = dataset if signal == "logs" else fill(field(df, "data_stream.dataset"), dataset)
    return _set(df, {
        "data_stream.type": F.lit(signal),
        "data_stream.dataset": stream_dataset,
        "data_stream.namespace": fill(field(df, "data_stream.namespace"), F.lit("default")),
        "event.module": fill(field(df, "event.module"), F.lit(module)),
        "event.dataset": event_dataset,
        "service.name": fill(field(df, "service.name"), field(df, "service_id")),
        "ecs.version": fill(field(df, "ecs.version"), F.lit(fx.ECS_VERSION_ENRICHED)),
    })


def gcp_azure_enrich(df: DataFrame, module: str, datasets: dict[str, str], signal: str = "logs") -> DataFrame:
    """The same defaults for the other vendors: the dataset comes from the service, unless the row names one."""
    named = F.coalesce(lookup_map(datasets, field(df, "service_id")), F.concat(F.lit(f"{module}."), field(df, "service_id")))
    keep = field(df, "event.dataset") if signal != "metrics" else F.lit(None).cast("string")
    out = _set(df, {"dataset": fill(keep, named)})
    out = enrich_defaults(out, module, signal)
    return related_fields(level_from_outcome(out) if signal == "logs" else out, wide=True)


def to_document(df: DataFrame, out: str = "document") -> DataFrame:
    """Each row as a JSON document without null-valued keys, at any depth."""
    nested = nest(df)
    return nested.select(F.to_json(F.struct(*nested.columns), {"ignoreNullFields": "true"}).alias(out))


# ---- vendor extras --------------------------------------------------------------------------------------------


def outcome_from_vendor(df: DataFrame) -> DataFrame:
    """Status code 0 or a Success / Succeeded result is a success, any other value a failure, none stays none."""
    code, result = field(df, "status_code"), field(df, "resultType")
    gcp = F.when(code.cast("string") == "0", "success").when(code.isNotNull(), "failure")
    azure = F.when(result.isin("Success", "Succeeded"), "success").when(result.isNotNull(), "failure")
    vendor = field(df, "vendor")
    return _set(df, {"event.outcome": fill(field(df, "event.outcome"), F.when(vendor == "gcp", gcp).when(vendor == "azure", azure))})


def vendor_resource_map(df: DataFrame) -> DataFrame:
    """Resource id, response status, caller agent, application id, service and project of vendor envelopes."""
    get = lambda name, path: F.get_json_object(field(df, name), path)
    return _fill_on(df, None, {
        "cloud.instance.id": [field(df, "resourceId")],
        "http.response.status_code": [get("properties", "$.statusCode")],
        "user_agent.original": [get("protoPayload", "$.requestMetadata.callerSuppliedUserAgent")],
        "user_agent.name": [F.try_element_at(field(df, "identity.claims", _MAP), F.lit("appid"))],
        "cloud.service.name": [get("resource", "$.type")],
        "cloud.project.id": [get("resource", "$.labels.project_id")],
    })


def trace_guid(trace_id: Column) -> Column:
    """A 32-digit hex id in the 8-4-4-4-12 form."""
    h = F.rpad(F.regexp_replace(F.lower(trace_id), "-", ""), 32, "0")
    return F.concat_ws("-", *[F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def otel_correlation_labels(df: DataFrame, vendor: str, source: str = "ingestion_source") -> DataFrame:
    """Vendor trace labels are kept and completed only in the vendor's gateway mode; other telemetry modes lose them."""
    empty = F.create_map().cast(_MAP)
    labels = F.coalesce(field(df, "labels", _MAP), empty)
    trace, span = field(df, "trace.id"), fill(field(df, "transaction.id"), field(df, "span.id"))
    from_trace = {
        "aws": {},
        "gcp": {"gcp.cloud_trace.trace_id": trace, "gcp.cloud_trace.span_id": span},
        "azure": {
            "azure.application_insights.operation_id": F.when(trace.isNotNull(), trace_guid(trace)),
            "azure.monitor.trace_id": trace, "azure.monitor.span_id": span,
        },
    }[vendor]
    constants = {k: F.lit(v) for k, v in fx.GATEWAY_CONSTANTS[vendor].items()}
    pack = lambda d: F.map_filter(F.create_map(*[c for k, v in d.items() for c in (F.lit(k), v)]), lambda _, v: v.isNotNull()) if d else empty
    missing = F.map_filter(pack(from_trace), lambda k, _: F.coalesce(F.try_element_at(labels, k), F.lit("")) == "")
    kept = F.map_filter(labels, lambda k, _: ~k.isin(*constants) & ~F.map_contains_key(missing, k))
    completed = F.map_concat(kept, missing, pack(constants))
    others = F.map_filter(labels, lambda k, _: ~k.isin(*fx.GATEWAY_LABELS[vendor]))
    mode = field(df, source)
    patched = F.when(mode == fx.GATEWAY_SOURCE, completed).otherwise(F.when(F.size(others) > 0, others))
    return _set(df, {"labels": F.when(mode.isin(*fx.OTEL_SOURCES), patched).otherwise(field(df, "labels", _MAP))})


GCP_SERIES = (
    "struct<metric:struct<type:string,labels:map<string,string>>,resource:struct<type:string,labels:map<string,string>>,"
    "points:array<struct<interval:struct<endTime:string>,value:struct<doubleValue:double>>>>"
)
AZURE_SERIES = (
    "struct<time:string,metricName:string,resourceGroup:string,subscriptionId:string,"
    "timeseries:array<struct<data:array<struct<average:double,count:bigint>>>>>"
)


def explode_native_metrics(df: DataFrame) -> DataFrame:
    """GCP points and Azure data arrays (JSON text) as long metric rows: source, ts, metric, value, resource."""
    keep = [c for c in df.columns if c not in ("monitoringTimeSeries", "azureMonitorMetric")]
    point = "array<struct<source:string,at:timestamp,metric:string,value:double,resource:string>>"
    rows = df.withColumns({"__g": F.from_json(field(df, "monitoringTimeSeries"), GCP_SERIES), "__a": F.from_json(field(df, "azureMonitorMetric"), AZURE_SERIES)})
    gcp = F.transform("__g.points", lambda p: F.struct(
        F.lit("gcp").alias("source"), F.to_timestamp(p["interval"]["endTime"]).alias("at"), F.col("__g.metric.type").alias("metric"),
        p["value"]["doubleValue"].alias("value"), F.col("__g.resource.type").alias("resource"),
    ))
    data = F.flatten(F.transform("__a.timeseries", lambda t: t.getField("data")))
    azure = F.transform(data, lambda p: F.struct(
        F.lit("azure").alias("source"), F.to_timestamp("__a.time").alias("at"), F.col("__a.metricName").alias("metric"),
        p["average"].alias("value"), F.col("__a.resourceGroup").alias("resource"),
    ))
    both = F.concat(*[F.coalesce(x.cast(point), F.array().cast(point)) for x in (gcp, azure)])
    return rows.select(*keep, F.inline(both))


def metric_rollup(df: DataFrame, keys: list[str], value: str, period: str = "60 seconds", ts: str = "ts") -> DataFrame:
    """Raw values as avg, sum, count, min and max per period and dimension."""
    grouped = df.groupBy(F.window(ts, period).alias("w"), *keys).agg(
        F.avg(value).alias("avg"), F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return grouped.select(F.col("w.start").alias("period_start"), *keys, "avg", "sum", "count", "min", "max")


def itsm_flatten(df: DataFrame, tag: str, values: list[str], displays: list[str]) -> DataFrame:
    """Rows of one table as columns: ``<field>`` from the value, ``<field>_name`` from the display value."""
    rec = F.col("rec")
    kept = df.filter(F.array_contains("tags", tag))
    part = lambda name, side: F.try_element_at(rec, F.lit(name)).getField(side)
    return kept.select(
        "ts", *[part(v, "value").alias(v) for v in values], *[part(v, "display_value").alias(f"{v}_name") for v in displays]
    )
