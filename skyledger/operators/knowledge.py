"""Runbook knowledge base: chunk, tag and search markdown; search logs by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import any_of, wildcard_any
from skyledger.session import cut_lineage

MIN_CHUNK = 50
MIN_GUIDE = 30

# Content tags and the case-insensitive patterns that earn them.
TAGS = (
    ("remediation", "containment|remediation"),
    ("esql-query", r"ES\|QL|esql|FROM logs"),
    ("escalation", "escalat"),
    ("mitre-attack", r"MITRE|ATT&CK|TA\d{4}|T\d{4}"),
    ("iam", "IAM|PrivEsc|privilege"),
    ("guardduty", "GuardDuty"),
    ("exfiltration", "exfil"),
    ("cloudtrail", "CloudTrail"),
    ("cmdb", "ServiceNow|CMDB"),
)
# Tags of a rule guide, from the rule's name.
GUIDE_TAGS = (("iam", "IAM|PrivEsc"), ("guardduty", "GuardDuty"), ("exfiltration", "Exfil"), ("data-pipeline", "Pipeline"))
# Severity words, most severe first.
SEVERITIES = (("critical", "Critical"), ("high", r"\bHigh\b"), ("medium", r"\bMedium\b"), ("low", r"\bLow\b"))

_H1 = r"(?m)^#[ \t]+(.+)$"
_H2 = r"(?m)(?=^##[ \t]+.)"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def chunk_markdown(docs: DataFrame, content: str = "content", source: str = "source") -> DataFrame:
    """Sections below second-level headings with more than 50 characters, under the document's first title.

    A document that yields none is kept whole.  Each document is cut within its own row: no shuffle.
    """
    rest = [c for c in docs.columns if c != content]
    h1 = _strip(F.regexp_extract(content, _H1, 1))
    titled = docs.select(*rest, F.col(content).alias("__text"), h1.alias("__h1"), F.split(content, _H1, 2).alias("__halves"))
    cut = titled.withColumn("__pieces", F.split(F.array_join("__halves", ""), _H2))
    headed = F.transform(
        F.filter("__pieces", lambda p: p.startswith("##")),
        lambda p: F.struct(_strip(F.regexp_extract(p, r"^##[ \t]+(.+)", 1)).alias("title"), _strip(F.regexp_replace(p, r"^##.*", "")).alias("content")),
    )
    kept = cut.withColumn("__all", headed).withColumn(
        "__kept", F.filter("__all", lambda s: (F.length(s.getField("content")) > MIN_CHUNK) & (s.getField("title") != ""))
    )
    name = F.regexp_replace(F.element_at(F.split(F.col(source), "/"), -1), r"\.md$", "")
    whole = F.struct(F.when(F.col("__h1") != "", F.col("__h1")).otherwise(name).alias("title"), _strip(F.col("__text")).alias("content"))
    fallback = F.when(F.length(_strip(F.col("__text"))) > MIN_CHUNK, F.array(whole))
    sections = F.when(F.size("__kept") > 0, F.col("__kept")).otherwise(fallback)
    parent = F.when((F.col("__h1") != "") & (F.size("__kept") > 0), F.col("__h1"))
    chosen = kept.select(*rest, parent.alias("parent_title"), sections.alias("__sections"))
    out = chosen.select(*rest, "parent_title", F.posexplode("__sections").alias("chunk", "c"))
    return out.select(*rest, "chunk", "c.title", "parent_title", "c.content")


def tag_chunks(chunks: DataFrame, base: list[str] | None = None) -> DataFrame:
    """Base tags plus those whose pattern occurs in the content."""
    found = [F.when(F.col("content").rlike(f"(?i){p}"), F.lit(t)) for t, p in TAGS]
    return chunks.withColumn("tags", F.array_distinct(F.array_compact(F.array(*[F.lit(b) for b in base or []], *found))))


def chunk_severity(chunks: DataFrame) -> DataFrame:
    """The most severe severity word in the content."""
    text = F.col("content")
    return chunks.withColumn("severity", F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(s)) for s, p in SEVERITIES]))


def extract_mitre(chunks: DataFrame) -> DataFrame:
    """Distinct tactic and technique ids named in the content."""
    ids = lambda p: F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(0)))
    return chunks.withColumns({"mitre_tactic": ids(r"TA\d{4}"), "mitre_technique": ids(r"T\d{4}(?:\.\d{3})?")})


def build_chunks(docs: DataFrame, base_tags: list[str] | None = None) -> DataFrame:
    """Chunk, tag, rate and annotate documents."""
    return extract_mitre(chunk_severity(tag_chunks(chunk_markdown(docs), base_tags)))


def category_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per category."""
    return chunks.groupBy("category").agg(F.count("*").alias("chunks"))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _occurrences(words: Column, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def keyword_search(docs: DataFrame, query: str, k: int, text: str = "content", id_col: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best rows by BM25.

    Term counts are taken within each row in one pass, a job that runs when this is called and writes a few numbers per row to the checkpoint folder; document
    frequencies, the mean length and the ranking, a distributed top-k, read those.  Nothing is exploded or shuffled.
    """
    import re

    terms = list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))
    if not terms:
        raise ValueError("the query holds no word")
    words = docs.select(id_col, tokens(F.col(text)).alias("__w"))
    tf = [_occurrences(F.col("__w"), t).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = cut_lineage(words.select(id_col, F.size("__w").alias("length"), *tf))
    stats = counted.agg(F.struct(
        F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    ).alias("s")).scalar()
    scored = counted.withColumn("__s", stats)
    parts = []
    for i in range(len(terms)):
        df, n = F.col(f"__s.df{i}"), F.col("__s.n")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        freq = F.col(f"tf{i}")
        parts.append(idf * freq * (k1 + 1) / (freq + k1 * (1 - b + b * F.col("length") / F.col("__s.mean"))))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    hit = any_of([F.col(f"tf{i}") > 0 for i in range(len(terms))])
    ranked = scored.filter(hit).withColumn("score", F.round(total, 6))
    return ranked.orderBy(F.desc("score"), F.asc(id_col)).limit(k).select(id_col, "score")


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of an array column with a fixed vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    size = sum(float(x) * float(x) for x in query) ** 0.5
    return F.try_divide(dot, norm * F.lit(size))


def vector_search(docs: DataFrame, query: list[float], k: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows by cosine, over all rows."""
    scored = docs.filter(F.size(vector) == len(query)).select(id_col, F.round(cosine(F.col(vector), query), 6).alias("score"))
    return scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def rule_guides(bundles: DataFrame, category: str, base_tags: list[str]) -> DataFrame:
    """Investigation guides of rule bundles (``source``, ``rules`` array) as chunks, with the rule's metadata."""
    rows = bundles.select("source", F.explode("rules").alias("r")).filter(F.length("r.note") >= MIN_GUIDE)
    named = F.array(*[F.when(F.col("r.name").rlike(f"(?i){p}"), F.lit(t)) for t, p in GUIDE_TAGS])
    own = F.coalesce(F.col("r.tags"), F.array().cast("array<string>"))
    tags = F.array_distinct(F.array_compact(F.concat(F.array(*[F.lit(t) for t in base_tags]).cast("array<string>"), own, named)))
    return rows.select(
        F.coalesce("r.name", "r.rule_id", F.lit("Unknown rule")).alias("title"), F.lit(f"{category} detection rules").alias("parent_title"),
        F.col("r.note").alias("content"), "source", F.lit("detection-rule-guide").alias("category"), tags.alias("tags"),
        F.col("r.severity").alias("severity"), F.col("r.risk_score").alias("risk_score"), F.col("r.rule_id").alias("rule_id"),
    )


def log_search(logs: DataFrame, streams: list[str], text: str, n: int, stream_col: str = "dataset", text_col: str = "message", ts: str = "ts", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows of the named streams whose text contains a phrase, whatever its case."""
    hit = wildcard_any(stream_col, streams) & F.lower(F.col(text_col)).contains(text.lower())
    return logs.filter(hit).orderBy(F.desc(ts), F.asc(tie)).limit(n)
