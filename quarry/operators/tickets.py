"""Ticket search: parse a question, match, score, relax, count and trend."""

from __future__ import annotations

import re

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a question's words ask for, in the order of their priority.
MODES = {
    "count": r"(?i)\b(how many|count|number of|trend|spike)\b",
    "oldest": r"(?i)\b(oldest|earliest|first|longest open)\b",
    "custom": r"(?i)\b(by (root cause|category|team|client|status)|most common|distribution|breakdown)\b",
}
ACTIVE, RESOLVED = r"(?i)\b(open|active|unresolved|in progress)\b", r"(?i)\b(resolved|closed|fixed|done)\b"


def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def parse_question(q: Column) -> Column:
    """struct<mode, limit, since (months), status, ticket_type>; what a question doesn't say is null, the mode top."""
    mode = F.lit("top")
    for name, pattern in reversed(MODES.items()):
        mode = F.when(q.rlike(pattern), F.lit(name)).otherwise(mode)
    n = lambda unit: F.expr(f"try_cast(nullif(regexp_extract(q_, r'(?i)\\b(\\d+)\\s+{unit}s?\\b', 1), '') as int)")
    since = (
        F.when(n("year").isNotNull(), n("year") * 12).when(n("month").isNotNull(), n("month"))
        .when(n("week").isNotNull(), F.greatest(F.lit(1), F.bround(n("week") / 4).cast("int")))
        .when(q.rlike(r"(?i)\bthis (week|month)\b"), 1).when(q.rlike(r"(?i)\bthis year\b"), 12)
    )
    limit = F.expr("try_cast(nullif(regexp_extract(q_, r'(?i)\\btop\\s+(\\d+)\\b', 1), '') as int)")
    status = F.when(q.rlike(ACTIVE), "active").when(q.rlike(RESOLVED), "resolved")
    kind = F.when(q.rlike(r"(?i)\brca\b|root cause ticket"), "RCA").when(q.rlike(r"(?i)\b(tri|triage)\b"), "TRI")
    return F.struct(mode.alias("mode"), limit.alias("limit"), since.alias("since"), status.alias("status"), kind.alias("ticket_type"))


def expand_synonyms(terms: Column, groups: Sequence[Sequence[str]], most: int = 5) -> Column:
    """Each term followed by the others of its group, without repeats, `most` at most."""
    table = {w: list(g) for g in groups for w in g}
    lookup = F.create_map(*[x for w, g in table.items() for x in (F.lit(w), F.array(*map(F.lit, g)))])
    return F.slice(F.array_distinct(F.flatten(F.transform(terms, lambda t: F.array_union(F.array(F.lower(t)), F.coalesce(lookup[F.lower(t)], F.array().cast("array<string>")))))), 1, most)


def match_any(terms: Sequence[str], columns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        for c in columns:
            hit = hit | F.coalesce(F.ilike(F.col(c), F.lit(f"%{escape_like(t)}%")), F.lit(False))
    return hit


def score(terms: Sequence[str], weights: Mapping[str, int]) -> Column:
    total = F.lit(0)
    for t in terms:
        for c, w in weights.items():
            total = total + F.when(F.ilike(F.col(c), F.lit(f"%{escape_like(t)}%")), w).otherwise(0)
    return total


def top(df: DataFrame, terms: Sequence[str], weights: Mapping[str, int], most: int) -> DataFrame:
    rows = df.where(match_any(terms, list(weights))).withColumn("score", score(terms, weights))
    return rows.orderBy(F.desc("score"), F.desc("created"), "key").limit(most)


def relaxed(df: DataFrame, tiers: Sequence[tuple[Column, str]], most: int) -> DataFrame:
    """Rows of the strictest tier that has them, then of the next: one row a key, filled up to `most`."""
    parts = None
    for nth, (condition, name) in enumerate(tiers):
        part = df.where(condition).withColumns({"tier": F.lit(nth), "step": F.lit(name)})
        parts = part if parts is None else parts.unionByName(part)
    once = parts.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("tier"))).where("r = 1").drop("r")
    return once.orderBy("tier", F.desc("created"), "key").limit(most)


# What a question's words say about the columns to look in, and how much each of them counts.
INTENTS = (
    (r"\b(fix|resolv|mitigat|workaround|solution|clear cache|reboot|restart)", {"Resolution_Mitigation": 3, "Resolution_Category": 2, "Root_Cause": 1}),
    (r"\b(root.?cause|cause|why|reason|diagnos|fault|failure|outage)", {"Root_Cause": 3, "Description": 2, "Resolution_Mitigation": 1}),
    (r"\b(ios|android|roku|xumo|firetv|appletv|stb|set.?top|laptop|macbook|browser|platform|device)", {"Platform_Affected": 3, "Description": 2, "Summary": 1}),
    (r"\b(error|no local|missing|not authorized|black screen|buffering|freeze|hang|crash|fail)", {"Description": 3, "Summary": 2, "Root_Cause": 1}),
    (r"\b(org|organization|vertical|customer|residential|commercial|enterprise|division)", {"Requesting_Organization": 3, "Vertical": 2, "Customer_Type": 1}),
    (r"\b(headend|node|controller|environment|he |sdv|cms)", {"Environment_HE_Controller": 3, "Description": 2}),
    (r"\b(comment|update|latest|recent|last note|activity)", {"Last_Comment": 3, "Description": 1}),
)
BASE_FIELDS = {"Summary": 2, "Description": 1}
DEFAULT_FIELDS = {"Summary": 3, "Description": 2, "Root_Cause": 2, "Resolution_Mitigation": 1, "Resolution_Category": 1, "Last_Comment": 1, "Labels": 2}


def detect_fields(terms: Column) -> Column:
    """Map of column to weight for the lower-case words of a search: the most that an intent they show gives; without any
    intent beyond the base columns the default weights."""
    names = sorted({c for _, w in INTENTS for c in w} | set(BASE_FIELDS))
    told = lambda c: [F.when(terms.rlike(p), w[c]) for p, w in INTENTS if c in w]
    weight = lambda c: F.coalesce(F.greatest(*told(c), F.lit(None).cast("int")) if told(c) else F.lit(None).cast("int"), F.lit(BASE_FIELDS.get(c)).cast("int"))
    own = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(weight, names))), lambda _, w: w.isNotNull())
    usual = F.map_from_arrays(F.array(*map(F.lit, DEFAULT_FIELDS)), F.array(*map(F.lit, DEFAULT_FIELDS.values())))
    return F.when(F.size(own) > 2, own).otherwise(usual)


def raw_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The rows of one SELECT over the named ticket tables, which may be called <name>_tickets. Names are bound to this
    statement only; anything but a single SELECT is refused."""
    statement = sql.strip().rstrip(";")
    if ";" in statement or not re.match(r"(?is)(select|with)\b", statement) or re.search(r"(?i)\b(insert|update|delete|drop|create|alter|merge|truncate)\b", statement):
        raise ValueError("a single SELECT is expected")
    for name in tables:
        statement = re.sub(rf"\b{name}(?:_tickets)?\b", "{" + name + "}", statement)
    return spark.sql(statement, **tables)


def from_sources(primary: DataFrame | None, secondary: DataFrame | None, both: bool = False) -> DataFrame:
    """The primary source's rows; the secondary's where the primary is missing or has none; with `both` all of both."""
    there = [d for d in (primary, secondary) if d is not None]
    if not there:
        raise ValueError("no ticket source is there")
    if both and len(there) == 2:
        return primary.unionByName(secondary)
    return there[-1] if primary is None or primary.isEmpty() else primary


def linked_to(rows: DataFrame, linked: str, project: str) -> DataFrame:
    """The tickets whose list of linked issues, parted by commas, has one of the project."""
    return rows.where(F.exists(F.split(F.col(linked), r"\s*,\s*"), lambda x: F.trim(x).startswith(f"{project}-")))
