"""Queries of ticket search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import dedup, tickets
from quarry.plans import fixtures as X
from quarry.plans.registry import query, table

TERMS = ("red", "widget")
WEIGHTS = {"summary": 2, "description": 1}
ANY = " OR ".join(f"{c} ILIKE '%{t}%'" for t in TERMS for c in WEIGHTS)
SCORE = " + ".join(f"CASE WHEN {c} ILIKE '%{t}%' THEN {w} ELSE 0 END" for t in TERMS for c, w in WEIGHTS.items())
AS_OF = "1997-06-30"
WITH = f"WITH {X.TICKETS} "
def one():
    return F.count(F.lit(1))



def rows(spark, sf):
    return X.tickets(spark, sf)


QUESTIONS = """q AS (SELECT o_orderkey AS q_id, CASE o_orderkey % 7 WHEN 0 THEN 'How many open tickets in the last ' || (o_orderkey % 9 + 1) || ' months?' WHEN 1 THEN 'top ' || (o_orderkey % 20) || ' triage tickets about modems' WHEN 2 THEN 'oldest active rca this year'
  WHEN 3 THEN 'breakdown by root cause over ' || (o_orderkey % 3 + 1) || ' years' WHEN 4 THEN 'tickets closed in ' || (o_orderkey % 12 + 1) || ' weeks' WHEN 5 THEN 'anything new this week' ELSE '' END AS q_ FROM orders)"""


def asked(spark, sf):
    k = F.col("o_orderkey")
    n = lambda m, a=0: (k % m + a).cast("string")
    forms = [
        F.concat(F.lit("How many open tickets in the last "), n(9, 1), F.lit(" months?")), F.concat(F.lit("top "), n(20), F.lit(" triage tickets about modems")), F.lit("oldest active rca this year"),
        F.concat(F.lit("breakdown by root cause over "), n(3, 1), F.lit(" years")), F.concat(F.lit("tickets closed in "), n(12, 1), F.lit(" weeks")), F.lit("anything new this week"), F.lit(""),
    ]
    from quarry.plans.registry import table

    return table(spark, sf, "orders").select(k.alias("q_id"), F.element_at(F.array(*forms), (k % 7 + 1).cast("int")).alias("q_"))


def _int(pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(q_, '{pattern}', 1), '') AS INTEGER)"


UNIT = {u: _int(rf"(?i)\b(\d+)\s+{u}s?\b") for u in ("year", "month", "week")}


@query("I01_parse_question", rf"""WITH {QUESTIONS} SELECT q_id, CASE {' '.join(f"WHEN regexp_matches(q_, '{p}') THEN '{m}'" for m, p in tickets.MODES.items())} ELSE 'top' END AS mode, {_int(r'(?i)\btop\s+(\d+)\b')} AS lim,
  CASE WHEN {UNIT['year']} IS NOT NULL THEN {UNIT['year']} * 12 WHEN {UNIT['month']} IS NOT NULL THEN {UNIT['month']} WHEN {UNIT['week']} IS NOT NULL THEN greatest(1, CAST(round_even({UNIT['week']} / 4.0, 0) AS INTEGER))
  WHEN regexp_matches(q_, '(?i)\bthis (week|month)\b') THEN 1 WHEN regexp_matches(q_, '(?i)\bthis year\b') THEN 12 END AS since,
  CASE WHEN regexp_matches(q_, '{tickets.ACTIVE}') THEN 'active' WHEN regexp_matches(q_, '{tickets.RESOLVED}') THEN 'resolved' END AS status,
  CASE WHEN regexp_matches(q_, '(?i)\brca\b|root cause ticket') THEN 'RCA' WHEN regexp_matches(q_, '(?i)\b(tri|triage)\b') THEN 'TRI' END AS ticket_type FROM q""")
def _parse(spark, sf):
    p = asked(spark, sf).select("q_id", tickets.parse_question(F.col("q_")).alias("p"))
    return p.select("q_id", "p.mode", F.col("p.limit").alias("lim"), "p.since", "p.status", "p.ticket_type")


GROUPS = (("slow", "lag", "delay"), ("down", "outage", "offline"))


@query("I02_expand_synonyms", """WITH t AS (SELECT DISTINCT source, CASE WHEN source LIKE '%1%' THEN ['slow', 'modem'] ELSE ['down', source] END AS terms FROM documents)
  SELECT source, array_to_string(CASE WHEN terms[1] = 'slow' THEN ['slow', 'lag', 'delay', 'modem'] ELSE ['down', 'outage', 'offline', source] END, ',') AS terms FROM t""")
def _synonyms(spark, sf):
    t = X.documents(spark, sf).select("source").distinct()
    terms = F.when(F.contains("source", F.lit("1")), F.array(F.lit("slow"), F.lit("modem"))).otherwise(F.array(F.lit("down"), F.col("source")))
    return t.select("source", F.array_join(tickets.expand_synonyms(terms, GROUPS), ",").alias("terms"))


@query("I03_expand_status", WITH + "SELECT key, status IN ('O', 'P') AS is_active, status IN ('F') AS is_resolved FROM tickets")
def _status(spark, sf):
    preset = {"active": ("O", "P"), "resolved": ("F",)}
    return rows(spark, sf).select("key", *[F.col("status").isin(*preset[name]).alias(f"is_{name}") for name in preset])


@query("I05_match_any", WITH + f"SELECT key FROM tickets WHERE {ANY}")
def _match(spark, sf):
    return rows(spark, sf).where(tickets.match_any(TERMS, list(WEIGHTS))).select("key")


@query("I06_weighted_score", WITH + f"SELECT key, {SCORE} AS score FROM tickets WHERE {ANY}")
def _score(spark, sf):
    return rows(spark, sf).where(tickets.match_any(TERMS, list(WEIGHTS))).select("key", tickets.score(TERMS, WEIGHTS).alias("score"))


@query("I07_status_filter", WITH + "SELECT status, count(*) AS n FROM tickets WHERE status NOT IN ('F') GROUP BY status")
def _status_filter(spark, sf):
    return rows(spark, sf).where(~F.col("status").isin("F")).groupBy("status").agg(one().alias("n"))


@query("I08_since_months", WITH + f"SELECT key FROM tickets WHERE created > DATE '{AS_OF}' - INTERVAL 4 MONTH AND created <= DATE '{AS_OF}'")
def _since(spark, sf):
    as_of = F.lit(AS_OF).cast("date")
    return rows(spark, sf).where((F.col("created") > F.add_months(as_of, -4)) & (F.col("created") <= as_of)).select("key")


@query("I09_client_filter", WITH + "SELECT key, client FROM tickets WHERE client ILIKE '%0000007%' OR vertical ILIKE '%0000007%'")
def _client(spark, sf):
    return rows(spark, sf).where(tickets.match_any(("0000007",), ("client", "vertical"))).select("key", "client")


@query("I10_exclude_keys", WITH + f"SELECT key FROM tickets t WHERE ({ANY}) AND key NOT IN (SELECT key FROM tickets WHERE priority LIKE '1%')")
def _exclude(spark, sf):
    t = rows(spark, sf)
    return t.where(tickets.match_any(TERMS, list(WEIGHTS))).join(t.where(F.col("priority").startswith("1")).select("key"), "key", "left_anti").select("key")


@query("I11_top", WITH + f"SELECT key, {SCORE} AS score, CAST(created AS VARCHAR) AS created FROM tickets WHERE {ANY} ORDER BY score DESC, tickets.created DESC, key LIMIT 15")
def _top(spark, sf):
    return tickets.top(rows(spark, sf), TERMS, WEIGHTS, 15).select("key", "score", F.col("created").cast("string").alias("created"))


@query("I12_count", WITH + f"SELECT substr(key, 1, 3) AS kind, count(*) AS n FROM tickets WHERE {ANY} GROUP BY kind")
def _count(spark, sf):
    return rows(spark, sf).where(tickets.match_any(TERMS, list(WEIGHTS))).groupBy(F.substring("key", 1, 3).alias("kind")).agg(one().alias("n"))


@query("I13_oldest", WITH + f"SELECT key, CAST(created AS VARCHAR) AS created FROM tickets WHERE {ANY} ORDER BY tickets.created, key LIMIT 1")
def _oldest(spark, sf):
    found = rows(spark, sf).where(tickets.match_any(TERMS, list(WEIGHTS))).agg(F.min(F.struct("created", "key")).alias("m"))
    return found.where("m is not null").select("m.key", F.col("m.created").cast("string").alias("created"))


FIRST = f"a AS (SELECT key, 0 AS pass FROM tickets WHERE {ANY} ORDER BY {SCORE} DESC, created DESC, key LIMIT 15)"


@query("I14_second_pass", WITH + f", {FIRST}, b AS (SELECT key, 1 AS pass FROM tickets WHERE summary ILIKE '%ring%' AND key NOT IN (SELECT key FROM a) ORDER BY created DESC, key LIMIT 8) SELECT * FROM a UNION ALL SELECT * FROM b")
def _second(spark, sf):
    t = rows(spark, sf)
    a = tickets.top(t, TERMS, WEIGHTS, 15).select("key")
    b = tickets.top(t.join(a, "key", "left_anti"), ("ring",), {"summary": 1}, 8).select("key")
    return a.withColumn("pass", F.lit(0)).unionByName(b.withColumn("pass", F.lit(1)))


@query("I15_relax_retry", WITH + """, u AS (SELECT key, created, 0 AS tier FROM tickets WHERE summary ILIKE '%red widget%' UNION ALL SELECT key, created, 1 FROM tickets WHERE description ILIKE '%widget%' AND created > DATE '1998-01-01' UNION ALL SELECT key, created, 2 FROM tickets WHERE description ILIKE '%widget%')
  SELECT key, tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier) AS r FROM u) WHERE r = 1 ORDER BY tier, created DESC, key LIMIT 40""")
def _relax(spark, sf):
    late = F.col("created") > F.lit("1998-01-01").cast("date")
    widget = tickets.match_any(("widget",), ("description",))
    tiers = [(tickets.match_any(("red widget",), ("summary",)), "strict"), (widget & late, "more columns"), (widget, "any date")]
    return tickets.relaxed(rows(spark, sf), tiers, 40).select("key", "tier")


RECENT = f"CASE WHEN date_diff('day', created, DATE '{AS_OF}') <= 30 THEN 3 WHEN date_diff('day', created, DATE '{AS_OF}') <= 90 THEN 2 WHEN date_diff('day', created, DATE '{AS_OF}') <= 180 THEN 1 ELSE 0 END"


@query("I17_export_search", WITH + f"SELECT key, 3 * CAST(summary ILIKE '%widget%' AS INTEGER) + CAST(description ILIKE '%widget%' AS INTEGER) + CAST(root_cause ILIKE '%widget%' AS INTEGER) + {RECENT} AS score FROM tickets WHERE key LIKE 'TRI-%' AND (summary || description || root_cause) ILIKE '%widget%' AND created <= DATE '{AS_OF}' AND created > DATE '{AS_OF}' - 360")
def _export(spark, sf):
    as_of = F.lit(AS_OF).cast("date")
    t = rows(spark, sf).where(F.col("key").startswith("TRI-") & (F.col("created") <= as_of) & (F.col("created") > F.date_sub(as_of, 360)))
    t = t.where(tickets.match_any(("widget",), ("summary", "description", "root_cause")))
    age = F.datediff(as_of, "created")
    recent = F.when(age <= 30, 3).when(age <= 90, 2).when(age <= 180, 1).otherwise(0)
    return t.select("key", (tickets.score(("widget",), {"summary": 3, "description": 1, "root_cause": 1}) + recent).alias("score"))


@query("I18_mirror_search", WITH + "SELECT key, 3 * CAST(summary ILIKE '%ring%' AS INTEGER) + CAST(root_cause ILIKE '%ring%' AS INTEGER) AS score FROM tickets WHERE summary ILIKE '%ring%' OR root_cause ILIKE '%ring%' ORDER BY score DESC, created DESC, key LIMIT 10")
def _mirror(spark, sf):
    return tickets.top(rows(spark, sf), ("ring",), {"summary": 3, "root_cause": 1}, 10).select("key", "score")


@query("I19_single_table_search", WITH + f"SELECT key, {SCORE} AS score FROM tickets WHERE key LIKE 'RCA-%' AND ({ANY}) ORDER BY score DESC, created DESC, key LIMIT 5")
def _single(spark, sf):
    return tickets.top(rows(spark, sf).where(F.col("key").startswith("RCA-")), TERMS, WEIGHTS, 5).select("key", "score")


@query("I20_merge_sources", WITH + ", u AS (SELECT key, status, 0 AS src FROM tickets WHERE priority LIKE '1%' UNION ALL SELECT key, status, 1 FROM tickets WHERE status = 'P') SELECT key, status, src FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src) AS r FROM u) WHERE r = 1")
def _merge(spark, sf):
    t = rows(spark, sf)
    u = t.where(F.col("priority").startswith("1")).select("key", "status", F.lit(0).alias("src")).unionByName(t.where("status = 'P'").select("key", "status", F.lit(1).alias("src")))
    return dedup.first_of(u, ["key"], "src")


@query("I22_group_breakdown", WITH + "SELECT root_cause, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM tickets GROUP BY root_cause")
def _breakdown(spark, sf):
    g = rows(spark, sf).groupBy("root_cause").agg(one().alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all")))).select("root_cause", "n", F.round(100 * F.col("n") / F.col("all"), 4).alias("pct"))


@query("I23_trend", WITH + "SELECT strftime(date_trunc('month', created), '%Y-%m') AS month, count(*) AS n, count(*) - lag(count(*)) OVER (ORDER BY strftime(date_trunc('month', created), '%Y-%m')) AS delta FROM tickets GROUP BY month")
def _trend(spark, sf):
    g = rows(spark, sf).groupBy(F.date_format("created", "yyyy-MM").alias("month")).agg(one().alias("n"))
    return g.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("month")))


LINKED_ISSUES = "li AS (SELECT o AS number, string_agg(link, ', ' ORDER BY link) AS linked FROM (SELECT DISTINCT l_orderkey AS o, 'N' || s_nationkey || '-' || s_suppkey AS link FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY o)"


@query("I24_linked_project_filter", WITH + f"SELECT key, linked FROM tickets JOIN ({'WITH ' + LINKED_ISSUES} SELECT * FROM li) ON number = CAST(substr(key, 5) AS BIGINT) WHERE linked LIKE 'N3-%' OR linked LIKE '%, N3-%'")
def _linked(spark, sf):
    """Tickets whose stored list of linked issues (the suppliers of their items) names a project's."""
    items = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    link = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"), F.lit("-"), F.col("s_suppkey").cast("string"))
    stored = items.groupBy(F.col("l_orderkey").alias("number")).agg(F.array_join(F.array_sort(F.collect_set(link)), ", ").alias("linked"))
    t = rows(spark, sf).withColumn("number", F.substring("key", 5, 20).cast("long")).join(stored, "number")
    return tickets.linked_to(t, "linked", "N3").select("key", "linked")
