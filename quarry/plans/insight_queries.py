"""Queries of insights and usage dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import folds, redact
from quarry.operators.dedup import keyword_set
from quarry.plans import fixtures as X
from quarry.plans.more_queries import EMAILED
from quarry.plans.registry import query, table
from quarry.sources.scratch import written

def one():
    return F.count(F.lit(1))



@query("K01_list_doc_ids", f"WITH {X.CHUNKS} SELECT DISTINCT doc_id FROM chunks")
def _ids(spark, sf):
    return X.chunks(spark, sf).select("doc_id").distinct()


BASICS = "b AS (SELECT doc_id, count(*) AS n_chunks, CAST(sum(len(regexp_extract_all(text, '[^ ]+'))) AS BIGINT) AS n_words, count(DISTINCT k // 2) AS n_pages FROM chunks GROUP BY doc_id)"


def basics(spark, sf):
    return basics_of(X.chunks(spark, sf))


def basics_of(c):
    return c.groupBy("doc_id").agg(one().alias("n_chunks"), F.sum(F.size(F.split("text", " "))).alias("n_words"), F.count_distinct(F.floor(F.col("k") / 2)).alias("n_pages"))


@query("K02_doc_basics", f"WITH {X.CHUNKS}, {BASICS} SELECT *, CAST(greatest(1, round_even(n_words / 220.0, 0)) AS BIGINT) AS minutes FROM b")
def _basics(spark, sf):
    return basics(spark, sf).withColumn("minutes", F.greatest(F.lit(1), F.bround(F.col("n_words") / 220)).cast("long"))


@query("K03_doc_categories_count", f"WITH {X.CHUNKS} SELECT category, count(*) AS n FROM chunks GROUP BY category")
def _categories(spark, sf):
    return X.chunks(spark, sf).groupBy("category").agg(one().alias("n"))


@query("K04_top_entities", f"WITH {X.ENTITIES}, c AS (SELECT doc_id, label, word, count(*) AS n FROM entities GROUP BY ALL) SELECT doc_id, label, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word, label) AS r FROM c) WHERE r <= 15")
def _entities(spark, sf):
    c = X.entities(spark, sf).groupBy("doc_id", "label", "word").agg(one().alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word", "label"))).where("r <= 15").drop("r")


@query("K05_top_tags", f"WITH {X.TAGS}, c AS (SELECT doc_id, tag AS word, count(*) AS n FROM (SELECT doc_id, unnest(tags) AS tag FROM tagged) GROUP BY ALL) SELECT doc_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c) WHERE r <= 15")
def _tags(spark, sf):
    return keyword_set(X.tagged(spark, sf), "doc_id", F.col("tags"), 15)


INSIGHTS = f"""WITH {X.TAGS}{X.ENTITIES[len(X.CHUNKS):]}, {BASICS}, c AS (SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, unnest(tags) AS tag FROM tagged) GROUP BY ALL),
  t AS (SELECT doc_id, string_agg(tag, ',' ORDER BY n DESC, tag) AS top_tags FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, tag) AS r FROM c) WHERE r <= 15 GROUP BY doc_id),
  ec AS (SELECT doc_id, label || '::' || word AS entity, count(*) AS n FROM entities GROUP BY ALL), e AS (SELECT doc_id, string_agg(entity, ',' ORDER BY n DESC, entity) AS top_entities FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, entity) AS r FROM ec) WHERE r <= 15 GROUP BY doc_id),
  rd AS (SELECT doc_id, {EMAILED} AS m, regexp_replace(text, '{redact.ADDRESS}', '<ADDRESS>', 'g') AS a FROM documents)
  SELECT b.doc_id, n_chunks, n_words, n_pages, CAST(greatest(1, round_even(n_words / 220.0, 0)) AS BIGINT) AS minutes, top_tags, coalesce(top_entities, '') AS top_entities, (length(m) - length(replace(m, '<EMAIL>', ''))) // 7 AS emails, (length(a) - length(replace(a, '<ADDRESS>', ''))) // 9 AS addresses
  FROM b JOIN t ON t.doc_id = b.doc_id LEFT JOIN e ON e.doc_id = b.doc_id JOIN rd ON rd.doc_id = b.doc_id"""


@query("K06_doc_insights", INSIGHTS)
def _insights(spark, sf):
    """What a document's page shows: sizes, tags, entities and what was redacted. Chunks and tags are built once."""
    t = written(X.tagged(spark, sf), "tagged")
    joined = lambda best, name: best.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), lambda x: x["word"]), ",").alias(name))
    tags = joined(keyword_set(t, "doc_id", F.col("tags"), 15), "top_tags")
    entities = X.entities_of(t).select("doc_id", F.array(F.concat("label", F.lit("::"), "word")).alias("one"))
    found = joined(keyword_set(entities, "doc_id", F.col("one"), 15), "top_entities")
    n = lambda clean, mark: T.occurrences(clean, F.lit(mark)).cast("long")
    redacted = X.documents(spark, sf).select("doc_id", n(redact.emails(F.col("text"), ("example.org",)), "<EMAIL>").alias("emails"), n(redact.addresses(F.col("text")), "<ADDRESS>").alias("addresses"))
    minutes = F.greatest(F.lit(1), F.bround(F.col("n_words") / 220)).cast("long").alias("minutes")
    all_ = basics_of(t).join(tags, "doc_id").join(found, "doc_id", "left").join(redacted, "doc_id")
    return all_.select("doc_id", "n_chunks", "n_words", "n_pages", minutes, "top_tags", F.coalesce("top_entities", F.lit("")).alias("top_entities"), "emails", "addresses")


@query("K07_faceted_search", f"WITH {X.TAGS}, f AS (SELECT * FROM tagged WHERE contains(lower(text), 'the')), c AS (SELECT 'category' AS facet, category AS value FROM f UNION ALL SELECT 'tag', unnest(keywords) FROM f UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR) FROM f), n AS (SELECT facet, value, count(*) AS n FROM c GROUP BY ALL) SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM n) WHERE r <= 30")
def _facets(spark, sf):
    f = X.tagged(spark, sf).where(F.contains(F.lower("text"), F.lit("the")))
    facets = F.concat(F.array(F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")), F.struct(F.lit("document").alias("facet"), F.col("doc_id").cast("string").alias("value"))), F.transform("keywords", lambda k: F.struct(F.lit("tag").alias("facet"), k.alias("value"))))
    n = f.select(F.inline(facets)).groupBy("facet", "value").agg(one().alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where("r <= 30").drop("r")


@query("K08_token_metrics", f"WITH {X.CHUNKS}, d AS (SELECT count(*) AS docs, CAST(sum(length(text) // 4) AS BIGINT) AS doc_tokens FROM documents), c AS (SELECT count(*) AS n_chunks, CAST(sum(length(text) // 4) AS BIGINT) AS chunk_tokens FROM chunks) SELECT docs, n_chunks, doc_tokens, chunk_tokens, doc_tokens - chunk_tokens AS saved, round(100.0 * (doc_tokens - chunk_tokens) / doc_tokens, 1) AS pct FROM d, c")
def _tokens(spark, sf):
    tokens = F.sum(F.floor(F.length("text") / 4))
    d = X.documents(spark, sf).agg(one().alias("docs"), tokens.alias("doc_tokens"))
    both = d.crossJoin(X.chunks(spark, sf).agg(one().alias("n_chunks"), tokens.alias("chunk_tokens")))
    saved = F.col("doc_tokens") - F.col("chunk_tokens")
    return both.select("docs", "n_chunks", "doc_tokens", "chunk_tokens", saved.alias("saved"), F.round(100 * saved / F.col("doc_tokens"), 1).alias("pct"))


@query("K09_index_stats", f"WITH {X.CHUNKS} SELECT coalesce(category, 'total') AS category, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM chunks GROUP BY ROLLUP (category)")
def _stats(spark, sf):
    return X.chunks(spark, sf).rollup("category").agg(one().alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs")).withColumn("category", F.coalesce("category", F.lit("total")))


@query("K10_size_estimate", f"WITH {X.CHUNKS} SELECT category, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(100.0 * sum(strlen(text)) / sum(sum(strlen(text))) OVER (), 4) AS pct FROM chunks GROUP BY category")
def _sizes(spark, sf):
    g = X.chunks(spark, sf).groupBy("category").agg(one().alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("bytes").alias("all")))).select("category", "n", "bytes", F.round(100 * F.col("bytes") / F.col("all"), 4).alias("pct"))


@query("K11_admin_counts", "SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_codes, (SELECT count(DISTINCT user_id) FROM events) AS sessions, (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-16 00:00:00') AS last_day")
def _admin(spark, sf):
    c = table(spark, sf, "customer").agg(one().alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active_codes"))
    day = (F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")) & (F.col("ts") <= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    return c.crossJoin(table(spark, sf, "events").agg(F.count_distinct("user_id").alias("sessions"), F.count_if(day).alias("last_day")))


def log(spark, sf):
    return X.access_log(spark, sf)


@query("K12_activity_query", f"WITH {X.ACCESS} SELECT event_id, event, (SELECT count(*) FROM log WHERE event = 'learn') AS total, (SELECT count(*) FROM log) AS total_all FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS r FROM log WHERE event = 'learn') WHERE r BETWEEN 11 AND 30")
def _activity(spark, sf):
    rows = log(spark, sf).where("event = 'learn'").orderBy(F.desc("ts"), "event_id").offset(10).limit(20)
    totals = log(spark, sf).agg(F.count_if(F.col("event") == "learn").alias("total"), one().alias("total_all"))
    return rows.select("event_id", "event").crossJoin(F.broadcast(totals))


@query("K13_perf_page", f"WITH {X.ACCESS} SELECT event_id, duration_ms, CAST(ceil((SELECT count(*) FROM log) / 20.0) AS BIGINT) AS pages FROM log ORDER BY event_id DESC LIMIT 20 OFFSET 20")
def _perf(spark, sf):
    pages = log(spark, sf).agg(F.ceil(one() / 20).alias("pages"))
    return log(spark, sf).orderBy(F.desc("event_id")).offset(20).limit(20).select("event_id", "duration_ms").crossJoin(F.broadcast(pages))


@query("K14_rolling_retention", f"WITH {X.ACCESS} SELECT event_id, event FROM log ORDER BY event_id DESC LIMIT 100")
def _retention(spark, sf):
    return log(spark, sf).orderBy(F.desc("event_id")).limit(100).select("event_id", "event")


CLIENT = "CASE WHEN user_id = 'anonymous' THEN client_ip ELSE user_id || ' (' || client_ip || ')' END"


@query("K15_calls_by_client", f"WITH {X.ACCESS} SELECT event, level, {CLIENT} AS client, count(*) AS n FROM log GROUP BY ALL")
def _clients(spark, sf):
    client = F.when(F.col("user_id") == "anonymous", F.col("client_ip")).otherwise(F.concat("user_id", F.lit(" ("), "client_ip", F.lit(")")))
    return log(spark, sf).groupBy("event", "level", client.alias("client")).agg(one().alias("n"))


@query("K16_avg_duration", f"WITH {X.ACCESS} SELECT event, CAST(round(avg(duration_ms)) AS BIGINT) AS avg_ms FROM log GROUP BY event")
def _duration(spark, sf):
    return log(spark, sf).groupBy("event").agg(F.round(F.avg("duration_ms")).cast("long").alias("avg_ms"))


@query("K17_calls_by_day", f"WITH {X.ACCESS} SELECT CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE event = 'search_kb') AS search_kb, count(*) FILTER (WHERE event = 'learn') AS learn, count(*) AS total FROM log GROUP BY day")
def _days(spark, sf):
    day = F.to_date(F.col("ts") - F.expr("interval 6 hours")).cast("string")
    return log(spark, sf).groupBy(day.alias("day")).agg(F.count_if(F.col("event") == "search_kb").alias("search_kb"), F.count_if(F.col("event") == "learn").alias("learn"), one().alias("total"))


@query("K18_kpis", f"WITH {X.ACCESS} SELECT count(*) AS total_calls, count(*) FILTER (WHERE event = 'tool_error') AS total_errors, round(avg(chunks_returned), 4) AS avg_chunks, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_activity FROM log")
def _kpis(spark, sf):
    return log(spark, sf).agg(one().alias("total_calls"), F.count_if(F.col("event") == "tool_error").alias("total_errors"), F.round(F.avg("chunks_returned"), 4).alias("avg_chunks"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_activity"))


@query("K19_event_list", f"WITH {X.ACCESS} SELECT event_id, event, client_ip FROM log WHERE event = 'search_kb' AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, event_id LIMIT 50")
def _events(spark, sf):
    since = F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return log(spark, sf).where(since & (F.col("event") == "search_kb")).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event", "client_ip")


@query("K20_error_list", f"WITH {X.ACCESS} SELECT event_id, user_id, (SELECT count(*) FROM log WHERE event = 'tool_error') AS total FROM log WHERE event = 'tool_error' ORDER BY ts DESC, event_id LIMIT 200")
def _errors(spark, sf):
    bad = log(spark, sf).where("event = 'tool_error'")
    return bad.orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "user_id").crossJoin(F.broadcast(bad.agg(one().alias("total"))))


@query("K21_learned_stats", f"WITH {X.ACCESS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(chunks_returned) AS BIGINT) AS size FROM log WHERE event = 'learn' GROUP BY day")
def _learned(spark, sf):
    return log(spark, sf).where("event = 'learn'").groupBy(F.to_date("ts").cast("string").alias("day")).agg(one().alias("n"), F.sum("chunks_returned").alias("size"))


@query("K22_list_recent", f"WITH {X.ACCESS} SELECT event_id, substr(user_id, 1, 80) AS title FROM log WHERE event = 'learn' ORDER BY ts DESC, event_id LIMIT 50")
def _recent(spark, sf):
    return log(spark, sf).where("event = 'learn'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", F.substring("user_id", 1, 80).alias("title"))


@query("K23_dashboard_30d", f"WITH {X.ACCESS}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-10', DATE '2024-02-08', INTERVAL 1 DAY)) AS DATE) AS day), n AS (SELECT CAST(ts AS DATE) AS day, event, count(*) AS n FROM log GROUP BY ALL), e AS (SELECT DISTINCT event FROM log) SELECT CAST(d.day AS VARCHAR) AS day, e.event, coalesce(n.n, 0) AS n FROM d CROSS JOIN e LEFT JOIN n ON d.day = n.day AND e.event = n.event")
def _month(spark, sf):
    days = F.explode(F.sequence(F.lit("2024-01-10").cast("date"), F.lit("2024-02-08").cast("date"))).alias("day")
    grid = log(spark, sf).select("event").distinct().select("event", days)
    n = log(spark, sf).groupBy(F.to_date("ts").alias("day"), "event").agg(one().alias("n"))
    return grid.join(n, ["day", "event"], "left").select(F.col("day").cast("string").alias("day"), "event", F.coalesce("n", F.lit(0)).alias("n"))


@query("K24_event_sort", f"WITH {X.ACCESS} SELECT event_id, duration_ms FROM log WHERE contains(client_ip, '0.7') ORDER BY duration_ms DESC, event_id LIMIT 100")
def _sorted(spark, sf):
    return log(spark, sf).where(F.contains("client_ip", F.lit("0.7"))).orderBy(F.desc("duration_ms"), "event_id").limit(100).select("event_id", "duration_ms")


@query("K25_library_counts", f"WITH {X.STATUS} SELECT job_id, count(*) AS tasks, count(*) FILTER (WHERE status IN ('queued', 'crawling', 'synthesizing')) AS active FROM st GROUP BY job_id")
def _library(spark, sf):
    return X.job_status(spark, sf).groupBy("job_id").agg(one().alias("tasks"), F.count_if(F.col("status").isin("queued", "crawling", "synthesizing")).alias("active"))


@query("K26_task_list", f"WITH {X.STATUS}, t AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id) AS r FROM st) SELECT t.job_id, event_id, status, c_name FROM t LEFT JOIN customer ON c_custkey = t.job_id WHERE r <= 5")
def _tasks(spark, sf):
    t = X.job_status(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ts"), "event_id"))).where("r <= 5")
    return t.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("job_id"), "left").select("job_id", "event_id", "status", "c_name")


@query("K27_quota_check", f"WITH {X.STATUS}, u AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE status = 'queued') AS active FROM st GROUP BY job_id) SELECT job_id, CASE WHEN n >= 25 THEN 'total_cap' WHEN active >= 2 THEN 'too_many_active' ELSE 'ok' END AS decision FROM u")
def _quota(spark, sf):
    u = X.job_status(spark, sf).groupBy("job_id").agg(one().alias("n"), F.count_if(F.col("status") == "queued").alias("active"))
    return u.select("job_id", F.when(F.col("n") >= 25, "total_cap").when(F.col("active") >= 2, "too_many_active").otherwise("ok").alias("decision"))


@query("K28_daily_request_limit", f"WITH {X.ACCESS} SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) > 2 OR row_number() OVER (PARTITION BY client_ip, CAST(ts AS DATE) ORDER BY ts, event_id) > 2 AS over_limit FROM log")
def _limit(spark, sf):
    return folds.over_daily_limit(log(spark, sf), ("user_id", "client_ip"), F.to_date("ts"))


@query("K29_chat_sessions", "SELECT conv_id, count(*) AS turns, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user_text FROM conversations GROUP BY conv_id")
def _chats(spark, sf):
    c = table(spark, sf, "conversations")
    user = F.col("role") == "user"
    return c.groupBy("conv_id").agg(one().alias("turns"), F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("last_user_text"))


@query("K30_session_title", "SELECT conv_id, substr(arg_min(text, turn), 1, 100) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _titles(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 100).alias("title"))


@query("K31_latency_summary", f"WITH {X.ACCESS} SELECT event, count(*) AS n, round(avg(duration_ms), 3) AS avg_ms, round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.95), 3) AS p95 FROM log GROUP BY event")
def _latency(spark, sf):
    p = lambda q: F.round(F.percentile("duration_ms", q), 3)
    return log(spark, sf).groupBy("event").agg(one().alias("n"), F.round(F.avg("duration_ms"), 3).alias("avg_ms"), p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("K32_chunk_size_profile", f"WITH {X.CHUNKS} SELECT category, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS total, max(length(text)) AS longest, quantile_cont(length(text), 0.9) AS p90 FROM chunks GROUP BY category")
def _profile(spark, sf):
    size = F.length("text")
    return X.chunks(spark, sf).groupBy("category").agg(one().alias("n"), F.sum(size).alias("total"), F.max(size).cast("long").alias("longest"), F.percentile(size, 0.9).alias("p90"))


@query("K33_latest_contact", "SELECT c_custkey, arg_max(o_orderpriority, struct_pack(d := o_orderdate, k := o_orderkey)) AS contact FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey")
def _contact(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("c_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("contact"))


@query("K34_learned_filter", f"WITH {X.CHUNKS} SELECT id, category FROM chunks WHERE category IN ('sop', 'manual') AND text ILIKE '%the%' AND source IN ('src1', 'src2')")
def _filter(spark, sf):
    return X.chunks(spark, sf).where(F.col("category").isin("sop", "manual") & F.ilike("text", F.lit("%the%")) & F.col("source").isin("src1", "src2")).select("id", "category")
