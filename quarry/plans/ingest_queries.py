"""Queries of incremental ingest, sources and status streams in their batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import folds, upsert
from quarry.plans import fixtures as X
from quarry.plans.registry import query, table

def one():
    return F.count(F.lit(1))

LISTING = "a AS (SELECT doc_id AS key, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id AS key, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 5)"


def listing(spark, sf):
    d = X.documents(spark, sf)
    now = d.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("key"), F.md5("text").alias("hash"))
    then = d.where("doc_id % 11 <> 5").select(F.col("doc_id").alias("key"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return now, then


@query("J01_file_fingerprint", "SELECT doc_id, md5(strlen(text) || ':' || source || ':' || CASE WHEN strlen(text) < 10000000 THEN text ELSE '' END) AS fingerprint FROM documents")
def _fingerprint(spark, sf):
    size = F.octet_length("text")
    return X.documents(spark, sf).select("doc_id", F.md5(F.concat(size.cast("string"), F.lit(":"), "source", F.lit(":"), F.when(size < 10_000_000, F.col("text")).otherwise(F.lit("")))).alias("fingerprint"))


@query("J02_detect_changes", f"WITH {LISTING} SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.key = b.key")
def _changes(spark, sf):
    return upsert.changes(*listing(spark, sf))


@query("J03_remove_docs", f"WITH {X.CHUNKS}, {LISTING} SELECT id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM b LEFT JOIN a ON a.key = b.key WHERE b.key = c.doc_id AND (a.key IS NULL OR a.hash <> b.hash))")
def _remove(spark, sf):
    gone = upsert.changes(*listing(spark, sf)).where("status in ('deleted', 'modified')").select(F.col("key").alias("doc_id"))
    return X.chunks(spark, sf).join(gone, "doc_id", "left_anti").select("id")


@query("J04_mark_processed", f"WITH {LISTING}, u AS (SELECT key, hash, 1 AS run FROM b UNION ALL SELECT key, hash, 2 FROM a) SELECT key, arg_max(hash, run) AS hash, max(run) AS run FROM u GROUP BY key")
def _mark(spark, sf):
    now, then = listing(spark, sf)
    u = then.withColumn("run", F.lit(1)).unionByName(now.withColumn("run", F.lit(2)))
    return u.groupBy("key").agg(F.max_by("hash", "run").alias("hash"), F.max("run").alias("run"))


@query("J05_merge_index", f"WITH {X.CHUNKS}, {LISTING}, s AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.key = b.key) SELECT id, CASE WHEN status = 'unchanged' THEN 'old' ELSE 'new' END AS origin FROM chunks JOIN s ON key = doc_id WHERE status <> 'deleted'")
def _merge(spark, sf):
    """Old chunks without modified and deleted documents, and chunks of new and modified ones."""
    status = upsert.changes(*listing(spark, sf)).withColumnRenamed("key", "doc_id")
    c = X.chunks(spark, sf)
    old = c.join(status.where("status <> 'unchanged'"), "doc_id", "left_anti").join(status, "doc_id", "left_semi").select("id", F.lit("old").alias("origin"))
    new = c.join(status.where("status in ('new', 'modified')"), "doc_id", "left_semi").select("id", F.lit("new").alias("origin"))
    return old.unionByName(new)


BATCHES = """so AS (SELECT key, created, updated, status, -1 AS pos FROM tickets WHERE length(summary) % 2 = 0),
 inc AS (SELECT key, created + 1 AS created, updated + CASE WHEN length(description) % 3 = 0 THEN 5 WHEN length(description) % 3 = 1 THEN 0 ELSE -5 END AS updated, 'N' AS status, CAST(substr(key, 5) AS BIGINT) * 2 AS pos FROM tickets WHERE priority < '4'
   UNION ALL SELECT key, created, updated + 9, 'R', CAST(substr(key, 5) AS BIGINT) * 2 + 1 FROM tickets WHERE priority < '2'),
 ev AS (SELECT * FROM so UNION ALL SELECT * FROM inc)"""


def batches(spark, sf):
    t = X.tickets(spark, sf)
    pos = F.substring("key", 5, 20).cast("long") * 2
    shift = F.when(F.length("description") % 3 == 0, 5).when(F.length("description") % 3 == 1, 0).otherwise(-5)
    stored = t.where(F.length("summary") % 2 == 0).select("key", "created", "updated", "status")
    a = t.where("priority < '4'").select("key", F.date_add("created", 1).alias("created"), F.date_add("updated", shift).alias("updated"), F.lit("N").alias("status"), pos.alias("pos"))
    b = t.where("priority < '2'").select("key", "created", F.date_add("updated", 9).alias("updated"), F.lit("R").alias("status"), (pos + 1).alias("pos"))
    return stored, a.unionByName(b)


@query("J07_upsert_newest", f"WITH {X.TICKETS}, {BATCHES} SELECT key, CAST(arg_min(created, pos) AS VARCHAR) AS created, CAST(max(updated) AS VARCHAR) AS updated, coalesce((SELECT e.status FROM ev e WHERE e.key = ev.key AND e.updated IS NOT NULL ORDER BY e.updated DESC, e.pos LIMIT 1), arg_min(status, pos)) AS status FROM ev GROUP BY key")
def _upsert(spark, sf):
    out = upsert.newest_wins(*batches(spark, sf), "key", "updated", "pos", ("created",))
    return out.select("key", F.col("created").cast("string").alias("created"), F.col("updated").cast("string").alias("updated"), "status")


@query("J08_upsert_counters", f"WITH {X.TICKETS}, {BATCHES}, w AS (SELECT *, max(updated) OVER o AS before, count(*) OVER o AS seen FROM ev WINDOW o AS (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT CASE WHEN seen = 0 THEN 'inserted' WHEN updated IS NOT NULL AND (before IS NULL OR updated > before) THEN 'updated' ELSE 'skipped' END AS status, count(*) AS n FROM w WHERE pos >= 0 GROUP BY 1")
def _counters(spark, sf):
    return upsert.counters(*batches(spark, sf), "key", "updated", "pos")


@query("J09_column_mapping", f"WITH {X.TICKETS} SELECT key, coalesce(nullif(trim(CASE WHEN priority LIKE '1%' THEN '' ELSE root_cause END), ''), nullif(trim(vertical), ''), '') AS cause FROM tickets")
def _mapping(spark, sf):
    a = F.when(F.col("priority").startswith("1"), "").otherwise(F.col("root_cause"))
    empty = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return X.tickets(spark, sf).select("key", F.coalesce(empty(a), empty(F.col("vertical")), F.lit("")).alias("cause"))


@query("J10_import_log", f"WITH {X.TICKETS}, {BATCHES} SELECT 'tickets.csv' AS filename, substr(key, 1, 3) AS kind, count(*) AS n FROM inc GROUP BY kind")
def _import(spark, sf):
    return batches(spark, sf)[1].groupBy(F.lit("tickets.csv").alias("filename"), F.substring("key", 1, 3).alias("kind")).agg(one().alias("n"))


@query("J11_mirror_sync", f"WITH {X.TICKETS}, {BATCHES}, n AS (SELECT key, max(updated) AS updated FROM inc GROUP BY key) SELECT coalesce(so.key, n.key) AS key, CASE WHEN so.key IS NULL THEN 'insert' WHEN n.updated > so.updated OR (so.updated IS NULL AND n.key IS NOT NULL) THEN 'replace' ELSE 'keep' END AS action FROM so FULL JOIN n ON so.key = n.key")
def _mirror(spark, sf):
    stored, incoming = batches(spark, sf)
    n = incoming.groupBy("key").agg(F.max("updated").alias("u")).withColumn("there", F.lit(True))
    j = stored.select("key", "updated", F.lit(True).alias("own")).join(n, "key", "full")
    action = F.when(F.col("own").isNull(), "insert").when((F.col("u") > F.col("updated")) | (F.col("updated").isNull() & F.col("there").isNotNull()), "replace").otherwise("keep")
    return j.select("key", action.alias("action"))


@query("J12_snapshot_diff", f"WITH {X.TICKETS}, {BATCHES} SELECT (SELECT count(*) FROM so) <> (SELECT count(*) FROM tickets) OR (SELECT max(updated) FROM so) <> (SELECT max(updated) FROM tickets) AS differs")
def _diff(spark, sf):
    a = batches(spark, sf)[0].agg(one().alias("n1"), F.max("updated").alias("u1"))
    b = X.tickets(spark, sf).agg(one().alias("n2"), F.max("updated").alias("u2"))
    return a.crossJoin(b).select(((F.col("n1") != F.col("n2")) | (F.col("u1") != F.col("u2"))).alias("differs"))


@query("J13_learned_edit", f"WITH {X.CHUNKS}, e AS (SELECT id, 'edited ' || category AS title FROM chunks WHERE doc_id % 4 = 1) SELECT c.id, coalesce(e.title, c.category) AS title, e.id IS NOT NULL AS edited FROM chunks c LEFT JOIN e ON c.id = e.id WHERE c.doc_id % 9 <> 2")
def _edit(spark, sf):
    c = X.chunks(spark, sf)
    edits = c.where("doc_id % 4 = 1").select("id", F.concat(F.lit("edited "), "category").alias("title"))
    kept = c.join(c.where("doc_id % 9 = 2").select("id"), "id", "left_anti")
    return kept.join(edits, "id", "left").select("id", F.coalesce("title", "category").alias("title"), F.col("title").isNotNull().alias("edited"))


VERSIONS = "v AS (SELECT user_id AS id, event_id AS version, event_type = 'error' AS deleted FROM events)"


@query("J14_learned_versions", f"WITH {VERSIONS} SELECT id, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM v WHERE version <= 6000) WHERE r = 1 AND NOT deleted")
def _versions(spark, sf):
    v = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"))
    return upsert.snapshot(v, 6000).select("id", "version")


@query("J15_pending_sync", f"WITH {X.CHUNKS} SELECT category, count(*) FILTER (WHERE doc_id % 3 = 0) AS pending, count(*) FILTER (WHERE doc_id % 3 <> 0) AS synced FROM chunks GROUP BY category")
def _pending(spark, sf):
    return X.chunks(spark, sf).groupBy("category").agg(F.count_if(F.col("doc_id") % 3 == 0).alias("pending"), F.count_if(F.col("doc_id") % 3 != 0).alias("synced"))


@query("A02_drop_without_id", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS id FROM documents WHERE CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END <> ''")
def _with_id(spark, sf):
    d = X.documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("id"))
    return d.where(F.col("id").isNotNull() & (F.col("id") != ""))


@query("A03_read_text_docs", "SELECT doc_id, strlen(text) AS bytes, md5(text) AS digest FROM documents")
def _text(spark, sf):
    return X.documents(spark, sf).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("digest"))


@query("A08_read_event_log", f"WITH {X.ACCESS} SELECT event_id, event FROM log ORDER BY ts DESC, event_id LIMIT 5000")
def _log(spark, sf):
    return X.access_log(spark, sf).orderBy(F.desc("ts"), "event_id").limit(5000).select("event_id", "event")


@query("A09_read_pages", "SELECT page_id, url, length(html) AS n FROM pages WHERE url LIKE 'http%'")
def _pages(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").startswith("http")).select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("A12_write_manifest", f"WITH {X.CHUNKS} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS files FROM chunks")
def _manifest(spark, sf):
    return X.chunks(spark, sf).agg(one().alias("chunks"), F.count_distinct("doc_id").alias("files"))


@query("A13_export_markdown", f"WITH {X.TAGS} SELECT category, '## ' || id || chr(10) || '**Metadata:** ' || array_to_string(tags, ', ') || chr(10) || '**Content:**' || chr(10) || text || chr(10) || '---' AS markdown FROM tagged")
def _export(spark, sf):
    md = F.concat(F.lit("## "), "id", F.lit("\n**Metadata:** "), F.array_join("tags", ", "), F.lit("\n**Content:**\n"), "text", F.lit("\n---"))
    return X.tagged(spark, sf).select("category", md.alias("markdown"))


@query("N03_usage_windows", f"WITH {X.ACCESS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event, count(*) AS n FROM log GROUP BY ALL")
def _usage(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return X.access_log(spark, sf).groupBy(F.date_format(w.getField("start"), "yyyy-MM-dd HH").alias("hour"), "event").agg(one().alias("n"))


@query("N04_latest_status", f"WITH {X.STATUS} SELECT job_id, arg_max(status, struct_pack(f := status = 'failed', t := ts, e := event_id)) AS status FROM st GROUP BY job_id")
def _latest(spark, sf):
    order = F.struct((F.col("status") == "failed").alias("f"), "ts", "event_id")
    return X.job_status(spark, sf).groupBy("job_id").agg(F.max_by("status", order).alias("status"))


@query("N05_reconcile_tasks", f"WITH {X.STATUS}, l AS (SELECT job_id, arg_max(status, struct_pack(f := status = 'failed', t := ts, e := event_id)) AS status FROM st GROUP BY job_id) SELECT c_custkey AS task_id, CASE WHEN l.status = 'failed' THEN 'failed' WHEN l.status = 'review' THEN 'review' ELSE 'active' END AS state FROM customer JOIN l ON c_custkey = job_id")
def _reconcile(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"))
    state = F.when(F.col("status") == "failed", "failed").when(F.col("status") == "review", "review").otherwise("active")
    return c.join(_latest(spark, sf), F.col("task_id") == F.col("job_id")).select("task_id", state.alias("state"))


@query("N08_quota_view", f"WITH {X.ACCESS} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS used FROM log WHERE user_id <> 'anonymous'")
def _used(spark, sf):
    log = X.access_log(spark, sf).where("user_id <> 'anonymous'").withColumn("ts", F.col("ts").cast("timestamp"))
    hour = F.unix_micros("ts")
    return log.select("event_id", one().over(Window.partitionBy("user_id").orderBy(hour).rangeBetween(-3_600_000_000, 0)).alias("used"))


@query("N09_expire_sessions", f"WITH {X.ACCESS} SELECT user_id, count(*) AS n FROM log GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1440 MINUTE")
def _expire(spark, sf):
    g = X.access_log(spark, sf).groupBy("user_id").agg(one().alias("n"), F.max("ts").alias("last"))
    return g.where(F.col("last") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("user_id", "n")


@query("N10_prune_cancelled", f"WITH {X.STATUS} SELECT event_id, status FROM st WHERE NOT (status = 'failed' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE)")
def _prune(spark, sf):
    old = (F.col("status") == "failed") & (F.col("ts") < F.lit("2024-01-14 23:55:00").cast("timestamp_ntz"))
    return X.job_status(spark, sf).where(~old).select("event_id", "status")


@query("N11_retention_by_count", f"WITH {X.STATUS} SELECT event_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM st) WHERE r <= 50")
def _keep(spark, sf):
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return X.job_status(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 50").select("event_id", "job_id")


@query("N12_ttl_expiry", f"WITH {X.STATUS} SELECT job_id, max(event_id) AS last_event FROM st GROUP BY job_id HAVING max(ts) >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 86400 SECOND")
def _ttl(spark, sf):
    g = X.job_status(spark, sf).groupBy("job_id").agg(F.max("event_id").alias("last_event"), F.max("ts").alias("last"))
    return g.where(F.col("last") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).select("job_id", "last_event")


@query("N13_sessionise", f"WITH {X.ACCESS}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM log), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s")
def _sessions(spark, sf):
    log = X.access_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    g = log.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(one().alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("N14_stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY ALL")
def _dedup(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts")
    return e.unionByName(e).dropDuplicates().groupBy("user_id", "event_type").agg(one().alias("n"))


@query("N07_sliding_rate_limit")
def _rate(spark, sf):
    """Fewer than two accepted events of the user in the hour before."""
    log = X.access_log(spark, sf).select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return folds.rate_limited(log, "user_id")
