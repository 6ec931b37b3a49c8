"""Views over the test tables in the shapes that the operators take: chunks, tags, entities, tickets, events.
Each has a Spark form and the SQL of the same rows (CTE) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking
from quarry.plans.registry import table

CATEGORIES = ("troubleshooting", "queries", "sop", "manual", "general")

WORDS = r"""w AS (SELECT doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)"""
CHUNKS = WORDS + r""",
k AS (SELECT doc_id, lang, source, words, unnest(range(0, CAST(ceil(greatest(len(words) - 300, 0) / 250.0) AS BIGINT) + 1)) AS k FROM w WHERE len(words) > 0),
p AS (SELECT doc_id, lang, source, k, array_to_string(list_slice(words, k * 250 + 1, k * 250 + 300), ' ') AS text FROM k),
chunks AS (SELECT 'doc' || doc_id || '::chunk' || lpad(CAST(k + 1 AS VARCHAR), 3, '0') || '::' || substr(sha256(text), 1, 8) AS id, doc_id, k, text, lang, source,
  CASE doc_id % 5 WHEN 0 THEN 'troubleshooting' WHEN 1 THEN 'queries' WHEN 2 THEN 'sop' WHEN 3 THEN 'manual' ELSE 'general' END AS category FROM p)"""
TAGS = CHUNKS + r""",
tw AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}]{4,}')) AS word FROM chunks) GROUP BY id, word),
tr AS (SELECT id, word, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS r FROM tw),
tk AS (SELECT id, list(word ORDER BY r) AS keywords FROM tr WHERE r <= 6 GROUP BY id),
tagged AS (SELECT c.*, coalesce(tk.keywords, []) AS keywords, list_concat(list_concat([c.category], coalesce(tk.keywords, [])), [c.lang]) AS tags FROM chunks c LEFT JOIN tk ON c.id = tk.id)"""
#: What the search reads: chunks with tags, a cluster and whether they were learned; and their entities.
SEARCHED = r"""lo AS (SELECT id, lower(text) AS low, tags, keywords, array_to_string(list_sort(tags[1:2]), '+') AS cluster, category = 'general' AND k = 0 AS learned FROM tagged)"""
ENTITIES = CHUNKS + r""",
ew AS (SELECT DISTINCT id, doc_id, word FROM (SELECT id, doc_id, unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}{4,}')) AS word FROM chunks)),
er AS (SELECT id, doc_id, word, CASE WHEN length(word) % 2 = 0 THEN 'ORG' ELSE 'PRODUCT' END AS label FROM ew),
entities AS (SELECT id, doc_id, label, word FROM (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY word) AS r FROM er) WHERE r <= 10)"""
TICKETS = """lp AS (SELECT l_orderkey, p_name, p_type, p_brand FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE r = 1),
tickets AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'RCA-' ELSE 'TRI-' END || o_orderkey AS key, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS created,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) END AS updated, o_orderpriority AS priority, c_mktsegment AS vertical, c_name AS client,
  coalesce(p_name, '') AS summary, coalesce(p_type, '') AS root_cause, coalesce(p_name || ' ' || p_brand, '') AS description
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lp ON l_orderkey = o_orderkey)"""
ACCESS = """log AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'search_kb' WHEN 'click' THEN 'search_jira' WHEN 'purchase' THEN 'build_index' WHEN 'signup' THEN 'learn' ELSE 'tool_error' END AS event,
  CAST(floor(value * 100) AS BIGINT) AS duration_ms, CASE CAST(json_extract(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'Quick' WHEN 1 THEN 'Standard' WHEN 2 THEN 'Deep' ELSE 'Exhaustive' END AS level,
  '10.0.0.' || (user_id % 50) AS client_ip, CASE WHEN event_id % 7 = 0 THEN 'anonymous' ELSE CAST(user_id AS VARCHAR) END AS user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS chunks_returned FROM events)"""
STATUS = """st AS (SELECT event_id, user_id AS job_id, ts, value, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'review' WHEN 'view' THEN 'crawling' WHEN 'click' THEN 'synthesizing' ELSE 'queued' END AS status FROM events)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """id, doc_id, k, text, lang, source, category of each 300-word window with 50 words of overlap."""
    d = documents(spark, sf).select("doc_id", "lang", "source", T.words(F.col("text")).alias("words"))
    c = chunking.split_with_overlap(d, "words", 300, 50).select("doc_id", "lang", "source", "k", F.array_join("part", " ").alias("text"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return c.select(chunking.chunk_id(F.col("doc_id"), F.col("k"), F.col("text")).alias("id"), "doc_id", "k", "text", "lang", "source", category.alias("category"))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """chunks with keywords and tags: the category, the six most frequent words of at least four letters, the language."""
    found = T.counted(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    words = F.transform(F.slice(found, 1, 6), lambda x: x["word"])
    t = chunks(spark, sf).withColumn("keywords", F.when(F.col("id").isNotNull(), words).otherwise(F.array().cast("array<string>")))
    return t.withColumn("tags", F.concat(F.array("category"), F.col("keywords"), F.array("lang")))


def searched(tagged: DataFrame) -> DataFrame:
    """id, text, tags, keywords, cluster, learned."""
    return tagged.select("id", "text", "tags", "keywords", F.array_join(F.array_sort(F.slice("tags", 1, 2)), "+").alias("cluster"), ((F.col("category") == "general") & (F.col("k") == 0)).alias("learned"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """id, doc_id, label, word: up to ten capitalised words of each kind in a chunk."""
    return entities_of(chunks(spark, sf))


def entities_of(c: DataFrame) -> DataFrame:
    found = c.select("id", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{4,}"), F.lit(0)))).alias("word"))
    found = found.withColumn("label", F.when(F.length("word") % 2 == 0, "ORG").otherwise("PRODUCT"))
    return found.withColumn("r", F.row_number().over(Window.partitionBy("id", "label").orderBy("word"))).where("r <= 10").select("id", "doc_id", "label", "word")


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    """key, status, created, updated, priority, vertical, client, summary, root_cause, description."""
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("p_partkey"))
    part = first.join(table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    day = F.to_date("o_orderdate")
    return o.select(
        F.concat(F.when(F.col("o_orderkey") % 4 == 0, "RCA-").otherwise("TRI-"), F.col("o_orderkey").cast("string")).alias("key"),
        F.col("o_orderstatus").alias("status"), day.alias("created"),
        F.when(F.col("o_orderkey") % 17 != 0, F.date_add(day, (F.col("o_orderkey") % 30).cast("int"))).alias("updated"),
        F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("vertical"), F.col("c_name").alias("client"),
        F.coalesce("p_name", F.lit("")).alias("summary"), F.coalesce("p_type", F.lit("")).alias("root_cause"),
        F.coalesce(F.concat("p_name", F.lit(" "), "p_brand"), F.lit("")).alias("description"),
    )


def access_log(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, ts, event, duration_ms, level, client_ip, user_id, chunks_returned."""
    name = F.create_map(*[F.lit(x) for kv in {"view": "search_kb", "click": "search_jira", "purchase": "build_index", "signup": "learn"}.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        "event_id", "ts", F.coalesce(name[F.col("event_type")], F.lit("tool_error")).alias("event"), F.floor(F.col("value") * 100).alias("duration_ms"),
        F.element_at(F.array(*map(F.lit, ("Quick", "Standard", "Deep", "Exhaustive"))), (k % 4 + 1).cast("int")).alias("level"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("client_ip"),
        F.when(F.col("event_id") % 7 == 0, "anonymous").otherwise(F.col("user_id").cast("string")).alias("user_id"), k.alias("chunks_returned"),
    )


def job_status(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, job_id, ts, value, status."""
    name = F.create_map(*[F.lit(x) for kv in {"error": "failed", "purchase": "review", "view": "crawling", "click": "synthesizing"}.items() for x in kv])
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"), "ts", "value", F.coalesce(name[F.col("event_type")], F.lit("queued")).alias("status"))
