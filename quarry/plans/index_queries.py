"""Queries of quality gates, redaction, duplicates, tags and links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import dedup, links, nearest, quality, redact
from quarry.plans import fixtures as X
from quarry.plans.registry import query, table

TOP = "coalesce(list_max(map_values(list_histogram(list_transform(words, lambda x: lower(x))))), 0)"
NOISE = "CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[ -~]', '', 'g')) / length(text)::DOUBLE ELSE 0 END"
REASON = f"CASE WHEN len(words) < 15 THEN 'too_short' WHEN {NOISE} > 0.15 THEN 'noisy' WHEN {TOP} > 0.5 * len(words) THEN 'repetitive' %s END"


@query("DQ1_is_quality_chunk", f"WITH {X.WORDS} SELECT doc_id, ({REASON % ''}) IS NULL AS good FROM w")
def _good(spark, sf):
    return quality.reason(X.documents(spark, sf), "text", 15).select("doc_id", F.col("reason").isNull().alias("good"))


LETTERS = "WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.35 * length(text) THEN 'few_letters'"


@query("DQ2_gate_quality", f"WITH {X.WORDS} SELECT doc_id, coalesce({REASON % LETTERS}, 'ok') AS reason FROM w")
def _gate(spark, sf):
    return quality.reason(X.documents(spark, sf), "text", 15, 0.35).select("doc_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


COVER = "c AS (SELECT d.doc_id, length(d.text) AS original, coalesce(sum(length(c.text)), 0) AS kept, count(c.id) AS n_chunks FROM documents d LEFT JOIN chunks c ON d.doc_id = c.doc_id GROUP BY d.doc_id, d.text)"


def coverage(spark, sf):
    kept = X.chunks(spark, sf).groupBy("doc_id").agg(F.sum(F.length("text")).alias("kept"), F.count(F.lit(1)).alias("n_chunks"))
    d = X.documents(spark, sf).select("doc_id", F.length("text").cast("long").alias("original")).join(kept, "doc_id", "left")
    d = d.select("doc_id", "original", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return d.withColumn("ratio", F.round(F.col("kept") / F.greatest("original", F.lit(1)), 6)).withColumn("low", F.col("ratio") < 0.7)


RATIO = "SELECT *, round(kept / greatest(original, 1)::DOUBLE, 6) AS ratio, round(kept / greatest(original, 1)::DOUBLE, 6) < 0.7 AS low FROM c"


@query("DQ3_extraction_coverage", f"WITH {X.CHUNKS}, {COVER} SELECT doc_id, original, CAST(kept AS BIGINT) AS kept, n_chunks, ratio, low FROM ({RATIO})")
def _coverage(spark, sf):
    return coverage(spark, sf)


@query("DQ4_coverage_report", f"WITH {X.CHUNKS}, {COVER} SELECT count(*) AS n_files, round(avg(ratio), 6) AS avg_ratio, count(*) FILTER (WHERE low) AS n_low FROM ({RATIO})")
def _report(spark, sf):
    return coverage(spark, sf).agg(F.count(F.lit(1)).alias("n_files"), F.round(F.avg("ratio"), 6).alias("avg_ratio"), F.count_if("low").alias("n_low"))


@query("DQ5_verify_tags", f"WITH {X.TAGS} SELECT CASE WHEN contains(tag, chr(10)) THEN 'newline' WHEN length(tag) > 50 THEN 'long' WHEN contains(tag, '--') THEN 'dashes' ELSE 'ok' END AS issue, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY issue")
def _verify_tags(spark, sf):
    t = F.col("tag")
    issue = F.when(F.contains(t, F.lit("\n")), "newline").when(F.length(t) > 50, "long").when(F.contains(t, F.lit("--")), "dashes").otherwise("ok")
    return X.tagged(spark, sf).select(F.explode("tags").alias("tag")).groupBy(issue.alias("issue")).agg(F.count(F.lit(1)).alias("n"))


@query("DQ6_verify_dups", f"WITH {X.CHUNKS} SELECT sha256(substr(text, 1, 500)) AS h, count(*) AS n, min(id) AS first_id FROM chunks GROUP BY h HAVING count(*) > 1")
def _verify_dups(spark, sf):
    return X.chunks(spark, sf).groupBy(F.sha2(F.substring("text", 1, 500), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query("DQ7_verify_xrefs", f"WITH {X.TAGS} SELECT count(*) AS n, round(100 * avg(CASE WHEN len(keywords) > 0 THEN 1.0 ELSE 0 END), 4) AS keyword_pct, round(avg(len(tags)), 6) AS avg_tags, avg(CASE WHEN len(keywords) > 0 THEN 1.0 ELSE 0 END) > 0.8 AS passed FROM tagged")
def _verify_xrefs(spark, sf):
    has = F.when(F.size("keywords") > 0, 1.0).otherwise(0.0)
    return X.tagged(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(has), 4).alias("keyword_pct"), F.round(F.avg(F.size("tags")), 6).alias("avg_tags"), (F.avg(has) > 0.8).alias("passed"))


RETIRED = ("page_start", "page_end", "nlp_category")


@query("DQ8_verify_metadata", f"WITH {X.CHUNKS} SELECT count(*) AS n, count(*) FILTER (WHERE k % 3 = 0) AS page_start, count(*) FILTER (WHERE k % 3 = 1) AS page_end, count(*) FILTER (WHERE doc_id % 9 = 0) AS nlp_category, count(*) FILTER (WHERE k % 3 < 2 OR doc_id % 9 = 0) AS any_of_them FROM chunks")
def _verify_metadata(spark, sf):
    """Metadata as they are written, JSON text: each retired field's rows and those that have any of them."""
    parts = {"page_start": F.when(F.col("k") % 3 == 0, F.col("k")), "page_end": F.when(F.col("k") % 3 == 1, F.col("k")), "nlp_category": F.when(F.col("doc_id") % 9 == 0, F.col("category"))}
    rows = X.chunks(spark, sf).select(F.to_json(F.struct("doc_id", *[c.alias(n) for n, c in parts.items()])).alias("metadata"))
    return quality.retired_fields(rows, "metadata", RETIRED)


MARKED = "'<EMAIL> ' || text || ' <PHONE> <EMAIL>'"


@query("DP11_count_redactions", f"SELECT doc_id, (length(t) - length(replace(t, '<EMAIL>', ''))) // 7 AS emails, (length(t) - length(replace(t, '<PHONE>', ''))) // 7 AS phones FROM (SELECT doc_id, {MARKED} AS t FROM documents)")
def _redactions(spark, sf):
    t = F.concat(F.lit("<EMAIL> "), "text", F.lit(" <PHONE> <EMAIL>"))
    return X.documents(spark, sf).select("doc_id", T.occurrences(t, F.lit("<EMAIL>")).cast("long").alias("emails"), T.occurrences(t, F.lit("<PHONE>")).cast("long").alias("phones"))


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("DP1_redact_bearer", f"SELECT doc_id, regexp_replace('Bearer ' || sha256(text) || ' ' || text, '{_sql(redact.BEARER)}', '\\1 <CREDENTIAL>', 'g') AS clean FROM documents")
def _bearer(spark, sf):
    return X.documents(spark, sf).select("doc_id", redact.bearer(F.concat(F.lit("Bearer "), F.sha2("text", 256), F.lit(" "), "text")).alias("clean"))


@query("DP3_redact_credentials", f"SELECT doc_id, regexp_replace(text || ' password=' || source || 'x9', '{_sql(redact.CREDENTIAL)}', '\\1\\2<CREDENTIAL>', 'g') AS clean FROM documents")
def _credentials(spark, sf):
    return X.documents(spark, sf).select("doc_id", redact.credentials(F.concat("text", F.lit(" password="), "source", F.lit("x9"))).alias("clean"))


@query("DP10_sanitize")
def _sanitize(spark, sf):
    return X.documents(spark, sf).select("doc_id", redact.sanitize(F.col("text"), ("example.org",), ("Alex Doe",)).alias("clean"))


@query("DF1_filter_domains", f"WITH {X.TAGS} SELECT id FROM tagged WHERE list_has_any(tags, ['sop', 'manual']) OR NOT EXISTS (SELECT 1 FROM tagged WHERE list_has_any(tags, ['sop', 'manual']))")
def _domains(spark, sf):
    t = X.tagged(spark, sf).withColumn("hit", F.arrays_overlap("tags", F.array(F.lit("sop"), F.lit("manual"))))
    any_hit = t.agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("any_hit"))
    return t.crossJoin(F.broadcast(any_hit)).where("hit or not any_hit").select("id")


@query("DF2_matches_terms", f"WITH {X.CHUNKS} SELECT id, n FROM (SELECT id, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'ing') AS INTEGER) + CAST(contains(lower(text), 'tion') AS INTEGER) AS n FROM chunks) WHERE n >= 2")
def _matches(spark, sf):
    n = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in ("the", "ing", "tion")), F.lit(0))
    return X.chunks(spark, sf).select("id", n.alias("n")).where("n >= 2")


@query("DF3_faceted_filter", f"WITH {X.TAGS} SELECT id, category FROM tagged WHERE category = 'sop' AND list_contains(tags, 'en') AND contains(lower(text), 'the')")
def _facets(spark, sf):
    return X.tagged(spark, sf).where((F.col("category") == "sop") & F.array_contains("tags", "en") & F.contains(F.lower("text"), F.lit("the"))).select("id", "category")


@query("E01_dedup_exact", f"WITH {X.CHUNKS} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY k) AS r FROM chunks) WHERE r = 1")
def _exact(spark, sf):
    return dedup.exact(X.chunks(spark, sf)).select("id")


@query("E02_dedup_cross_file", f"WITH {X.CHUNKS}, n AS (SELECT *, sha256(text) AS h FROM chunks WHERE doc_id % 2 = 1), o AS (SELECT DISTINCT sha256(text) AS h FROM chunks WHERE doc_id % 2 = 0) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY h ORDER BY id) AS r FROM n WHERE h NOT IN (SELECT h FROM o)) WHERE r = 1")
def _cross(spark, sf):
    c = X.chunks(spark, sf)
    return dedup.against(c.where("doc_id % 2 = 1"), c.where("doc_id % 2 = 0")).select("id")


RESULTS = """r AS (SELECT user_id AS id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS prio, event_id FROM events)"""


@query("E06_dedup_results", f"WITH {RESULTS} SELECT id, prio, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio, event_id) AS n FROM r) WHERE n = 1")
def _results(spark, sf):
    e = table(spark, sf, "events")
    prio = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return dedup.first_of(e.select(F.col("user_id").alias("id"), prio.alias("prio"), "event_id"), ["id"], "prio", "event_id")


@query("E07_dedup_urls", "SELECT host, url, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM (SELECT regexp_extract(url, '//([^/]+)', 1) AS host, url, page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS r FROM pages) WHERE r = 1) WHERE n <= 3")
def _urls(spark, sf):
    p = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    once = dedup.first_of(p, ["url"], "page_id")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where("n <= 3").select("host", "url", "page_id")


@query("E08_learned_exact", rf"WITH d AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')))) AS h FROM documents) SELECT doc_id, EXISTS (SELECT 1 FROM d e WHERE e.h = d.h AND e.doc_id % 2 = 0) AS known FROM d WHERE doc_id % 2 = 1")
def _learned(spark, sf):
    d = X.documents(spark, sf).select("doc_id", F.sha2(T.normalize_for_hash(F.col("text")), 256).alias("h"))
    known = d.where("doc_id % 2 = 0").select("h", F.lit(True).alias("hit")).distinct()
    return d.where("doc_id % 2 = 1").join(known, "h", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("known"))


VECTOR = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
QV = "q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0)"


@query("E09_learned_same_topic", f"WITH {QV} SELECT a.vec_id, max(round({VECTOR}, 6)) AS best, bool_or(round({VECTOR}, 6) >= 0.92) AS duplicate FROM q a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def _same_topic(spark, sf):
    e = table(spark, sf, "embeddings")
    best = nearest.nearest(e.where("vec_id % 20 = 0"), e, 1, group="label")
    return best.select(F.col("query_id").alias("vec_id"), F.col("similarity").alias("best"), (F.col("similarity") >= 0.92).alias("duplicate"))


@query("E10_learned_cross_topic", f"WITH {QV}, m AS (SELECT a.vec_id, b.vec_id AS other, round({VECTOR}, 6) AS s FROM q a JOIN embeddings b ON a.label <> b.label) SELECT m.vec_id, other, s, s >= 0.98 OR (s >= 0.92 AND (SELECT count(*) FROM documents x JOIN documents y ON x.lang = y.lang AND x.source = y.source WHERE x.doc_id = m.vec_id AND y.doc_id = other) > 0) AS duplicate FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS r FROM m) m WHERE r = 1")
def _cross_topic(spark, sf):
    e = table(spark, sf, "embeddings")
    best = nearest.nearest(e.where("vec_id % 20 = 0"), e, 1, group="label", other=True).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("other"), F.col("similarity").alias("s"))
    tags = X.documents(spark, sf).select("doc_id", F.array("lang", "source").alias("tags"))
    shared = F.coalesce(F.size(F.array_intersect("t1", "t2")), F.lit(0))
    best = best.join(tags.toDF("vec_id", "t1"), "vec_id", "left").join(tags.toDF("other", "t2"), "other", "left")
    return best.select("vec_id", "other", "s", ((F.col("s") >= 0.98) | ((F.col("s") >= 0.92) & (shared >= 2))).alias("duplicate"))


@query("E12_keyword_set", f"WITH {X.WORDS}, c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]{{3,}}')) AS word FROM documents) GROUP BY ALL) SELECT doc_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c) WHERE r <= 20")
def _keywords(spark, sf):
    return dedup.keyword_set(X.documents(spark, sf), "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0)))


@query("E13_ingest_decision", f"WITH {X.WORDS}, g AS (SELECT doc_id, {REASON % LETTERS} AS reason, sha256(lower(text)) AS h FROM w), d AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM g WHERE reason IS NULL) SELECT g.doc_id, CASE WHEN g.reason IS NOT NULL THEN 'rejected' WHEN d.r > 1 THEN 'duplicate' ELSE 'ok' END AS status, coalesce(g.reason, '') AS reason FROM g LEFT JOIN d ON g.doc_id = d.doc_id")
def _ingest(spark, sf):
    g = quality.reason(X.documents(spark, sf), "text", 15, 0.35).withColumn("h", F.sha2(F.lower("text"), 256))
    w = Window.partitionBy("h", F.col("reason").isNull()).orderBy("doc_id")
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.row_number().over(w) > 1, "duplicate").otherwise("ok")
    return g.select("doc_id", status.alias("status"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("F03_acronym_tags", f"WITH {X.CHUNKS} SELECT id, word, count(*) AS n FROM (SELECT id, unnest(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM chunks) WHERE regexp_full_match(word, '[A-Z]{{2,7}}') GROUP BY ALL HAVING count(*) >= 2")
def _acronyms(spark, sf):
    """Words of any script are split at what is neither letter nor digit; those of 2 to 7 capitals A-Z are acronyms."""
    words = X.chunks(spark, sf).select("id", F.explode(F.split("text", r"[^\p{L}\p{N}_]+")).alias("word")).where(F.col("word").rlike(r"^[A-Z]{2,7}$"))
    return words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


NOUN_STOP = ("with", "that", "this", "from", "have", "dans", "pour", "sich")
NOUNS = "n AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}]{4,}')) AS word FROM chunks) WHERE word NOT IN (" + ", ".join(f"'{w}'" for w in NOUN_STOP) + ") GROUP BY ALL HAVING count(*) >= 2)"


def nouns(spark, sf):
    words = X.chunks(spark, sf).select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), F.lit(0))).alias("word")).where(~F.col("word").isin(*NOUN_STOP))
    return words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("F04_noun_tags", f"WITH {X.CHUNKS}, {NOUNS} SELECT id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS r FROM n) WHERE r <= 5")
def _nouns(spark, sf):
    return nouns(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))).where("r <= 5").drop("r")


@query("F05_verb_tags", f"WITH {X.CHUNKS}, {NOUNS} SELECT id, 'action-' || word AS tag FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS r FROM n WHERE word LIKE '%ing' OR word LIKE '%ed') WHERE r <= 3")
def _verbs(spark, sf):
    v = nouns(spark, sf).where(F.col("word").endswith("ing") | F.col("word").endswith("ed"))
    return v.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))).where("r <= 3").select("id", F.concat(F.lit("action-"), "word").alias("tag"))


@query("F07_finalise_tags", f"WITH {X.TAGS} SELECT id, array_to_string(list_sort(list_distinct(list_filter(tags, lambda t: length(t) >= 3))), ',') AS tags FROM tagged")
def _final(spark, sf):
    return X.tagged(spark, sf).select("id", F.array_join(F.array_sort(F.array_distinct(F.filter("tags", lambda t: F.length(t) >= 3))), ",").alias("tags"))


@query("F12_promote_and_cap", f"WITH {X.TAGS} SELECT id, array_to_string(list_concat([category], list_filter(tags, lambda t: t <> category))[1:5], ',') AS tags FROM tagged")
def _promote(spark, sf):
    return X.tagged(spark, sf).select("id", F.array_join(F.slice(F.array_union(F.array("category"), F.array_except("tags", F.array("category"))), 1, 5), ",").alias("tags"))


@query("F13_merge_caller_tags", f"WITH {X.TAGS} SELECT id, array_to_string(list_sort(list_distinct(list_concat(tags, [source, lang]))), ',') AS tags FROM tagged")
def _merge(spark, sf):
    return X.tagged(spark, sf).select("id", F.array_join(F.array_sort(F.array_union("tags", F.array("source", "lang"))), ",").alias("tags"))


@query("F14_topic_metadata", f"WITH {X.TAGS} SELECT id, source || '/' || doc_id || '.txt' AS file_path, len(tags) AS n_tags FROM tagged")
def _topic(spark, sf):
    return X.tagged(spark, sf).select("id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.size(F.coalesce("tags", F.array().cast("array<string>"))).cast("long").alias("n_tags"))


@query("F15_doc_categories", f"WITH {X.TAGS}, c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(keywords) AS word FROM tagged) GROUP BY ALL) SELECT d.doc_id, coalesce(string_agg(word, ',' ORDER BY r), 'general') AS categories FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c) t ON d.doc_id = t.doc_id AND r <= 3 GROUP BY d.doc_id")
def _doc_categories(spark, sf):
    best = dedup.keyword_set(X.tagged(spark, sf), "doc_id", F.col("keywords"), 3)
    named = best.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), lambda x: x["word"]), ",").alias("c"))
    return X.documents(spark, sf).join(named, "doc_id", "left").select("doc_id", F.coalesce("c", F.lit("general")).alias("categories"))


def tag_rows(spark, sf):
    return X.tagged(spark, sf).select("id", "doc_id", F.explode("keywords").alias("tag"))


TAG_ROWS = "t AS (SELECT id, doc_id, unnest(keywords) AS tag FROM tagged)"
PAIRS = "pr AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM t a JOIN t b ON a.tag = b.tag AND a.id < b.id AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= 3)"
BOTH = "bo AS (SELECT a AS id, b AS other, shared FROM pr UNION ALL SELECT b, a, shared FROM pr), rl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS r FROM bo) WHERE r <= 5)"


@query("G01_term_cooccurrence", f"WITH {X.TAGS}, {TAG_ROWS}, f AS (SELECT tag FROM t GROUP BY tag HAVING count(*) >= 40) SELECT a.tag AS term, count(DISTINCT b.tag) AS n_terms, count(*) AS n_pairs FROM t a JOIN t b ON a.id = b.id AND a.tag <> b.tag JOIN f ON a.tag = f.tag GROUP BY a.tag")
def _cooccur(spark, sf):
    t = tag_rows(spark, sf)
    often = t.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 40").select("tag")
    b = t.select("id", F.col("tag").alias("other"))
    return t.join(often, "tag").join(b, "id").where("tag <> other").groupBy(F.col("tag").alias("term")).agg(F.count_distinct("other").alias("n_terms"), F.count(F.lit(1)).alias("n_pairs"))


@query("G02_term_frequency", f"WITH {X.TAGS}, {TAG_ROWS} SELECT tag, count(*) AS n FROM t GROUP BY tag HAVING count(*) >= 10 ORDER BY n DESC, tag LIMIT 20")
def _frequency(spark, sf):
    return tag_rows(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").orderBy(F.desc("n"), "tag").limit(20)


@query("G05_related_candidates", f"WITH {X.TAGS}, {TAG_ROWS}, {PAIRS} SELECT a, b, shared FROM pr")
def _candidates(spark, sf):
    return links.shared_tag_pairs(tag_rows(spark, sf))


@query("G06_cosine", f"WITH {QV} SELECT a.vec_id AS a, b.vec_id AS b, round({VECTOR}, 6) AS similarity FROM q a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id")
def _cosine(spark, sf):
    """Each query vector with all others of its label."""
    e = table(spark, sf, "embeddings")
    return nearest.similarities(e.where("vec_id % 20 = 0"), e, group="label").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "similarity")


@query("G06_cosine_all_rows", f"WITH {QV} SELECT a.vec_id AS a, b.vec_id AS b, round({VECTOR}, 6) AS similarity FROM q a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id")
def _cosine_all(spark, sf):
    """The same rows under the name that they had before."""
    return _cosine(spark, sf)


CLUSTER = "array_to_string(list_sort(tags[1:3]), '+')"


@query("G08_topic_clusters", f"WITH {X.TAGS} SELECT {CLUSTER} AS cluster, count(*) AS n, min(id) AS first_id FROM tagged WHERE len(tags) >= 2 GROUP BY cluster")
def _clusters(spark, sf):
    key = F.array_join(F.array_sort(F.slice("tags", 1, 3)), "+")
    return X.tagged(spark, sf).where(F.size("tags") >= 2).groupBy(key.alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("G09_cluster_membership", f"WITH {X.TAGS} SELECT id, {CLUSTER} AS cluster, count(*) OVER (PARTITION BY {CLUSTER}) AS size FROM tagged")
def _membership(spark, sf):
    t = X.tagged(spark, sf).select("id", F.array_join(F.array_sort(F.slice("tags", 1, 3)), "+").alias("cluster"))
    return t.join(t.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")


KNN = f"s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round({VECTOR}, 6) AS similarity FROM q a, embeddings b WHERE a.vec_id <> b.vec_id)"


@query("G15_knn_exact", f"WITH {QV}, {KNN} SELECT query_id, vec_id, similarity, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 10")
def _knn(spark, sf):
    e = table(spark, sf, "embeddings")
    return nearest.nearest(e.where("vec_id % 20 = 0"), e, 10)


@query("G16_vector_search", f"WITH {QV}, {KNN} SELECT query_id, vec_id, similarity, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s WHERE label = 1) WHERE r <= 5")
def _search(spark, sf):
    e = table(spark, sf, "embeddings")
    return nearest.nearest(e.where("vec_id % 20 = 0"), e.where("label = 1"), 5)
