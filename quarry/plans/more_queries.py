"""Queries of redaction parts, search phases and sources that the other modules don't have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import dedup, dictionary, folds, nearest, phrases, redact, search
from quarry.plans import fixtures as X
from quarry.plans.index_queries import CLUSTER, QV, TAG_ROWS, VECTOR
from quarry.plans.registry import query, table
from quarry.plans.search_queries import WITH, found, index, queries


def one():
    return F.count(F.lit(1))


def redacted(name: str, make, sql: str | None = None) -> None:
    """Patterns that look ahead or behind, which DuckDB's can't, are held against plain Python in tests/test_operators.py."""
    query(name, sql)(lambda spark, sf: X.documents(spark, sf).select("doc_id", make(F.col("text")).alias("clean")))


EMAILED = f"array_to_string(list_transform(list_zip(string_split_regex(text, '{redact.EMAIL}'), regexp_extract_all(text, '{redact.EMAIL}')), lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' WHEN lower(regexp_extract(z[2], '@(.*)$', 1)) = 'example.org' THEN z[2] ELSE '<EMAIL>' END), '')"

redacted("DP2_redact_account_numbers", redact.account_numbers)
redacted("DP4_redact_slash_pairs", redact.slash_pairs)
redacted("DP5_redact_emails", lambda t: redact.emails(t, ("example.org",)), f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE {EMAILED} END AS clean FROM documents")
redacted("DP6_redact_phones", redact.phones)
redacted("DP7_redact_addresses", redact.addresses, f"SELECT doc_id, regexp_replace(text, '{redact.ADDRESS}', '<ADDRESS>', 'g') AS clean FROM documents")
redacted("DP8_redact_person_names", lambda t: redact.persons(t, ("Alex Doe",)))
redacted("DP9_query_safe_mode", lambda t: F.when(redact.is_log_query(t), redact.account_numbers(redact.bearer(t))).otherwise(redact.credentials(t)))


GAZETTEER = r"""ga AS (SELECT word, min(CASE WHEN item_id % 2 = 0 THEN 'ORG' ELSE 'PRODUCT' END) AS label FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM benchmark) WHERE length(word) >= 6 GROUP BY word),
  cw AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM chunks)),
  ge AS (SELECT id, label, word, row_number() OVER (PARTITION BY id, label ORDER BY min(place)) AS r FROM cw JOIN ga USING (word) GROUP BY id, label, word)"""


def gazetteer(spark, sf):
    """phrase, label: the long words of the benchmark's items."""
    words = table(spark, sf, "benchmark").select("item_id", F.explode(dictionary.words_of(F.col("text"))).alias("phrase"))
    return words.where(F.length("phrase") >= 6).select("phrase", F.when(F.col("item_id") % 2 == 0, "ORG").otherwise("PRODUCT").alias("label"))


def named(spark, sf):
    return dictionary.entities(dictionary.matches(X.chunks(spark, sf).select(F.col("id").alias("key"), "text"), gazetteer(spark, sf)))


@query("F01_entities", f"WITH {X.CHUNKS}, {GAZETTEER} SELECT id, label, string_agg(word, ',' ORDER BY r) AS words FROM ge WHERE r <= 10 GROUP BY id, label")
def _entities(spark, sf):
    """Entities of a dictionary that is given as a table, ten of a label in the order of the text."""
    return named(spark, sf).select(F.col("key").alias("id"), "label", F.array_join("phrases", ",").alias("words"))


@query("F06_org_product_tags", f"WITH {X.CHUNKS}, {GAZETTEER} SELECT id, label, substr(regexp_replace(word, '[^A-Za-z0-9_-]', '', 'g'), 1, 50) AS tag FROM (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY r) AS k FROM ge WHERE r <= 10 AND length(word) < 30) WHERE k <= 3")
def _org(spark, sf):
    """The first three of each label's entities that are shorter than 30 characters, as tags."""
    short = F.slice(F.filter("phrases", lambda p: F.length(p) < 30), 1, 3)
    return named(spark, sf).select(F.col("key").alias("id"), "label", F.explode(short).alias("word")).select("id", "label", T.normalize_tag(F.col("word")).alias("tag"))


@query("F08_phrase_tags", f"""WITH {X.TAGS}, pd AS (SELECT phrase, min('topic-' || item_id % 7) AS tag FROM (SELECT item_id, ws[i] || ' ' || ws[i + 1] AS phrase FROM (SELECT item_id, ws, unnest(range(1, least(len(ws), 12))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM benchmark))) GROUP BY phrase),
  cp AS (SELECT id, ws[i] || ' ' || ws[i + 1] AS phrase FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM chunks))),
  ft AS (SELECT id, unnest(tags) AS tag FROM tagged UNION SELECT id, tag FROM cp JOIN pd USING (phrase)) SELECT id, string_agg(tag, ',' ORDER BY tag) AS tags FROM ft GROUP BY id""")
def _phrase_tags(spark, sf):
    """Tags of the phrases of a dictionary (pairs of the first words of each benchmark item) beside a chunk's own."""
    items = table(spark, sf, "benchmark").select("item_id", F.slice(dictionary.words_of(F.col("text")), 1, 12).alias("w"))
    pairs = items.select("item_id", F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, 12).alias("b"))).alias("x"))
    phrases = pairs.select(F.concat_ws(" ", "x.a", "x.b").alias("phrase"), F.concat(F.lit("topic-"), (F.col("item_id") % 7).cast("string")).alias("label"))
    tagged = X.tagged(spark, sf)
    more = dictionary.matches(tagged.select(F.col("id").alias("key"), "text"), phrases, longest=False).groupBy(F.col("key").alias("id")).agg(F.collect_set("label").alias("more"))
    tags = F.array_union("tags", F.coalesce("more", F.array().cast("array<string>")))
    return tagged.join(more, "id", "left").select("id", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query("G04_expand_terms", f"WITH {X.TAGS}, {TAG_ROWS}, g AS (SELECT DISTINCT item_id AS grp, word FROM (SELECT item_id, unnest((regexp_extract_all(lower(text), '[\\p{{L}}]{{4,}}'))[1:5]) AS word FROM benchmark)), m AS (SELECT DISTINCT id, grp FROM t JOIN g ON t.tag = g.word), x AS (SELECT id, tag FROM t UNION SELECT id, word FROM m JOIN g USING (grp)) SELECT id, string_agg(tag, ',' ORDER BY tag) AS tags FROM x GROUP BY id")
def _expand_terms(spark, sf):
    """Tags with all words of the alias groups (a table) that have one of them: the first long words of each benchmark item."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("group"), F.explode(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), F.lit(0)), 1, 5)).alias("word"))
    rows = X.tagged(spark, sf).where(F.size("keywords") > 0).select(F.col("id").alias("key"), "keywords")
    return dictionary.expanded(rows, "keywords", b).select(F.col("key").alias("id"), F.array_join(F.array_sort("keywords"), ",").alias("tags"))


STOP_LIST = ", ".join(f"'{w}'" for w in phrases.STOP)


@query("F02_key_phrases", f"""WITH tk AS (SELECT doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{phrases.TOKEN}') AS ts FROM documents)),
  br AS (SELECT *, NOT regexp_full_match(tok, '{phrases.WORD}') OR tok IN ({STOP_LIST}) AS brk FROM tk), il AS (SELECT *, sum(CAST(brk AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM br),
  ph AS (SELECT doc_id, run, string_agg(tok, ' ' ORDER BY pos) AS phrase, count(*) AS size FROM il WHERE NOT brk GROUP BY ALL),
  wd AS (SELECT doc_id, tok, count(*) AS freq, sum(size) AS degree FROM il JOIN ph USING (doc_id, run) WHERE NOT brk GROUP BY ALL),
  sc AS (SELECT DISTINCT doc_id, phrase, score FROM (SELECT doc_id, run, CAST(sum(degree * 1000000 // freq) AS BIGINT) AS score FROM il JOIN wd USING (doc_id, tok) WHERE NOT brk GROUP BY ALL) JOIN ph USING (doc_id, run) WHERE length(phrase) > 3)
  SELECT doc_id, phrase, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS r FROM sc) WHERE r <= 20""")
def _phrases(spark, sf):
    return phrases.key_phrases(X.documents(spark, sf), "doc_id", F.col("text"))


@query("G17_cluster_expansion", f"WITH {X.TAGS}, c AS (SELECT id, {CLUSTER} AS cluster FROM tagged), f AS (SELECT cluster FROM c ORDER BY id LIMIT 5) SELECT id, cluster FROM (SELECT c.*, row_number() OVER (PARTITION BY cluster ORDER BY id) AS r FROM c WHERE cluster IN (SELECT cluster FROM f)) WHERE r <= 5")
def _expand(spark, sf):
    c = X.tagged(spark, sf).select("id", F.array_join(F.array_sort(F.slice("tags", 1, 3)), "+").alias("cluster"))
    first = c.orderBy("id").limit(5).select("cluster").distinct()
    return c.join(first, "cluster", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where("r <= 5").select("id", "cluster")


@query("G18_tables_first", f"WITH {QV} SELECT query_id, vec_id FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.label = 0 DESC, round({VECTOR}, 6) DESC, b.vec_id) AS r FROM q a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE r <= 12")
def _tables(spark, sf):
    e = table(spark, sf, "embeddings")
    return nearest.nearest(e.where("vec_id % 20 = 0"), e, 12, prefer=F.col("label") == 0).select("query_id", "vec_id")


@query("H04_phase3_related", WITH + "SELECT query_id, id FROM p3")
def _related(spark, sf):
    c, linked, _, words = index(spark, sf)
    q = queries(spark, sf, c)
    return search.referred(search.initial(search.term_hits(q, c, words)), linked, c, search.limits_of(q))


@query("H12_exclusion_chain", WITH + "SELECT query_id, id, CAST(min(o) AS INTEGER) AS phase FROM al GROUP BY ALL")
def _chain(spark, sf):
    """One phase a chunk: the first that found it (before the cut by score)."""
    return found(spark, sf, cut=False).phases


@query("H13_label_match_type", WITH + "SELECT query_id, match_type, count(*) AS n FROM rk GROUP BY ALL")
def _label(spark, sf):
    return found(spark, sf).ranked.groupBy("query_id", "match_type").agg(one().alias("n"))


@query("H16_query_floor", WITH + ", g AS (SELECT *, match_type = 'Query' AND row_number() OVER (PARTITION BY query_id, match_type ORDER BY score DESC, id) <= 4 AS first FROM rk) SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, score DESC, id) AS r2 FROM g) WHERE r2 <= 20")
def _floor(spark, sf):
    r = found(spark, sf).ranked
    nth = F.row_number().over(Window.partitionBy("query_id", "match_type").orderBy(F.desc("score"), "id"))
    g = r.withColumn("nth", nth).withColumn("first", (F.col("match_type") == "Query") & (F.col("nth") <= 4))
    w = Window.partitionBy("query_id").orderBy(F.desc("first"), F.desc("score"), "id")
    return g.withColumn("r2", F.row_number().over(w)).where("r2 <= 20").select("query_id", "id")


@query("A06_latest_file", "SELECT source, arg_max(doc_id, struct_pack(n := n_chars, d := doc_id)) AS latest FROM documents GROUP BY source")
def _latest(spark, sf):
    return X.documents(spark, sf).groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("latest"))


@query("N06_task_transitions")
def _transitions(spark, sf):
    """Each job's updates in order: a move is refused if the state that the accepted moves have led to doesn't allow it."""
    return folds.transitions(X.job_status(spark, sf), MOVES)


MOVES = {"queued": ("crawling", "failed"), "crawling": ("synthesizing", "failed"), "synthesizing": ("review", "failed"), "review": ("queued",), "failed": ("queued",)}
