"""Queries of ranked search: twenty searches by frequent words against all chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import links, search, termindex
from quarry.plans import fixtures as X
from quarry.plans.index_queries import BOTH, PAIRS, TAG_ROWS
from quarry.plans.registry import query
from quarry.sources.scratch import written

def one():
    return F.count(F.lit(1))



def queries(spark, sf, tagged=None):
    """query_id, terms, level: three neighbours each in the list of the commonest keywords of at least five letters."""
    c = X.tagged(spark, sf) if tagged is None else tagged
    n = c.select(F.explode("keywords").alias("word")).where(F.length("word") >= 5).groupBy("word").agg(one().alias("n")).orderBy(F.desc("n"), "word").limit(60)
    ranked = n.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1)
    q = ranked.groupBy(F.floor(F.col("r") / 3).alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("terms"))
    return q.withColumn("level", F.element_at(F.array(*map(F.lit, search.LEVELS)), (F.col("query_id") % 4 + 1).cast("int")))


def related(tagged):
    rows = tagged.select("id", "doc_id", F.explode("keywords").alias("tag"))
    return links.best_by_tags(rows)


#: The index (chunks, links, entities, words) of each session, folder and state of its documents, as files.
_built = {}


def state(spark, sf):
    """The files of the documents and when the last one changed."""
    d = X.documents(spark, sf)
    return tuple(sorted(d.inputFiles())), str(d.agg(F.max("_metadata.file_modification_time")).first()[0])


def index(spark, sf):
    """What a search reads. It is built and written once for a session, and again if the documents change; a search starts from
    these tables."""
    key = (spark.sparkContext.applicationId, sf, *state(spark, sf))
    if key not in _built:
        tagged = written(X.tagged(spark, sf), "tagged")
        entities = X.entities_of(tagged).select("id", F.concat("label", F.lit("::"), "word").alias("entity"))
        _built[key] = tagged, written(related(tagged), "links"), written(entities, "entities"), termindex.build(tagged)
    return _built[key]


def found(spark, sf, cut=True):
    tagged, linked, entities, words = index(spark, sf)
    return search.search(queries(spark, sf, tagged), X.searched(tagged), linked, entities, words, cut=cut)


def _caps(name: str) -> str:
    return "CASE level " + " ".join(f"WHEN '{k}' THEN {v[name]}" for k, v in search.LEVELS.items()) + " END"


def _phase(name: str, rows: str, before: str, column: str, order: str) -> str:
    """A phase's CTE: its rows (query_id, id and what orders them) that `before` lacks, up to the level's cap."""
    return f"""{name} AS (SELECT query_id, id FROM (SELECT x.query_id, x.id, row_number() OVER (PARTITION BY x.query_id ORDER BY {order}x.id) AS r, {_caps(column)} AS cap FROM ({rows}) x JOIN q ON q.query_id = x.query_id WHERE NOT EXISTS (SELECT 1 FROM {before} f WHERE f.query_id = x.query_id AND f.id = x.id)) WHERE r <= cap)"""


Q = f"""{X.TAGS}{X.ENTITIES[len(X.CHUNKS):]}, {TAG_ROWS}, {PAIRS}, {BOTH}, {X.SEARCHED},
fw AS (SELECT tag AS word, row_number() OVER (ORDER BY count(*) DESC, tag) - 1 AS r FROM t WHERE length(tag) >= 5 GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 60),
q AS (SELECT CAST(r // 3 AS BIGINT) AS query_id, list(word ORDER BY r) AS terms, CASE (r // 3) % 4 WHEN 0 THEN 'Quick' WHEN 1 THEN 'Standard' WHEN 2 THEN 'Deep' ELSE 'Exhaustive' END AS level FROM fw GROUP BY r // 3),
qt AS (SELECT query_id, unnest(terms) AS term FROM q),
th AS (SELECT query_id, id, sum(CASE WHEN contains(low, term) THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN length(term) >= 5 AND contains(low, substr(term, 1, 5)) THEN 1 ELSE 0 END) AS fuzzy, least(40, sum(least(10, 2 * ((length(low) - length(replace(low, term, ''))) // length(term))))) AS term_score FROM lo, qt GROUP BY ALL),
h AS (SELECT * FROM th WHERE hits > 0),
p1 AS (SELECT query_id, id, hits FROM (SELECT *, max(hits) OVER (PARTITION BY query_id) AS best FROM h) WHERE hits >= 2 OR best < 2),
sz AS (SELECT query_id, count(*) AS size FROM p1 GROUP BY query_id),
tf AS (SELECT p.query_id, token, count(*) AS n FROM (SELECT query_id, unnest(tags) AS token FROM p1 JOIN lo ON p1.id = lo.id) p WHERE token NOT IN ({', '.join(f"'{w}'" for w in search.TAG_STOP)}) GROUP BY ALL),
tt AS (SELECT query_id, token, n, r FROM (SELECT tf.query_id, token, n, row_number() OVER (PARTITION BY tf.query_id ORDER BY n DESC, token) AS r FROM tf JOIN sz ON tf.query_id = sz.query_id WHERE n >= greatest(2, floor(size * 0.2))) WHERE r <= 15),
kf AS (SELECT query_id, token, count(*) AS n FROM (SELECT query_id, unnest(keywords) AS token FROM p1 JOIN lo ON p1.id = lo.id) GROUP BY ALL HAVING count(*) >= 2),
kt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, token) AS r FROM kf WHERE length(token) >= 3) WHERE r <= 20),
rf AS (SELECT query_id, other AS id, count(*) AS n FROM p1 JOIN rl ON p1.id = rl.id GROUP BY ALL),
p3a AS (SELECT query_id, id, n FROM (SELECT rf.*, row_number() OVER (PARTITION BY rf.query_id ORDER BY n DESC, id) AS r, 3 * {_caps('related')} AS cap FROM rf JOIN q ON q.query_id = rf.query_id) WHERE r <= cap),
p3 AS (SELECT query_id, id FROM (SELECT p3a.*, row_number() OVER (PARTITION BY p3a.query_id ORDER BY n DESC, id) AS r, {_caps('related')} AS cap FROM p3a JOIN q ON q.query_id = p3a.query_id WHERE id IN (SELECT id FROM lo)) WHERE r <= cap),
f3 AS (SELECT query_id, id FROM p1 UNION SELECT query_id, id FROM p3),
{_phase('p35', 'SELECT h.* FROM h JOIN lo ON lo.id = h.id WHERE learned', 'f3', 'learned', 'hits DESC, ')},
f35 AS (SELECT * FROM f3 UNION SELECT * FROM p35),
tk2 AS (SELECT query_id, token FROM tt UNION SELECT query_id, token FROM kt),
sh AS (SELECT query_id, id, count(*) AS n FROM (SELECT DISTINCT id, unnest(list_concat(tags, keywords)) AS token FROM lo) c JOIN tk2 ON c.token = tk2.token GROUP BY ALL),
{_phase('p4', 'SELECT coalesce(h.query_id, sh.query_id) AS query_id, coalesce(h.id, sh.id) AS id, coalesce(n, 0) AS n FROM h FULL JOIN sh ON h.query_id = sh.query_id AND h.id = sh.id', 'f35', 'deep', 'n DESC, ')},
f4 AS (SELECT * FROM f35 UNION SELECT * FROM p4),
cz AS (SELECT cluster, count(*) AS size FROM lo GROUP BY cluster HAVING count(*) >= 3),
{_phase('p5', 'SELECT w.query_id, lo.id, size FROM (SELECT DISTINCT query_id, cluster FROM p1 JOIN lo ON lo.id = p1.id) w JOIN cz ON cz.cluster = w.cluster JOIN lo ON lo.cluster = w.cluster', 'f4', 'cluster', 'size DESC, ')},
f5 AS (SELECT * FROM f4 UNION SELECT * FROM p5),
fv AS (SELECT query_id, token FROM (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS k FROM (SELECT query_id, token, r FROM tt UNION ALL SELECT query_id, token, r + 1000 FROM kt) GROUP BY query_id, token) WHERE k <= 5),
pt AS (SELECT query_id, term AS token FROM qt UNION SELECT fv.query_id, token FROM fv JOIN q ON q.query_id = fv.query_id WHERE level <> 'Quick'),
{_phase('p6', "SELECT query_id, id, count(*) AS n FROM lo, pt WHERE list_has_any(tags, ['sop', 'manual']) AND contains(low, token) GROUP BY query_id, id", 'f5', 'priority', 'n DESC, ')},
f6 AS (SELECT * FROM f5 UNION SELECT * FROM p6),
{_phase('p7', 'SELECT * FROM th WHERE fuzzy >= 2', 'f6', 'fuzzy', 'fuzzy DESC, ')},
f7 AS (SELECT * FROM f6 UNION SELECT * FROM p7),
ek AS (SELECT id, label || '::' || word AS entity FROM entities),
et AS (SELECT query_id, entity FROM (SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, entity) AS r FROM p1 JOIN ek ON ek.id = p1.id GROUP BY query_id, entity) WHERE r <= 10),
{_phase('p8', 'SELECT DISTINCT query_id, id FROM ek JOIN et ON et.entity = ek.entity', 'f7', 'entity', '')},
al AS (SELECT query_id, id, min(o) AS o FROM (SELECT query_id, id, 0 AS o FROM p1 {' '.join(f'UNION ALL SELECT query_id, id, {k + 1} FROM {p}' for k, p in enumerate(('p3', 'p35', 'p4', 'p5', 'p6', 'p7', 'p8')))}) GROUP BY ALL),
ts AS (SELECT al.query_id, al.id, count(*) AS n FROM al JOIN (SELECT id, unnest(tags) AS x FROM lo) u ON u.id = al.id JOIN tt ON tt.token = u.x AND tt.query_id = al.query_id GROUP BY al.query_id, al.id),
ks AS (SELECT al.query_id, al.id, count(*) AS n FROM al JOIN (SELECT id, unnest(keywords) AS x FROM lo) u ON u.id = al.id JOIN kt ON kt.token = u.x AND kt.query_id = al.query_id GROUP BY al.query_id, al.id),
sc AS (SELECT al.query_id, al.id, list_extract([{', '.join(f"'{p}'" for p in search.PHASES)}], o + 1) AS match_type,
  CAST(coalesce(term_score, 0) + least(20, 4 * coalesce(ts.n, 0)) + least(15, 3 * coalesce(ks.n, 0)) + list_extract({[search.BONUS.get(p, search.OTHER_BONUS) for p in search.PHASES]}, o + 1) AS INTEGER) AS score
  FROM al LEFT JOIN (SELECT * FROM th WHERE hits > 0 OR fuzzy > 1) h2 ON h2.query_id = al.query_id AND h2.id = al.id LEFT JOIN ts ON ts.query_id = al.query_id AND ts.id = al.id LEFT JOIN ks ON ks.query_id = al.query_id AND ks.id = al.id),
rk AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.query_id ORDER BY score DESC, id) AS rank, {_caps('total')} AS total FROM sc JOIN q ON q.query_id = sc.query_id) WHERE rank <= total)"""
WITH = f"WITH {Q} "


def phase(name: str, cte: str, match_type: str) -> None:
    """A query of one phase's rows."""
    at = search.PHASES.index(match_type)
    query(name, WITH + f"SELECT query_id, id FROM {cte}")(lambda spark, sf: found(spark, sf, cut=False).phases.where(F.col("phase") == at).select("query_id", "id"))


phase("H05_phase35_learned", "p35", "Learned")
phase("H06_phase4_deep_dive", "p4", "DeepDive")
phase("H07_phase5_cluster", "p5", "Cluster")
phase("H09_phase6_full", "p6", "Query")
phase("H10_phase7_fuzzy", "p7", "Fuzzy")
phase("H11_phase8_entity", "p8", "Entity")


@query("H08_phase6_quick", WITH + "SELECT p6.query_id, p6.id FROM p6 JOIN q ON q.query_id = p6.query_id WHERE level = 'Quick'")
def _quick(spark, sf):
    """The searches of the least level: priority chunks with a term."""
    of = found(spark, sf, cut=False)
    rows = of.phases.where(F.col("phase") == search.PHASES.index("Query")).select("query_id", "id")
    return rows.where(F.col("query_id") % len(search.LEVELS) == 0)  # queries() deals out the levels in turn


@query("H01_phase1_initial", WITH + "SELECT query_id, id, CAST(hits AS INTEGER) AS hits FROM p1")
def _initial(spark, sf):
    c, _, _, words = index(spark, sf)
    return search.initial(search.term_hits(queries(spark, sf, c), c, words)).select("query_id", "id", "hits")


@query("H02_discover_tags", WITH + "SELECT query_id, token, n, r FROM tt")
def _tags(spark, sf):
    c, _, _, words = index(spark, sf)
    return search.discover(search.initial(search.term_hits(queries(spark, sf, c), c, words)), c)[0]


@query("H03_discover_keywords", WITH + "SELECT query_id, token, n, r FROM kt")
def _keywords(spark, sf):
    c, _, _, words = index(spark, sf)
    return search.discover(search.initial(search.term_hits(queries(spark, sf, c), c, words)), c)[1]


@query("H14_score", WITH + "SELECT query_id, id, match_type, score FROM rk")
def _score(spark, sf):
    return found(spark, sf).ranked.select("query_id", "id", "match_type", "score")


@query("H15_rank_and_cap", WITH + "SELECT query_id, id, rank FROM rk")
def _rank(spark, sf):
    return found(spark, sf).ranked.select("query_id", "id", "rank")


@query("H17_paginate", WITH + "SELECT query_id, id, CAST((rank - 1) // 20 + 1 AS BIGINT) AS page, CAST(ceil(count(*) OVER (PARTITION BY query_id) / 20.0) AS BIGINT) AS pages FROM rk")
def _pages(spark, sf):
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return found(spark, sf).ranked.select("query_id", "id", (F.floor((F.col("rank") - 1) / 20) + 1).alias("page"), F.ceil(n / 20).alias("pages"))


@query("H18_phase_counts", WITH + "SELECT query_id, match_type, count(*) AS n FROM rk WHERE rank <= 20 GROUP BY ALL")
def _counts(spark, sf):
    return found(spark, sf).ranked.where("rank <= 20").groupBy("query_id", "match_type").agg(one().alias("n"))


@query("H20_validate_questions", WITH + "SELECT query_id, max(score) AS best, max(score) >= 20 AS good FROM rk GROUP BY query_id")
def _validate(spark, sf):
    return found(spark, sf).ranked.groupBy("query_id").agg(F.max("score").alias("best"), (F.max("score") >= 20).alias("good"))


@query("DQ9_relevance_gate", WITH + "SELECT q.query_id, coalesce(max(score) >= 15, false) AS proceed FROM q LEFT JOIN rk ON q.query_id = rk.query_id GROUP BY q.query_id")
def _gate(spark, sf):
    best = found(spark, sf).ranked.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries(spark, sf, index(spark, sf)[0]).select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce(F.col("best") >= 15, F.lit(False)).alias("proceed"))


@query("H19_level_limits", WITH + f"SELECT query_id, level, {_caps('related')} AS related, {_caps('deep')} AS deep, {_caps('total')} AS total FROM q")
def _limits(spark, sf):
    return search.limits_of(queries(spark, sf)).select("query_id", "level", "related", "deep", "total")


@query("H21_round_robin_sample", f"WITH {X.CHUNKS}, r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM chunks) SELECT id, category, rn FROM r ORDER BY rn, category LIMIT 30")
def _sample(spark, sf):
    # the 30 least ids of a category by an aggregate, as five windows over all chunks would be five tasks
    least = X.chunks(spark, sf).groupBy("category", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, 30).alias("ids"))
    r = least.select("category", F.explode("ids").alias("id")).withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy("id"))).where("rn <= 30")
    return r.orderBy("rn", "category").limit(30).select("id", "category", "rn")


@query("H22_template_suggestions", f"WITH {X.ENTITIES} SELECT DISTINCT 'What do we know about ' || word || '?' AS question FROM entities WHERE label = 'ORG' AND length(word) BETWEEN 8 AND 20 ORDER BY question LIMIT 15")
def _suggest(spark, sf):
    e = X.entities(spark, sf).where((F.col("label") == "ORG") & F.length("word").between(8, 20))
    return e.select(F.concat(F.lit("What do we know about "), "word", F.lit("?")).alias("question")).distinct().orderBy("question").limit(15)


@query("H23_same_cluster", f"WITH {X.TAGS}, c AS (SELECT id, array_to_string(list_sort(tags[1:3]), '+') AS cluster FROM tagged WHERE category = 'sop') SELECT id, cluster FROM c WHERE cluster IN (SELECT cluster FROM c GROUP BY cluster HAVING count(*) > 1)")
def _same(spark, sf):
    c = X.tagged(spark, sf).where("category = 'sop'").select("id", F.array_join(F.array_sort(F.slice("tags", 1, 3)), "+").alias("cluster"))
    return c.join(c.groupBy("cluster").agg(one().alias("n")).where("n > 1").select("cluster"), "cluster", "left_semi")
