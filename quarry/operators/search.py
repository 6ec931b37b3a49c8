"""Multi-phase ranked search of many queries at once. Each row carries its query_id; a phase is a table of
(query_id, id, phase, hits), and later phases leave out what earlier ones found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.termindex import TermIndex, occurrences
from quarry.sources.scratch import written

#: Rows that each phase may add, and in all, by depth.
LEVELS = {
    "Quick": {"related": 5, "learned": 0, "deep": 0, "cluster": 0, "priority": 3, "fuzzy": 0, "entity": 0, "total": 20},
    "Standard": {"related": 55, "learned": 15, "deep": 25, "cluster": 20, "priority": 40, "fuzzy": 0, "entity": 0, "total": 165},
    "Deep": {"related": 110, "learned": 30, "deep": 50, "cluster": 40, "priority": 80, "fuzzy": 20, "entity": 70, "total": 420},
    "Exhaustive": {"related": 220, "learned": 60, "deep": 100, "cluster": 80, "priority": 160, "fuzzy": 40, "entity": 140, "total": 840},
}
#: The phases in the order in which they run.
PHASES = ("Initial", "Related", "Learned", "DeepDive", "Cluster", "Query", "Fuzzy", "Entity")
#: What a phase adds to a score, and what all others add.
BONUS = {"Initial": 10, "Related": 7, "Query": 5, "DeepDive": 3, "Learned": 8}
OTHER_BONUS = 2
#: Tags that tell nothing.
TAG_STOP = ("address", "report", "client", "issue", "select", "your", "home", "usage", "task", "role")


def term_hits(queries: DataFrame, chunks: DataFrame, index: TermIndex) -> DataFrame:
    """query_id, id, hits (terms that occur), term_score, fuzzy (how many of the terms of at least 5 characters occur with
    their first 5). The terms and beginnings are looked up in the index of the chunks; empty ones count nowhere."""
    terms = queries.select("query_id", F.posexplode("terms").alias("place", "term")).where("term <> ''").withColumn("whole", F.lower("term"))
    terms = terms.withColumn("start", F.when(F.length("term") >= 5, F.lower(F.substring("term", 1, 5))))
    asked = written(terms, "terms")
    found = written(occurrences(index, asked.select(F.explode(F.array("whole", "start")).alias("string")), chunks), "occurrences")
    t = F.broadcast(asked)  # a stated set of searches
    score = F.least(F.lit(10), 2 * F.floor(F.col("n") * F.length("whole") / F.length("term"))).cast("int")
    whole = found.join(t, found["string"] == t["whole"]).select("query_id", "id", F.lit(1).alias("hit"), score.alias("score"), F.lit(0).alias("begun"))
    begun = found.join(t, found["string"] == t["start"]).select("query_id", "id", F.lit(0).alias("hit"), F.lit(0).alias("score"), F.lit(1).alias("begun"))
    rows = whole.unionByName(begun).groupBy("query_id", "id").agg(F.sum("hit").cast("int").alias("hits"), F.least(F.lit(40), F.sum("score")).cast("int").alias("term_score"), F.sum("begun").cast("int").alias("fuzzy"))
    return rows.where("hits > 0 or fuzzy > 1")


def initial(hits: DataFrame) -> DataFrame:
    """Chunks with two terms; for queries without any such chunk, with one."""
    two = hits.where("hits >= 2").select("query_id").distinct().withColumn("two_", F.lit(True))
    return hits.where("hits > 0").join(F.broadcast(two), "query_id", "left").where("hits >= 2 or two_ is null").drop("two_")


def discover(phase1: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags (at least max(2, a fifth of the phase), 15) and keywords (at least 2, 20) of a query's first phase, by frequency."""
    rows = phase1.select("query_id", "id").join(chunks.select("id", "tags", "keywords"), "id")
    n = phase1.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))

    def best(column: str, keep, least, most: int) -> DataFrame:
        f = rows.select("query_id", F.explode(column).alias("token")).where(keep).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("n"))
        f = f.join(F.broadcast(n), "query_id").where(F.col("n") >= least)
        return f.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "token"))).where(F.col("r") <= most).select("query_id", "token", "n", "r")

    tags = best("tags", ~F.col("token").isin(*TAG_STOP), F.greatest(F.lit(2), F.floor(F.col("size") * 0.2)), 15)
    return tags, best("keywords", F.length("token") >= 3, F.lit(2), 20)


@dataclass
class Found:
    """What a search gives: the ranked rows, what it discovered on the way, and each phase's rows."""

    ranked: DataFrame
    tags: DataFrame
    keywords: DataFrame
    phases: DataFrame


def _cap(df: DataFrame, limits: DataFrame, column: str, *order) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "id"))
    return df.join(F.broadcast(limits.select("query_id", F.col(column).alias("cap_"))), "query_id").withColumn("r_", r).where("r_ <= cap_").drop("r_", "cap_")


def limits_of(queries: DataFrame) -> DataFrame:
    names = list(next(iter(LEVELS.values())))
    out = queries.select("query_id", "level")
    for name in names:
        c = F.lit(None).cast("int")
        for level, caps in LEVELS.items():
            c = F.when(F.col("level") == level, caps[name]).otherwise(c)
        out = out.withColumn(name, c)
    return out


def referred(first: DataFrame, links: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """query_id, id: what the first phase's chunks refer to, most often first: three times the cap, of these the ones that
    exist, of these the cap."""
    refs = first.select("query_id", "id").join(links, "id").groupBy("query_id", F.col("other").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    refs = _cap(refs, limits.withColumn("related", F.col("related") * 3), "related", F.desc("n"))
    return _cap(refs.join(chunks.select("id"), "id", "left_semi"), limits, "related", F.desc("n")).select("query_id", "id")


def priority_tokens(queries: DataFrame, tags: DataFrame, keywords: DataFrame) -> DataFrame:
    """query_id, tokens: the terms and, but for Quick, the first five of the discovered tags and keywords."""
    found = tags.select("query_id", "token", "r").union(keywords.select("query_id", "token", F.col("r") + 1000)).groupBy("query_id", "token").agg(F.min("r").alias("r"))
    five = found.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).where("k <= 5").groupBy("query_id").agg(F.collect_set("token").alias("five"))
    none = F.array().cast("array<string>")
    more = F.when(F.col("level") == "Quick", none).otherwise(F.coalesce("five", none))
    return queries.join(five, "query_id", "left").select("query_id", F.array_distinct(F.concat(F.transform("terms", F.lower), F.transform(more, F.lower))).alias("tokens"))


def search(queries: DataFrame, chunks: DataFrame, links: DataFrame, entities: DataFrame, index: TermIndex, priority: tuple[str, ...] = ("sop", "manual"), cut: bool = True) -> Found:
    """queries (query_id, terms, level) over chunks (id, text, tags, keywords, cluster, learned), links (id, other),
    entities (id, entity) and the index of the chunks' words. Each phase leaves out what earlier ones found and adds as many rows as the level allows:

    Initial: chunks with the terms. Related: those that they refer to, by frequency. Learned: learned chunks with a term,
    by hits. DeepDive: chunks with a term or a discovered token, by the number of their tokens that were discovered.
    Cluster: chunks of the initial ones' clusters of at least 3, by size. Query: chunks with a priority tag and a term
    or one of the first discovered tokens, by hits. Fuzzy: chunks with the beginnings of two terms. Entity: chunks that
    share one of the initial ones' ten most frequent entities, by id.

    Scores add up what the terms (40), the discovered tags (20) and keywords (15) and the phase give; a query's rows are
    ranked by score and id and, with `cut`, ended at its level's total. Terms are looked up in the index; the phases are
    written as they come, so none runs twice."""
    queries = written(queries, "queries")
    hits = written(term_hits(queries, chunks, index), "hits")
    limits = limits_of(queries)
    one = written(initial(hits), "initial")
    tags, keywords = (written(x, "discovered") for x in discover(one, chunks))
    found = one.select("query_id", "id").withColumn("phase", F.lit(0))

    def add(phase: str, rows: DataFrame, column: str | None = None, *order) -> None:
        nonlocal found
        rows = rows.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
        if column:
            rows = _cap(rows, limits, column, *order)
        found = found.unionByName(written(rows.select("query_id", "id").withColumn("phase", F.lit(PHASES.index(phase))), phase.lower()))

    add("Related", referred(one, links, chunks, limits))
    add("Learned", hits.where("hits > 0").join(chunks.where("learned").select("id"), "id", "left_semi"), "learned", F.desc("hits"))

    tokens = tags.select("query_id", "token").union(keywords.select("query_id", "token")).distinct()
    held = chunks.select("id", F.explode(F.array_union("tags", "keywords")).alias("token"))
    shared = held.join(F.broadcast(tokens), "token").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))  # 35 tokens a query at most
    deep = hits.where("hits > 0").select("query_id", "id").join(shared, ["query_id", "id"], "full").fillna(0, ["n"])
    add("DeepDive", deep, "deep", F.desc("n"))

    named = chunks.select("id", "cluster").where("cluster is not null")
    size = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    wanted = one.join(named, "id").select("query_id", "cluster").distinct().join(size, "cluster")
    add("Cluster", wanted.join(named, "cluster").select("query_id", "id", "size"), "cluster", F.desc("size"))

    prior = chunks.where(F.arrays_overlap("tags", F.array(*map(F.lit, priority)))).select("id")
    wanted = written(priority_tokens(queries, tags, keywords).select("query_id", F.explode("tokens").alias("string")).where("string <> ''"), "priority")
    held = occurrences(index, wanted, chunks).join(prior, "id", "left_semi")
    six = held.join(F.broadcast(wanted), "string").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))
    add("Query", six.select("query_id", "id", "n"), "priority", F.desc("n"))
    add("Fuzzy", hits.where("fuzzy >= 2"), "fuzzy", F.desc("fuzzy"))

    often = one.join(entities, "id").groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    top = often.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "entity"))).where("r <= 10")
    add("Entity", entities.join(F.broadcast(top.select("query_id", "entity")), "entity").select("query_id", "id").distinct(), "entity")

    tag_list = tags.groupBy("query_id").agg(F.collect_set("token").alias("top_tags"))
    word_list = keywords.groupBy("query_id").agg(F.collect_set("token").alias("top_words"))
    scored = found.join(hits.select("query_id", "id", "term_score"), ["query_id", "id"], "left").join(chunks.select("id", "tags", "keywords"), "id")
    scored = scored.join(F.broadcast(tag_list), "query_id", "left").join(F.broadcast(word_list), "query_id", "left")
    none = F.array().cast("array<string>")
    common = lambda a, b: F.size(F.filter(a, lambda t: F.array_contains(F.coalesce(b, none), t)))
    match_type = F.element_at(F.array(*map(F.lit, PHASES)), F.col("phase") + 1)
    bonus = F.lit(OTHER_BONUS)
    for name, points in BONUS.items():
        bonus = F.when(match_type == name, points).otherwise(bonus)
    score = F.coalesce("term_score", F.lit(0)) + F.least(F.lit(20), 4 * common("tags", F.col("top_tags"))) + F.least(F.lit(15), 3 * common("keywords", F.col("top_words"))) + bonus
    ranked = scored.select("query_id", "id", match_type.alias("match_type"), score.cast("int").alias("score")).join(F.broadcast(limits.select("query_id", "total")), "query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = ranked.withColumn("rank", rank)
    return Found((ranked.where(F.col("rank") <= F.col("total")) if cut else ranked).drop("total"), tags, keywords, found)
