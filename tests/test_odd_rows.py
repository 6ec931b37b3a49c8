"""Queries on odd rows: what Spark gives for them is what their SQL gives in DuckDB, or what plain Python does."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import fuzzy, links, nearest, phrases, redact
from quarry.plans import insight_queries, more_queries, registry  # noqa: F401


def against_sql(spark, tmp_path, name, rows):
    """The sorted rows of a query and of its SQL over documents (doc_id, text)."""
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("src1"), "n_chars": F.length("text").cast("bigint")})
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    return sorted(map(tuple, got.itertuples(index=False))), sorted(map(tuple, want.itertuples(index=False)))


EDGES = [
    "at 98.203.215.189 einstü zu", "ü12 Oak Street ä", "12 Oak Stß", "é12 Oak Lane", "12\x0bOak Street", "12 Oak\x0bStreet", "12 Oak ſtreet", "7 King Road", "9 Oak Street Apt ſ7-", "9 Oak Street Apt 7-a",
    "xü a@example.com", "üa@example.com", "a@example.comü b", "a@example.orgé", "_a@example.com-", "ß.b@example.com", "5 Oak Way and nothing", "12 Oak ıStreet",
]


@pytest.mark.parametrize("name", ["DP7_redact_addresses", "DP5_redact_emails", "K06_doc_insights"])
def test_edges_of_words_as_in_sql(spark, tmp_path, name):
    """Letters beyond ASCII beside a match, vertical tabs, the long s and the Kelvin sign."""
    got, want = against_sql(spark, tmp_path, name, list(enumerate(EDGES)))
    assert got == want


def test_masks_at_letters_of_any_script(spark):
    df = spark.createDataFrame([("12 Oak Stü a@example.comü",)], "t string")
    assert df.select(redact.emails(redact.addresses(F.col("t")))).first()[0] == "<ADDRESS>ü <EMAIL>ü"


def tagged_chunks(spark, seed):
    """Chunks of few documents with tags of which some are common, as a dict and as rows, some of them twice."""
    import random

    rng = random.Random(seed)
    chunks = {}
    for k in range(200):
        own = {f"t{rng.randint(0, 25)}" for _ in range(rng.randint(0, 4))} | {h for h in ("hot", "warm") if rng.random() < 0.7}
        chunks[f"c{k * 7919 % 1000:03d}"] = (rng.choice([0, 0, 0, k % 40]), own)
    tags = [(i, d, t) for i, (d, own) in chunks.items() for t in own]
    return chunks, spark.createDataFrame(tags + tags[:30], "id string, doc_id bigint, tag string")


@pytest.mark.parametrize("seed", [1, 2])
def test_best_partners_without_all_pairs(spark, seed, monkeypatch):
    """Many chunks of one document and many ties; the ranked rows of all pairs, and no pair is made."""
    chunks, df = tagged_chunks(spark, seed)
    want = set()
    for a, (da, x) in chunks.items():
        best = sorted((-len(x & y), b) for b, (db, y) in chunks.items() if da != db and len(x & y) >= 3)[:5]
        want |= {(a, b, -n, r + 1) for r, (n, b) in enumerate(best)}
    monkeypatch.setattr(links, "shared_tag_pairs", None)
    monkeypatch.setattr(links, "pairs_of_new", None)
    got = [tuple(r) for r in links.best_by_tags(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    new = spark.createDataFrame([(i,) for i in list(chunks)[::9]], "id string")
    assert {tuple(r) for r in links.best_by_tags(df, new).collect()} == {x for x in want if x[0] in set(list(chunks)[::9])}
    inside = {b for a, (da, x) in chunks.items() if da % 3 == 0 for b, (db, y) in chunks.items() if db % 3 and da != db and len(x & y) >= 3}
    assert sorted(r["id"] for r in links.linked_to(df, F.col("doc_id") % 3 == 0).collect()) == sorted(inside)


def test_best_partners_of_many_tags(spark):
    """Beyond FEW tags the pairs are ranked."""
    rows = [(f"c{k}", k, f"t{j}") for k in range(12) for j in range(k % 4, k % 4 + 10)]
    df = spark.createDataFrame(rows, "id string, doc_id bigint, tag string")
    want = {tuple(r) for r in links.related(links.shared_tag_pairs(df), "shared").select("id", "other", "shared", "r").collect()}
    assert {tuple(r) for r in links.best_by_tags(df).select("id", "other", "shared", "r").collect()} == want
    assert {r["id"] for r in links.linked_to(df, F.col("doc_id") == 0).collect()} == {f"c{k}" for k in range(1, 12)}
    none = spark.createDataFrame([], df.schema)
    assert links.best_by_tags(none).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_nearest_by_tags_is_what_all_pairs_give(spark, seed, monkeypatch):
    """Several blocks, documents without a vector, a zero vector, equal vectors; the pairs are not made."""
    import random

    chunks, df = tagged_chunks(spark, seed)
    rng = random.Random(seed)
    v = {d: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] for d in range(40) if d % 7 != 5} | {3: [0.0] * 4}
    vectors = spark.createDataFrame(list(v.items()), "doc_id bigint, vector array<double>")
    of_chunk = spark.createDataFrame([(i, v[d]) for i, (d, _) in chunks.items() if d in v], "id string, vector array<double>")
    row = lambda r: (r["id"], r["other"], r["similarity"], r["r"])
    want = [row(r) for r in links.related_by_similarity(links.shared_tag_pairs(df), of_chunk, 0.2).collect()]
    monkeypatch.setattr(links, "shared_tag_pairs", None)
    monkeypatch.setattr(links, "DOCUMENTS", 9)
    got = [row(r) for r in links.nearest_by_tags(df, vectors, 0.2).collect()]
    assert want and sorted(got) == sorted(want)
    assert links.nearest_by_tags(df.where("false"), vectors, 0.2).count() == links.nearest_by_tags(df, vectors.where("false"), 0.2).count() == 0


def test_words_are_counted_in_their_row(spark):
    rows = [(["b", "a", "b", "é", "a", "b", "Z"],), ([],), (None,), (["x"],), (["a", None, "a"],)]
    got = [[(-x["less"], x["word"]) for x in r["c"] or []] for r in spark.createDataFrame(rows, "w array<string>").select(T.counted(F.col("w")).alias("c")).collect()]
    assert got == [[(3, "b"), (2, "a"), (1, "Z"), (1, "é")], [], [], [(1, "x")], [(2, "a")]]
    assert "Exchange" not in spark.createDataFrame(rows, "w array<string>").select(T.counted(F.col("w")))._jdf.queryExecution().toString()


def test_key_phrases_stay_in_their_row(spark):
    """Ties of phrases beyond the Basic Multilingual Plane go by bytes, and nothing is moved."""
    texts = {1: "deep sea, deep sky; the deep sea and Straße", 2: None, 3: "", None: "lost words", 4: " . ".join(["𝒳yzw", "ﬁnal", "abcd"])}
    df = spark.createDataFrame(list(texts.items()), "k bigint, t string")
    got = phrases.key_phrases(df, "k", F.col("t"), 2)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.collect()] == [(1, "deep sea", 4000000), (1, "deep sky", 4000000), (4, "abcd", 1000000), (4, "ﬁnal", 1000000)]


def test_nearest_that_shares_words_is_brute_force(spark):
    import random

    import numpy as np

    rng = random.Random(7)
    row = lambda k: (k, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], rng.sample(range(12), rng.randint(0, 6)))
    asked, known = [row(k) for k in range(25)], [row(100 + k) for k in range(60)] + [(200, None, [1, 2, 3]), (201, [0.0] * 4, [1, 2, 3, 4])]
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    want = {}
    for q, v, w in asked:
        best = sorted((-round(float(unit(v) @ unit(u)), 6) + 0.0, k) for k, u, x in known if u is not None and len(set(w) & set(x)) >= 3)
        want |= {q: (best[0][1], -best[0][0] + 0.0)} if best else {}
    kind = "vec_id bigint, embedding array<double>, words array<bigint>"
    got = nearest.nearest_sharing(spark.createDataFrame(asked, kind), spark.createDataFrame(known, kind), 3, block=9).collect()
    assert want and {r["query_id"]: (r["vec_id"], r["similarity"]) for r in got} == want and len(got) == len(want)


def test_fuzzy_blocks_move_few_rows(spark):
    """A window of many texts goes to BLOCKS blocks, whatever `block` is, and gives the same pairs."""
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(40)]
    texts = [" ".join(sorted(rng.sample(words, 6))) for _ in range(120)]
    texts += [t[:-1] + "x" for t in texts[:30]]
    rows = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(rows)), "key bigint, t string")
    want = {(a, b) for a, x in enumerate(rows) for b, y in enumerate(rows) if a < b and fuzzy.token_set_ratio(x, y) >= 94}
    found = fuzzy.alike_by_edits(df, 94, block=3)
    pairs = {tuple(r) for r in found.collect()}
    by_tokens = {tuple(r) for r in fuzzy.alike_by_tokens(df.select("key", "t", F.split("t", " ").alias("tokens")), 94).collect()}
    assert want and pairs <= want and want <= pairs | by_tokens
    many = spark.createDataFrame([(100,), (5000,), (119_191,), (1_000_000,)], "n long")
    assert [r[0] for r in many.select(fuzzy.blocks_of(F.col("n"))).collect()] == [1, 8, 8, 62]  # 1, 10, 233 and 1954 before
