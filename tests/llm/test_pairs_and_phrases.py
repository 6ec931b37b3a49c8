"""Exact duplicates, collocations and hard negatives against brute force, on given tables and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import exact, negatives, phrases, queries
from quarry.llm.fmindex import PhraseIndex

SF = "/root/testdata/sf0.001"
#: Columns beside the needed ones, whose names the operators use themselves.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, text_sha256 string, keep_id string, words string, shard int, phrase string"
VECTORS = "vec_id bigint, embedding array<float>, label int, row int, cell string, q string, shard int"


def tuples(df, columns):
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


# op11


def copies(rows):
    """doc_id, keep_id, group_size, kept, text_sha256 of (doc_id, text) rows."""
    of = defaultdict(list)
    for d, t in rows:
        of[t or ""].append(d)
    out = []
    for t, ids in of.items():
        keep = max((d for d in ids if d is not None), default=None)
        first = ids.index(keep)
        out += [(d, keep, len(ids), k == first, hashlib.sha256(t.encode()).hexdigest()) for k, d in enumerate(ids)]
    return sorted(out, key=str)


COLUMNS11 = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
TEXTS = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (5, " "), (None, "z"), (None, "z"), (6, "é" * 300_000), (9, "é" * 300_000), (7, "A"), (8, "a\x00")]


def docs_of(spark, rows, lang=lambda k: "en"):
    return spark.createDataFrame([(d, t, lang(k), "s", 1, 2, "x", "y", "z", 3, "p") for k, (d, t) in enumerate(rows)], DOCS)


def test_exact_duplicates_of_odd_rows(spark):
    assert tuples(exact.duplicates(docs_of(spark, TEXTS)), COLUMNS11) == copies(TEXTS)
    assert exact.duplicates(docs_of(spark, TEXTS).limit(0)).collect() == []


def test_exact_duplicates_with_a_hot_text(spark):
    rng = random.Random(4)
    rows = [(k, "hot" if rng.random() < 0.4 else f"text {rng.randrange(300)}") for k in range(3000)]
    df = docs_of(spark, rows).repartition(7)
    assert tuples(exact.duplicates(df), COLUMNS11) == copies(rows)


def test_texts_of_one_digest_are_told_apart_by_content(spark, monkeypatch):
    """A digest that is the same for many texts, as a second digest too, still gives each text its own group."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))
    rows = [(k, "ab"[k % 2] + str(k % 5)) for k in range(400)] + [(None, "a0"), (7, "b1")]
    got = tuples(exact.duplicates(docs_of(spark, rows), digest=lambda t: F.substring(t, 1, 1)), COLUMNS11[:4])
    assert got == sorted((r[:4] for r in copies(rows)), key=str)


def test_exact_duplicates_are_the_sqls(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.execute(queries.ORACLES["op11_exact_dedup"]).df()[COLUMNS11]
    assert tuples(queries.op11_exact_dedup(spark, SF), COLUMNS11) == sorted(map(tuple, want.itertuples(index=False)), key=str)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    df = docs_of(spark, TEXTS)
    got = exact.dedup(df)
    assert got.columns == df.columns
    texts = [r["text"] or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in TEXTS})
    assert {r["doc_id"] for r in got.collect() if r["text"] == "a"} == {2}


# op12


def grams(rows, longest=3):
    """Counts of phrases by language, and of words, of (lang, text) rows."""
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang, t = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for p in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def best_phrases(rows, best=2000, least=10):
    f, n = grams(rows)
    out = []
    for lang, of in f.items():
        found = {g: a for g, a in of.items() if len(g) > 1 and a >= least}
        ranked = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * b >= 50 * a and g in (h[:2], h[1:]) for h, b in found.items()):
                continue
            value, k = min((1_000_000 * a * a // (of[g[:k]] * of[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-value, -a, " ".join(g).encode(), of[g[:k]], of[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -v) for i, (v, a, p, left, right) in enumerate(sorted(ranked)[:best])]
    return sorted(out, key=str)


COLUMNS12 = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def texts_of(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 1, 2, "x", "y", "z", 3, "p") for k, (lang, t) in enumerate(rows)], DOCS)


def test_index_counts_phrases_and_their_neighbours():
    rng = random.Random(3)
    for _ in range(60):
        w = [rng.choice(range(rng.randint(2, 6))) for _ in range(rng.randint(0, 60))]
        for depth in (1, 2, 3, 4):
            for least in (1, 2):
                got = {tuple(g): tuple(map(int, x)) for lv in PhraseIndex(np.array(w, np.int32), depth).levels(least) for g, *x in zip(lv.words.tolist(), lv.count, lv.left, lv.right, strict=True)}
                want = {}
                for k in range(1, depth + 1):
                    for i in range(len(w) - k + 1):
                        if min(g := tuple(w[i : i + k])) >= least:
                            c, left, right = want.get(g, (0, 0, 0))
                            want[g] = (c + 1, left + (i > 0 and w[i - 1] > 0), right + (i + k < len(w) and w[i + k] > 0))
                assert got == want


def test_collocations_of_a_table(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert tuples(queries.op12_collocations(spark, SF), COLUMNS12) == best_phrases(rows)


@pytest.mark.parametrize("shard_words", [3, 50, 2_000_000])
def test_collocations_of_odd_rows_in_shards_of_any_size(spark, shard_words):
    rng = random.Random(6)
    words = ["a", "B", "ß", "c d", "x y", "é", ".", ",", "\n", "\t", "İ", "x.y"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("en", ".,;"), ("fr", "tick tock " * 5000), ("fr", "tick tock. " * 20), *[("en", "New York City hall")] * 15]
    df = texts_of(spark, rows).repartition(3)
    assert tuples(phrases.collocations(df, least=5, best=20, shard_words=shard_words), COLUMNS12) == best_phrases(rows, 20, 5)


def test_neighbours_are_added_up(spark):
    df = texts_of(spark, [("en", "x new york is, new york. y new york")] * 10)
    r = phrases.collocations(df).where("phrase = 'new york'").first()
    assert (r["a"], r["left_n"], r["right_n"]) == (30, 20, 10)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(texts_of(spark, [("en", "a b")]).limit(0)).collect() == []
    assert phrases.collocations(texts_of(spark, [("en", None)])).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 10**12, 3 * 10**12, 2 * 10**12
    df = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert df.select(phrases.score("a", "l", "r").alias("s")).first()["s"] == 1_000_000 * a * a // (left * right)


# op13


def mined(rows):
    """Hard negatives of (vec_id, vector, label) rows."""
    own = []
    for k, (v, e, label) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((v, [math.floor(256 * float(np.float32(x))) for x in e], (label + 1) % 10 if v is not None and v % 7 == 0 else label, k))
    width = max((len(r[1]) for r in own), default=0)
    q = np.array([r[1] + [0] * (width - len(r[1])) for r in own], np.int64).reshape(len(own), width)
    out = []
    for i, (v, _, label, _) in enumerate(own):
        if v is None or v % 100:
            continue
        score = (q @ q[i]).tolist()
        order = sorted(range(len(own)), key=lambda j: (-score[j], own[j][0] is None, own[j][0] or 0, j))
        for p in [j for j in order if j != i and own[j][2] == label][:5]:
            fit = [j for j in order if own[j][2] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            out += [(v, own[p][0], n + 1, own[j][0], score[p], score[j]) for n, j in enumerate(fit)]
    return sorted(out, key=str)


COLUMNS13 = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows], VECTORS)


def clustered(n, width=16, clusters=12, ids=1600):
    """Vectors near cluster centres, a third of them one vector; ids repeat."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(clusters, width))
    rows = []
    for k in range(n):
        j = int(rng.integers(clusters)) if k % 3 else 0
        e = centre[j] + (0.05 if k % 3 else 0) * rng.normal(size=width)
        rows.append((k * 4 % ids, (e / np.linalg.norm(e)).astype(np.float32).tolist(), j % 10 if k % 5 else int(rng.integers(10))))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 30, "shard_rows": 64, "seed_rows": 30}])
def test_hard_negatives_of_odd_rows(spark, sizes):
    rows = clustered(1200)
    rows += [(None, rows[3][1], 3), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan")] * 16, 2), (400, rows[0][1], None), (500, [0.5, 0.25], 2)]
    rows += [(600, [], 2), (-100, rows[7][1], 1), (0, [0.0] * 16, 1), (2**62 // 100 * 100, rows[5][1], 4), (700, [float("inf")] * 16, 2)]
    assert tuples(negatives.hard_negatives(vectors_of(spark, rows), **sizes), COLUMNS13) == mined(rows)


def test_hard_negatives_of_a_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert tuples(queries.op13_hard_negatives(spark, SF), COLUMNS13) == mined(rows)


def test_hard_negatives_with_wide_numbers(spark):
    """Scores over 53 bits are still exact; over 64 bits they are an error."""
    rng = np.random.default_rng(9)
    rows = [(k * 20, (rng.normal(size=4) * 10**6).astype(np.float32).tolist(), k % 3) for k in range(60)]
    assert tuples(negatives.hard_negatives(vectors_of(spark, rows)), COLUMNS13) == mined(rows)
    with pytest.raises(OverflowError):
        negatives.hard_negatives(vectors_of(spark, [(0, [1e15], 1), (1, [1e15], 1)]))


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(vectors_of(spark, [])).collect() == []


def test_cells_come_by_falling_bounds_that_hold():
    rng = np.random.default_rng(2)
    vectors = np.floor(256 * rng.normal(size=(500, 8)))
    books = (negatives.fitted(vectors[:, :4], 5), negatives.fitted(vectors[:, 4:], 6))
    codes = negatives.Codebooks(books, "int64")
    near = [negatives.nearest(h, b) for h, b in zip(codes.halves(vectors), books, strict=True)]
    cell = near[0][0] * len(books[1]) + near[1][0]
    n = len(books[0]) * len(books[1])
    codes.rows = np.bincount(cell, minlength=n)
    codes.radii = np.array([[near[h][1][cell == c].max(initial=0) for h in (0, 1)] for c in range(n)])
    for query in vectors[:20].astype(np.int64):
        visits = list(codes.visits(query))
        assert [v[0] for v in visits] and sorted(v[0] for v in visits) == np.flatnonzero(codes.rows).tolist()
        assert all(a[1] >= b[1] for a, b in zip(visits, visits[1:], strict=False))
        score = vectors @ query
        for k, (c, bound, own) in enumerate(visits):
            assert score[cell == c].max() <= own
            assert score[np.isin(cell, [v[0] for v in visits[k:]])].max() <= bound


def test_only_some_cells_are_asked_where_vectors_are_clustered(spark):
    rows, codes = negatives.index(negatives.quantised(vectors_of(spark, clustered(1200))), cell_rows=30, shard_rows=64)
    anchors = rows.where("vec_id % 100 = 0").withColumns({"tops": F.array().cast("array<bigint>"), "floor": F.lit(60000.0)})
    asked = negatives.asked(anchors, codes, None).select(F.explode("cells").alias("cell")).count()
    assert 0 < asked < anchors.count() * int((codes.rows > 0).sum()) / 2
