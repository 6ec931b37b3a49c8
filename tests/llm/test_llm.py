"""The training-data operators against brute force on small tables, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, eliasfano, html, lengths, minhash, mixing, ngrams, quality, queries, repeats, simhash, suffix, suffix_order, toxicity
from quarry.operators.components import components

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, words string, d string, bucket int, block int, h0 long"
#: Nulls in each column, empty and blank texts, ties, repeated rows, a long text, markup of other operators' columns.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "src1", 5, "x", "y", "z", 1, 2, 3),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "src1", 5, "x", "y", "z", 1, 2, 3),
    (2, None, None, None, None, None, None, None, None, None, None),
    (None, "one two three", "en", "src2", 3, None, None, None, None, None, None),
    (3, "", "en", "src2", 0, None, None, None, None, None, None),
    (4, " \n\t ", "en", "odd", 0, None, None, None, None, None, None),
    (5, "word " * 30_000 + "é😀", "fr", "src3", 9, None, None, None, None, None, None),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa mu", "en", "src1", 5, None, None, None, None, None, None),
    (7, "word " * 30_000 + "end", "de", "src3", 9, None, None, None, None, None, None),
    (8, "é", "de", "src3", 1, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# op5, op10


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_bpe_is_the_librarys(tokenizer):
    codec = bpe.Codec(open(BPE, encoding="utf-8").read())
    rng = random.Random(1)
    letters = "   aAeé  ​ \n\t\r\x1c\x85'sдж中😀1²٣_-.!́"
    odd_texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    plain = ["".join(rng.choice("ab c'stre.,!\n12_ Éüß×") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    special = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "", "it's we'll I'D don't", "  a  b \n c "]
    for text in odd_texts + plain + special:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want
        assert codec.decode(want) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_digests(docs, texts, tokenizer):
    got = by_id(bpe.digests(docs, BPE))
    for d, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip_in_spark(docs, texts):
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), BPE).select("doc_id", "ids"), BPE)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == texts


def test_token_counts(docs, texts, tokenizer):
    n = Counter(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts.values())
    sums = lengths.token_counts(docs, BPE)
    got = {r["context_limit"]: r for r in sums.collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r["n_docs"] == n[limit]
        assert r["docs_over"] == sum(k for x, k in n.items() if x > limit)
        assert r["tokens_total"] == sum(x * k for x, k in n.items())
        assert r["tokens_truncated"] == sum(min(x, limit) * k for x, k in n.items())
    for limit in (0, 7, 333, 10**6):
        assert lengths.truncated_total(sums, limit).first()[0] == sum(min(x, limit) * k for x, k in n.items())
    every = sorted(x for x, k in n.items() for _ in range(k))
    assert lengths.quantile(sums, 0.5).first()[0] == every[(len(every) + 1) // 2 - 1]


# op3


def test_base_counts(docs, texts, labels):
    got = by_id(quality.verdicts(docs, quality.trusted_rows(labels)))
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        rows = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(rows) - len(set(rows)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.LEAST_RATIO)


def test_ratios_are_brute_force(spark, docs, texts, labels):
    """llr from counts in plain Python; only the buckets' hash is Spark's."""
    trusted = {r["doc_id"] for r in quality.trusted_rows(labels).collect()}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts.items()}
    kinds = sorted({(a, b) for w in words.values() for a, b in zip(w, [*w[1:], None], strict=True)} | {(a, None) for w in words.values() for a in w}, key=str)
    n = quality.BUCKETS
    df = spark.createDataFrame(kinds, "a string, b string").select("a", "b", F.when(F.col("b").isNull(), F.pmod(F.xxhash64("a"), F.lit(n))).otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(n))).alias("k"))
    of = {(r["a"], r["b"]): r["k"] for r in df.collect()}
    grams = {d: [of[a, None] for a in w] + [of[p] for p in zip(w, w[1:], strict=False)] for d, w in words.items()}
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if d in trusted:
            target.update(g)
    total = sum(raw.values()), sum(target.values())
    ratio = {k: np.log((target[k] + 1) / (total[1] + n)) - np.log((raw[k] + 1) / (total[0] + n)) for k in raw}
    got = by_id(quality.verdicts(docs, quality.trusted_rows(labels)))
    for d, g in grams.items():
        want = float(np.mean([ratio[k] for k in g])) if g else 0.0
        assert got[d]["llr"] == pytest.approx(want, abs=1e-5)


def test_quality_keeps_clean_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.verdicts(spark.read.parquet(f"{sf}/documents.parquet"), quality.trusted_rows(labels, 150)).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) / len(clean) > 0.9 and sum(junk) / len(junk) < 0.5


# op1


def brute_removals(rows, window=100):
    first, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            if s in first:
                cover[p] += 1
                cover[p + window] -= 1
            first.add(s)
        c = np.cumsum(cover)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        out[d] = (len(b), int(c.sum()), int((c & ~np.concatenate([[False], c[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_ranks():
    rng = np.random.default_rng(0)
    for _ in range(150):
        x = rng.integers(1, rng.integers(2, 6), rng.integers(0, 50))
        order = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        want = np.empty(len(x), int)
        want[order] = np.arange(1, len(x) + 1)
        assert (suffix.suffix_ranks(x) == want).all()


@pytest.mark.parametrize("hot", [3, 20_000])
def test_removals(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_PIECES", hot)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(80):
        s = ""
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 300)
            s += b[a : a + rng.randint(20, 250)] + rng.choice(["", "x", "é", "aaaa" * rng.randint(0, 80), "ab" * rng.randint(0, 90)])
        rows.append((i, s))
    rows += [(1000, ""), (1001, None), (1002, "a" * 99), (1003, "a" * 100), (1004, "a" * 1500), (1005, "abc" * 400)]
    got = by_id(suffix.removals(spark.createDataFrame(rows, "doc_id bigint, text string")))
    want = brute_removals(rows)
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == want


def test_removals_of_documents(docs, texts):
    got = by_id(suffix.removals(docs))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute_removals(texts.items())


@pytest.mark.parametrize("n", [3, 9, 10, 11, 200])
def test_distributed_suffix_order(spark, monkeypatch, n):
    monkeypatch.setattr(suffix_order, "LOCAL", 4)
    monkeypatch.setattr(suffix_order, "BLOCK", 16)
    x = np.random.default_rng(n).integers(1, 3, n)
    got = suffix_order.ranks(spark.createDataFrame([(i, int(c)) for i, c in enumerate(x)], "pos bigint, c bigint"), n).collect()
    assert sorted((r["pos"], r["rank"]) for r in got) == list(enumerate(suffix.suffix_ranks(x).tolist()))


def test_windows_of_the_distributed_order(spark, monkeypatch):
    monkeypatch.setattr(suffix_order, "LOCAL", 500)
    monkeypatch.setattr(suffix_order, "BLOCK", 64)
    rng = random.Random(6)
    base = "".join(rng.choice("ab") for _ in range(120))
    rows = [(i, base[rng.randint(0, 60) :] + rng.choice(["", "x", "aaaa" * 20])) for i in range(9)] + [(20, None), (21, "")]
    first, want = set(), set()
    for d, t in rows:
        for p in range(len(t or "") - 29):
            if t[p : p + 30] in first:
                want.add((d, p))
            first.add(t[p : p + 30])
    got = suffix_order.later_windows(spark.createDataFrame(rows, "doc_id bigint, text string"), 30).collect()
    assert {(r["doc_id"], r["start"]) for r in got} == want


def test_texts_that_share_an_id(spark):
    """Each text of an id is a document of its own, however many there are; equal ones are one."""
    base = "".join(random.Random(1).choice("abcdef ") for _ in range(300))
    rows = [(None if i % 2 else 7, base if i < 2 else f"{i:04d}" * 30 + ("" if i % 5 else base[:150])) for i in range(600)] + [(7, base)]
    got = suffix.removals(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    # order: null first, then 7; within an id by the digest of the text
    digest = lambda t: hashlib.md5(t.encode()).digest()
    distinct = sorted({(-1 if d is None else d, digest(t), t) for d, t in rows})
    want = brute_removals([(i, t) for i, (_, _, t) in enumerate(distinct)])
    of = Counter((d, want[i]) for i, (d, _, t) in enumerate(distinct) for _ in range(sum(1 for e, u in rows if (-1 if e is None else e, u) == (d, t))))
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == of


def test_pieces_cover_all_windows():
    data = np.frombuffer(("abc" * 300 + "".join(random.Random(2).choice("xyz ") for _ in range(2000))).encode(), np.uint8)
    _, _, start, size, _ = repeats.pieces(data, 100)
    assert np.array_equal(np.concatenate([np.arange(s, s + n) for s, n in zip(start, size, strict=True)]), np.arange(len(data) - 99))


# op7


def test_bag_minhash_is_unbiased():
    rng, gap = np.random.default_rng(0), []
    for t in range(200):
        a = rng.integers(0, 40, 60).astype(np.uint64) + np.uint64(t * 1000)
        b = a.copy()
        b[:15] = rng.integers(0, 60, 15).astype(np.uint64) + np.uint64(t * 1000)
        s = minhash.signatures([a, b])
        gap.append((s[0] == s[1]).mean() - minhash.overlap(a, b))
    assert abs(np.mean(gap)) < 0.01


def brute_classes(texts, least=0.8):
    bags = {d: Counter(minhash.shingles(minhash.words_of(t)).tolist()) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, b in bags.items():
        for s in b:
            holders[s].append(d)
    top = {d: d for d in bags}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in {(x, y) for h in holders.values() for i, x in enumerate(h) for y in h[:i]}:
        if sum((bags[a] & bags[b]).values()) >= least * sum((bags[a] | bags[b]).values()):
            ra, rb = sorted((find(a), find(b)))
            top[rb] = ra
    return {d: find(d) for d in bags}


def test_classes(docs, texts):
    assert {d: r["class_id"] for d, r in by_id(minhash.classes(docs)).items()} == brute_classes(texts)


def test_classes_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randint(0, 399)] = f"n{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(w)))
    got = {d: r["class_id"] for d, r in by_id(minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))).items()}
    assert got == brute_classes(dict(rows))


def test_repeated_and_null_ids_lose_no_text(spark):
    long = [" ".join(f"{p}{k}" for k in range(30)) for p in "abc"]
    rows = [(1, long[0], 1), (1, long[1], 2), (2, long[2], 3), (None, long[1] + " x", 4), (None, long[0].replace("a29", "y"), 5), (None, "lonely text", 6), (3, long[2], 7), (3, long[2], 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row int")
    kept = {r["row"] for r in minhash.dedup(df).collect()}
    assert kept == {1, 2, 3, 6}
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in minhash.classes(df).collect())
    assert got == [(0, 0), (0, 1), (0, 1), (1, 1), (1, 1), (2, 2), (3, 2), (3, 2)]


def test_classes_of_large_groups_are_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(300)]
        for _ in range(150):
            w = list(base)
            # around the limit of 0.8: many pairs are linked only over others
            for _ in range(rng.randint(3, 9)):
                w[rng.randint(0, 299)] = f"n{rng.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(w)))
    got = {d: r["class_id"] for d, r in by_id(minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))).items()}
    assert got == brute_classes(dict(rows))


def test_equal_slots(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (40, minhash.SLOTS)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < 0.4, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    rows = [(i, x.view(np.int64).tolist(), y.view(np.int64).tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    got = spark.createDataFrame(rows, "i int, x array<bigint>, y array<bigint>").select("i", minhash.equal_slots("x", "y").alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == dict(enumerate((a == b).sum(1).tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# op2


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.02


def test_models_are_kneser_ney(spark):
    """Both log-likelihoods of each text in full, in plain Python."""
    rng = random.Random(6)
    common, bad = [f"c{k}" for k in range(2000)], ["mean", "nasty", "vile"]
    rows = []
    for i in range(300):
        w = [rng.choice(common) for _ in range(rng.randint(0, 40))]
        if i % 6 == 0:
            w = [rng.choice(bad) if rng.random() < 0.3 else x for x in w] + ["so", "nasty"]
        rows.append((" ".join([*w, "so", "c1"]), int(i % 6 == 0)))
    n = [Counter(), Counter()]
    for t, c in rows:
        w = ["", *t.split()]
        n[c].update(set(zip(w, w[1:], strict=False)))
    cont = [Counter(w for _, w in x) for x in n]
    shared = Counter(w for _, w in n[0].keys() | n[1].keys())
    ctx = [Counter(), Counter()]
    for c in (0, 1):
        for (v, _), k in n[c].items():
            ctx[c][v] += k
    off = lambda k, e: min(k, toxicity.SHARED * e + toxicity.DEVIATIONS * e**0.5 + toxicity.DISCOUNT)
    total = [sum(x.values()) for x in cont]
    d1 = [{w: off(k, (cont[0][w] + cont[1][w]) * total[c] / sum(total)) for w, k in cont[c].items()} for c in (0, 1)]
    d2 = [{p: off(k, (n[0][p] + n[1][p]) * ctx[c][p[0]] / (ctx[0][p[0]] + ctx[1][p[0]])) for p, k in n[c].items()} for c in (0, 1)]
    floor = toxicity.FLOOR

    def log_likelihood(c, w):
        out = 0
        for v, x in zip(["", *w], w, strict=False):
            p = (shared[x] + floor) / (sum(shared.values()) + floor * (len(shared) + 1))
            p = (cont[c][x] - d1[c].get(x, 0)) / total[c] + sum(d1[c].values()) / total[c] * p
            left = sum(k for q, k in d2[c].items() if q[0] == v) / ctx[c][v] if ctx[c][v] else 1
            out += np.log(((n[c][v, x] - d2[c].get((v, x), 0)) / ctx[c][v] if ctx[c][v] else 0) + left * p)
        return out

    as_long = lambda x: int(np.array([x], np.uint64).view(np.int64)[0])
    key = lambda w: as_long(toxicity.token_hashes(w)[1] if w else 0)
    grams = spark.createDataFrame([(key(v), key(w), n[0][v, w], n[1][v, w]) for v, w in n[0].keys() | n[1].keys()], "v bigint, w bigint, a int, b int")
    model = toxicity.build(grams, [F.col("a"), F.col("b")])
    assert len(model.words) >= 3 and len(model.pairs) >= 1
    for t in [*(t for t, _ in rows[:40]), "c1 c2 unheard nasty", "unheard", "vile vile"]:
        w = t.split()
        want = (log_likelihood(1, w) - log_likelihood(0, w)) / len(w) if w else 0
        assert model.mean_ratio(toxicity.token_hashes(t)) == pytest.approx(want, abs=1e-9)


# op4


def test_main_text():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>m</a></nav><article><h1>A &amp; B</h1><p><b>x  y<br><p>z&nbsp;&#233;<ul><li>1<li>2</ul>"
        "<script>var a='</p>';</script><div class='comments'><p>no</p></div></article><div class=\"ad\">buy</div><div class='cookie-notice'>c</div><footer>f</footer>"
    )
    assert html.main_text(page) == "A & B\n\nx y\n\nz é\n\n1\n\n2"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("<p>a<div>b</div>c</p>") == "a\n\nb\n\nc"


def test_templates_go(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", f"<body><div><p>Always here</p></div><div><p>Own text {i}</p></div>") for i in range(12)] + [(99, None, None), (98, "x", "<p>q")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Own text {i}" for i in range(12)} | {99: "", 98: "q"}


@pytest.mark.parametrize("tag", ["article", "main"])
def test_templates_in_articles_go(spark, tag):
    page = lambda i, text: f"<body><{tag}><h1>T{i}</h1><p>{text}</p><div class='x{i % 2}7'>Read our app <b>now</b></div></{tag}></body>"
    own = {i: f"Own words of page {i} and <b>the same</b> ones" for i in range(12)}
    copied = "A long text that stands on many pages of this site, " * 9
    rows = [(i, f"http://a.example.com/{i}", page(0, t).replace("T0", f"T{i}")) for i, t in own.items()]
    # copies of one article, some with another date, and edited copies: their paragraphs stay
    rows += [(100 + i, f"http://b.example.com/{i}", f"<{tag}><div><p>{copied}</p></div><time>{i}.1.2020</time></{tag}>") for i in range(8)]
    rows += [(200 + i, f"http://c.example.com/{i}", f"<{tag}><p>Short but the same</p><p>{copied}</p><p>n {i}</p></{tag}>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = {i: f"T{i}\n\nOwn words of page {i} and the same ones" for i in own}
    want |= {100 + i: f"{copied.strip()}\n\n{i}.1.2020" for i in range(8)} | {200 + i: f"Short but the same\n\n{copied.strip()}\n\nn {i}" for i in range(8)}
    assert got == want


def test_articles_are_chosen_after_the_deletion():
    page = "<main><p>Text of the page</p><article><div>Always here</div></article></main>"
    root = html.parse(page)
    own, _ = html.subtree_hashes(root)
    inner = {own[id(root.children[0].children[1].children[0])]}
    assert html.main_text(page) == "Always here" and html.main_text(page, inner=inner) == "Text of the page"


def plain_pages(n, hosts=2):
    """Pages without article, main or telling names: only counts can tell menus, adverts and footers from the text."""
    rng = random.Random(12)
    stock = [f"Stock line {k} about nothing" for k in range(6)]
    rows, want = [], {}
    for i in range(n):
        words = lambda k: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(k))
        own = [f"Title {words(4)}", words(40), words(25)]
        menu = "".join(f"<div><a>{w}</a></div>" for w in rng.choice(stock).split())
        rare = f"Only once {i}" if i % 9 == 0 else rng.choice(stock)
        rows.append((i, f"http://h{i % hosts}.example.com/{i}", f"<body><div class='x1'>{menu}</div><div class='x2'>{rare}</div><div class='x3'><h1>{own[0]}</h1><p>{own[1]}</p><p>{own[2]}</p></div><div class='x4'>&copy; h{i % hosts} {rng.choice(stock)}</div></body>"))
        want[i] = "\n\n".join(own)
    return rows, want


def test_slots_go(spark):
    rows, want = plain_pages(80)
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_subtree_counts_are_brute_force(spark):
    rows, _ = plain_pages(30)
    rows += rows[:3]
    seen = defaultdict(set)
    for _, url, page in rows:
        host = url.split("/")[2]
        for block in re.findall(r"<div class='x[24]'>[^<]*</div>", page):
            seen[host, block].add(max(re.findall(r">([^<]+)<", page), key=len))
    root = {b: html.parse(f"<body>{b}</body>") for _, b in seen}
    own = {b: html.subtree_hashes(r)[0][id(r.children[0].children[0])] for b, r in root.items()}
    got = {(r["host"], r["subtree"]): r["n"] for r in html.subtree_counts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect() if r["subtree"] is not None}
    assert {(h, b): got[h, own[b]] for h, b in seen} == {k: len(v) for k, v in seen.items()}


def test_odd_pages(spark):
    schema = "page_id bigint, url string, html string, host string, salt int, subtrees string, text string, slots string"
    long = "<p>" + "long " * 50_000 + "</p>"
    rows = [(1, None, None, "a", 1, "b", "c", "d"), (2, "http://a.example.com/", "", None, None, None, None, None), (3, "http://a.example.com/", long, "x", 2, "y", "z", "w"), (3, "http://a.example.com/", long, "x", 2, "y", "z", "w"), (None, "::", "<p>q", None, None, None, None, None)]
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 249_999), (3, 249_999)]
    assert html.extract(spark.createDataFrame([], schema)).count() == 0


# op6


def test_elias_fano():
    rng = np.random.default_rng(0)
    for universe, n in ((10, 3), (1000, 900), (10**9, 5000), (2**40, 1000), (5, 5), (1, 1), (3000, 2), (10**6, 70_000)):
        v = np.unique(rng.integers(0, universe, n))
        e = eliasfano.EliasFano(eliasfano.encode(v, universe))
        assert (e.access(np.arange(len(v))) == v).all()
        asked = np.concatenate([v, rng.integers(0, universe, 500), [-1, universe, universe + 7]])
        at = np.minimum(np.searchsorted(v, asked), len(v) - 1)
        assert (e.find(asked) == np.where(v[at] == asked, at, -1)).all()
        lo, hi = len(v) // 3, len(v) - len(v) // 4
        assert (e.find(asked, lo, hi) == np.where((v[at] == asked) & (at >= lo) & (at < hi), at, -1)).all()
        never_falls = np.sort(rng.integers(0, universe, n))
        assert (eliasfano.EliasFano(eliasfano.encode(never_falls, universe)).access(np.arange(n)) == never_falls).all()


@pytest.mark.parametrize("n", [0, 1, 4000])
def test_trie_in_a_mapped_file(tmp_path, n):
    import mmap

    rng = np.random.default_rng(n)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 50, n) ** 3, rng.integers(1, 3000, n), strict=True)})
    contexts = np.array(sorted({a for a, _ in pairs}), np.int64)
    of = np.searchsorted(contexts, [a for a, _ in pairs])
    codes, backoff = rng.integers(1, 60_000, len(pairs)).astype(np.uint16), rng.integers(1, 60_000, len(contexts)).astype(np.uint16)
    (tmp_path / "trie").write_bytes(eliasfano.Trie.pack(contexts, backoff, of, np.array([b for _, b in pairs], np.int64), codes))
    with open(tmp_path / "trie", "rb") as f:
        trie = eliasfano.Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        asked = pairs + [(int(a), int(b)) for a, b in zip(rng.integers(0, 130_000, 500), rng.integers(1, 5000, 500), strict=True)] + [(a, 10**9) for a, _ in pairs[:5]]
        got = trie.lookup(np.array([a for a, _ in asked], np.int64), np.array([b for _, b in asked], np.int64))
        want, back = dict(zip(pairs, codes.tolist(), strict=True)), dict(zip(contexts.tolist(), backoff.tolist(), strict=True))
        assert got[0].tolist() == [want.get(p, 0) for p in asked]
        assert got[1].tolist() == [back.get(a, 0) for a, _ in asked]


def test_scores(docs, texts, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 20_000)
    got = by_id(ngrams.scores(docs))
    tokens = {d: ngrams.tokens(t) for d, t in texts.items()}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for d in train for w in tokens[d])
    pairs = Counter(p for d in train for p in zip([None, *tokens[d][:-1]], tokens[d], strict=True))
    total, kinds = Counter(), Counter()
    for (v, _), k in pairs.items():
        total[v] += k
        kinds[v] += 1
    n, types = sum(c.values()), len(c)
    once, twice = (sum(k == x for k in c.values()) for x in (1, 2))
    discount = once / (once + 2 * twice)
    for d, t in tokens.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, d not in train)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + types + 1)) for w in t))
        want = 0
        for v, w in zip([None, *t[:-1]], t, strict=True):
            single = (c[w] - discount) / n if c[w] else discount * types / n
            left = ngrams.DISCOUNT * kinds[v] / total[v] if total[v] else 1
            want += np.log10(min(1, (max(pairs[v, w] - ngrams.DISCOUNT, 0) / total[v] if total[v] else 0) + left * single))
        assert r["score"] == pytest.approx(want, abs=2e-4 * len(t))


# op8


def test_budgets_are_filled(docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["n_tokens"] for r in rows)
    leaves = defaultdict(list)
    for r in rows:
        leaves[r["domain"], r["lang"], r["source"]].append(r)
    assert sum(r["tokens_taken"] for r in rows) == total * 50 // 100
    for own in leaves.values():
        assert sum(r["tokens_taken"] for r in own) == own[0]["leaf_budget"] <= 2 * sum(r["n_tokens"] for r in own)


def brute_mix(rows, targets):
    """doc_id -> (copies, tokens taken), for different doc_ids: the tree's budgets and each leaf's epochs, one by one."""
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    path = {}
    for r in rows:
        number = re.search(r"(\d{1,9})$", r["source"] or "")
        path[r["doc_id"]] = ("d" + str(int(number[1]) % 4) if number else "other", r["lang"] or "(none)", r["source"] or "(none)")
    leaf = Counter()
    for d, p in path.items():
        leaf[p] += size[d]
    weights = (targets.domains, targets.langs, targets.sources)

    def share(budget, at):
        if len(at) == 3:
            return {at: budget}
        room = Counter()
        for p, n in leaf.items():
            if p[: len(at)] == at:
                room[p[len(at)]] += n * targets.max_epochs
        left, todo, given = budget, sorted(room, key=lambda k: (room[k] / weights[len(at)].get(k, 1), k)), {}
        while todo:
            w = {k: weights[len(at)].get(k, 1) for k in todo}
            k = todo[0]
            if room[k] * sum(w.values()) > w[k] * left:
                given |= {k: w[k] * left // sum(w.values()) for k in todo}
                for k in todo[: left - sum(given[k] for k in todo)]:
                    given[k] += 1
                break
            given[k] = room[k]
            left -= room[k]
            todo.pop(0)
        return {p: n for k, b in given.items() for p, n in share(b, (*at, k)).items()}

    total = sum(leaf.values())
    budgets = share(min(total * targets.budget_percent // 100, total * targets.max_epochs), ())
    out = {}
    for p, budget in budgets.items():
        own = [d for d in path if path[d] == p]
        full = budget // leaf[p] if leaf[p] else 0
        wanted = budget - full * leaf[p]
        for d in sorted(own, key=lambda d: hashlib.md5(f"{targets.seed}:{full}:{d}".encode()).hexdigest()):
            last = min(size[d], max(wanted, 0))
            out[d] = (full + (wanted > 0), full * size[d] + last)
            wanted -= size[d]
    return out


@pytest.mark.parametrize("targets", [mixing.Targets(), mixing.Targets(max_epochs=1), mixing.Targets(budget_percent=130, max_epochs=3, seed=11)])
def test_mix_is_brute_force(docs, targets):
    got = {r["doc_id"]: (r["copies"], r["tokens_taken"]) for r in mixing.mix(docs, targets).collect()}
    assert got == brute_mix(docs.collect(), targets)


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 1000)], "domain string, lang string, source string, tokens bigint")
    t = mixing.Targets(domains={"a": 1, "b": 1}, langs={}, sources={}, budget_percent=20, max_epochs=1)
    got = {r["source"]: r["leaf_budget"] for r in mixing.leaf_budgets(leaves, t).collect()}
    # 602 tokens: 301 for each domain; a's odd one goes to the child of the least capacity for its weight
    assert got == {"s1": 10, "s2": 140, "s3": 151, "s4": 301}


# op9


def test_fingerprints(docs, texts):
    got = by_id(simhash.fingerprints(docs))
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, after = texts[d], texts[order[(i + 1) % len(order)]]
        k = len(t) // 3
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    own = defaultdict(set)
    for d, t in texts.items():
        own[t].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in own.values())
    assert np.median([r["near_edited"] for r in got.values()]) > 0.5 > np.median([r["near_next"] for r in got.values()]) + 0.3


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def as_prints(spark, prints):
    return spark.createDataFrame([(f"{x:032x}", signed(x >> 64), signed(x & (2**64 - 1))) for x in prints], "id string, high bigint, low bigint")


def test_permuted_tables_find_all_near_ones(spark, monkeypatch):
    rng = random.Random(4)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(128)
        prints |= {x} | {x ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 6))) for _ in range(4)}
    # a group around one fingerprint that fills buckets, with some of it connected only over others
    x = rng.getrandbits(128)
    prints |= {x ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 7))) for _ in range(120)}
    every = sorted(prints)
    want = {frozenset((a, b)) for i, a in enumerate(every) for b in every[:i] if (a ^ b).bit_count() <= simhash.RADIUS}
    got = {frozenset((int(r[0], 16), int(r[1], 16))) for r in simhash.near_pairs(as_prints(spark, prints)).collect()}
    assert got == want
    top = {x: x for x in every}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for pair in want:
        a, b = sorted(map(find, pair))
        top[b] = a
    label = {int(r["id"], 16): int(r["component"], 16) for r in simhash.near_classes(as_prints(spark, prints)).collect()}
    assert {x: label.get(x, x) for x in every} == {x: find(x) for x in every}


def test_fingerprint_bits(spark, texts):
    """The votes of each bit, from the shingles' hashes alone."""
    some = dict(sorted(texts.items())[:25]) | {10**6: "one two", 10**6 + 1: "a b c d e a b c d e a"}
    rows = []
    for d, t in some.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        rows += [(d, *(w[i : i + 5] + [None] * 5)[:5]) for i in range(max(len(w) - 4, min(len(w), 1)))]
    cells = [f"w{k}" for k in range(5)]
    hashed = spark.createDataFrame(rows, "d bigint, " + ", ".join(f"{c} string" for c in cells)).select("d", F.xxhash64(*cells), F.xxhash64(F.lit(7), *cells)).collect()
    votes, n = defaultdict(lambda: [0] * 128), Counter()
    for d, high, low in hashed:
        n[d] += 1
        for k, h in enumerate((high, low)):
            for i in range(64):
                votes[d][64 * k + i] += (h >> i) & 1
    want = {d: "".join(f"{sum(1 << i for i in range(64) if 2 * votes[d][64 * k + i] > n[d]):016x}" for k in (0, 1)) for d in some}
    got = by_id(simhash.fingerprints(spark.createDataFrame(list(some.items()), "doc_id bigint, text string")))
    assert {d: r["fingerprint"] for d, r in got.items()} == want
    order = sorted(some, reverse=True)
    for i, d in enumerate(order):
        r, after = got[d], got[order[(i + 1) % len(order)]]
        like = lambda a, b: max(0.0, float(np.cos((int(a, 16) ^ int(b, 16)).bit_count() / 128 * np.pi)))
        assert r["near_next"] == pytest.approx(like(r["fingerprint"], after["fingerprint"]))
        assert r["near_edited"] == pytest.approx(like(r["fingerprint"], r["edited_fingerprint"]))


def test_next_rows_with_gaps_and_outliers(spark):
    rng = random.Random(9)
    ids = sorted({*range(500), *(rng.randint(0, 10**6) for _ in range(300)), 10**15, -(10**12)})
    rows = [(d, f"text {d}") for d in ids] + [(None, "none")]
    got = simhash.neighbours(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = {f"text {d}": f"text {ids[i - 1]}" for i, d in enumerate(ids) if i} | {f"text {ids[0]}": "none", "none": f"text {ids[-1]}"}
    assert {r["text"]: r["next_text"] for r in got} == want
    assert len({(r["range"], r["nth"]) for r in got}) == len(rows) and len({r["range"] for r in got}) > 60


def test_near_rows_are_a_class(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(1000)]
    edited = [*base[:500], "changed", *base[501:]]
    other = [f"v{rng.randint(0, 10**6)}" for _ in range(1000)]
    rows = [(4, " ".join(base)), (2, " ".join(edited)), (9, " ".join(base)), (5, " ".join(other)), (7, " ".join([*base[:100], "x", *base[101:]])), (None, " ".join(other))]
    got = by_id(simhash.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {d: (r["class_id"], r["n_same"], r["n_class"]) for d, r in got.items()} == {4: (2, 1, 4), 9: (2, 1, 4), 2: (2, 0, 4), 7: (2, 0, 4), 5: (5, 1, 2), None: (5, 1, 2)}


# odd rows


def run_all(df, labels):
    return {
        "suffix": suffix.removals(df), "suffix dedup": suffix.dedup(df), "toxicity": toxicity.scores(df, labels), "quality": quality.verdicts(df, quality.trusted_rows(labels)), "bpe": bpe.digests(df, BPE),
        "lm": ngrams.scores(df), "classes": minhash.classes(df), "dedup": minhash.dedup(df), "mix": mixing.mix(df), "chosen": mixing.chosen(df, mixing.Targets(max_epochs=1)),
        "simhash": simhash.fingerprints(df), "lengths": lengths.token_counts(df, BPE),
    }


def test_odd_rows(odd, labels):
    clash = odd.withColumns({c: F.lit(1) for c in ("toxic", "fold", "tid", "bands", "marks", "nth", "key", "range", "next_text", "own", "component", "top", "n_tokens", "tokens", "capacity", "budget")})
    got = {name: df.collect() for name, df in run_all(clash, labels.withColumn("text", F.lit("x"))).items()}
    for name in ("suffix", "toxicity", "quality", "bpe", "lm", "mix", "simhash"):
        assert sorted(r["doc_id"] is None or r["doc_id"] for r in got[name]) == sorted(r[0] is None or r[0] for r in ODD), name
    classes = {r["doc_id"]: r["class_id"] for r in got["classes"]}
    assert classes == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6, 7: 5, 8: 8, None: None}
    assert classes[None] is None
    assert sorted((r["doc_id"] or 0) for r in got["dedup"]) == [0, 1, 2, 5, 6, 8]
    assert got["dedup"][0].asDict().keys() == clash.first().asDict().keys() == got["chosen"][0].asDict().keys() == got["suffix dedup"][0].asDict().keys()
    assert {r["doc_id"]: r["kept"] for r in got["quality"]}[3] is False
    empty = {r["doc_id"]: r for r in got["bpe"]}[2]
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_tables(odd, labels):
    for name, df in run_all(odd.limit(0), labels.limit(0)).items():
        assert df.count() == 0, name


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, tokenizer):
    """Each stage on its predecessor's rows against brute force."""
    import corpus_pipeline
    from quarry.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        rows = docs.collect()
        of = {r["doc_id"]: r["text"] for r in rows}
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(got)
        if k == 0:
            assert set(got) == {r["doc_id"] for r in quality.verdicts(table(spark, SF, "documents"), quality.trusted_rows(labels)).collect() if r["kept"]}
        elif k == 1:
            assert set(got) == set(brute_classes(of).values())
        elif k == 2:
            want, first = {}, set()
            for d, t in sorted(of.items()):
                b = t.encode()
                keep = np.ones(len(b), bool)
                for p in range(len(b) - 99):
                    if b[p : p + 100] in first:
                        keep[p : p + 100] = False
                    first.add(b[p : p + 100])
                want[d] = bytes(np.frombuffer(b, np.uint8)[keep]).decode("utf-8", "ignore")
            assert got == {d: t for d, t in want.items() if t or not of[d]}
        else:
            assert set(got) == {d for d, (copies, _) in brute_mix(rows, mixing.Targets(max_epochs=1)).items() if copies}
        assert k == 2 or all(got[d] == of[d] for d in got)
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert {d: r["n_tokens"] for d, r in last.items()} == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) for d, t in got.items()}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, odd, k):
    import corpus_pipeline

    clash = odd.withColumns({c: F.lit("x") for c in ("row_", "d_", "h_", "t_", "left_", "doc_", "text_hash", "toxic")})
    got = corpus_pipeline.STAGES[k][1](spark, clash, SF)
    assert k == 4 or got.columns == clash.columns
    assert got.count() <= clash.count()
    assert corpus_pipeline.STAGES[k][1](spark, clash.limit(0), SF).count() == 0


def recipes(n, every):
    """Articles of one site whose headings recur, on all pages or on one of `every`, with their own paragraphs."""
    rng = random.Random(n + every)
    words = lambda k: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        own = [f"Dish {words(2)}", words(20), words(30), words(25)]
        parts = [f"<h1>{own[0]}</h1><p>{own[1]}</p>", f"<h2>Ingredients</h2><p>{own[2]}</p><h2>Method</h2><div><h3>Step</h3><p>{own[3]}</p></div><p>Serve warm.</p>"]
        text = [own[0], own[1], "Ingredients", own[2], "Method", "Step", own[3], "Serve warm."]
        if i % every:
            parts[1], text[2:] = f"<p>{own[2]}</p>", [own[2]]
        rows.append((i, f"http://food.example.com/{i}", f"<body><nav>x</nav><article>{''.join(parts)}</article><footer>f</footer></body>"))
        want[i] = "\n\n".join(text)
    return rows, want


@pytest.mark.parametrize(("n", "every"), [(10, 1), (200, 1), (200, 2), (200, 3)])
def test_headings_and_phrases_that_recur_in_articles_stay(spark, n, every):
    rows, want = recipes(n, every)
    assert {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} == want


def test_extraction_is_brute_force(spark):
    """The given pages by regular expressions alone: what stands in the article, cut at the tags of blocks."""
    import html as names

    block = r"</?(?:p|div|h[1-6]|ul|ol|li|table|tr|td|th|blockquote|section|article|pre|figure|figcaption|dl|dt|dd|form|aside|nav|header|footer)\b[^>]*>"
    for r in spark.read.parquet(f"{SF}/pages.parquet").join(queries.op4_html_extraction(spark, SF).select("page_id", "text"), "page_id").collect():
        own = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", r["html"] or "")
        own = re.search(r"(?is)<article\b[^>]*>(.*?)(?:</article>|$)", own)[1]
        own = re.sub(r"(?is)<(nav|aside|form|footer)\b.*?</\1>|<div class=\"(?:ad|comments?|share|related|cookie[^\"]*)\".*?</div>", "<p>", own)
        parts = [" ".join(names.unescape(re.sub(r"<br\s*/?>", " ", p) if "<br" in p else p).split()) for p in re.split(block, own)]
        parts = [" ".join(names.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert r["text"] == "\n\n".join(p for p in parts if p), r["page_id"]
