"""Operators that SQL can't state: redaction vectors, streams against batches, files."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import categories, chunking, dedup, dictionary, folds, fuzzy, links, nearest, phrases, redact, spans, termindex, tickets
from quarry.plans import ingest_queries, more_queries, registry, rule_queries  # noqa: F401
from quarry.sources import files, ticket_store
from quarry.streaming import streams


def one(spark, make, text):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("make", "text", "want"), [
    (redact.bearer, "Bearer abcdefgh123", "Bearer <CREDENTIAL>"),
    (redact.account_numbers, "id 123456789 of 3f2504e0-4f89-11d3-9a0c-0305e82c3301", "id <ACCOUNT_NUMBER> of 3f2504e0-4f89-11d3-9a0c-0305e82c3301"),
    (redact.credentials, "password=hunter22, ok", "password=<CREDENTIAL>, ok"),
    (redact.account_numbers, "acct12345678 and 12345678,87654321 but deadbeef12 and 1234567", "acct<ACCOUNT_NUMBER> and <ACCOUNT_NUMBER>,<ACCOUNT_NUMBER> but deadbeef12 and 1234567"),
    *[(redact.credentials, f"a {w}: abcd1234 b", f"a {w}: <CREDENTIAL> b") for w in ("password", "passwd", "pwd", "pass", "secret", "api_key", "api-key", "apikey", "credential")],
    (redact.credentials, "db_password=abcd1234", "db_password=<CREDENTIAL>"),
    (redact.slash_pairs, "use admin/pa55word! now, and/or not", "use <CREDENTIAL> now, and/or not"),
    *[(redact.addresses, f"at 12 Oak {w} now", "at <ADDRESS> now") for w in "Street St Avenue Ave Boulevard Blvd Road Rd Drive Dr Lane Ln Court Ct Way Place Pl Circle Cir".split()],
    *[(redact.phones, f"{w} 303-555-0199", f"{w} 303-555-0199") for w in ("helpdesk", "help desk", "support line", "escalate", "oncall", "on-call", "contact", "phone:", "call list", "option 2", "ext. 5", "toll free", "1-855")],
    (redact.phones, "contact " + "x" * 130 + " 3035550199 or (303) 555 0199", "contact " + "x" * 130 + " <PHONE> or <PHONE>"),
    *[(lambda t: redact.persons(t, ("Alex Doe",)), f"{w} Alex Doe", f"{w} Alex Doe") for w in ("escalate to", "contact", "oncall", "on-call", "director", "engineer", "analyst", "lead", "team", "VP ", "attn:", "assigned to", "owned by", "POC", "SME", "ext 5")],
    (lambda t: redact.emails(t, ("example.org",)), "a@example.com b@example.org", "<EMAIL> b@example.org"),
    (redact.phones, "call 303-555-0199", "call <PHONE>"),
    (redact.phones, "toll free 800-555-0199", "toll free 800-555-0199"),
    (redact.phones, "escalation: 303-555-0199", "escalation: 303-555-0199"),
    (redact.addresses, "at 12 North Oak Street Apt 4", "at <ADDRESS>"),
    (lambda t: redact.persons(t, ("Alex Doe",)), "Alex Doe called. The manager Alex Doe too.", "<PERSON_NAME> called. The manager Alex Doe too."),
])
def test_redact(spark, make, text, want):
    assert one(spark, make, text) == want
    assert one(spark, lambda t: make(make(t)), text) == want


@pytest.mark.parametrize("text", ["index=main | stats count by a@example.com", "sourcetype=x a@example.com", "a | dedup b@example.com", "earliest=-1d a@example.com", "field.name : a@example.com", "x AND a.b a@example.com"])
def test_log_queries_keep_their_pairs(spark, text):
    assert one(spark, redact.sanitize, text) == text
    assert one(spark, redact.sanitize, "Bearer abcdefgh1 12345678 " + text) == "Bearer <CREDENTIAL> <ACCOUNT_NUMBER> " + text


def test_whole_documents_against_plain_python(spark):
    """Numbers, phones and pairs in every document, cut out and judged one by one."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    extra = ["a 3f2504e0-4f89-11d3-9a0c-0305e82c3301 12345678 cafe1234 9", "call 3035550199, x 303-555-0188 helpdesk", "u/p4ss u/pa55word /x/y1234"]
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(10**6 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in df.select("doc_id", redact.account_numbers(F.col("text")).alias("a"), redact.phones(F.col("text")).alias("p"), redact.slash_pairs(F.col("text")).alias("s")).collect()}
    for d, t in rows:
        if t is None:
            continue
        safe = [m.span() for m in re.finditer(redact.UUID, t)] + [m.span() for m in re.finditer(redact.HEX_WORD, t)]
        masked, at = "", 0
        for m in re.finditer(r"\d+", t):
            if 8 <= len(m[0]) <= 16 and not any(lo <= m.start() and m.end() <= hi for lo, hi in safe):
                masked, at = masked + t[at : m.start()] + "<ACCOUNT_NUMBER>", m.end()
        assert got[d]["a"] == masked + t[at:], d
        out, at = "", 0
        for m in re.finditer(redact.PHONE, t, re.A):
            near = t[max(0, m.start() - 120) : m.end() + 120]
            if not re.search(redact.PHONE_CONTEXT, near, re.I) and not re.match(f"1?({redact.TOLL_FREE})", re.sub(r"\D", "", m[0])):
                out, at = out + t[at : m.start()] + "<PHONE>", m.end()
        assert got[d]["p"] == out + t[at:], d
        assert got[d]["s"] == re.sub(redact.SLASH_PAIR, "<CREDENTIAL>", t, flags=re.A), d


@pytest.mark.parametrize(("n", "size", "overlap"), [(0, 5, 2), (1, 5, 2), (5, 5, 2), (6, 5, 2), (23, 7, 3), (9, 4, 9)])
def test_windows_cover_all_words(spark, n, size, overlap):
    df = spark.createDataFrame([([str(i) for i in range(n)],)], "words array<string>")
    parts = [r["part"] for r in chunking.split_with_overlap(df, "words", size, overlap).orderBy("k").collect()]
    step, want, at = max(size - overlap, 1), [], 0
    while n:
        want.append([str(i) for i in range(at, min(at + size, n))])
        if at + size >= n:
            break
        at += step
    assert parts == want


def test_read_chunks_leaves_out_bad_lines(spark, tmp_path):
    (tmp_path / "chunks.sop.jsonl").write_text(json.dumps({"id": "a", "text": "x", "tags": ["t"]}) + "\n\n{broken\n" + json.dumps({"id": "", "text": "y"}) + "\n")
    assert [r["id"] for r in files.read_chunks(spark, str(tmp_path)).collect()] == ["a"]


def test_write_by_category_replaces_only_what_it_writes(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id string, metadata struct<nlp_category:string>")
    files.write_by_category(make([("a", ("sop",)), ("b", (None,))]), str(tmp_path / "x"))
    files.write_by_category(make([("c", ("sop",))]), str(tmp_path / "x"))
    assert {(r["id"], r["nlp_category"]) for r in spark.read.parquet(str(tmp_path / "x")).collect()} == {("c", "sop"), ("b", "general")}


def test_validate_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Key,Status\n1,Open\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert files.validate_csv(df, ["Key"]) == (True, "")
    assert files.validate_csv(df, ["Key", "Owner"]) == (False, "missing columns: Owner")


def events(n=400):
    return [{"event_id": i, "ts": f"2024-01-01T{i // 60 % 24:02d}:{i % 60:02d}:00.000Z", "user_id": f"u{i % 5}", "event": "a" if i % 3 else "b"} for i in range(n)]


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams_equal_batches(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(e) for e in events()[k * 200 : k * 200 + 200]))
    tail = streams.log_tail(spark, str(tmp_path))
    run(streams.usage_windows(tail), "usage", "complete")
    batch = spark.read.schema(streams.EVENT).json(str(tmp_path))
    want = {(r["w"]["start"], r["event"], r["count"]) for r in batch.groupBy(F.window("ts", "1 hour").alias("w"), "event").count().collect()}
    assert {(r["window"]["start"], r["event"], r["n"]) for r in spark.table("usage").collect()} == want
    run(streams.once(tail.union(tail), ["event_id"]), "once", "append")
    assert spark.table("once").count() == 400
    run(streams.rate_limited(tail), "limited", "append")
    times, accepted = {}, set()
    for e in events():
        t = e["event_id"] * 60
        own = times.setdefault(e["user_id"], [])
        if len([x for x in own if x > t - 3600]) < 2:
            own.append(t)
            accepted.add(e["event_id"])
    assert {r["event_id"] for r in spark.table("limited").collect()} == accepted


def test_rate_limit_in_batches(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["event_id"] for r in ingest_queries._rate(spark, sf).collect()}
    log = ingest_queries.X.access_log(spark, sf).withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp"))).orderBy("t", "event_id").collect()
    times, want = {}, set()
    for r in log:
        own = times.setdefault(r["user_id"], [])
        if len([x for x in own if x > r["t"] - 3600]) < 2:
            own.append(r["t"])
            want.add(r["event_id"])
    assert got == want


def test_csv_drop_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("key,updated\nk1,2024-01-01\nk2,2024-01-02\n")
    seen = []
    schema = "key string, updated date"
    from pyspark.sql.types import _parse_datatype_string

    q = streams.csv_drops(spark, str(tmp_path / "in"), _parse_datatype_string(schema), None, lambda df, _: seen.extend(r["key"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == ["k1", "k2"]


def test_each_query_vector_meets_all_of_its_label(spark, tmp_path):
    rows = [(i, [float(i % 5 + 1), 1.0], i % 2) for i in range(45)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = lambda name: {(r["a"], r["b"]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert pairs("G06_cosine") == {(a, b) for a in (0, 20, 40) for b in range(0, 45, 2) if a != b}
    assert pairs("G06_cosine_all_rows") == pairs("G06_cosine")


def plain_ratio(a, b):
    """The token-set ratio by the textbook table of common subsequences."""

    def like(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return 200 * row[-1] / (len(x) + len(y)) if x or y else 100.0

    x, y = set(a.split()), set(b.split())
    both, one_, two = (sorted(s) for s in (x & y, x - y, y - x))
    if not x or not y:
        return 0.0
    if both and (not one_ or not two):
        return 100.0
    s, p, q = " ".join(both), " ".join(both + one_), " ".join(both + two)
    return max([like(p, q)] + ([like(s, p), like(s, q)] if both else []))


def test_token_set_ratio():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a, b = (" ".join(rng.choice(["ab", "abc", "b", "cad", "x"]) + rng.choice("12345") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert fuzzy.token_set_ratio(a, b) == pytest.approx(plain_ratio(a, b)), (a, b)


def groups(keys, linked):
    top = {k: k for k in keys}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {k: find(k) for k in keys}


def test_fuzzy_classes_are_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = {r["doc_id"]: (r["text"] or "")[:1000] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    base = [f"word{rng.randint(0, 999)}" for _ in range(60)]
    for i in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randint(0, 59)] = f"new{rng.randint(0, 9)}"
        rows[1000 + i] = " ".join(w[: rng.choice((20, 60, 60))])
    rows |= {2000: "", 2001: "  ", 2002: "a", 2003: "a a"}
    keys = sorted(rows)
    linked = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if set(rows[a].split()) == set(rows[b].split()) or fuzzy.token_set_ratio(rows[a], rows[b]) >= 97]
    got = {r["k"]: r["kept_key"] for r in fuzzy.fuzzy_classes(spark.createDataFrame(list(rows.items()), "k bigint, t string"), "k", F.col("t")).collect()}
    assert got == groups(keys, linked)


@pytest.mark.parametrize("intensity", [2, 3, 4, 5])
def test_fuzzy_classes_when_letters_change_inside_words(spark, intensity):
    """Texts that share few whole words or none, at each threshold; blocks smaller than a window."""
    import random

    rng = random.Random(intensity)
    letters = "abcdefghij"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = {1: "x" * 60, 2: "x" * 61, 3: "y" * 60, 4: "yy", 5: " ".join(sorted(word(6) for _ in range(20)))}
    rows[6] = " ".join(w + "q" if k < 8 else w for k, w in enumerate(rows[5].split()))
    for g in range(12):
        base = [word(rng.randint(3, 9)) for _ in range(rng.choice((3, 12, 40)))]
        for v in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 2)):
                k = rng.randrange(len(w))
                c = rng.randrange(len(w[k]) + 1)
                w[k] = rng.choice((w[k][:c] + rng.choice(letters) + w[k][c:], w[k][:c] + w[k][c + 1 :] or "z", w[k] + word(2)))
            rng.shuffle(w)
            rows[100 + 10 * g + v] = " ".join(w[: rng.choice((len(w), len(w), len(w) - 1))])
    keys, least = sorted(rows), fuzzy.threshold(intensity)
    linked = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if set(rows[a].split()) == set(rows[b].split()) or fuzzy.token_set_ratio(rows[a], rows[b]) >= least]
    df = spark.createDataFrame(list(rows.items()), "k bigint, t string")
    got = {r["k"]: r["kept_key"] for r in fuzzy.fuzzy_classes(df, "k", F.col("t"), intensity).collect()}
    assert got == groups(keys, linked)
    sets = df.select(F.col("k").alias("key"), F.array_join(F.array_sort(F.array_distinct(F.split("t", " "))), " ").alias("t"))
    by_edits = {tuple(sorted(r)) for r in fuzzy.alike_by_edits(sets, least, block=7).collect()}
    assert by_edits <= {tuple(sorted(p)) for p in linked}


def test_newest_versions(spark):
    rows = [(1, "s", "one two three four five six seven"), (2, "s", "other words here"), (3, "s", "one two three four five six seven eight"), (4, "s", "one  two three four five six seven"), (5, "t", None), (6, "t", None)]
    df = spark.createDataFrame(rows, "k bigint, b string, t string")
    kept = lambda i: sorted(r["k"] for r in fuzzy.newest_versions(df, "b", "k", F.col("t"), i).collect())
    assert kept(1) == [1, 2, 3, 4, 6]
    assert kept(2) == [2, 4, 5, 6]


def test_chunk_spans(spark):
    import hashlib
    import random

    rng = random.Random(2)
    rows = [(d, s, p, k, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 12)))) for d in range(3) for s in range(2) for p in range(s * 5, s * 5 + 5) for k in range(rng.randint(0, 4))]
    want = set()
    for d, s in {(r[0], r[1]) for r in rows}:
        def flush(words, pages):
            at = 0
            while words:
                part = " ".join(words[at : at + 30])
                want.add((f"doc{d}::ch{s:02d}::p{pages[0]}-{pages[-1]}::para::{hashlib.sha256(part.encode()).hexdigest()[:8]}", part))
                if at + 30 >= len(words):
                    return
                at += 25

        text, pages = [], []
        for p in sorted({r[2] for r in rows if r[:2] == (d, s)}):
            text += [r[4] for r in sorted(rows) if r[:3] == (d, s, p)]
            pages.append(p)
            if max(1, len(" ".join(text)) // 4) >= 45:
                flush(" ".join(text).split(), pages)
                text, pages = [], []
        flush(" ".join(text).split(), pages)
    got = {(r["id"], r["text"]) for r in spans.chunk_spans(spark.createDataFrame(rows, "doc_id bigint, span bigint, page bigint, pos bigint, text string"), 30, 5).collect()}
    assert got == want


def test_context_with_related(spark):
    chunks = spark.createDataFrame([(f"c{i}", i, "x" * n) for i, n in enumerate((30, 30, 500, 30, 30, 30))], "id string, doc_id bigint, text string")
    links = spark.createDataFrame([("c0", "c2", 1), ("c0", "c1", 2), ("c0", "c5", 3), ("c3", "c0", 1)], "id string, other string, r int")
    hits = spark.createDataFrame([(7, 1, "c0"), (7, 2, "c1"), (7, 3, "c3"), (7, 4, "c2"), (7, 5, "c4")], "query_id bigint, r int, id string")
    got = spans.context_with_related(hits, chunks, links, 150).first()
    # c2 doesn't fit as a link and ends the context as a hit; c5 is the third link; c1 and c0 are there already
    assert (got["ids"], got["used"]) == (["c0", "c1", "c3"], 3 * 34)


def test_csv_types(spark):
    files = {"t": (["Key", "Summary", "Resolution", "Vertical"], [""] * 4), "n": (["id", "Title", "Notes"], [""] * 3), "l": (["a", "b"], ["x x", "long text " * 8]), "f": (["a", "b"], ["", ""]), "e": ([], [])}
    df = spark.createDataFrame([(k, *v) for k, v in files.items()], "file string, headers array<string>, sample array<string>")
    got = {r["file"]: (r["kind"], r["main_column"]) for r in categories.csv_types(df).collect()}
    assert got == {"t": ("tickets", "Summary"), "n": ("table", "Notes"), "l": ("table", "b"), "f": ("table", "a"), "e": ("table", "text")}


@pytest.mark.parametrize("raw", ["no json", "{}", "[]", "[1, 2]", '[{"name": "!!!"}]', None, ""])
def test_odd_category_answers(spark, raw):
    assert not one(spark, categories.parse_categories, raw)


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; DROP TABLE t", "CREATE TABLE x AS SELECT 1"])
def test_raw_sql_is_one_select(spark, sql):
    with pytest.raises(ValueError):
        tickets.raw_sql(spark, sql)


def test_fields_without_intent(spark):
    assert one(spark, tickets.detect_fields, "modem") == tickets.DEFAULT_FIELDS
    assert one(spark, tickets.detect_fields, "fix roku")["Platform_Affected"] == 3


def test_summaries(spark):
    """Each rule of the router's summary on its own."""
    from quarry.functions import text as T

    say = lambda t, most: one(spark, lambda c: T.summarize(c, most), t)
    assert say("One.  Two.\nThree.", 100) == "One. Two. Three." and say("One. Two. Three.", 7) == "One. Tw"
    long = "A one. B two. " + "middle " * 30 + "end. Last one."
    assert say(long, 60) == "A one. B two. ... Last one."
    assert say(long, 300).startswith("A one. B two. middle") and say(long, 300).endswith("... Last one.")


def test_task_transitions_are_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    allowed = {"queued": ("crawling", "failed"), "crawling": ("synthesizing", "failed"), "synthesizing": ("review", "failed"), "review": ("queued",), "failed": ("queued",)}
    want = {}
    for r in ingest_queries.X.job_status(spark, sf).orderBy("job_id", "ts", "event_id").collect():
        state, ok, no = want.get(r["job_id"], ("queued", 0, 0))
        want[r["job_id"]] = (r["status"], ok + 1, no) if r["status"] in allowed[state] else (state, ok, no + 1)
    got = {r["job_id"]: (r["state"], r["accepted"], r["refused"]) for r in registry.QUERIES["N06_task_transitions"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("same", [None, True, False])
def test_nearest_in_blocks_is_brute_force(spark, same):
    """Small blocks and packs, one vector a third of all rows, a zero vector, ties by id."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 2.0, 0.5] if k % 3 == 0 else [float(round(x, 1)) for x in rng.normal(size=3)], int(rng.integers(3))) for k in range(200)] + [(200, [0.0, 0.0, 0.0], 1), (201, None, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    units = {k: (lambda v, n: v / n if n else v)(np.float32(e).astype(float), np.linalg.norm(np.float32(e).astype(float))) for k, e, _ in rows if e}
    label = {k: own for k, _, own in rows}
    want, every = set(), set()
    for q in range(0, 201, 10):
        found = sorted((-round(float(units[q] @ units[k]), 6) + 0.0, k) for k in units if k != q and (same is None or (label[k] == label[q]) == same))
        every |= {(q, k, -s + 0.0) for s, k in found}
        want |= {(q, k, -s + 0.0, r + 1) for r, (s, k) in enumerate(found[:4])}
    kw = {} if same is None else {"group": "label", "other": not same}
    queries = df.where("vec_id % 10 = 0")
    assert {(r[0], r[1], round(r[2], 6), r[3]) for r in nearest.nearest(queries, df, 4, block=17, together=3, **kw).collect()} == want
    assert {(r[0], r[1], round(r[2], 6)) for r in nearest.similarities(queries, df, block=17, together=3, **kw).collect()} == every


def test_ticket_store_files_are_sqlites_and_filters_are_pushed(spark, tmp_path):
    import datetime
    import sqlite3

    rows = [(f"T-{k}", k, k / 4, k % 3 == 0, None if k % 5 == 0 else datetime.date(2024, 1, 1 + k % 28), datetime.datetime(2024, 1, 1, k % 24, 5), "it's \"x\"" if k % 2 else None) for k in range(100)]
    schema = "key string, n bigint, x double, done boolean, day date, at timestamp_ntz, \"odd\" string".replace('"odd"', "`odd name`")
    df = spark.createDataFrame(rows, schema).repartition(3)
    ticket_store.export_tickets({"t": df}, str(tmp_path))
    found = []
    for file in (tmp_path / "t").iterdir():
        with sqlite3.connect(file) as db:
            found += db.execute("SELECT n FROM t").fetchall()
    assert sorted(found) == [(k,) for k in range(100)]
    back = ticket_store.read_tickets(spark, str(tmp_path / "t"), "t", df.schema, rows=7)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert back.rdd.getNumPartitions() >= 100 // 7
    kept = back.where("n in (3, 4, 6) or n > 90").where("done and day >= date'2024-01-02' and key like 'T-9%' and `odd name` is not null and x < 24")
    assert sorted(r["n"] for r in kept.collect()) == [k for k in range(100) if (k in (3, 4, 6) or k > 90) and k % 3 == 0 and k % 5 and k % 28 >= 1 and str(k).startswith("9") and k % 2 and k / 4 < 24]
    guessed = ticket_store.read_tickets(spark, str(tmp_path / "t"), "t")
    assert guessed.where("n = 7").select("key", "x").collect() == [("T-7", 1.75)]
    ticket_store.export_tickets({"t": df.limit(5)}, str(tmp_path))
    assert ticket_store.read_tickets(spark, str(tmp_path / "t"), "t").count() == 5
    reader = ticket_store.Reader({"path": str(tmp_path / "t"), "table": "t"}, df.schema)
    assert list(reader.pushFilters([ticket_store.EqualTo(("n",), 7), ticket_store.GreaterThan(("x",), 1.0)])) == [ticket_store.GreaterThan(("x",), 1.0)]
    assert reader.where == ['"n" = ?'] and reader.values == [7]
    with pytest.raises(ValueError):
        ticket_store.folder_of("hdfs://store/t")


@pytest.mark.parametrize("range_rows", [7, 50, 100_000])
def test_rate_limit_of_a_busy_key_is_brute_force(spark, range_rows):
    """A key with a seventh of all rows and one that never rests, in ranges much smaller than they are."""
    import random

    rng = random.Random(range_rows)
    rows = [("busy" if k % 7 == 0 else "steady" if k % 3 == 0 else f"u{rng.randint(0, 40)}", rng.randint(0, 90_000), k) for k in range(700)]
    rows += [(None, 5, 9001), ("u1", 10, 9002), ("u1", 10, 9003), ("u1", 10, 9004)]
    want, last = set(), {}
    for k, t, e in sorted((r for r in rows if r[0]), key=lambda r: r):
        own = [x for x in last.get(k, []) if x > t - 3600]
        if len(own) < 2:
            last[k] = [*own, t]
            want.add((k, e))
    got = folds.rate_limited(spark.createDataFrame(rows, "u string, t bigint, event_id bigint"), "u", range_rows=range_rows)
    assert {tuple(r) for r in got.collect()} == want


def test_links_with_hot_tags_are_brute_force(spark, monkeypatch):
    """Three tags that a third of the chunks or more have, dealt into small parts; rows that repeat."""
    import random

    monkeypatch.setattr(links, "FRAGMENT", 20)
    rng = random.Random(5)
    chunks = {}
    for k in range(240):
        own = {f"t{rng.randint(0, 60)}" for _ in range(rng.randint(0, 3))} | {h for h in ("hot", "warm", "big") if rng.random() < 0.6}
        chunks[f"c{k:03d}"] = (k % 80, own)
    tags = [(i, d, t) for i, (d, own) in chunks.items() for t in own]
    df = spark.createDataFrame(tags + tags[:20], "id string, doc_id bigint, tag string")
    want = {(a, b, len(x & y)) for a, (da, x) in chunks.items() for b, (db, y) in chunks.items() if a < b and da != db and len(x & y) >= 3}
    got = [tuple(r) for r in links.shared_tag_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = links.prefixes(df, 3)
    assert max(r["n"] for r in first.groupBy("tag", "part").count().withColumnRenamed("count", "n").collect()) <= 45
    new = spark.createDataFrame([(i,) for i in list(chunks)[::10]], "id string")
    found = {tuple(r) for r in links.pairs_of_new(df, new).collect()}
    both = want | {(b, a, n) for a, b, n in want}
    assert found == {(a, b, n) for a, b, n in both if a in set(list(chunks)[::10])}


def test_term_index_is_brute_force(spark):
    """Strings inside words, across words, shorter than a gram, empty and absent ones."""
    import random

    rng = random.Random(8)
    words = ["Anna", "banana", "an", "a", "éan", "x-an.an", "aaaa", "\u0130an"]
    texts = {f"c{k}": " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for k in range(60)} | {"c98": None, "c99": "a  b"}
    chunks = spark.createDataFrame(list(texts.items()), "id string, text string")
    low = {r["id"]: r["t"] for r in chunks.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    strings = ["an", "a", "ana", "nan", "aa", "aaa", "banana", "n.a", "n b", "a a", "  ", "zzz", "", "anna banana"]
    got = {(r["string"], r["id"]): r["n"] for r in termindex.occurrences(termindex.build(chunks), spark.createDataFrame([(s,) for s in strings + strings[:3]], "string string"), chunks).collect()}
    assert got == {(s, i): t.count(s) for s in strings if s for i, t in low.items() if s in t}


def dictionary_case(spark):
    import random

    rng = random.Random(11)
    words = ["a", "b", "c", "Éa", "d1", "x"]
    texts = {k: " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) + rng.choice(["", ".", " - a, b!"]) for k in range(40)} | {98: None, 99: ""}
    phrases = {" ".join(rng.choice(words[:4]) for _ in range(rng.randint(1, 4))): rng.choice(["ORG", "PRODUCT"]) for _ in range(25)} | {"a": "ORG", "A": "PRODUCT", "...": "ORG", "a b c a b c a": "ORG"}
    low = {}
    for p, label in phrases.items():
        own = tuple(re.findall(r"\w+", p.lower()))
        if 1 <= len(own) <= dictionary.LONGEST:
            low[own] = min(low.get(own, label), label)
    return texts, phrases, low


@pytest.mark.parametrize("longest", [True, False])
@pytest.mark.parametrize("most_entries", [50_000, 3])
def test_dictionary_matches_are_brute_force(spark, longest, most_entries):
    """By the trie and, for a dictionary over the limit, by the join."""
    texts, phrases, low = dictionary_case(spark)
    want = set()
    for k, t in texts.items():
        w, at = re.findall(r"\w+", (t or "").lower()), 0
        while at < len(w):
            here = [n for n in range(1, dictionary.LONGEST + 1) if at + n <= len(w) and tuple(w[at : at + n]) in low]
            for n in here[-1:] if longest else here:
                want.add((k, at, n, " ".join(w[at : at + n]), low[tuple(w[at : at + n])]))
            at += here[-1] if longest and here else 1
    df = spark.createDataFrame(list(texts.items()), "key bigint, text string")
    found = dictionary.matches(df, spark.createDataFrame(list(phrases.items()), "phrase string, label string"), longest, most_entries)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = {(r["key"], r["label"]): r["phrases"] for r in dictionary.entities(found, 2).collect()}
    for (k, label), names in few.items():
        assert names == list(dict.fromkeys(p for _, _, p, _ in sorted((at, n, p, x) for q, at, n, p, x in want if q == k and x == label)))[:2]


def test_groups_expand_tags(spark):
    rows = spark.createDataFrame([(1, ["Slow", "x"]), (2, ["y"]), (3, ["down", "lag"]), (4, [])], "key bigint, tags array<string>")
    groups = spark.createDataFrame([("g", "slow"), ("g", "lag"), ("g", "Delay"), ("h", "down"), ("h", "offline")], "group string, word string")
    got = {r["key"]: r["tags"] for r in dictionary.expanded(rows, "tags", groups).collect()}
    assert got == {1: ["Slow", "x", "delay", "lag", "slow"], 2: ["y"], 3: ["down", "lag", "delay", "offline", "slow"], 4: []}


def test_key_phrases_are_brute_force(spark):
    import random

    rng = random.Random(13)
    words = ["the", "red", "Engine", "and", "blaue", "ключ", "x", "of", "42", ",", ".", "l'eau"]
    texts = {k: " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for k in range(30)} | {98: None, 99: "  "}
    got = {}
    for r in phrases.key_phrases(spark.createDataFrame(list(texts.items()), "k bigint, t string"), "k", F.col("t"), 5).collect():
        got.setdefault(r["k"], []).append((-r["score"], r["phrase"]))
    for k, t in texts.items():
        runs, own = [], []
        for tok in [*re.findall(r"[^\W_]+|[^\s\w]|_", (t or "").lower()), "."]:
            if re.fullmatch(r"[^\W_]+", tok) and tok not in phrases.STOP:
                own.append(tok)
            elif own:
                runs.append(own)
                own = []
        freq, degree = {}, {}
        for run in runs:
            for w in run:
                freq[w], degree[w] = freq.get(w, 0) + 1, degree.get(w, 0) + len(run)
        want = sorted((-sum(degree[w] * 1_000_000 // freq[w] for w in run), " ".join(run)) for run in {tuple(x) for x in runs} if len(" ".join(run)) > 3)[:5]
        assert sorted(got.get(k, [])) == want, t


def test_sharing_words_is_brute_force(spark):
    import random

    rng = random.Random(14)
    asked = {k: {f"w{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randint(1, 8))} for k in range(20)}
    known = {k: {f"w{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randint(1, 15))} for k in range(60)}
    rows = lambda d, c: spark.createDataFrame([(k, w) for k, own in d.items() for w in own], f"{c} bigint, word string")
    got = {tuple(r) for r in dedup.sharing(rows(asked, "doc"), rows(known, "other"), "doc", "other", "word", 3).collect()}
    assert got == {(a, b, len(x & y)) for a, x in asked.items() for b, y in known.items() if len(x & y) >= 3}


def batches(spark, tmp_path, schema, parts, make, name, mode, pause=0.0):
    """Runs a stream over one file for each part, a run each; the rows of each run and the number of keys that are kept."""
    import time

    source, found = tmp_path / "in", []
    source.mkdir()
    for k, part in enumerate(parts):
        (source / f"{k}.json").write_text("\n".join(json.dumps(r) for r in part))
        rows = []
        stream = make(spark.readStream.schema(schema).json(str(source)))
        q = stream.writeStream.foreachBatch(lambda df, _, rows=rows: rows.extend(map(tuple, df.collect()))).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        found.append((rows, kept[-1] if kept else None))
        time.sleep(pause)
    return found


def test_latest_status_forgets_jobs(spark, tmp_path):
    row = lambda j, day, m, e, s: {"job_id": j, "ts": f"2024-01-{day:02d}T00:{m:02d}:00", "event_id": e, "status": s}
    parts = [
        [row(1, 1, 1, 1, "queued"), row(1, 1, 3, 3, "crawling"), row(1, 1, 2, 2, "review"), row(2, 1, 1, 4, "failed"), row(2, 1, 9, 5, "review")],
        [row(1, 1, 4, 6, "review"), row(2, 1, 10, 7, "queued"), row(3, 4, 1, 8, "queued")],
        [row(3, 4, 2, 9, "queued"), row(2, 4, 3, 10, "review")],
    ]
    found = batches(spark, tmp_path, "job_id bigint, ts timestamp, event_id bigint, status string", parts, streams.latest_status, "latest", "update")
    # the second job's failure outweighs what comes until its state has gone, two days later
    assert [sorted(rows) for rows, _ in found] == [[(1, "crawling"), (2, "failed")], [(1, "review"), (3, "queued")], [(2, "review"), (3, "queued")]]


def test_sessions_expire_and_their_state_goes(spark, tmp_path):
    row = lambda u, day, h: {"user_id": u, "ts": f"2024-01-{day:02d}T{h:02d}:00:00"}
    parts = [[row("a", 1, 1), row("a", 1, 5), row("b", 1, 2)], [row("b", 2, 1), row("c", 2, 6)], [row("c", 2, 7), row("d", 3, 4)], [row("d", 9, 1), row("a", 9, 2)], [row("a", 9, 3)]]
    found = batches(spark, tmp_path, "user_id string, ts timestamp", parts, streams.expired_sessions, "sessions", "append")
    ended = sorted((u, str(last)[:19], n) for rows, _ in found for u, last, n in rows)
    assert ended == [("a", "2024-01-01 05:00:00", 2), ("b", "2024-01-02 01:00:00", 2), ("c", "2024-01-02 07:00:00", 2), ("d", "2024-01-03 04:00:00", 1)]
    assert found[-1][1] is not None
