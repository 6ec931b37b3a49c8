"""Queries of the text functions and of chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, dedup
from quarry.plans import fixtures as X
from quarry.plans.registry import query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


def per_doc(name: str, column: str, make, sql: str) -> None:
    """A query doc_id, <column> over documents."""
    query(name, f"SELECT doc_id, {sql} AS {column} FROM documents")(lambda spark, sf: docs(spark, sf).select("doc_id", make(F.col("text")).alias(column)))


WS = r"[\x20\x09-\x0D]+"
FOLD = f"trim(regexp_replace(text, '{WS}', ' ', 'g'))"

per_doc("B01_sha8", "sha8", T.sha8, "substr(sha256(text), 1, 8)")
per_doc("B02_rough_token_len", "n_tokens", T.rough_tokens, "CAST(greatest(1, length(text) // 4) AS INTEGER)")
per_doc(
    "B03_normalize_text", "normalized", T.normalize_lines,
    r"""trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(replace(text, chr(173), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(10)),
    lambda x: CASE WHEN regexp_matches(x, 'index=|sourcetype=|\||SELECT|WHERE|\{|\}') THEN x || chr(10) WHEN regexp_matches(x, '(^|[^-])-$') THEN substr(x, 1, length(x) - 1) ELSE x || ' ' END), ''), '[\x00-\x1F\x7F]', ' ', 'g'), ' +', ' ', 'g'))""",
)
per_doc("B04_sanitize_for_json", "clean", T.clean_for_json, r"trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), ' +', ' ', 'g'))")
per_doc("B07_normalize_for_hash", "normalized", T.normalize_for_hash, f"lower({FOLD})")
per_doc("B10_count_occurrences", "n", lambda t: T.occurrences(t, F.lit("the")), "CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER)")
per_doc("B19_truncate_words", "short", lambda t: T.truncate_words(T.fold_space(t), 120), f"""CASE WHEN length({FOLD}) <= 120 THEN {FOLD} ELSE
  (CASE WHEN contains(substr({FOLD}, 1, 120), ' ') AND 120 - instr(reverse(substr({FOLD}, 1, 120)), ' ') > 60 THEN substr({FOLD}, 1, 120 - instr(reverse(substr({FOLD}, 1, 120)), ' ')) ELSE substr({FOLD}, 1, 120) END) || '…' END""")
CODES = r"""array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(%s, '\\b[A-Z]{3,5}-\\d{3,4}\\b'), regexp_extract_all(%s, '\\b(?:INC|TICKET|CASE)[-#: ]?\\d+\\b'))))[1:10], '|')""".replace("\\\\", "\\")
per_doc("B15_extract_codes", "codes", lambda t: F.array_join(T.codes(t), "|"), CODES % ("text", "text"))


@query("B15_ticket_codes", f"WITH {X.TICKETS}, t AS (SELECT key, 'CASE ' || length(description) || ' of ' || client || ', see ' || key || ': ' || summary || ' ' || description AS note FROM tickets) SELECT key, {CODES % ('note', 'note')} AS codes FROM t")
def _ticket_codes(spark, sf):
    """Codes in the notes of tickets, which name other codes."""
    note = F.concat(F.lit("CASE "), F.length("description").cast("string"), F.lit(" of "), "client", F.lit(", see "), "key", F.lit(": "), "summary", F.lit(" "), "description")
    return X.tickets(spark, sf).select("key", F.array_join(T.codes(note), "|").alias("codes"))


per_doc(
    "B21_trim_to_body", "body", lambda t: T.trim_to_body(t, 600),
    r"""(WITH b AS (SELECT CASE WHEN nth > 0 THEN array_to_string(lines[nth:], chr(10)) ELSE text END AS body FROM (SELECT string_split(text, chr(10)) AS lines,
    coalesce(list_position(list_transform(string_split(text, chr(10)), lambda x: length(trim(x)) > 80 AND NOT regexp_matches(trim(x), '^[\[\-*#|!]')), true), 0) AS nth))
    SELECT CASE WHEN length(body) > 600 THEN substr(body, 1, 600) || chr(10) || '[truncated]' ELSE body END FROM b)""",
)


@query("B05_summarize_router")
def _summary(spark, sf):
    return docs(spark, sf).select("doc_id", T.summarize(F.col("text"), 400).alias("summary"))


@query("B06_normalize_tag", rf"""SELECT DISTINCT source, lang, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '{WS}', '-', 'g'), '[^A-Za-z0-9_-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 50) AS tag
  FROM (SELECT source, lang, ' -' || source || '  ' || lang || '!! Tag-- ' AS raw FROM documents)""")
def _tag(spark, sf):
    raw = F.concat(F.lit(" -"), "source", F.lit("  "), "lang", F.lit("!! Tag-- "))
    return docs(spark, sf).select("source", "lang", T.normalize_tag(raw).alias("tag")).distinct()


@query("B08_build_search_text", "WITH " + X.TAGS + " SELECT id, lower(array_to_string(list_filter(list_concat(list_concat([source], tags), keywords), lambda x: x <> ''), ' ')) AS search_text FROM tagged")
def _search_text(spark, sf):
    return X.tagged(spark, sf).select("id", T.search_text(F.col("source"), F.col("tags"), F.col("keywords")).alias("search_text"))


@query("B09_search_blob", "WITH " + X.TAGS + " SELECT id, lower(text || ' ' || substr(lower(array_to_string(tags, ' ')), 1, 500)) AS blob FROM tagged")
def _blob(spark, sf):
    return X.tagged(spark, sf).select("id", T.search_blob(F.col("text"), F.lower(F.array_join("tags", " "))).alias("blob"))


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def questions(spark, sf):
    """One question for each source and language, from the tables."""
    q = docs(spark, sf).select("source", "lang").distinct()
    return q.withColumn("question", F.concat(F.lit("What skill or degree does "), "source", F.lit(" mean for the company in "), "lang", F.lit("?")))


QUESTIONS = "q AS (SELECT DISTINCT source, lang, 'What skill or degree does ' || source || ' mean for the company in ' || lang || '?' AS question FROM documents)"


@query("B11_extract_terms", f"WITH {QUESTIONS} SELECT source, lang, array_to_string(list_filter(regexp_extract_all(lower(question), '[a-zA-Z0-9][A-Za-z0-9_\\-]*'), lambda w: w NOT IN ({STOP}) AND length(w) >= 2), ' ') AS terms FROM q")
def _terms(spark, sf):
    return questions(spark, sf).select("source", "lang", F.array_join(T.search_terms(F.col("question")), " ").alias("terms"))


@query("B12_match_tokens", "WITH " + X.TAGS + " SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(tags, list_transform(keywords, lambda k: '  ' || k || ' ')), lambda t: lower(trim(t))), lambda t: t <> ''))), ' ') AS tokens FROM tagged")
def _tokens(spark, sf):
    raised = F.transform("keywords", lambda k: F.concat(F.lit("  "), k, F.lit(" ")))
    return X.tagged(spark, sf).select("id", F.array_join(T.match_tokens(F.concat("tags", raised)), " ").alias("tokens"))


DOMAIN_SQL = ", ".join(f"CASE WHEN regexp_matches(question, '{p}') THEN '{n}' END" for n, p in T.DOMAINS.items())


@query("B13_detect_domains", f"WITH {QUESTIONS} SELECT source, lang, array_to_string(list_filter([{DOMAIN_SQL}], lambda x: x IS NOT NULL), ',') AS domains FROM q")
def _domains(spark, sf):
    return questions(spark, sf).select("source", "lang", F.array_join(T.domains(F.col("question")), ",").alias("domains"))


@query("B14_is_greeting", """SELECT conv_id, turn, len(w) <= 4 AND len(c) > 0 AND len(list_filter(c, lambda x: x NOT IN ('hi', 'hello', 'hey', 'thanks', 'thank', 'morning', 'evening'))) = 0 AS greeting FROM
  (SELECT conv_id, turn, w, list_filter(w, lambda x: x NOT IN ('there', 'you', 'good', 'all')) AS c FROM (SELECT conv_id, turn, regexp_extract_all(lower(CASE WHEN turn = 0 THEN 'Hello there, good morning' ELSE text END), '[a-z'']+') AS w FROM conversations))""")
def _greeting(spark, sf):
    said = F.when(F.col("turn") == 0, "Hello there, good morning").otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_greeting(said).alias("greeting"))


@query("B16_extract_row_id", "WITH " + X.TICKETS + " SELECT key, CASE WHEN r <> '' THEN r ELSE 'row-' || length(summary) END AS row_id FROM (SELECT key, summary, regexp_extract(CASE WHEN priority LIKE '1%' THEN key || ': ' || summary ELSE summary END, '\\b([A-Z]+-\\d+)\\b', 1) AS r FROM tickets)")
def _row_id(spark, sf):
    primary = F.when(F.col("priority").startswith("1"), F.concat("key", F.lit(": "), "summary")).otherwise(F.col("summary"))
    return X.tickets(spark, sf).select("key", T.row_code(primary, F.length("summary")).alias("row_id"))


PROFILES = {"guide": ("src1", "manual"), "notes": ("src2",), "report": ("src3", "src4")}


@query("B17_classify_profile", "SELECT doc_id, CASE WHEN contains(s, 'src1') OR contains(s, 'manual') THEN 'guide' WHEN contains(s, 'src2') THEN 'notes' WHEN contains(s, 'src3') OR contains(s, 'src4') THEN 'report' ELSE 'general' END AS profile FROM (SELECT doc_id, lower(source) AS s FROM documents)")
def _profile(spark, sf):
    return docs(spark, sf).select("doc_id", T.profile_of(F.col("source"), PROFILES).alias("profile"))


CONTENT = {"english": ("the ", " and "), "french": (" le ", " les "), "german": (" der ", " das "), "spanish": (" el ", " los ")}
CONTENT_SQL = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{k}{chr(39)})' for k in ks)} THEN '{n}' END" for n, ks in CONTENT.items())


@query("B18_content_tags", f"SELECT doc_id, array_to_string(list_sort(list_filter([{CONTENT_SQL}], lambda x: x IS NOT NULL)), ',') AS tags FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _content(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(T.content_tags(F.col("text"), CONTENT), ",").alias("tags"))


@query("B20_format_context", "WITH " + X.CHUNKS + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM chunks) SELECT doc_id, string_agg('[' || r || '] ' || category || chr(10) || substr(text, 1, 200), chr(10) || chr(10) ORDER BY r) AS context FROM r WHERE r <= 5 GROUP BY doc_id")
def _context(spark, sf):
    r = X.chunks(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))).where("r <= 5")
    block = F.concat(F.lit("["), F.col("r").cast("string"), F.lit("] "), "category", F.lit("\n"), F.substring("text", 1, 200))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("r", block.alias("b")))), lambda x: x["b"])
    return r.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("context"))


HTML_SQL = rf"substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{WS}', ' ', 'g')), 1, 50000)"


@query("B22_html_to_text", f"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, {HTML_SQL} AS content, {HTML_SQL} <> '' AS success FROM pages")
def _html(spark, sf):
    p = table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("content"))
    return p.withColumn("success", F.col("content") != "")


@query("B23_page_usable", f"SELECT page_id, url FROM pages WHERE length({HTML_SQL}) > 100")
def _usable(spark, sf):
    return table(spark, sf, "pages").where(F.length(T.html_text(F.col("html"))) > 100).select("page_id", "url")


@query("B25_parse_ticket_date", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(CASE o_orderkey % 4 WHEN 0 THEN 822 WHEN 1 THEN 102 ELSE 0 END) END AS parsed FROM orders")
def _dates(spark, sf):
    d, m = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(m == 0, F.concat(F.date_format(d, "MM/dd/yyyy"), F.lit(" 13:42"))).when(m == 1, F.concat(F.date_format(d, "MMM dd, yyyy"), F.lit(" 1:42 AM"))).when(m == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return table(spark, sf, "orders").select("o_orderkey", T.ticket_date(text).alias("parsed"))


@query("B26_to_local_time", "SELECT event_id, ts - INTERVAL 6 HOUR AS local_ts, CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS local_day FROM events")
def _local(spark, sf):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "-06:00")
    return table(spark, sf, "events").select("event_id", local.alias("local_ts"), F.to_date(local).cast("string").alias("local_day"))


@query("B27_doc_of_route", "WITH " + X.CHUNKS + " SELECT id, string_split(id, '::')[1] AS doc FROM chunks")
def _route(spark, sf):
    return X.chunks(spark, sf).select("id", F.split("id", "::")[0].alias("doc"))


@query("B28_chunk_ids", "WITH " + X.CHUNKS + """ SELECT id, 'doc' || doc_id || '::sec' || lpad(CAST(k // 3 + 1 AS VARCHAR), 3, '0') || '::part' || lpad(CAST(k % 3 + 1 AS VARCHAR), 3, '0') || '::' || substr(sha256(text), 1, 8) AS section_id,
  'gloss::' || substr(sha256(substr(text, 1, 50)), 1, 8) AS glossary_id, 'learned::' || category || '::' || substr(sha256(text), 1, 8) AS learned_id FROM chunks""")
def _ids(spark, sf):
    c, pad = X.chunks(spark, sf), lambda n: F.lpad(n.cast("string"), 3, "0")
    return c.select(
        "id", F.concat(F.lit("doc"), "doc_id", F.lit("::sec"), pad(F.floor(F.col("k") / 3) + 1), F.lit("::part"), pad(F.col("k") % 3 + 1), F.lit("::"), T.sha8(F.col("text"))).alias("section_id"),
        F.concat(F.lit("gloss::"), T.sha8(F.substring("text", 1, 50))).alias("glossary_id"), F.concat(F.lit("learned::"), "category", F.lit("::"), T.sha8(F.col("text"))).alias("learned_id"),
    )


@query("B29_slim_row", "WITH " + X.CHUNKS + " SELECT id, category, CASE WHEN length(text) > 1800 THEN substr(text, 1, 1800) || '…' ELSE text END AS text FROM chunks")
def _slim(spark, sf):
    short = F.when(F.length("text") > 1800, F.concat(F.substring("text", 1, 1800), F.lit("…"))).otherwise(F.col("text"))
    return X.chunks(spark, sf).drop("lang", "source", "k", "doc_id").withColumn("text", short)


@query("B30_preview_row", "WITH " + X.TAGS + " SELECT id, substr(text, 1, 80) AS title, replace(substr(text, 1, 120), chr(10), ' ') AS preview, tags[1] AS category FROM tagged")
def _preview(spark, sf):
    return X.tagged(spark, sf).select("id", F.substring("text", 1, 80).alias("title"), F.translate(F.substring("text", 1, 120), "\n", " ").alias("preview"), F.element_at("tags", 1).alias("category"))


@query("B31_flatten_xml_attrs", r"""SELECT doc_id, regexp_replace(raw, '\b(lang|source)=(?:''([^'']*)''|"([^"]*)")', '\1=\2\3', 'g') AS flat FROM (SELECT doc_id, '<doc lang=''' || lang || ''' source="' || source || '" other=''x''/>' AS raw FROM documents)""")
def _attributes(spark, sf):
    raw = F.concat(F.lit("<doc lang='"), "lang", F.lit("' source=\""), "source", F.lit("\" other='x'/>"))
    return docs(spark, sf).select("doc_id", T.flatten_attributes(raw, ("lang", "source")).alias("flat"))


@query("C01_split_with_overlap", "WITH " + X.WORDS + ", k AS (SELECT doc_id, words, unnest(range(0, CAST(ceil(greatest(len(words) - 512, 0) / 384.0) AS BIGINT) + 1)) AS k FROM w WHERE len(words) > 0) SELECT doc_id, k, len(list_slice(words, k * 384 + 1, k * 384 + 512)) AS n_words, array_to_string(list_slice(words, k * 384 + 1, k * 384 + 512), ' ') AS text FROM k")
def _split(spark, sf):
    d = docs(spark, sf).select("doc_id", T.words(F.col("text")).alias("words"))
    return chunking.split_with_overlap(d, "words", 512, 128).select("doc_id", "k", F.size("part").cast("long").alias("n_words"), F.array_join("part", " ").alias("text"))


@query("C02_chunk_text", "WITH " + X.CHUNKS + " SELECT id, doc_id, text, category FROM chunks")
def _chunks(spark, sf):
    return X.chunks(spark, sf).select("id", "doc_id", "text", "category")


LINES = r"""l AS (SELECT doc_id, text.pos AS pos, text.line AS line FROM (SELECT doc_id, unnest(list_transform(range(1, len(ls) + 1), lambda i: {'pos': i, 'line': ls[i]})) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


def lines(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "line")


SECTIONS = LINES + """, h AS (SELECT *, length(line) < 40 AS heading FROM l),
  f AS (SELECT *, CASE WHEN heading AND NOT coalesce(lag(heading) OVER (PARTITION BY doc_id ORDER BY pos), true) THEN 1 ELSE 0 END AS s FROM h),
  s AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM f),
  sec AS (SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n_lines, coalesce(string_agg(CASE WHEN heading THEN line END, ' > ' ORDER BY pos), '') AS breadcrumb, string_agg(CASE WHEN NOT heading THEN line END, ' ' ORDER BY pos) AS body FROM s GROUP BY doc_id, section)"""


def section_rows(spark, sf):
    """doc_id, section, n_lines, breadcrumb, body: short lines are headings."""
    s = chunking.sections(lines(spark, sf).withColumn("heading", F.length("line") < 40), "doc_id", "pos", "heading")
    g = s.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("pos", "line", "heading"))).alias("all"))
    pick = lambda want, sep: F.array_join(F.transform(F.filter("all", lambda x: x["heading"] == want), lambda x: x["line"]), sep)
    body = F.when(F.exists("all", lambda x: ~x["heading"]), pick(False, " "))
    return g.select("doc_id", F.col("section").cast("long").alias("section"), "n_lines", pick(True, " > ").alias("breadcrumb"), body.alias("body"))


@query("C03_chunk_sections", "WITH " + SECTIONS + """, w AS (SELECT *, regexp_extract_all(coalesce(body, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM sec),
  k AS (SELECT *, unnest(range(0, CAST(ceil(greatest(len(words) - 120, 0) / 100.0) AS BIGINT) + 1)) AS k FROM w WHERE len(words) > 0),
  t AS (SELECT doc_id, section, k, '[' || breadcrumb || ']' || chr(10) || array_to_string(list_slice(words, k * 100 + 1, k * 100 + 120), ' ') AS text FROM k)
  SELECT 'doc' || doc_id || '::sec' || lpad(CAST(section + 1 AS VARCHAR), 3, '0') || '::' || lpad(CAST(k + 1 AS VARCHAR), 3, '0') || '::' || substr(sha256(text), 1, 8) AS id, doc_id, section, k, text FROM t""")
def _sections(spark, sf):
    return chunking.section_windows(section_rows(spark, sf), 120, 20)


@query("C03_section_bodies", "WITH " + SECTIONS + " SELECT doc_id, section, n_lines, '[' || breadcrumb || ']' AS breadcrumb, body FROM sec")
def _section_bodies(spark, sf):
    return section_rows(spark, sf).withColumn("breadcrumb", F.concat(F.lit("["), "breadcrumb", F.lit("]")))


@query("C04_chunk_slides", "WITH " + LINES + ", g AS (SELECT doc_id, (pos - 1) // 4 AS slide, string_agg(line, ' ' ORDER BY pos) AS text FROM l GROUP BY doc_id, slide) SELECT 'doc' || doc_id || '::slide' || lpad(CAST(slide + 1 AS VARCHAR), 3, '0') || '::' || substr(sha256(text), 1, 8) AS id, doc_id, substr(text, 1, 900) AS summary FROM g WHERE trim(text) <> ''")
def _slides(spark, sf):
    g = lines(spark, sf).withColumn("slide", F.floor((F.col("pos") - 1) / 4)).groupBy("doc_id", "slide").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))
    return g.where(F.trim("text") != "").select(F.concat(F.lit("doc"), "doc_id", F.lit("::slide"), F.lpad((F.col("slide") + 1).cast("string"), 3, "0"), F.lit("::"), T.sha8(F.col("text"))).alias("id"), "doc_id", F.substring("text", 1, 900).alias("summary"))


OUTLINE = """pg AS (SELECT doc_id, CAST(17 + doc_id % 40 AS BIGINT) AS n_pages FROM documents),
  ol AS (SELECT doc_id, idx, 1 + (doc_id * 7 + idx * 3) % 3 AS level, 'Part ' || idx AS title, idx * 2 + doc_id % 2 AS page FROM (SELECT doc_id, unnest(range(0, 8)) AS idx FROM documents WHERE doc_id % 10 <> 0))"""


def outline(spark, sf):
    o = docs(spark, sf).where("doc_id % 10 <> 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("idx"))
    return o.select("doc_id", "idx", (1 + (F.col("doc_id") * 7 + F.col("idx") * 3) % 3).alias("level"), F.concat(F.lit("Part "), F.col("idx").cast("string")).alias("title"), (F.col("idx") * 2 + F.col("doc_id") % 2).alias("page"))


def doc_pages(spark, sf):
    return docs(spark, sf).select("doc_id", (17 + F.col("doc_id") % 40).alias("n_pages"))


@query("C05_build_hierarchy", "WITH " + OUTLINE + """ SELECT doc_id, idx, level, title, page FROM ol WHERE level <= 2 UNION ALL
  SELECT doc_id, idx, 1, 'Section ' || (idx + 1), idx * step FROM (SELECT doc_id, n_pages, greatest(10, greatest(1, n_pages // 15)) AS step, unnest(range(0, CAST(ceil(n_pages / greatest(10, greatest(1, n_pages // 15))::DOUBLE) AS BIGINT))) AS idx FROM pg WHERE doc_id % 10 = 0)""")
def _hierarchy(spark, sf):
    return chunking.hierarchy(outline(spark, sf), doc_pages(spark, sf), 2)


@query("C06_slice_spans", "WITH " + OUTLINE + """ SELECT a.doc_id, a.idx, a.level, a.title, a.page, greatest(a.page, coalesce((SELECT arg_min(b.page, b.idx) FROM ol b WHERE b.doc_id = a.doc_id AND b.idx > a.idx AND b.level <= a.level) - 1, n_pages - 1)) AS end_page FROM ol a JOIN pg ON a.doc_id = pg.doc_id""")
def _spans(spark, sf):
    return chunking.spans(outline(spark, sf), doc_pages(spark, sf))


@query("C07_breadcrumb_path", "WITH " + OUTLINE + """, a AS (SELECT x.doc_id, x.idx, x.title, y.idx AS up, y.title AS up_title, y.level AS up_level, x.level FROM ol x LEFT JOIN ol y ON x.doc_id = y.doc_id AND y.idx < x.idx AND y.level < x.level
    AND NOT EXISTS (SELECT 1 FROM ol z WHERE z.doc_id = x.doc_id AND z.idx > y.idx AND z.idx < x.idx AND z.level <= y.level))
  SELECT doc_id, idx, coalesce(string_agg(up_title, ' > ' ORDER BY up) || ' > ', '') || title AS path FROM a GROUP BY doc_id, idx, title""")
def _paths(spark, sf):
    """Ancestors are the earlier entries of a lower level after which no entry of that level or lower comes before this one."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    o = outline(spark, sf).withColumn("before", F.collect_list(F.struct("idx", "level", "title")).over(w))
    step = lambda acc, x: F.when(x["level"] < acc["top"], F.struct(x["level"].alias("top"), F.concat(F.array(x["title"]), acc["path"]).alias("path"))).otherwise(acc)
    start = F.struct(F.col("level").alias("top"), F.array("title").alias("path"))
    return o.select("doc_id", "idx", F.array_join(F.aggregate(F.reverse("before"), start, step)["path"], " > ").alias("path"))


SPANS = "sp AS (SELECT a.doc_id, a.idx, a.page, greatest(a.page, coalesce((SELECT arg_min(b.page, b.idx) FROM ol b WHERE b.doc_id = a.doc_id AND b.idx > a.idx AND b.level <= a.level) - 1, n_pages - 1)) AS end_page FROM ol a JOIN pg ON a.doc_id = pg.doc_id)"
BLOCKS = LINES + """, tl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l WHERE contains(line, '|')),
  tb AS (SELECT doc_id, min(pos) AS first_pos, (min(pos) - 1) // 3 AS page, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM tl GROUP BY doc_id, run)"""


def table_blocks(spark, sf):
    """Runs of lines with a bar; three lines make a page."""
    return chunking.table_blocks(lines(spark, sf), F.floor((F.col("first_pos") - 1) / 3))


@query("C09_chunk_tables", "WITH " + BLOCKS + ", " + OUTLINE + ", " + SPANS + """, m AS (SELECT tb.doc_id, idx, first_pos, 'Table:' || chr(10) || text AS text FROM tb JOIN sp ON sp.doc_id = tb.doc_id AND tb.page BETWEEN sp.page AND sp.end_page)
  SELECT doc_id, idx, first_pos, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idx, substr(text, 1, 200) ORDER BY first_pos) AS r FROM m) WHERE r = 1""")
def _tables(spark, sf):
    return chunking.tables_of_spans(table_blocks(spark, sf), chunking.spans(outline(spark, sf), doc_pages(spark, sf)))


@query("C09_table_blocks", "WITH " + BLOCKS + " SELECT doc_id, first_pos, page, n_lines, text FROM tb")
def _blocks(spark, sf):
    return table_blocks(spark, sf)


@query("E05_dedup_tables", "WITH " + BLOCKS + " SELECT doc_id, page, first_pos, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, substr(text, 1, 400) ORDER BY first_pos) AS r FROM tb) WHERE r = 1")
def _dedup_tables(spark, sf):
    """Of tables on one page whose first 400 characters are the same the first."""
    return dedup.first_of(table_blocks(spark, sf), ["doc_id", "page", F.substring("text", 1, 400)], "first_pos").select("doc_id", "page", "first_pos", "text")


@query("C10_table_to_markdown", """WITH r AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL),
  t AS (SELECT c_mktsegment, list([CAST(c_nationkey AS VARCHAR), CAST(n AS VARCHAR)] ORDER BY c_nationkey) AS rows FROM r GROUP BY c_mktsegment)
  SELECT c_mktsegment, '| ' || array_to_string(rows[1], ' | ') || ' |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(rows[2:], lambda x: '| ' || array_to_string(x, ' | ') || ' |'), chr(10)) AS markdown FROM t""")
def _markdown(spark, sf):
    r = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_nationkey", "n"))), lambda x: F.array(x["c_nationkey"].cast("string"), x["n"].cast("string")))
    return r.groupBy("c_mktsegment").agg(rows.alias("rows")).select("c_mktsegment", chunking.table_markdown(F.col("rows")).alias("markdown"))


@query("C11_glossary_entries", r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(replace(lang || ' - ' || text, '. ', chr(10) || source || ' - '), '[^\r\n]+')) AS line FROM documents)
  SELECT DISTINCT 'gloss::' || substr(sha256(line), 1, 8) AS id, regexp_extract(line, '^(.{2,40}?) - (.+)$', 1) AS term, regexp_extract(line, '^(.{2,40}?) - (.+)$', 2) AS definition FROM l WHERE regexp_matches(line, '^(.{2,40}?) - (.+)$')""")
def _glossary(spark, sf):
    raw = F.replace(F.concat("lang", F.lit(" - "), "text"), F.lit(". "), F.concat(F.lit("\n"), "source", F.lit(" - ")))
    form = r"^(.{2,40}?) - (.+)$"
    rows = docs(spark, sf).select(F.explode(F.split(raw, r"[\r\n]+")).alias("line")).where(F.col("line").rlike(form))
    return rows.select(F.concat(F.lit("gloss::"), T.sha8(F.col("line"))).alias("id"), F.regexp_extract("line", form, 1).alias("term"), F.regexp_extract("line", form, 2).alias("definition")).distinct()


@query("C12_chunk_csv_rows", "WITH " + X.TICKETS + """ SELECT key, array_to_string(list_filter(['Key: ' || key, 'Status: ' || status, CASE WHEN summary <> '' THEN 'Summary: ' || summary END, CASE WHEN root_cause <> '' THEN 'Root_Cause: ' || root_cause END, 'Priority: ' || priority], lambda x: x IS NOT NULL), chr(10)) AS text,
  key || ' > ' || status || CASE WHEN length(summary) BETWEEN 1 AND 50 THEN ' > ' || summary ELSE '' END AS breadcrumb FROM tickets WHERE length(summary) >= 10""")
def _csv_rows(spark, sf):
    empty = ("", "Empty", "None", "N/A")
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("v")) for n, c in (("Key", "key"), ("Status", "status"), ("Summary", "summary"), ("Root_Cause", "root_cause"), ("Priority", "priority"))])
    full = F.filter(cells, lambda x: x["v"].isNotNull() & ~x["v"].isin(*empty))
    crumbs = F.slice(F.filter(F.array("key", "status", "summary"), lambda v: (F.length(v) >= 1) & (F.length(v) <= 50)), 1, 3)
    return X.tickets(spark, sf).where(F.length("summary") >= 10).select("key", F.array_join(F.transform(full, lambda x: F.concat(x["name"], F.lit(": "), x["v"])), "\n").alias("text"), F.array_join(crumbs, " > ").alias("breadcrumb"))


ITEM = r"""i AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark), it AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'star' ELSE 'qa' END AS kind, w, len(w) // 5 AS n FROM i)"""


def items(spark, sf):
    """Items made of all words of the benchmark texts: a fifth is the question; of every second item the rest is the answer, of the
    others four parts."""
    b = table(spark, sf, "benchmark").select("item_id", T.words(F.col("text")).alias("w")).withColumn("n", F.floor(F.size("w") / 5).cast("int"))
    part = lambda k: F.array_join(F.slice("w", k * F.col("n") + 1, F.col("n")), " ")
    rest = lambda k: F.array_join(F.slice("w", k * F.col("n") + 1, F.size("w")), " ")
    star = F.col("item_id") % 2 == 0
    return b.select("item_id", F.when(star, "star").otherwise("qa").alias("kind"), part(0).alias("question"), F.when(~star, rest(1)).alias("answer"), part(1).alias("situation"), part(2).alias("task"), part(3).alias("action"), rest(4).alias("result"))


@query("C14_curated_chunks", "WITH " + ITEM + """ SELECT 'curated::' || item_id AS id, 'curated,' || kind AS tags, 'curated' AS category, 'Q: ' || array_to_string(w[1:n], ' ') || CASE WHEN kind = 'star' THEN
  chr(10) || chr(10) || 'Situation: ' || array_to_string(w[n+1:2*n], ' ') || chr(10) || 'Task: ' || array_to_string(w[2*n+1:3*n], ' ') || chr(10) || 'Action: ' || array_to_string(w[3*n+1:4*n], ' ') || chr(10) || 'Result: ' || array_to_string(w[4*n+1:], ' ')
  ELSE chr(10) || 'A: ' || array_to_string(w[n+1:], ' ') END AS text FROM it""")
def _curated(spark, sf):
    return chunking.curated(items(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query("C15_doc_text_sample", "WITH " + X.CHUNKS + """, s AS (SELECT doc_id, k, substr(text, 1, 800) AS sn FROM chunks), b AS (SELECT *, coalesce(sum(length(sn)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
  SELECT doc_id, substr(string_agg(sn, chr(10) ORDER BY k), 1, 4000) AS sample FROM b WHERE before < 4000 GROUP BY doc_id""")
def _sample(spark, sf):
    return chunking.text_sample(X.chunks(spark, sf))


@query("C16_explode_tags", "WITH " + X.TAGS + " SELECT id, unnest(tags) AS tag FROM tagged")
def _explode(spark, sf):
    return X.tagged(spark, sf).select("id", F.explode("tags").alias("tag"))
