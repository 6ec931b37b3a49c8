"""Splitting documents into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def split_with_overlap(df: DataFrame, words: str, size: int, overlap: int) -> DataFrame:
    """Replaces the array `words` by rows k, part: windows of `size` words that start every size - overlap words, the
    last one reaching the end. No words, no rows."""
    step = max(size - overlap, 1)
    last = F.ceil(F.greatest(F.size(words) - size, F.lit(0)) / step)
    rows = df.where(F.size(words) > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.withColumn("part", F.slice(words, (F.col("k") * step + 1).cast("int"), size)).drop(words)


def chunk_id(doc: Column, k: Column, text: Column) -> Column:
    return F.concat(F.lit("doc"), doc.cast("string"), F.lit("::chunk"), F.lpad((k + 1).cast("string"), 3, "0"), F.lit("::"), T.sha8(text))


def sections(rows: DataFrame, doc: str, pos: str, heading: str) -> DataFrame:
    """Adds section: a new one starts at each heading that follows body text. The running count is per document."""
    w = Window.partitionBy(doc).orderBy(pos)
    starts = F.col(heading) & ~F.coalesce(F.lag(heading).over(w), F.lit(True))
    return rows.withColumn("section", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def section_windows(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """id, doc_id, section, k, text: windows of the body words of each section (doc_id, section, breadcrumb, body), each after its
    breadcrumb in brackets. A section without body words has none."""
    parts = split_with_overlap(rows.withColumn("words_", T.words(F.coalesce("body", F.lit("")))), "words_", size, overlap)
    text = F.concat(F.lit("["), "breadcrumb", F.lit("]\n"), F.array_join("part", " "))
    code = lambda c, n: F.lpad((F.col(c) + 1).cast("string"), n, "0")
    named = parts.withColumn("text", text)
    own = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("::sec"), code("section", 3), F.lit("::"), code("k", 3), F.lit("::"), T.sha8(F.col("text")))
    return named.select(own.alias("id"), "doc_id", "section", "k", "text")


def table_blocks(lines: DataFrame, page: Column) -> DataFrame:
    """doc_id, first_pos, page, n_lines, text: runs of consecutive lines (doc_id, pos, line) with a bar, whole, on the page of
    their first line. Lines of one run have the same difference of place and rank among the document's lines with a bar."""
    rows = lines.where(F.contains("line", F.lit("|")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    runs = rows.withColumn("run", F.col("pos") - rank).groupBy("doc_id", "run").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("all"))
    return runs.select("doc_id", "first_pos", page.alias("page"), "n_lines", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"))


def tables_of_spans(blocks: DataFrame, spans: DataFrame, head: int = 200) -> DataFrame:
    """doc_id, idx, first_pos, text: each block (doc_id, first_pos, page, text) as a `Table:` chunk of each span (doc_id, idx,
    page, end_page) that holds its page; of the span's chunks that begin with the same `head` characters the first. Blocks and
    spans meet by their document, whose spans are few."""
    s = spans.select("doc_id", "idx", F.col("page").alias("from_page"), "end_page")
    held = blocks.join(s, "doc_id").where(F.col("page").between(F.col("from_page"), F.col("end_page"))).withColumn("text", F.concat(F.lit("Table:\n"), "text"))
    w = Window.partitionBy("doc_id", "idx", F.substring("text", 1, head)).orderBy("first_pos")
    return held.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").select("doc_id", "idx", "first_pos", "text")


def curated(items: DataFrame) -> DataFrame:
    """id, text, tags, category of curated items (item_id, kind, question, answer, situation, task, action, result), whole; a
    missing part is empty. Only items of kind star have the four parts."""
    said = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit("")))
    star = F.concat(said("Q", "question"), F.lit("\n\n"), F.concat_ws("\n", *[said(c.capitalize(), c) for c in ("situation", "task", "action", "result")]))
    text = F.when(F.col("kind") == "star", star).otherwise(F.concat_ws("\n", said("Q", "question"), said("A", "answer")))
    return items.select(F.concat(F.lit("curated::"), F.col("item_id").cast("string")).alias("id"), text.alias("text"), F.array(F.lit("curated"), "kind").alias("tags"), F.lit("curated").alias("category"))


def hierarchy(outline: DataFrame, pages: DataFrame, depth: int) -> DataFrame:
    """Outline rows (doc_id, idx, level, title, page) down to a depth; documents of `pages` (doc_id, n_pages) without
    any get a section every max(10, n_pages / 15) pages."""
    kept = outline.where(F.col("level") <= depth)
    step = F.greatest(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("n_pages") / 15))).cast("int")
    bare = pages.join(outline.select("doc_id").distinct(), "doc_id", "left_anti").where("n_pages > 0")
    made = bare.select("doc_id", F.posexplode(F.sequence(F.lit(0), (F.col("n_pages") - 1).cast("int"), step)).alias("idx", "page"))
    made = made.select("doc_id", F.col("idx").cast("long").alias("idx"), F.lit(1).cast("long").alias("level"), F.concat(F.lit("Section "), (F.col("idx") + 1).cast("string")).alias("title"), F.col("page").cast("long").alias("page"))
    return kept.select("doc_id", "idx", "level", "title", "page").unionByName(made)


def spans(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds end_page: the page before the next entry of the same or a higher level, else the last, never before page."""
    a, b = outline.alias("a"), outline.alias("b")
    later = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.idx") > F.col("a.idx")) & (F.col("b.level") <= F.col("a.level")))
    after = later.groupBy("a.doc_id", "a.idx").agg(F.min_by("b.page", "b.idx").alias("next_page"))
    joined = outline.join(after, ["doc_id", "idx"], "left").join(pages, "doc_id")
    return joined.withColumn("end_page", F.greatest("page", F.coalesce(F.col("next_page") - 1, F.col("n_pages") - 1))).drop("next_page", "n_pages")


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a markdown table, rows padded to the widest; null unless there are two rows and two columns."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(rows, line)
    text = F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0)))), "\n")
    return F.when((F.size(rows) >= 2) & (width >= 2), text)


def text_sample(chunks: DataFrame, most: int = 4000, snippet: int = 800) -> DataFrame:
    """doc_id, sample: snippets of a document's chunks in order while the running length is within `most`."""
    s = chunks.withColumn("snippet", F.substring("text", 1, snippet))
    before = F.coalesce(F.sum(F.length("snippet")).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = s.withColumn("before", before).where(F.col("before") < most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "snippet"))), lambda x: x["snippet"])
    return kept.groupBy("doc_id").agg(F.substring(F.array_join(parts, "\n"), 1, most).alias("sample"))
