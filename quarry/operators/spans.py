"""Chunks of page spans, and the context of a search's hits: folds over the few rows of one span or one search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking


def blocks_of_span(pages: Column, target: int) -> Column:
    """pages (array of struct page, text in order) -> array of struct text, first, last. Pages are gathered until they
    hold one and a half times the target in tokens, at a page's end; the rest of the span is a block too."""
    empty = F.struct(F.array().cast("array<struct<text:string,first:int,last:int>>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    block = lambda acc: F.array(F.struct(acc["text"].alias("text"), acc["first"].alias("first"), acc["last"].alias("last")))

    def step(acc, p):
        fresh = acc["text"] == ""
        text = F.when(fresh, p["text"]).when(p["text"] == "", acc["text"]).otherwise(F.concat(acc["text"], F.lit(" "), p["text"]))
        grown = F.struct(acc["done"].alias("done"), text.alias("text"), F.when(fresh, p["page"]).otherwise(acc["first"]).alias("first"), F.when(p["text"] == "", acc["last"]).otherwise(p["page"]).alias("last"))
        full = T.rough_tokens(text) >= target * 1.5
        flushed = F.struct(F.concat(acc["done"], block(grown)).alias("done"), F.lit("").alias("text"), F.lit(0).alias("first"), F.lit(0).alias("last"))
        return F.when(full, flushed).otherwise(grown)

    return F.aggregate(pages, empty, step, lambda acc: F.when(acc["text"] == "", acc["done"]).otherwise(F.concat(acc["done"], block(acc))))


def chunk_spans(paragraphs: DataFrame, target: int = 300, overlap: int = 50) -> DataFrame:
    """paragraphs (doc_id, span, page, pos, text) -> id, doc_id, span, first, last, text of windows of `target` words over the
    blocks of each span; the id holds the pages. A span's pages are one row; spans are chapters, not whole corpora."""
    page = paragraphs.groupBy("doc_id", "span", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    span = page.groupBy("doc_id", "span").agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "text"))).alias("pages"))
    block = span.select("doc_id", "span", F.explode(blocks_of_span(F.col("pages"), target)).alias("b")).select("doc_id", "span", "b.first", "b.last", T.words(F.col("b.text")).alias("words"))
    part = chunking.split_with_overlap(block, "words", target, overlap).select("doc_id", "span", "first", "last", "k", F.array_join("part", " ").alias("text"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("::ch"), F.lpad(F.col("span").cast("string"), 2, "0"), F.lit("::p"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit("::para::"), T.sha8(F.col("text")))
    return part.select(name.alias("id"), "doc_id", "span", "first", "last", "text")


def context_with_related(hits: DataFrame, chunks: DataFrame, links: DataFrame, most: int = 5000, each: int = 2) -> DataFrame:
    """query_id, ids, used. hits (query_id, r, id) in order, each followed by up to `each` of its links (id, other, r), with
    no chunk twice, while blocks (source line and text) fit into `most` characters: a hit that doesn't fit ends the
    context, a linked chunk that doesn't fit is passed over. A search has few hits, so its rows are one array."""
    size = F.length(F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]\n"), "text")).cast("long")
    sized = chunks.select("id", size.alias("size"))
    other = links.where(F.col("r") <= each).join(sized.toDF("other", "size"), "other").select("id", F.col("r").alias("sub"), F.col("other").alias("own"), "size")
    rows = hits.join(sized, "id").select("query_id", "r", F.lit(0).alias("sub"), F.col("id").alias("own"), "size", F.col("id").alias("parent"))
    rows = rows.unionByName(hits.join(other, "id").select("query_id", "r", "sub", "own", "size", F.col("id").alias("parent")))
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "sub", "own", "size", "parent"))).alias("rows"))
    empty = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("ended"), F.array().cast("array<string>").alias("heads"))

    def step(acc, x):
        hit = x["sub"] == 0
        seen = F.array_contains(acc["ids"], x["own"])
        fits = acc["used"] + x["size"] <= most
        skip = acc["ended"] | seen | (~hit & (~fits | ~F.array_contains(acc["heads"], x["parent"])))
        taken = F.struct(F.concat(acc["ids"], F.array(x["own"])).alias("ids"), (acc["used"] + x["size"]).alias("used"), acc["ended"].alias("ended"), F.when(hit, F.concat(acc["heads"], F.array(x["own"]))).otherwise(acc["heads"]).alias("heads"))
        end = F.struct(acc["ids"].alias("ids"), acc["used"].alias("used"), F.lit(True).alias("ended"), acc["heads"].alias("heads"))
        return F.when(skip, acc).when(fits, taken).otherwise(end)

    done = ordered.select("query_id", F.aggregate("rows", empty, step).alias("d"))
    return done.select("query_id", "d.ids", "d.used")
