"""Queries of file sources and sinks and of streams over files: the test tables are written in the form that an operator
reads or by the operator that writes, in a new folder below spark.checkpoint.dir, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans import fixtures as X
from quarry.plans.registry import query, table
from quarry.sources import files, ticket_store
from quarry.sources.scratch import scratch_dir
from quarry.streaming import streams


def folder(spark, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def one():
    return F.count(F.lit(1))


def chunk_rows(spark, sf):
    """Chunks in the shape of an index; every seventh has no id."""
    meta = F.struct(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("category").alias("nlp_category"), F.col("k").cast("int").alias("page_start"), F.col("k").cast("int").alias("page_end"))
    return X.chunks(spark, sf).select(F.when(F.col("doc_id") % 7 != 0, F.col("id")).alias("id"), "text", F.lit("paragraph").alias("element_type"), meta.alias("metadata"))


@query("A01_read_chunks", f"WITH {X.CHUNKS} SELECT id, category, length(text) AS n FROM chunks WHERE doc_id % 7 <> 0")
def _chunks(spark, sf):
    """JSON lines with blank and broken lines and rows without an id among them."""
    at = folder(spark, "index")
    rows = chunk_rows(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    odd = X.documents(spark, sf).select(F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit('{"id": "x'), "lang", F.lit('", "text'))).alias("value"))
    rows.unionByName(odd).write.text(at)
    return files.read_chunks(spark, at).select("id", F.col("metadata.nlp_category").alias("category"), F.length("text").cast("long").alias("n"))


@query("A03_read_text_files", "SELECT doc_id // 50 AS file, count(*) AS n_docs, sum(strlen(coalesce(text, '')) + 1) AS bytes, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents GROUP BY 1")
def _text_files(spark, sf):
    """Whole texts, fifty documents to a file, read as one row each."""
    at = folder(spark, "texts")
    d = X.documents(spark, sf).select(F.expr("doc_id div 50").alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    d.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(at)
    read = files.read_text_docs(spark, at).select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))
    return read.join(d.groupBy("file").agg(one().alias("n_docs")), "file").select("file", "n_docs", "bytes", "digest")


@query("A04_read_csv_docs", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, md5(text) AS digest FROM documents WHERE text <> '' AND NOT contains(text, chr(13))")
def _csv(spark, sf):
    """Headed CSV with line breaks, quotes and commas in its cells."""
    at = folder(spark, "csv")
    d = X.documents(spark, sf).where(~F.contains("text", F.lit("\r"))).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "source", "text")
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    return files.read_csv(spark, at).where("text <> ''").select("doc_id", "lang", "source", F.md5("text").alias("digest"))


@query("A05_list_source_files", "SELECT lang, 1::BIGINT AS n_files, true AS has_content FROM documents GROUP BY lang")
def _listing(spark, sf):
    """Files of one suffix below a folder, with sizes and content hashes."""
    at = folder(spark, "sources")
    X.documents(spark, sf).select("lang", F.col("source").alias("value")).repartition("lang").sortWithinPartitions("lang").write.partitionBy("lang").text(at)
    found = files.list_files(spark, at, ("txt",)).where("length > 0")
    return found.groupBy(F.regexp_extract("key", "lang=([^/]+)", 1).alias("lang")).agg(one().alias("n_files"), F.bool_and(F.length("hash") == 32).alias("has_content"))


@query("A06_latest_file_of_folder", "SELECT max(source) AS newest FROM documents")
def _newest(spark, sf):
    """The newest file of a drop folder: the last source is written last."""
    at = folder(spark, "drops")
    newest = X.documents(spark, sf).agg(F.max("source").alias("value"))
    X.documents(spark, sf).agg(F.min("source").alias("value")).coalesce(1).write.mode("append").text(at)
    newest.coalesce(1).write.mode("append").text(at)
    last = files.latest_file(spark, f"{at}/*.txt").first()["path"]
    return spark.read.text(last).select(F.col("value").alias("newest"))


@query("A08_read_event_log_files", f"WITH {X.ACCESS} SELECT event_id, event FROM log ORDER BY ts DESC, event_id LIMIT 5000")
def _log_files(spark, sf):
    """Access events from rotated JSON lines, the newest 5000."""
    at = folder(spark, "log")
    rows = X.access_log(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event")
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).write.json(f"{at}/log.{part}")
    return spark.read.schema(streams.EVENT).json(f"{at}/*").orderBy(F.desc("ts"), "event_id").limit(5000).select("event_id", "event")


@query("A10_write_by_category", f"WITH {X.CHUNKS} SELECT category, count(*) AS n, min(id) AS first_id FROM chunks GROUP BY 1")
def _by_category(spark, sf):
    """Chunks in a folder for each category; a second write replaces only the categories that it has."""
    at = folder(spark, "categories")
    rows = X.chunks(spark, sf).select("id", F.struct(F.col("category").alias("nlp_category")).alias("metadata"))
    files.write_by_category(rows, at)
    files.write_by_category(rows.where("metadata.nlp_category = 'sop'"), at)
    return spark.read.parquet(at).groupBy(F.col("nlp_category").alias("category")).agg(one().alias("n"), F.min("id").alias("first_id"))


@query("A11_write_router", "SELECT doc_id, source AS title, run FROM documents, (VALUES (1), (2)) r(run) WHERE doc_id % 2 = run - 1")
def _router(spark, sf):
    """Router rows appended by two runs."""
    at = folder(spark, "router")
    for run in (1, 2):
        files.append(X.documents(spark, sf).where(F.col("doc_id") % 2 == run - 1).select("doc_id", F.col("source").alias("title"), F.lit(run).alias("run")), at)
    return spark.read.parquet(at)


@query("A12_write_manifest_files", f"WITH {X.CHUNKS} SELECT run, count(*) AS chunks, count(DISTINCT doc_id) AS files FROM chunks, (VALUES (1), (2)) r(run) WHERE doc_id % 2 = run - 1 GROUP BY run")
def _manifest(spark, sf):
    """A row of totals appended by each run."""
    at = folder(spark, "manifest")
    for run in (1, 2):
        files.append(X.chunks(spark, sf).where(F.col("doc_id") % 2 == run - 1).agg(one().alias("chunks"), F.count_distinct("doc_id").alias("files")).withColumn("run", F.lit(run)), at)
    return spark.read.parquet(at)


@query("A13_export_markdown_files", f"WITH {X.CHUNKS} SELECT category, count(*) AS headings FROM chunks GROUP BY category")
def _markdown(spark, sf):
    """Markdown files by category, read back as text."""
    at = folder(spark, "markdown")
    md = F.concat(F.lit("## "), "id", F.lit("\n**Content:**\n"), "text", F.lit("\n---"))
    X.chunks(spark, sf).select("category", md.alias("value")).write.partitionBy("category").text(at)
    return spark.read.text(at).where(F.col("value").rlike("^## doc[0-9]+::chunk")).groupBy("category").agg(one().alias("headings"))


TICKET = "key string, status string, client string, created date, updated date, summary string"


@query("A14_export_tickets", f"WITH {X.TICKETS} SELECT key, status, client, CAST(created AS VARCHAR) AS created, CAST(updated AS VARCHAR) AS updated, summary, CASE WHEN key LIKE 'RCA-%' THEN 'reviews' ELSE 'triage' END AS store FROM tickets")
def _tickets(spark, sf):
    """Both ticket tables in SQLite files, one store each, read back from there."""
    at = folder(spark, "tickets")
    t = X.tickets(spark, sf).select("key", "status", "client", "created", "updated", "summary")
    ticket_store.export_tickets({"reviews": t.where("key like 'RCA-%'"), "triage": t.where("key not like 'RCA-%'")}, at)
    read = [ticket_store.read_tickets(spark, f"{at}/{name}", name, TICKET).withColumn("store", F.lit(name)) for name in ("reviews", "triage")]
    return read[0].unionByName(read[1]).withColumns({c: F.col(c).cast("string") for c in ("created", "updated")})


@query("A07_read_tickets", f"WITH {X.TICKETS} SELECT key, status, CAST(updated AS VARCHAR) AS updated, summary FROM tickets WHERE status IN ('F', 'O') AND created >= DATE '1995-01-01' AND updated IS NOT NULL AND key LIKE 'TRI-%'")
def _read_tickets(spark, sf):
    """A store's tickets in ranges of rows; the filters on columns are answered by SQLite."""
    at = folder(spark, "store")
    ticket_store.export_tickets({"tickets": X.tickets(spark, sf).select("key", "status", "client", "created", "updated", "summary")}, at)
    t = ticket_store.read_tickets(spark, f"{at}/tickets", "tickets", TICKET, rows=2000)
    kept = t.where(F.col("status").isin("F", "O") & (F.col("created") >= F.lit("1995-01-01").cast("date")) & F.col("updated").isNotNull() & F.col("key").startswith("TRI-"))
    return kept.select("key", "status", F.col("updated").cast("string").alias("updated"), "summary")


@query("A15_validate_csv_schema", "SELECT * FROM (VALUES ('customer', true, ''), ('empty', false, 'no rows'), ('region', false, 'missing columns: c_custkey, c_name')) AS t(file, valid, reason) WHERE EXISTS (SELECT 1 FROM customer)")
def _schema(spark, sf):
    """Three dropped files against the columns that are required."""
    at = folder(spark, "checked")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    drops = {"customer": c, "empty": c.limit(0), "region": table(spark, sf, "region").select("r_name")}
    rows = []
    for name, df in drops.items():
        df.coalesce(1).write.option("header", True).csv(f"{at}/{name}")
        rows.append((name, *files.validate_csv(files.read_csv(spark, f"{at}/{name}"), ["c_custkey", "c_name"])))
    return spark.createDataFrame(rows, "file string, valid boolean, reason string")


@query("A16_write_vectors", f"WITH {X.TAGS} SELECT id, doc_id, category, lower(array_to_string(tags, ' ')) AS search_text, len(embedding) AS size, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM tagged JOIN embeddings ON vec_id = doc_id")
def _vectors(spark, sf):
    """Chunks with their payload and the vector that the caller supplies, appended to a store and read back."""
    at = folder(spark, "vectors")
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    files.write_vectors(X.tagged(spark, sf).withColumn("search_text", F.lower(F.array_join("tags", " "))), own, ["id", "doc_id", "category", "search_text"], "doc_id", at)
    v = spark.read.parquet(at)
    return v.select("id", "doc_id", "category", "search_text", F.size("vector").alias("size"), F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"))


@query("J06_full_rebuild", f"WITH {X.CHUNKS} SELECT category, count(*) AS n FROM chunks WHERE doc_id % 3 <> 0 GROUP BY category")
def _rebuild(spark, sf):
    """An index that is discarded and built again without the documents that are gone."""
    at = folder(spark, "rebuilt")
    X.chunks(spark, sf).select("id", "category").write.parquet(at)
    files.rebuild(X.chunks(spark, sf).where("doc_id % 3 <> 0").select("id", "category"), at)
    return spark.read.parquet(at).groupBy("category").agg(one().alias("n"))


@query("N01_csv_drop_stream", "SELECT o_custkey AS key, arg_max(o_orderkey, struct_pack(u := CAST(o_orderdate AS DATE), k := o_orderkey)) AS newest, false AS refused FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, c_custkey, true FROM customer WHERE c_custkey % 2 = 0")
def _drops(spark, sf):
    """CSV files as they drop: rows are merged, newest first, into a table for each batch; rows that don't fit the schema
    go to a folder for invalid ones; done files are archived."""
    at = folder(spark, "drop")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.to_date("o_orderdate").alias("updated"))
    orders.write.option("header", True).csv(f"{at}/in")
    bad = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("value"), F.lit("no date").alias("updated"))
    bad.write.mode("append").option("header", True).csv(f"{at}/in")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.LongType()), T.StructField("updated", T.DateType())])
    best = F.max_by(F.struct("value", "updated"), F.struct("updated", "value")).alias("m")

    def merge(batch, n):
        batch.groupBy("key").agg(best).select("key", "m.*").write.mode("overwrite").parquet(f"{at}/table/{n}")

    streams.csv_drops(spark, f"{at}/in", schema, f"{at}/done", merge, f"{at}/state", invalid=f"{at}/invalid").awaitTermination()
    kept = spark.read.parquet(f"{at}/table/*").groupBy("key").agg(best).select("key", F.col("m.value").alias("newest"), F.lit(False).alias("refused"))
    refused = spark.read.text(f"{at}/invalid").select(F.split("value", ",")[0].cast("long").alias("key"), F.split("value", ",")[1].cast("long").alias("newest"), F.lit(True).alias("refused"))
    return kept.unionByName(refused)


@query("N02_log_tail", f"WITH {X.ACCESS} SELECT event_id, event FROM log WHERE event = 'search_kb'")
def _tail(spark, sf):
    """Events of one kind from the files of a log folder, as a stream into a table."""
    at = folder(spark, "tail")
    X.access_log(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event").write.json(f"{at}/log")
    kept = streams.log_tail(spark, f"{at}/log").where("event = 'search_kb'").select("event_id", "event")
    kept.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/table").awaitTermination()
    return spark.read.parquet(f"{at}/table")
