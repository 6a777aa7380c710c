"""Registered queries of sources, sinks, streams and storage, each with the SQL that states the same for the oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import views
from ledgerloom.functions import registered, text
from ledgerloom.operators import evaluate, store, vat
from ledgerloom.plans import analytics
from ledgerloom.queries import I, P, T, query
from ledgerloom.session import shared_folder
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import streams


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file in the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()


# --- uploads and folders --------------------------------------------------------------------------------------------

_SUFFIX = "CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.tiff' ELSE '' END"
_MIME = "CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 3 THEN 'image/jpeg' WHEN 4 THEN 'image/tiff' END"


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".txt", ".jpeg", ".tiff", ""))), (k % 6 + 1).cast("int"))
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("/in/"), "source", F.lit("/d"), k.cast("string"), suffix).alias("path"), (F.col("n_chars").cast("long") * 5000).alias("length"), F.encode("text", "UTF-8").alias("content"))


@query(f"""SELECT doc_id, CAST(CASE WHEN doc_id % 6 IN (2, 5) THEN 415 WHEN n_chars * 5000 > 52428800 THEN 413 ELSE 202 END AS INTEGER) AS status FROM documents""")
def uploads_judged(spark, sf_dir):
    return readers.judged_uploads(_uploads(spark, sf_dir)).select("doc_id", "status")


@query(f"SELECT doc_id, lower({_SUFFIX}) AS suffix, {_MIME} AS mime_type FROM documents WHERE doc_id % 6 NOT IN (2, 5)")
def supported_files(spark, sf_dir):
    return readers.supported(_uploads(spark, sf_dir)).select("doc_id", "suffix", "mime_type")


@query(f"""SELECT substr(md5(text), 1, 8) || '_d' || CAST(doc_id AS VARCHAR) || {_SUFFIX} AS filename, CAST(n_chars * 5000 AS BIGINT) AS file_size_bytes, {_MIME} AS mime_type, 'pending' AS status FROM documents WHERE doc_id % 6 NOT IN (2, 5)""")
def pending_transactions(spark, sf_dir):
    rows = readers.pending_transactions(readers.supported(_uploads(spark, sf_dir)), "2024-01-01")
    return analytics.pending(rows).select("filename", "file_size_bytes", "mime_type", "status")


@query("SELECT r_name || '.pdf' AS name, CAST(length(r_name) AS BIGINT) AS length, md5(r_name) AS digest, 'application/pdf' AS mime_type FROM region WHERE r_regionkey % 2 = 0")
def folder_scan(spark, sf_dir):
    folder = _folder(spark, "scan")
    for r in views.table(spark, sf_dir, "region").collect():  # a dimension of a few rows
        _put(spark, f"{folder}/in/{r.r_name}{'.pdf' if r.r_regionkey % 2 == 0 else '.txt'}", r.r_name.encode())
    found = readers.documents_in(spark, folder, recursive=True)
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", F.md5("content").alias("digest"), "mime_type")


@query("SELECT name, CAST(length(content) AS BIGINT) AS length, mime FROM (VALUES ('a.pdf', 'one', 'application/pdf'), ('b.bmp', 'three', 'image/bmp')) AS t(name, content, mime)")
def uploads_from_bytes(spark, sf_dir):
    own = readers.from_bytes(spark, [("a.pdf", b"one"), ("b.bmp", b"three"), ("c.exe", b"x")])
    return own.select(F.col("path").alias("name"), "length", F.col("mime_type").alias("mime"))


@query("SELECT doc_id, text, CASE WHEN length(text) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence, 'native' AS engine FROM documents")
def text_layer(spark, sf_dir):
    return readers.text_layer(_uploads(spark, sf_dir)).select(F.regexp_extract("path", r"/d(\d+)", 1).cast("long").alias("doc_id"), "text", "confidence", "engine")


@query("SELECT CAST(0 AS BIGINT) AS pages")
def render_pages(spark, sf_dir):
    """Without a renderer there are no pages: the adapter's boundary."""
    return readers.render_adapter(_uploads(spark, sf_dir)).agg(F.count("*").alias("pages"))


# --- files ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(round(n_nationkey / CAST(7 AS DOUBLE), 2) AS VARCHAR) AS share FROM nation")
def csv_round_trip(spark, sf_dir):
    folder = _folder(spark, "csv")
    sinks.write_csv(views.table(spark, sf_dir, "nation").withColumn("SHARE", F.col("n_nationkey") / 7), folder, {"SHARE": 2})
    return readers.csv_texts(spark, folder).drop("_source_csv")


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'plyn_mo' ELSE 'voda' END AS _commodity, CASE WHEN r_regionkey % 2 = 0 THEN 'set1' ELSE 'set2' END AS _dataset FROM region""")
def tagged_csv_sets(spark, sf_dir):
    rows = views.table(spark, sf_dir, "region").collect()  # a dimension of a few rows
    folder = _folder(spark, "sets")
    for even, name, sep in ((True, "ground_truth_plyn_MO.csv", ";"), (False, "voda.csv", ","), (False, "voda copy.csv", ",")):
        lines = [f" Key {sep}NAME", *[f"{r.r_regionkey}{sep}{r.r_name}" for r in rows if (r.r_regionkey % 2 == 0) == even]]
        _put(spark, f"{folder}/{'one' if even else 'two'}/{name}", ("﻿" + "\n".join(lines)).encode())
    return readers.tagged_sets([("set1", readers.csv_texts(spark, f"{folder}/one")), ("set2", readers.csv_texts(spark, f"{folder}/two"))]).select("key", "name", "_commodity", "_dataset")


_BAND_FILE = "x;x;commodity;to;rate\n;;Plyn MO;;\n;;Plyn MO;;\n;;voda;;\n;;;2021-10-31;21\n;;2021-11-01;;0\n;;2020-01-01;2020-12-31;10\n"


@query("""SELECT commodity, CAST(valid_from AS DATE) AS valid_from, CAST(valid_to AS DATE) AS valid_to, CAST(rate AS DOUBLE) AS rate, gapless FROM
 (VALUES ('plyn_mo', '2013-01-01', '2021-10-31', 21, true), ('plyn_mo', '2021-11-01', NULL, 0, true), ('voda', '2020-01-01', '2020-12-31', 10, false)) AS t(commodity, valid_from, valid_to, rate, gapless)""")
def tax_bands_csv(spark, sf_dir):
    bands = vat.vat_bands(spark, readers.bands_from_csv(_BAND_FILE))
    return bands.join(vat.contiguous(bands).withColumnRenamed("contiguous", "gapless"), "commodity")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_lines_round_trip(spark, sf_dir):
    folder = _folder(spark, "jsonl")
    sinks.write_json_lines(views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), folder)
    return readers.json_lines(spark, folder, "s_suppkey long, s_name string, s_acctbal double")


@query("SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region")
def json_file(spark, sf_dir):
    import json

    path = f"{_folder(spark, 'json')}/all.json"
    rows = views.table(spark, sf_dir, "region").collect()  # a dimension of a few rows
    _put(spark, path, json.dumps([{"key": r.r_regionkey, "name": r.r_name} for r in rows], indent=1).encode())
    return readers.json_file(spark, path).select("key", "name")


@query("""SELECT p_brand AS strategy, to_json({'evaluations': list({'key': p_partkey, 'name': p_name} ORDER BY p_partkey), 'corpus': {'n': count(*), 'largest': max(p_size)}}) AS report FROM part GROUP BY 1""")
def json_report(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "strategy")
    corpus = part.groupBy("strategy").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))
    return sinks.json_report(part.select("strategy", F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), corpus)


@query(f"""WITH {P} SELECT 'results' AS file, count(*) AS n FROM flags UNION ALL SELECT 'lines', count(*) FROM flags UNION ALL SELECT 'summary', count(DISTINCT field_name) FROM flags UNION ALL SELECT 'audit', count(*) FROM flags WHERE NOT is_correct""")
def run_outputs(spark, sf_dir):
    own = views.predictions(spark, sf_dir)
    flags = own.withColumns(evaluate.match_flags(F.col("expected"), F.col("extracted"), F.col("field_name"))).select("key", "field_name", "is_correct")
    paths = sinks.run_outputs(_folder(spark, "run"), flags, flags.groupBy("field_name").agg(F.count("*").alias("n")), flags.filter("NOT is_correct"))
    read = {"results": readers.csv_texts(spark, paths["results_csv"], ","), "lines": readers.json_lines(spark, paths["results_jsonl"]), "summary": readers.json_lines(spark, paths["summary_json"]), "audit": readers.csv_texts(spark, paths["audit_csv"], ",")}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), "n") for name, df in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""SELECT n_nationkey AS key, n_name AS name, NULL AS parent FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT r_regionkey, NULL, NULL FROM region""")
def append_evolving(spark, sf_dir):
    path, nation = _folder(spark, "grown"), views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    sinks.append(nation.filter("key < 5").drop("parent"), spark, path)
    sinks.append(nation.filter("key >= 5"), spark, path)  # a column more
    sinks.append(views.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key")), spark, path)  # and fewer
    return sinks.read_appended(spark, path)


@query("""SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS before, CAST(1 AS DOUBLE) AS after, round(e[1] / sqrt(list_inner_product(e, e)), 5) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def vector_table(spark, sf_dir):
    from ledgerloom.functions import similarity

    path, own = _folder(spark, "vectors"), views.table(spark, sf_dir, "embeddings")
    sinks.write_vectors(own, path, "vec_id")
    size = lambda c: F.round(F.sqrt(similarity.dot(c, c)), 6)
    stored = spark.read.parquet(path).select("vec_id", size(F.col("embedding")).alias("after"), F.round(F.get("embedding", F.lit(0)), 5).alias("first"))
    return own.select("vec_id", size(F.col("embedding")).alias("before")).join(stored, "vec_id")


@query("SELECT substr(sha1(CAST(doc_id AS VARCHAR)), 1, 10) AS doc_id, lang, n_chars FROM documents")
def anonymised_documents(spark, sf_dir):
    return sinks.anonymised(views.table(spark, sf_dir, "documents").withColumnRenamed("source", "supplier").drop("text"), "doc_id")


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents""")
def hash_digests(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text.digests("text").items()])


_DRAW = "(CAST('0x' || substr(md5('42|{}|' || invoice_number), 1, 8) AS BIGINT) % 10000)"
_SYNTHETIC = f"""grid AS (SELECT printf('SYN-%02d-%d-%d', s, t, c) AS invoice_number, CASE s % 6 WHEN 0 THEN 'elektrina_nn' WHEN 1 THEN 'elektrina_vn' WHEN 2 THEN 'plyn_mo' WHEN 3 THEN 'plyn_vo' WHEN 4 THEN 'teplo' ELSE 'voda' END AS commodity,
 'Q' || CAST(t + 1 AS VARCHAR) AS quality FROM range(18) a(s), range(3) b(t), range(3) d(c)),
started AS (SELECT *, DATE '2023-01-01' + CAST(floor({_DRAW.format('start')} * 700 / CAST(10000 AS DOUBLE)) AS INTEGER) AS period_from FROM grid),
synthetic AS (SELECT *, period_from + CAST(floor(30 + {_DRAW.format('days')} * 335 / CAST(10000 AS DOUBLE)) AS INTEGER) AS period_to FROM started)"""


@query(f"WITH {_SYNTHETIC} SELECT invoice_number, commodity, quality, period_from, period_to FROM synthetic")
def synthetic_invoices(spark, sf_dir):
    return readers.suppliers_fixture(spark)


@query(f"""WITH {_SYNTHETIC}, r(commodity, lo, hi, a, b, vat_rate) AS (VALUES ('elektrina_nn', 1500, 12000, 4.5, 6.5, 21), ('elektrina_vn', 30000, 180000, 1.8, 5.5, 21), ('plyn_mo', 2000, 30000, 1.8, 3.2, 21), ('plyn_vo', 50000, 400000, 1.2, 2.0, 21), ('teplo', 10, 80, 450.0, 750.0, 21), ('voda', 80, 600, 68.0, 95.0, 12)),
p AS (SELECT invoice_number, vat_rate, lo + CAST(floor((hi - lo) * {_DRAW.format('consumption')} / CAST(10000 AS DOUBLE)) AS BIGINT) AS consumption, CAST(a * 10000 AS BIGINT) + CAST(floor(CAST((b - a) * 10000 AS BIGINT) * {_DRAW.format('price')} / CAST(10000 AS DOUBLE)) AS BIGINT) AS price FROM synthetic JOIN r USING (commodity)),
x AS (SELECT *, (consumption * price + 50) // 100 AS ex FROM p), v AS (SELECT *, (ex * vat_rate + 50) // 100 AS vat FROM x),
d AS (SELECT *, CAST(floor((ex + vat) * (7000 + {_DRAW.format('advances')} * 6 // 10) / CAST(100000000 AS DOUBLE)) AS BIGINT) * 10000 AS adv FROM v)
SELECT invoice_number, consumption, price / CAST(10000 AS DOUBLE) AS unit_price, ex / CAST(100 AS DOUBLE) AS amount_ex_vat, vat / CAST(100 AS DOUBLE) AS vat_amount, (ex + vat) / CAST(100 AS DOUBLE) AS amount_inc_vat, adv / CAST(100 AS DOUBLE) AS advances, (ex + vat - adv) / CAST(100 AS DOUBLE) AS balance FROM d""")
def synthetic_amounts(spark, sf_dir):
    return readers.with_amounts(readers.suppliers_fixture(spark)).select("invoice_number", "consumption", "unit_price", "amount_ex_vat", "vat_amount", "amount_inc_vat", "advances", "balance")


# --- plans ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def guarded_sql(spark, sf_dir):
    views.table(spark, sf_dir, "orders").createOrReplaceTempView("guarded_orders")
    return analytics.custom_query(spark, " SELECT o_orderstatus AS status, count(*) AS n FROM guarded_orders GROUP BY 1 ; ")


@query(f"WITH {T} SELECT status, count(*) AS count, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM transactions GROUP BY status")
def named_report(spark, sf_dir):
    views.transactions(spark, sf_dir).createOrReplaceTempView("transactions")
    return analytics.run_report(spark, "error_summary")


@query("""SELECT doc_id, lower(trim(regexp_replace(substr(text, 1, 200), '\\s+', ' ', 'g'))) AS normal, lower(strip_accents(substr(text, 1, 200))) AS folded, CASE WHEN length(text) > 0 THEN round(CAST(1 AS DOUBLE) / greatest(1, len(regexp_split_to_array(trim(text, ' ' || chr(10)), '[ \\n]+'))), 9) END AS wer FROM documents""")
def sql_functions(spark, sf_dir):
    """What :func:`ledgerloom.functions.registered.register` gives to SQL, in the oracle's form; the word rate is that of the text
    with its last word lengthened, which makes it another one whatever it is. Words end at blanks and line feeds."""
    registered.register(spark)
    views.table(spark, sf_dir, "documents").createOrReplaceTempView("sql_documents")
    return spark.sql("""SELECT doc_id, normalise_string(substr(text, 1, 200), 'sql') AS normal, fold_accents(substr(text, 1, 200), 'sql') AS folded,
 CASE WHEN length(text) > 0 THEN round(word_error_rate(text, concat(trim(TRAILING ' \n' FROM text), '#'), ' \n'), 9) END AS wer FROM sql_documents""")


@query(f"""WITH {I}, d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT l_linenumber, l_partkey, l_suppkey, CASE WHEN o_orderkey IS NULL THEN l_orderkey END AS l_orderkey FROM lineitem LEFT JOIN d ON l_orderkey = o_orderkey""")
def set_null(spark, sf_dir):
    gone = views.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return store.set_null(views.table(spark, sf_dir, "lineitem"), gone, "l_orderkey", "o_orderkey").select("l_linenumber", "l_partkey", "l_suppkey", "l_orderkey")


# --- streams --------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = views.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows that a stream over the files there are gives, by way of a table in the shared folder."""
    out, state = _folder(spark, name), _folder(spark, f"{name}-state")

    def store_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that comes again replaces itself

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(store_batch).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"""WITH {T}, d AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS total, CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM transactions GROUP BY 1)
SELECT date, total, completed, errors FROM d WHERE date + INTERVAL 1 DAY <= (SELECT max(created_at) FROM transactions) - INTERVAL 2 DAY""")
def stream_daily_volume(spark, sf_dir):
    """Days that the watermark has closed."""
    events = _stream(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error").otherwise("pending")
    return _drained(spark, streams.daily_volume(events.select(F.col("ts").cast("timestamp").alias("created_at"), status.alias("status"))), "daily").drop("batch")


@query("SELECT user_id AS digest, CAST(1 AS BIGINT) AS results FROM events GROUP BY 1")
def stream_result_cache(spark, sf_dir):
    """One result per digest while it lives; here for longer than the table spans."""
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("digest"), F.col("ts").cast("timestamp").alias("cached_at"))
    return _drained(spark, streams.first_results(events, ttl="4000 days"), "cache").groupBy("digest").agg(F.count("*").alias("results"))


@query("""SELECT event_type AS model, count(*) AS n FROM events GROUP BY 1""")
def stream_feedback(spark, sf_dir):
    """The state's count of classifications; rates hang on the order of arrival."""
    kind = lambda n: F.when(F.col(n) % 2 == 0, "scanned").otherwise("native_pdf")
    events = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("model"), kind("event_id").alias("truth"), kind("user_id").alias("predicted"))
    return _drained(spark, streams.feedback_stream(events), "feedback", "update").groupBy("model").agg(F.max("n").alias("n"))


@query("SELECT r_name || '.png' AS filename_end, 'pending' AS status FROM region")
def stream_landing(spark, sf_dir):
    """Files that lie in a landing folder become pending transactions."""
    folder, table, rejects = _folder(spark, "landing"), _folder(spark, "landed"), _folder(spark, "rejects")
    for r in views.table(spark, sf_dir, "region").collect():  # a dimension of a few rows
        _put(spark, f"{folder}/{r.r_name}.png", r.r_name.encode())
        _put(spark, f"{folder}/{r.r_name}.doc", b"x")
    streams.ingest(streams.landing(spark, folder), table, rejects, _folder(spark, "landing-state")).awaitTermination()
    return spark.read.parquet(table).select(F.substring_index("filename", "_", -1).alias("filename_end"), "status")


@query("""WITH e AS (SELECT user_id AS digest, min(ts) AS cached_at FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR GROUP BY 1) SELECT digest, CAST(cached_at AS TIMESTAMP) AS cached_at FROM e ORDER BY cached_at DESC, digest LIMIT 60""")
def bounded_cache(spark, sf_dir):
    """Results that live for three days, the sixty newest."""
    own = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("digest"), F.col("ts").alias("cached_at"), "event_id")
    return streams.cache_after(own.filter("event_id % 2 = 0"), own.filter("event_id % 2 = 1"), "2024-01-20 00:00:00", "72 hours", 60).select("digest", "cached_at")
