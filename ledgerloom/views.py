"""Invoice-shaped views of the driver's tables, in Spark and as SQL text for the oracle.

Amounts are whole numbers and every choice hangs on keys, so both engines see the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMMODITIES = ("elektrina_nn", "elektrina_vn", "plyn_mo", "plyn_vo", "teplo", "voda")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(n, values) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    o = table(spark, sf_dir, "orders").join(quantity, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    ex = (F.col("q") * 13 + k % 97).cast("double")
    inc = ex + F.floor(ex / 5) + F.when(k % 13 == 0, 10).otherwise(0)
    issue = F.add_months(F.to_date("o_orderdate"), 276)
    to = F.date_sub(issue, (F.col("o_custkey") % 20).cast("int"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(
        k.alias("id"), F.concat(F.lit("FV-"), k.cast("string")).alias("invoice_number"), _pick(k, COMMODITIES).alias("commodity"), issue.alias("issue_date"),
        F.date_add(issue, (F.lit(14) + k % 10 - F.when(k % 19 == 0, 30).otherwise(0)).cast("int")).alias("due_date"), F.date_sub(to, (F.lit(30) + k % 400).cast("int")).alias("period_from"), to.alias("period_to"),
        F.when(k % 11 != 0, ex).alias("amount_ex_vat"), F.when(k % 7 != 0, F.when(k % 17 == 0, -inc).otherwise(inc)).alias("amount_inc_vat"), F.when(k % 5 == 0, F.lit(0.0)).when(k % 5 == 1, ex).alias("amount_to_pay"),
        (k % 17 == 0).alias("is_correction"), F.when(k % 17 == 0, F.concat(F.lit("FV-"), before.cast("string"))).alias("original_number"),
        F.when(k % 23 != 0, F.lpad(F.col("o_custkey").cast("string"), 8, "0")).otherwise(F.lit("1234567")).alias("customer_tax_id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"),
    )


INVOICES = """
quantity AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey),
base AS (SELECT o.*, q, CAST(q * 13 + o_orderkey % 97 AS DOUBLE) AS ex, CAST(CAST(o_orderdate AS DATE) + INTERVAL 23 YEAR AS DATE) AS issue,
                lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders o JOIN quantity ON o_orderkey = l_orderkey),
invoices AS (SELECT o_orderkey AS id, 'FV-' || CAST(o_orderkey AS VARCHAR) AS invoice_number,
  CASE o_orderkey % 6 WHEN 0 THEN 'elektrina_nn' WHEN 1 THEN 'elektrina_vn' WHEN 2 THEN 'plyn_mo' WHEN 3 THEN 'plyn_vo' WHEN 4 THEN 'teplo' ELSE 'voda' END AS commodity,
  issue AS issue_date, issue + CAST(14 + o_orderkey % 10 - CASE WHEN o_orderkey % 19 = 0 THEN 30 ELSE 0 END AS INTEGER) AS due_date,
  issue - CAST(o_custkey % 20 AS INTEGER) - CAST(30 + o_orderkey % 400 AS INTEGER) AS period_from, issue - CAST(o_custkey % 20 AS INTEGER) AS period_to,
  CASE WHEN o_orderkey % 11 <> 0 THEN ex END AS amount_ex_vat,
  CASE WHEN o_orderkey % 7 <> 0 THEN (ex + floor(ex / 5) + CASE WHEN o_orderkey % 13 = 0 THEN 10 ELSE 0 END) * CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END END AS amount_inc_vat,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 5 = 1 THEN ex END AS amount_to_pay,
  o_orderkey % 17 = 0 AS is_correction, CASE WHEN o_orderkey % 17 = 0 THEN 'FV-' || CAST(prev AS VARCHAR) END AS original_number,
  CASE WHEN o_orderkey % 23 <> 0 THEN lpad(CAST(o_custkey AS VARCHAR), 8, '0') ELSE '1234567' END AS customer_tax_id, o_custkey AS customer, o_orderpriority AS priority FROM base)"""

BANDS = """
bands(c, valid_from, valid_to, rate) AS (SELECT c, CAST(a AS DATE), CAST(b AS DATE), CAST(r AS DOUBLE) FROM (VALUES
  ('e', '2013-01-01', '2021-10-31', 21), ('e', '2021-11-01', '2021-12-31', 0), ('e', '2022-01-01', NULL, 21),
  ('voda', '2013-01-01', '2020-04-30', 15), ('voda', '2020-05-01', '2023-12-31', 10), ('voda', '2024-01-01', NULL, 12),
  ('teplo', '2013-01-01', '2019-12-31', 15), ('teplo', '2020-01-01', '2023-12-31', 10), ('teplo', '2024-01-01', NULL, 12)) AS t(c, a, b, r))"""


def rated(day: str) -> str:
    """Oracle CTE: invoices with the rate of ``day``."""
    kind = "CASE WHEN commodity IN ('voda', 'teplo') THEN commodity ELSE 'e' END"
    return f"{INVOICES},{BANDS},\nrated AS (SELECT i.*, b.rate AS vat_rate FROM invoices i LEFT JOIN bands b ON b.c = {kind} AND {day} >= b.valid_from AND (b.valid_to IS NULL OR {day} <= b.valid_to))"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processing transactions: purchases completed, errors with a message by their key, the rest pending."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error").otherwise("pending")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), status.alias("status"), F.when((F.col("event_type") == "error") & (k % 4 != 0), F.concat(F.lit("code "), (k % 25).cast("string"))).alias("error_message"),
        F.col("user_id"), F.col("event_type"), F.col("value"),
    )


TRANSACTIONS = """
events_k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
transactions AS (SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'pending' END AS status,
  CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN 'code ' || CAST(k % 25 AS VARCHAR) END AS error_message, user_id, event_type, value FROM events_k)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as expected values with a fixed corruption as extracted ones; every ninth is missing."""
    k = F.col("p_partkey")
    e = F.col("p_name")
    x = F.when(k % 9 == 0, None).when(k % 5 == 0, F.upper(e)).when(k % 5 == 1, F.concat(e, F.lit("x"))).when(k % 5 == 2, F.substring(e, 2, 100)).when(k % 45 == 3, F.lit("null")).otherwise(e)
    return table(spark, sf_dir, "part").select(
        k.alias("key"), F.concat(F.lit("f"), (k % 50).cast("string")).alias("filename"), F.col("p_brand").alias("strategy"), F.col("p_type").alias("field_name"), F.when(k % 13 != 0, e).alias("expected"), x.alias("extracted"),
        ((k * 37 % 101) / 100.0).alias("confidence"),
    )


PREDICTIONS = """
predictions AS (SELECT p_partkey AS key, 'f' || CAST(p_partkey % 50 AS VARCHAR) AS filename, p_brand AS strategy, p_type AS field_name, CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS expected,
  CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 1 THEN p_name || 'x' WHEN p_partkey % 5 = 2 THEN substr(p_name, 2) WHEN p_partkey % 45 = 3 THEN 'null' ELSE p_name END AS extracted,
  CAST(p_partkey * 37 % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence FROM part),
norm AS (SELECT *, lower(trim(expected)) AS a, lower(trim(extracted)) AS b FROM predictions),
flags AS (SELECT *, expected IS NOT NULL AS is_evaluable, coalesce(extracted NOT IN ('', 'None', 'null'), false) AS is_present, coalesce(a = b, false) AS is_exact_match, coalesce(a = b, false) AS is_correct,
  CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(length(a), length(b)) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END AS cer FROM norm)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words as word boxes: ten to a line, a wide gap after the fourth, pages of a hundred lines."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "[ \n]+"), lambda w: w != "")).alias("n", "text"))
    line, at = F.floor(F.col("n") % 1000 / 10), F.col("n") % 10
    return own.select(
        "doc_id", (F.floor(F.col("n") / 1000) + 1).cast("int").alias("page"), "text", (at * 60 + F.when(at >= 4, 90).otherwise(0)).cast("int").alias("left"), (line * 30 + F.col("n") % 3).cast("int").alias("top"),
        F.least(F.length("text") * 6, F.lit(55)).cast("int").alias("width"), F.lit(12).alias("height"), ((F.col("n") * 7) % 100).cast("string").alias("conf"),
    )


WORDS = """
split AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS text, unnest(range(len(ws))) AS n FROM split),
words AS (SELECT doc_id, CAST(n // 1000 + 1 AS INTEGER) AS page, text, n % 10 * 60 + CASE WHEN n % 10 >= 4 THEN 90 ELSE 0 END AS l, n % 1000 // 10 * 30 + n % 3 AS t, least(length(text) * 6, 55) AS w, 12 AS h, n * 7 % 100 AS conf FROM pos)"""
