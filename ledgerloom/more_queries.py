"""Registered queries of scalar functions, statistics, corrections, extraction, layout and cascade, with SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom import views
from ledgerloom.functions import fields, similarity, text
from ledgerloom.operators import analysis, cascade, classify, evaluate, extract, layout, retrieve, rules, stats, store, vat
from ledgerloom.plans import analytics
from ledgerloom.queries import I, P, T, W, _boxes, _BOXES, _CENTRE, _fields, _flags, _FIELDS, _raw_numbers, _RAW_NUMBERS, invoice_texts, query
from ledgerloom.session import ship_package


def pick(n, *values):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def chosen(n: str, *values: str) -> str:
    """The same as SQL."""
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values)) + " END"


# --- scalar functions -----------------------------------------------------------------------------------------------


@query(f"""WITH {_RAW_NUMBERS}, s AS (SELECT id, raw, replace(raw, ' ', '') AS s FROM raw), p AS (SELECT id, raw, CASE WHEN contains(s, ',') THEN replace(replace(s, '.', ''), ',', '.') WHEN regexp_full_match(s, '-?[0-9]{{1,3}}(\\.[0-9]{{3}})+') THEN replace(s, '.', '') ELSE s END AS s FROM s)
SELECT id, CASE WHEN regexp_full_match(s, '-?[0-9]+\\.?[0-9]*') THEN TRY_CAST(s AS DOUBLE) END AS number, CASE WHEN NOT regexp_full_match(s, '-?[0-9]+\\.?[0-9]*') THEN 'not a number: ' || raw END AS reason FROM p""")
def required_numbers(spark, sf_dir):
    good, bad = text.required_number(_raw_numbers(spark, sf_dir), "raw")
    return good.select("id", "number", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", F.lit(None).cast("double").alias("number"), "reason"))


_DAY = "CAST(o_orderdate AS DATE)"


@query(f"""WITH d AS (SELECT o_orderkey AS id, {_DAY} AS d, o_orderkey % 8 AS k FROM orders) SELECT id, CASE WHEN k IN (4, 6, 7) THEN NULL ELSE d END AS flexible, CASE WHEN k = 0 THEN d END AS strict FROM d""")
def parse_date_flexible(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    forms = [F.date_format(d, f) for f in ("yyyy-MM-dd", "yyyy.M.d", "d. M. yyyy", "dd/MM/yy", "dd-MM-yyyy", "d.M.yyyy")] + [F.lit("none"), F.lit("31.2.2024")]
    raw = F.coalesce(*[F.when(k % 8 == n, c) for n, c in enumerate(forms)])
    return views.table(spark, sf_dir, "orders").select(k.alias("id"), text.parse_date_flexible(raw).alias("flexible"), text.safe_iso_date(raw).alias("strict"))


_SAYS = ("true", "Yes ", "1", "y", "no", "oprava", "Opravný", "0", "", None)


@query(f"""WITH s AS (SELECT o_orderkey AS id, {chosen('o_orderkey', *_SAYS)} AS s FROM orders) SELECT id, coalesce(lower(trim(s)) IN ('true', '1', 'yes', 'y') OR contains(lower(s), 'oprav'), false) AS is_correction FROM s""")
def parse_is_correction(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.parse_is_correction(pick(F.col("o_orderkey"), *_SAYS)).alias("is_correction"))


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fold_accents(spark, sf_dir):
    ship_package(spark)
    return views.table(spark, sf_dir, "documents").select("doc_id", text.fold_accents("text").alias("folded"))


@query("""SELECT doc_id, lower(strip_accents(lang || 'É')) || CASE WHEN doc_id % 3 = 2 THEN '__scan_q' ELSE '' END || CAST(doc_id AS VARCHAR) AS stem FROM documents""")
def normalised_stems(spark, sf_dir):
    ship_package(spark)
    k = F.col("doc_id").cast("string")
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(k, F.lit("__scan_q2_17.pdf"))).when(F.col("doc_id") % 3 == 1, F.concat(k, F.lit(".x"))).otherwise(F.concat(F.lit("__scan_q"), k))
    return views.table(spark, sf_dir, "documents").select("doc_id", text.normalise_stem(F.concat(F.lit("/a.b/c\\d/"), "lang", F.lit("É"), tail)).alias("stem"))


@query("""WITH p AS (SELECT p_partkey AS key, p_name AS a, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 'x' WHEN 2 THEN substr(p_name, 2) WHEN 3 THEN '' ELSE 'zz ' || p_name END AS b FROM part),
n AS (SELECT *, lower(trim(a)) AS x, lower(trim(b)) AS y FROM p)
SELECT key, x = y AS exact, round(CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y)), 6) AS cer, 1 - CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y)) >= 0.9 AS fuzzy FROM n""")
def text_matches(spark, sf_dir):
    k, a = F.col("p_partkey"), F.col("p_name")
    b = F.when(k % 5 == 0, F.upper(a)).when(k % 5 == 1, F.concat(a, F.lit("x"))).when(k % 5 == 2, F.substring(a, 2, 100)).when(k % 5 == 3, "").otherwise(F.concat(F.lit("zz "), a))
    return views.table(spark, sf_dir, "part").select(k.alias("key"), similarity.exact_match(a, b).alias("exact"), F.round(similarity.char_error_rate(a, b), 6).alias("cer"), similarity.fuzzy_match(a, b).alias("fuzzy"))


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 3 THEN 1.0 ELSE round(CAST(CASE p_partkey % 4 WHEN 0 THEN 0 ELSE 1 END AS DOUBLE) / CASE p_partkey % 4 WHEN 1 THEN 3 ELSE 2 END, 6) END AS wer FROM part""")
def word_error_rates(spark, sf_dir):
    """Against the same two words, one more, one changed, none."""
    ship_package(spark)
    k, a = F.col("p_partkey"), F.col("p_name")
    b = F.when(k % 4 == 0, F.concat(F.lit(" "), a)).when(k % 4 == 1, F.concat(a, F.lit(" more"))).when(k % 4 == 2, F.concat(F.split(a, " ")[0], F.lit(" other"))).otherwise("")
    return views.table(spark, sf_dir, "part").select(k.alias("key"), F.round(similarity.word_error_rate(a, b), 6).alias("wer"))


@query("""WITH p AS (SELECT s_suppkey AS key, list_sort(string_split(lower(s_name || ' of nation'), ' ')) AS a FROM supplier) SELECT key, CAST(100 AS DOUBLE) AS same, round(200 * CAST(length(array_to_string(a, ' ')) AS DOUBLE) / (2 * length(array_to_string(a, ' ')) + 2), 6) AS longer FROM p""")
def indel_ratios(spark, sf_dir):
    ship_package(spark)
    a = F.concat(F.lower("s_name"), F.lit(" of nation"))
    return views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), similarity.token_sort_ratio(a, F.concat(F.lit("nation  of "), F.lower("s_name"))).alias("same"), F.round(similarity.token_sort_ratio(a, F.concat(a, F.lit("zz"))), 6).alias("longer"))


@query(f"""SELECT o_orderkey AS id, o_orderkey % 5 <> 4 AND abs(CASE o_orderkey % 5 WHEN 2 THEN 0.5 WHEN 3 THEN 0.005 ELSE 0 END) <= 0.01 AS numeric_match, o_orderkey % 4 IN (0, 1) AS date_match FROM orders""")
def typed_matches(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    n = (k % 900 + 1).cast("string")
    raw = F.when(k % 5 == 0, F.concat(n, F.lit(",00"))).when(k % 5 == 1, n).when(k % 5 == 2, F.concat(n, F.lit(".5"))).when(k % 5 == 3, F.concat(n, F.lit(",005"))).otherwise("none")
    day = F.when(k % 4 == 0, F.date_format(d, "d.M.yyyy")).when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(F.date_add(d, 1), "yyyy-MM-dd")).otherwise(F.lit(None).cast("string"))
    return views.table(spark, sf_dir, "orders").select(k.alias("id"), similarity.numeric_match(n, raw).alias("numeric_match"), similarity.date_match(F.date_format(d, "yyyy-MM-dd"), day).alias("date_match"))


@query(f"""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 999 AS VARCHAR) || '.50' WHEN 1 THEN '1' || lpad(CAST(o_orderkey % 999 AS VARCHAR), 3, '0') || '.25' WHEN 2 THEN 'abc' ELSE CAST(o_orderkey % 999 AS VARCHAR) || '.00' END AS number,
CASE WHEN o_orderkey % 4 = 3 THEN 'soon' ELSE strftime({_DAY}, '%Y-%m-%d') END AS day, 'ab' || CAST(o_orderkey AS VARCHAR) AS code FROM orders""")
def normalised_values(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    n = (k % 999).cast("string")
    number = F.when(k % 4 == 0, F.concat(n, F.lit(",5 Kč"))).when(k % 4 == 1, F.concat(F.lit("1."), F.lpad(n, 3, "0"), F.lit(",25"))).when(k % 4 == 2, "abc").otherwise(n)
    day = F.when(k % 4 == 0, F.date_format(d, "d.M.yyyy")).when(k % 4 == 1, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("soon")
    return views.table(spark, sf_dir, "orders").select(k.alias("id"), text.normalise_value(number, "float").alias("number"), text.normalise_value(day, "date").alias("day"), text.normalise_value(F.concat(F.lit(" A B "), k.cast("string")), "string").alias("code"))


@query("""SELECT s_suppkey AS id, printf('%.2f', CAST(s_suppkey * 1000 AS DOUBLE) + CAST(0.25 AS DOUBLE)) AS amount, replace(replace(replace(format('{:,.2f}', CAST(s_suppkey * 1000 AS DOUBLE) + CAST(0.25 AS DOUBLE)), ',', chr(160)), '.', ','), '', '') AS shown,
CAST(s_suppkey AS DOUBLE) * CAST(23.5 AS DOUBLE) AS czk, s_suppkey % 3 = 0 AS is_zero, CASE s_suppkey % 3 WHEN 1 THEN CAST(1.5 AS DOUBLE) WHEN 0 THEN CAST(0 AS DOUBLE) END AS lenient FROM supplier""")
def formatted_amounts(spark, sf_dir):
    k = F.col("s_suppkey")
    amount = k * 1000 + F.lit(0.25)
    raw = pick(k, "0,0", "1,5", "x")
    return views.table(spark, sf_dir, "supplier").select(
        k.alias("id"), text.format_amount(amount).alias("amount"), text.format_local_number(amount).alias("shown"), text.usd_to_czk(k.cast("double")).alias("czk"), text.is_zero(pick(k, "0.0", "1", "x")).alias("is_zero"), text.safe_float(raw).alias("lenient"),
    )


@query("""SELECT p_partkey AS key, p_partkey * 700 <= 1114111 AND NOT p_partkey * 700 BETWEEN 55296 AND 57343 AS valid FROM part""")
def code_points(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.valid_code_point(F.col("p_partkey") * 700).alias("valid"))


_FONTS = ("Helvetica", "ArialMT", "GIDxx", "T1_0", "F7", "Garamond12", "Times-Roman-Bold-1999", "", None)


@query(f"""WITH f AS (SELECT p_partkey AS key, lower({chosen('p_partkey', *_FONTS)}) AS f FROM part)
SELECT key, coalesce(f = '' OR regexp_matches(f, 'unknown|gid|arial|tdsr|t1_0') OR length(f) < 3 OR (regexp_matches(f, '[0-9]') AND length(f) < 10), true) AS v2, coalesce(f = '' OR regexp_matches(f, 'unknown|gid|tdsr|t1_0'), true) AS hybrid FROM f""")
def invisible_fonts(spark, sf_dir):
    f = pick(F.col("p_partkey"), *_FONTS)
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.invisible_font(f).alias("v2"), text.invisible_font(f, "hybrid").alias("hybrid"))


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS name, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS VARCHAR) END AS size FROM part""")
def repaired_json(spark, sf_dir):
    k = F.col("p_partkey")
    whole = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("size")))
    raw = F.when(k % 3 == 0, whole).when(k % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), whole, F.lit("\n```"))).otherwise("no object")
    own = views.table(spark, sf_dir, "part").select(k.alias("key"), text.json_object(raw, "name string, size string").alias("o"))
    return own.select("key", "o.name", "o.size")


@query("""SELECT p_partkey AS key, round((p_size / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 2, 4) AS mean_confidence, CAST(-p_size AS DOUBLE) AS mean_logprob, substr(p_name, 1, 80) AS capped FROM part""")
def confidence_means(spark, sf_dir):
    sure = F.create_map(F.lit("a"), F.col("p_size") / 100.0, F.lit("b"), F.lit(0.5), F.lit("c"), F.lit(None).cast("double"))
    token = lambda t, p: F.struct(F.lit(t).alias("token"), p.cast("double").alias("logprob"))
    tokens = F.array(token("{", F.lit(-99.0)), token("12", -F.col("p_size") - 1), token('": "', F.lit(-50.0)), token("x", -F.col("p_size") + 1))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.mean_of_map(sure).alias("mean_confidence"), text.mean_logprob(tokens).alias("mean_logprob"), text.capped("p_name", "reason").alias("capped"))


@query("""SELECT p_partkey AS key, '[' || lower(p_type) || '] name=' || p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ', size=' || CAST(p_size AS VARCHAR) END AS line FROM part""")
def example_lines(spark, sf_dir):
    size = F.when(F.col("p_size") % 3 == 0, pick(F.col("p_partkey"), "", "nan", "None", None)).otherwise(F.col("p_size").cast("string"))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.example_line(F.lower("p_type"), {"name": F.col("p_name"), "size": size}).alias("line"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, v, lead(v) OVER (ORDER BY vec_id) AS w FROM e)
SELECT vec_id, round(list_inner_product(v, w), 6) AS product, round(list_cosine_similarity(v, w), 6) AS cosine, round(v[2] / sqrt(list_inner_product(v, v)), 6) AS second FROM p WHERE w IS NOT NULL""")
def vector_products(spark, sf_dir):
    own = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    other = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    six = lambda c, n: F.round(c, 6).alias(n)
    return own.join(other, "vec_id").select("vec_id", six(similarity.dot("v", "w"), "product"), six(retrieve.cosine(F.col("v"), F.col("w")), "cosine"), six(F.get(similarity.unit("v"), F.lit(1)), "second"))


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS n, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, n) AS r FROM p) SELECT query_id, 'Similar examples:' || chr(10) || string_agg('e' || CAST(n AS VARCHAR), chr(10) ORDER BY r) AS prompt FROM r WHERE r <= 2 GROUP BY 1""")
def few_shot_blocks(spark, sf_dir):
    index = views.table(spark, sf_dir, "embeddings")
    near = retrieve.top_neighbours(index.filter("vec_id % 20 = 0"), index, 2)
    return retrieve.few_shot_block(near, index.select(F.col("vec_id").alias("id"), F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("line")))


# --- filters, joins, sets -------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def inner_join(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(o, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS confidence FROM lineitem WHERE l_discount * 10 >= 0.3")
def confident_tokens(spark, sf_dir):
    own = views.table(spark, sf_dir, "lineitem").withColumn("confidence", F.col("l_discount") * 10)
    return layout.confident_tokens(own).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("confidence"))


@query("""WITH p AS (SELECT doc_id, string_split(text, ' ') AS a, string_split(text, chr(10)) AS b FROM documents), l AS (SELECT doc_id, least(len(a), len(b)) AS n, a, b FROM p),
u AS (SELECT doc_id, a, b, unnest(range(n)) AS position FROM l) SELECT doc_id, CAST(position AS INTEGER) AS position, a[position + 1] AS predicted, b[position + 1] AS truth FROM u""")
def positional_zip(spark, sf_dir):
    own = views.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("a"), F.split("text", "\n").alias("b"))
    return stats.zipped(own, "a", "b", "doc_id", names=("predicted", "truth"))


@query("""SELECT p_partkey AS key, array_to_string(list_filter(['ECONOMY', 'MEDIUM', 'PROMO', 'SMALL'], lambda x: x <> p_type AND NOT (p_size > 25 AND x = 'PROMO')), ',') AS left_out FROM part""")
def set_difference(spark, sf_dir):
    own = F.when(F.col("p_size") > 25, F.array("p_type", F.lit("PROMO"))).otherwise(F.array("p_type"))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.array_join(stats.left_out(own, ["ECONOMY", "MEDIUM", "PROMO", "SMALL"]), ",").alias("left_out"))


_STATEMENTS = ("select 1", "Delete from t; drop table t", "SELECT replace(a, 'x', '') FROM updates", "create table call as merge")


@query(f"""SELECT o_orderkey AS id, {chosen('o_orderkey', '', 'DELETE,DROP', 'REPLACE', 'CALL,CREATE,MERGE')} AS forbidden FROM orders""")
def forbidden_words(spark, sf_dir):
    words = stats.forbidden_words(pick(F.col("o_orderkey"), *_STATEMENTS), list(analytics.FORBIDDEN))
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(words, ",").alias("forbidden"))


@query("""WITH r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS r FROM part) SELECT p_type, p_partkey FROM r WHERE r <= 7""")
def limit_per_commodity(spark, sf_dir):
    return stats.limit_per_group(views.table(spark, sf_dir, "part"), "p_type", ["p_size", "p_partkey"], 7).select("p_type", "p_partkey")


@query("""SELECT commodity, n, required, first, third FROM (VALUES ('elektrina_nn', 14, 8, 'amount_ex_vat', 'consumption_point_code'), ('elektrina_vn', 26, 6, 'consumption_point_code', 'period_from'), ('plyn_mo', 25, 13, 'amount_ex_vat', 'combustion_heat'),
 ('plyn_vo', 25, 14, 'amount_ex_vat', 'combustion_heat'), ('teplo', 17, 12, 'amount_ex_vat', 'consumption_gj'), ('voda', 15, 10, 'amount_ex_vat', 'consumption_point_code')) AS t(commodity, n, required, first, third)""")
def required_fields_first(spark, sf_dir):
    own = fields.required_first(fields.field_registry(spark))
    rank = F.row_number().over(Window.partitionBy("commodity").orderBy(F.desc("is_required"), "field_name"))
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("field_name")))
    return own.withColumn("r", rank).groupBy("commodity").agg(F.count("*").cast("int").alias("n"), F.sum(F.when(F.col("is_required"), 1).otherwise(0)).cast("int").alias("required"), at(1).alias("first"), at(3).alias("third"))


@query("""SELECT commodity, CAST(n AS INTEGER) AS n, mandatory FROM (VALUES ('elektrina_nn', 14, 7), ('elektrina_vn', 26, 6), ('plyn_mo', 25, 8), ('plyn_vo', 25, 8), ('teplo', 17, 7), ('voda', 15, 7)) AS t(commodity, n, mandatory)""")
def commodity_schemas(spark, sf_dir):
    """F33 and the schema factory: properties of each commodity's JSON schema, all of them in its Spark type too."""
    rows = []
    for c in fields.COMMODITIES:
        schema, kind = fields.json_schema(c), fields.extraction_struct(c)
        names = [n for n in schema["properties"] if n != "_confidence"]
        own = spark.createDataFrame([], f"x {kind}").schema["x"].dataType.names
        rows.append((c, len(names) if own == [*names, "_confidence"] and schema["required"] == own else -1, len(fields.mandatory_fields(c))))
    return spark.createDataFrame(rows, "commodity string, n int, mandatory int")


@query("""SELECT o_orderkey AS id, 'FV-' || CAST(o_orderkey AS VARCHAR) AS invoice_number, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS issue_date, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 900 AS VARCHAR) || '.50' ELSE '' END AS amount_ex_vat, CAST(o_orderkey % 900 AS VARCHAR) || '.00' AS amount_inc_vat, '' AS due_date FROM orders""")
def truth_records(spark, sf_dir):
    """Amounts come under their alias, one of them under both names; other registered fields are missing."""
    k = F.col("o_orderkey")
    truth = views.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit(" FV-"), k.cast("string")).alias("invoice_number"), F.when(k % 3 != 0, F.date_format("o_orderdate", "d.M.yyyy")).alias("issue_date"),
        F.when(k % 4 == 0, F.concat((k % 900).cast("string"), F.lit(",5"))).alias("total_amount_ex_vat"), (k % 900).cast("string").alias("amount_inc_vat"), F.lit("7").alias("total_amount_inc_vat"),
    )
    return fields.truth_record(truth, "voda", "id").select("id", "invoice_number", "issue_date", "amount_ex_vat", "amount_inc_vat", "due_date")


@query(f"""WITH {I} SELECT id, (CASE WHEN id % 29 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(amount_inc_vat, 0) <> 0 THEN 1 ELSE 0 END) + (CASE WHEN id % 10 <> 0 THEN 1 ELSE 0 END) + CASE commodity WHEN 'plyn_mo' THEN 3 WHEN 'plyn_vo' THEN 3 WHEN 'voda' THEN 2 ELSE 0 END AS n_fields FROM invoices""")
def extracted_field_counts(spark, sf_dir):
    k = F.col("id")
    details = F.array(F.create_map(F.lit("consumption_m3"), F.lit("5"), F.lit("consumption_mwh"), F.lit("0")), F.create_map(F.lit("consumption_m3"), F.lit("7"), F.lit("consumption_mwh"), F.lit("1,5")))
    own = views.invoices(spark, sf_dir).select("id", "commodity", F.when(k % 29 != 0, F.col("invoice_number")).otherwise("UNKNOWN").alias("invoice_number"), F.col("amount_inc_vat").alias("total_amount_inc_vat"), (k % 10).cast("string").alias("ean_code"), details.alias("details"))
    return own.select("id", store.extracted_fields(own).alias("n_fields"))


@query("""SELECT p_partkey AS key, round(((CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)) / CAST(3 AS DOUBLE), 6) AS null_share FROM part""")
def null_shares(spark, sf_dir):
    own = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 1, F.col("p_name")).otherwise("").alias("a"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("b"), F.col("p_brand").alias("c"))
    return own.select("key", F.round(store.null_share(["a", "b", "c"]), 6).alias("null_share"))


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("""SELECT p_type, round(avg(p_size), 4) AS p_size, round(avg(p_retailprice), 4) AS p_retailprice, count(*) AS n, min(p_brand) AS p_brand FROM part GROUP BY 1""")
def group_means(spark, sf_dir):
    return stats.group_means(views.table(spark, sf_dir, "part"), "p_type", means=["p_size", "p_retailprice"], firsts=["p_brand"])


_PIVOT = " UNION ALL ".join(
    f"SELECT '{how}' AS how, event_type, " + ", ".join(f"round(CAST(coalesce({sql.format(k)}, 0) AS DOUBLE), 6) AS {c}" for k, c in enumerate("abc")) + " FROM events GROUP BY 2"
    for how, sql in (("sum", "sum(value) FILTER (WHERE user_id % 3 = {})"), ("mean", "avg(value) FILTER (WHERE user_id % 3 = {})"), ("std", "stddev_samp(value) FILTER (WHERE user_id % 3 = {})"), ("size", "count(*) FILTER (WHERE user_id % 3 = {})"))
)


@query(_PIVOT)
def pivot_measures(spark, sf_dir):
    own = views.table(spark, sf_dir, "events").withColumn("third", pick(F.col("user_id"), "a", "b", "c"))
    parts = [stats.pivoted(own, "event_type", "third", ["a", "b", "c"], "value", how).select(F.lit(how).alias("how"), "event_type", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in "abc"]) for how in ("sum", "mean", "std", "size")]
    return stats.union_by_name(parts)


@query("""SELECT 0 AS k, round(quantile_cont(value, 0.01), 9) AS q FROM events UNION ALL SELECT 1, round(quantile_cont(value, 0.5), 9) FROM events UNION ALL SELECT 2, round(quantile_cont(value, 0.99), 9) FROM events""")
def exact_quantiles(spark, sf_dir):
    found = stats.quantiles(views.table(spark, sf_dir, "events"), "value", [0.01, 0.5, 0.99])
    return spark.createDataFrame([(k, round(q, 9)) for k, q in enumerate(found)], "k int, q double")


@query(f"""WITH {P}, s AS (SELECT field_name, CASE WHEN coalesce(a, '') = '' THEN 'no_gt' WHEN coalesce(b, '') = a THEN 'tp' WHEN coalesce(b, '') <> '' THEN 'fp' ELSE 'fn' END AS status FROM norm)
SELECT field_name, CAST(sum(CASE WHEN status = 'tp' THEN 1 ELSE 0 END) AS BIGINT) AS tp, count(*) AS present, round(CAST(sum(CASE WHEN status = 'tp' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 4) AS accuracy FROM s WHERE status <> 'no_gt' GROUP BY 1""")
def field_accuracy(spark, sf_dir):
    """From one JSON map of statuses per file."""
    own = views.predictions(spark, sf_dir).withColumn("status", evaluate.field_status(F.lower(F.trim("expected")), F.lower(F.trim("extracted"))))
    maps = own.groupBy("key").agg(F.to_json(F.map_from_arrays(F.collect_list("field_name"), F.collect_list(F.struct("status")))).alias("per_field_json"))
    return evaluate.field_accuracy(maps)


@query(f"""WITH {views.rated('issue_date')}, c AS (SELECT amount_inc_vat AS raw, round(amount_ex_vat * (1 + vat_rate / 100), 2) AS computed, CASE WHEN id % 3 <> 0 THEN floor(amount_ex_vat) + floor(amount_ex_vat / 5) END AS truth FROM rated),
d AS (SELECT raw, truth, CASE WHEN computed IS NOT NULL AND (raw IS NULL OR abs(raw - computed) > 1) THEN computed ELSE raw END AS fixed FROM c)
SELECT count(truth) AS present, CAST(sum(CASE WHEN raw IS DISTINCT FROM fixed THEN 1 ELSE 0 END) AS BIGINT) AS corrected, round(CAST(sum(CASE WHEN abs(raw - truth) < 0.005 THEN 1 ELSE 0 END) AS DOUBLE) / count(truth), 4) AS accuracy_before,
 round(CAST(sum(CASE WHEN abs(fixed - truth) < 0.005 THEN 1 ELSE 0 END) AS DOUBLE) / count(truth), 4) AS accuracy_after FROM d""")
def vat_correction_effect(spark, sf_dir):
    rows = vat.correct_invoices(views.invoices(spark, sf_dir), vat.vat_bands(spark))
    truth = F.when(F.col("id") % 3 != 0, F.floor("amount_ex_vat") + F.floor(F.col("amount_ex_vat") / 5))
    return evaluate.correction_effect(rows.withColumn("truth", truth.cast("double")), "truth", "extracted_value", "amount_inc_vat")


@query("SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN '/' || p_type ELSE '' END AS strategy_key, p_brand AS strategy FROM part")
def strategy_keys(spark, sf_dir):
    model = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    key = evaluate.strategy_key(F.col("p_brand"), model)
    return views.table(spark, sf_dir, "part").select(key.alias("strategy_key"), evaluate.strategy_key(F.col("p_brand"), model, with_model=False).alias("strategy")).distinct()


@query(f"""WITH {P}, s AS (SELECT strategy, confidence, CASE WHEN is_correct THEN 1.0 ELSE 0.0 END AS ok, least(CAST(floor(confidence / (1.0 / CAST(10 AS DOUBLE))) AS INTEGER), 9) AS bin FROM flags),
b AS (SELECT strategy, count(*) AS n, avg(confidence) AS c, avg(ok) AS a FROM s GROUP BY strategy, bin), t AS (SELECT strategy, abs(c - a) AS gap, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY strategy) AS share FROM b)
SELECT strategy, round(sum(share * gap), 6) AS ece, round(max(gap), 6) AS mce FROM t GROUP BY 1""")
def calibration_errors(spark, sf_dir):
    own = _flags(spark, sf_dir).withColumn("ok", F.when(F.col("is_correct"), 1.0).otherwise(0.0))
    return evaluate.calibration(evaluate.calibration_bins(own, "confidence", "ok", "strategy"), "strategy").select("strategy", F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query(f"""WITH {P}, s AS (SELECT strategy, CASE WHEN coalesce(a, '') = '' THEN 'no_gt' WHEN coalesce(b, '') = a THEN 'tp' WHEN coalesce(b, '') <> '' THEN 'fp' WHEN key % 2 = 0 THEN 'tp' ELSE 'fn' END AS status FROM norm WHERE true) SELECT strategy, status, count(*) AS n FROM s GROUP BY 1, 2""")
def rescored_statuses(spark, sf_dir):
    """Truth of every second part is a written zero where the value is missing."""
    own = views.predictions(spark, sf_dir)
    status = evaluate.field_status(F.lower(F.trim("expected")), F.lower(F.trim("extracted")))
    zero = F.when(F.col("key") % 2 == 0, "0.0").otherwise("5")
    return own.select("strategy", evaluate.rescored(status, zero, F.col("extracted")).alias("status")).groupBy("strategy", "status").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT doc_id, text, n_chars FROM documents), c AS (SELECT doc_id, count(DISTINCT c) AS codepoint_diversity FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM p) WHERE c <> '' GROUP BY 1)
SELECT p.doc_id, CAST(2 * length(text) AS BIGINT) AS total_chars, CAST(2 AS BIGINT) AS total_pages, CAST(CASE WHEN length(text) >= 50 THEN 2 ELSE 0 END AS BIGINT) AS pages_with_text, coalesce(codepoint_diversity, 0) AS codepoint_diversity, CAST(2 AS BIGINT) AS font_count,
 round(CAST(p.doc_id % 5 AS DOUBLE) / 10, 6) AS image_area_ratio FROM p LEFT JOIN c ON c.doc_id = p.doc_id""")
def page_metrics(spark, sf_dir):
    """Two pages of the same text each, one past the limit of pages."""
    fonts = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    pages = views.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(19), F.lit(20))).alias("page"), "text", fonts.alias("fonts"), (F.col("doc_id") % 5).cast("double").alias("image_area"), F.lit(10.0).alias("page_area"))
    return classify.document_metrics(pages).select("doc_id", "total_chars", "total_pages", "pages_with_text", "codepoint_diversity", "font_count", F.round("image_area_ratio", 6).alias("image_area_ratio"))


@query("""WITH e AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, round(list_reduce(v, lambda s, x: s * CAST(0.9 AS DOUBLE) + x * CAST(0.1 AS DOUBLE)), 6) AS average FROM e""")
def moving_averages(spark, sf_dir):
    own = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("e"))
    return own.select("user_id", F.round(classify.moving_average(F.transform("e", lambda x: x["value"])), 6).alias("average"))


@query("""SELECT 'bands' AS name, commodity, true AS contiguous FROM (VALUES ('elektrina_nn'), ('elektrina_vn'), ('plyn_mo'), ('plyn_vo'), ('teplo'), ('voda')) AS t(commodity)""")
def contiguous_bands(spark, sf_dir):
    return vat.contiguous(vat.vat_bands(spark)).select(F.lit("bands").alias("name"), "commodity", "contiguous")


# --- corrections and details ----------------------------------------------------------------------------------------


def _detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    first = F.create_map(F.lit("consumption_m3"), (k % 90).cast("string"), F.lit("consumption_mwh"), (k % 7).cast("string"), F.lit("supply_consumption"), (k % 4).cast("string"), F.lit("consumption_gj"), F.lit("5"))
    return views.invoices(spark, sf_dir).withColumn("details", F.array(first, first))


_PAIRS = f"""{I}, p AS (SELECT c.id AS cid, o.id AS oid, c.invoice_number, c.commodity, o.invoice_number AS onum, c.amount_inc_vat AS ci, o.amount_inc_vat AS oi FROM invoices c LEFT JOIN invoices o ON c.original_number = o.invoice_number AND NOT o.is_correction WHERE c.is_correction)"""


@query(f"""WITH {_PAIRS}, m AS (SELECT invoice_number, commodity, oid % 90 AS a, cid % 90 AS b, 'consumption_m3' AS field_name FROM p WHERE oid IS NOT NULL AND commodity IN ('plyn_mo', 'plyn_vo', 'voda') UNION ALL SELECT invoice_number, commodity, oid % 7, cid % 7, 'consumption_mwh' FROM p WHERE oid IS NOT NULL AND commodity IN ('plyn_mo', 'plyn_vo')
 UNION ALL SELECT invoice_number, commodity, oid % 4, cid % 4, 'supply_consumption' FROM p WHERE oid IS NOT NULL AND commodity = 'elektrina_vn' UNION ALL SELECT invoice_number, commodity, 5, 5, 'consumption_gj' FROM p WHERE oid IS NOT NULL AND commodity = 'teplo')
SELECT invoice_number, field_name, CAST(a AS DOUBLE) AS original_value, CAST(b AS DOUBLE) AS corrected_value, CAST(b - a AS DOUBLE) AS delta, CASE WHEN a <> 0 THEN round(CAST(b - a AS DOUBLE) / a * 100, 2) END AS delta_percent FROM m WHERE a <> 0 OR b <> 0""")
def detail_deltas(spark, sf_dir):
    return analysis.detail_deltas(analysis.correction_pairs(_detailed(spark, sf_dir)))


@query(f"""WITH {_PAIRS}, d AS (SELECT *, CASE WHEN oi IS NULL THEN ci ELSE ci - oi END AS t FROM p) SELECT cid AS id, onum AS original_invoice_number, oid AS original_invoice_id, CASE WHEN onum IS NOT NULL THEN t END AS total_delta,
CASE WHEN onum IS NULL THEN NULL WHEN t < 0 THEN 'dobropis' WHEN t > 0 THEN 'vrubopis' WHEN t = 0 THEN 'neutrální' END AS correction_type FROM d""")
def linked_corrections(spark, sf_dir):
    own = analysis.linked_corrections(analysis.correction_pairs(views.invoices(spark, sf_dir)))
    return own.select("id", "correction_info.original_invoice_number", "correction_info.original_invoice_id", "correction_info.total_delta", "correction_info.correction_type")


@query(f"""WITH {_PAIRS}, d AS (SELECT *, CASE WHEN oi IS NULL THEN ci ELSE ci - oi END AS t FROM p),
k AS (SELECT *, CASE WHEN onum IS NULL THEN NULL WHEN t < 0 THEN 'DOBROPIS (kredit)' WHEN t > 0 THEN 'VRUBOPIS (debet)' WHEN t = 0 THEN 'NEUTRÁLNÍ OPRAVA' END AS kind, round(coalesce(ci, 0) - coalesce(oi, 0), 2) AS dd FROM d),
l AS (SELECT *, CASE WHEN onum IS NOT NULL AND (ci IS NOT NULL OR oi IS NOT NULL) THEN chr(10) || 'Změny jednotlivých položek:' || chr(10) || repeat('-', 40) || chr(10) || '  amount_inc_vat:' || chr(10) || '    Původně: ' || CASE WHEN coalesce(oi, 0) <> 0 THEN format('{{:,.2f}}', oi) ELSE 'N/A' END
 || chr(10) || '    Nově: ' || CASE WHEN coalesce(ci, 0) <> 0 THEN format('{{:,.2f}}', ci) ELSE 'N/A' END || ' (' || CASE WHEN dd >= 0 THEN '+' ELSE '' END || format('{{:,.2f}}', dd) || CASE WHEN coalesce(oi, 0) <> 0 THEN ', ' || CASE WHEN dd >= 0 THEN '+' ELSE '' END || 'P%' ELSE '' END || ')' END AS items FROM k)
SELECT invoice_number, concat_ws(chr(10), repeat('=', 60), 'ANALÝZA OPRAVNÉ FAKTURY', repeat('=', 60), 'Původní faktura: ' || onum, 'Typ opravy: ' || kind, 'Celková změna: ' || CASE WHEN onum IS NOT NULL THEN CASE WHEN t >= 0 THEN '+' ELSE '' END || format('{{:,.2f}}', t) || ' Kč' END, items, repeat('=', 60)) AS report FROM l""")
def correction_reports(spark, sf_dir):
    """Percentages are masked: the two engines write doubles differently."""
    pairs = analysis.correction_pairs(views.invoices(spark, sf_dir))
    out = analysis.correction_report(analysis.linked_corrections(pairs), analysis.correction_deltas(pairs, ("amount_inc_vat",)))
    return out.withColumn("report", F.regexp_replace("report", r", (\+?)-?[0-9.E]+%", ", $1P%"))


@query(f"""WITH {I}, y AS (SELECT *, unnest(generate_series(CAST(year(period_from) AS BIGINT), CAST(year(period_to) AS BIGINT))) AS y FROM invoices WHERE year(period_to) > year(period_from) AND commodity = 'plyn_mo'),
s AS (SELECT *, date_diff('day', greatest(period_from, make_date(y, 1, 1)), least(period_to, make_date(y, 12, 31))) + 1 AS days, date_diff('day', period_from, period_to) + 1 AS total FROM y), f AS (SELECT id, y, round(CAST(days AS DOUBLE) / total, 4) AS f FROM s)
SELECT id, array_to_string(list(CAST(CAST(round((id % 900 + 100) * 100 * f * 100) AS BIGINT) AS VARCHAR) || '/' || CAST(id % 9 AS VARCHAR) ORDER BY y), ',') AS details FROM f GROUP BY 1""")
def scaled_details(spark, sf_dir):
    """A measure that is scaled and one that is not, of all years of an invoice in order."""
    own = views.invoices(spark, sf_dir).filter("commodity = 'plyn_mo'").withColumn("details", F.array(F.struct((F.col("id") % 900 * 100 + 10_000).cast("double").alias("consumption_m3"), (F.col("id") % 9).cast("double").alias("unit_price_commodity"))))
    split = analysis.year_split(own)
    split = split.withColumn("details", analysis.scale_details(F.col("details"), F.col("fraction"), "plyn_mo", ["consumption_m3", "unit_price_commodity"]))
    tenth = F.transform("details", lambda d: F.concat(F.round(d["consumption_m3"] * 100).cast("bigint").cast("string"), F.lit("/"), d["unit_price_commodity"].cast("bigint").cast("string")))
    return analysis.replaced_details(split, "id", "details").select("id", F.array_join(tenth, ",").alias("details"))


@query(f"""WITH {I}, own AS (SELECT id, invoice_number, lower(commodity) AS commodity FROM invoices), fresh AS (SELECT * FROM own WHERE id % 5 <> 0)
SELECT 'invoices' AS "table", count(*) AS n FROM fresh UNION ALL SELECT CASE commodity WHEN 'elektrina_nn' THEN 'electricity_nn_details' WHEN 'elektrina_vn' THEN 'electricity_vn_details' WHEN 'plyn_mo' THEN 'gas_mo_details' WHEN 'plyn_vo' THEN 'gas_vo_details' WHEN 'voda' THEN 'water_details' ELSE 'heat_details' END, 2 * count(*) FROM fresh GROUP BY 1""")
def save_plan(spark, sf_dir):
    """Rows to append to each of the seven tables; every fifth invoice is stored already."""
    k = F.col("id")
    details = F.array(F.struct(k.alias("value")), F.struct((-k).alias("value")))
    own = views.invoices(spark, sf_dir).select("id", "invoice_number", F.upper("commodity").alias("commodity"), F.col("customer_tax_id").alias("supplier_cin"), F.lit(None).cast("string").alias("customer_cin"), F.lit("CZ-1").alias("supply_point_code"), details.alias("details"))
    stored = own.filter("id % 5 = 0").withColumns({"commodity": F.lower("commodity"), "supplier_cin": text.clean_tax_id("supplier_cin")})
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in store.save_plan(own, stored).items()]
    return stats.union_by_name(parts)


# --- extraction -----------------------------------------------------------------------------------------------------

_DETAIL_LINES = (
    ("elektřina, distribuční tarif: D25d\nSpotřeba NT: 1 200,5 kWh\nJistič: 25 A", "consumption_low_tariff=1200.5,distribution_tariff=D25d,circuit_breaker=25.0"),
    ("vysoké napětí, rezervovaná kapacita\nÚčiník: 0,95\nČtvrthodinové maximum: 12,5 kW", "power_factor=0.95,quarter_hour_max=12.5"),
    ("zemní plyn\nOdběr: 900 m3\nSpalné teplo: 10,5 MJ/m3", "consumption_m3=900.0,combustion_heat=10.5"),
    ("plyn velkoodběr, velkoodběr\nOdběr: 77 MWh", "consumption_mwh=77.0"),
    ("tepelná energie\nSpotřeba: 42,5 GJ\nVytápěná plocha: 80 m2", "consumption_gj=42.5,heated_area=80.0"),
    ("Vodné: 45,5 Kč\nStočné: 41 Kč\npitná voda", "water_rate=45.5,sewage_rate=41.0"),
    ("zemní plyn bez údajů", None),
)
_KINDS = ("elektrina_nn", "elektrina_vn", "plyn_MO", "plyn_MO", "teplo", "voda", "plyn_MO")


@query("SELECT o_orderkey AS id, " + chosen("o_orderkey", *_KINDS) + " AS commodity, " + chosen("o_orderkey", *[d for _, d in _DETAIL_LINES]) + " AS details FROM orders")
def extracted_details(spark, sf_dir):
    """The commodity's own fields, in their order; none at all where no field is found."""
    texts = views.table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism, "o_orderkey").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), *[t for t, _ in _DETAIL_LINES]).alias("text"))
    out = extract.extract_invoices(texts, "2025-06-30")
    listed = F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("id", "commodity", listed.alias("details"))


@query(f"""WITH {I} SELECT id, (CASE WHEN id % 29 <> 0 THEN 2 ELSE 0 END + CASE WHEN id % 7 <> 0 THEN 2 ELSE 0 END + 2 + CASE WHEN id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(amount_inc_vat, 0) <> 0 THEN 2 ELSE 0 END + 1) / CAST(10 AS DOUBLE) AS confidence FROM invoices""")
def model_confidences(spark, sf_dir):
    k = F.col("id")
    sure = rules.model_confidence(F.when(k % 29 != 0, F.col("invoice_number")).otherwise("UNKNOWN"), F.when(k % 7 != 0, "859").otherwise(""), F.col("period_from"), F.col("period_to"), F.when(k % 3 != 0, F.col("issue_date")), F.col("amount_inc_vat"), F.col("customer_tax_id"))
    return views.invoices(spark, sf_dir).select("id", sure.alias("confidence"))


@query(f"""WITH {I}, w AS (SELECT id, concat_ws(',', CASE WHEN id % 29 = 0 THEN 'missing_number' END, CASE WHEN id % 7 = 0 THEN 'no_supply_point' END, CASE WHEN due_date < issue_date THEN 'due_before_issue' END, CASE WHEN amount_inc_vat < 0 AND NOT is_correction THEN 'negative_amount' END,
 CASE WHEN amount_inc_vat > 10000000 THEN 'high_amount' END) AS regex, concat_ws(',', CASE WHEN year(period_from) <> year(period_to) THEN 'cross_year' END, CASE WHEN is_correction AND coalesce(original_number, '') = '' THEN 'correction_without_reference' END) AS more FROM invoices)
SELECT id, regex, concat_ws(',', nullif(regex, ''), nullif(more, '')) AS model FROM w""")
def validation_warnings(spark, sf_dir):
    k = F.col("id")
    given = [F.when(k % 29 != 0, F.col("invoice_number")), F.when(k % 7 != 0, "859"), F.col("issue_date"), F.col("due_date"), F.col("amount_inc_vat"), F.col("is_correction")]
    model = rules.warnings(*given, cross_year=text.is_cross_year(F.col("period_from"), F.col("period_to")), original=F.col("original_number"))
    return views.invoices(spark, sf_dir).select("id", F.array_join(rules.warnings(*given), ",").alias("regex"), F.array_join(model, ",").alias("model"))


@query(f"""WITH {I} SELECT id, CASE WHEN id % 10 <> 0 THEN invoice_number ELSE 'UNKNOWN' END AS invoice_number, period_from, CASE WHEN id % 4 = 0 THEN period_from ELSE period_to END AS period_to, CASE WHEN id % 3 = 0 THEN 'CP' WHEN id % 2 = 0 THEN 'EAN' ELSE 'EIC' END AS code, 'CZK' AS currency FROM invoices""")
def nested_invoices(spark, sf_dir):
    """Reversed periods, single dates and missing codes made whole."""
    k = F.col("id")
    flat = views.invoices(spark, sf_dir).select(
        "id", F.when(k % 10 != 0, F.col("invoice_number")).otherwise("").alias("invoice_number"), "commodity", F.when(k % 4 == 0, F.col("period_from")).when(k % 4 == 1, F.col("period_to")).otherwise(F.col("period_from")).alias("period_from"),
        F.when(k % 4 == 1, F.col("period_from")).when(k % 4 != 0, F.col("period_to")).alias("period_to"), F.when(k % 3 == 0, "CP").alias("consumption_point_code"), F.when(k % 2 == 0, "EAN").alias("ean_code"), F.lit("EIC").alias("eic_code"),
        "issue_date", "due_date", F.col("amount_inc_vat").alias("total_amount_inc_vat"),
    )
    out = extract.nested_invoice(flat.withColumn("commodity", F.col("id").cast("string")))
    return out.select(F.col("commodity").cast("long").alias("id"), "invoice_number", "period.period_from", "period.period_to", "supply_point.code", "total_inc_vat.currency")


@query(f"""WITH {I} SELECT id, 'regex' AS strategy, CASE WHEN id % 10 <> 0 THEN invoice_number END AS invoice_number, CASE WHEN id % 9 <> 0 THEN strftime(period_to, '%Y-%m-%d') ELSE '2025-06-30' END AS period_to, printf('%.2f', abs(amount_inc_vat) + CAST(0.25 AS DOUBLE)) AS amount_inc_vat,
CASE WHEN id % 7 <> 0 THEN '859' || lpad(CAST(id AS VARCHAR), 15, '0') END AS point, CAST(0 AS DOUBLE) AS cost_usd FROM invoices""")
def regex_strategy(spark, sf_dir):
    """The rule-based strategy as an extractor, as it is used where no model can be reached."""
    own = cascade.RegexExtractor("2025-06-30")
    out = own(invoice_texts(spark, sf_dir).withColumn("commodity", F.lit(None).cast("string")))
    value = lambda n: F.try_element_at("fields", F.lit(n))
    return out.select("id", F.lit(own.name).alias("strategy"), *[value(n).alias(n) for n in ("invoice_number", "period_to", "amount_inc_vat")], value("consumption_point_code").alias("point"), "cost_usd")


@query(f"""WITH {_FIELDS} SELECT id, CASE WHEN num IS NULL THEN '1' ELSE num END AS invoice_number, printf('%.2f', CAST(coalesce(ex, 1) AS DOUBLE)) AS amount_ex_vat, round((CAST(id % 61 AS DOUBLE) / 60 + 1) / 2, 4) AS mean_confidence FROM f""")
def extracted_documents(spark, sf_dir):
    """Cascade, normalisation by type, checks; both readers are stand-ins and the second fills what is missing."""

    def reader(docs):
        sure = F.create_map(F.lit("invoice_number"), F.col("sure"), F.lit("due_date"), F.lit(1.0))
        return docs.withColumns({"fields": F.transform_values("fields", lambda k, v: F.coalesce(v, F.lit("1"))), "confidences": sure, "api_error": F.lit(None).cast("string"), "cost_usd": F.lit(0.25), "latency_ms": F.lit(4000.0)})

    out = cascade.extract_documents(_fields(spark, sf_dir), reader, reader, key="id")
    value = lambda n: F.try_element_at("fields", F.lit(n))
    return out.select("id", value("invoice_number").alias("invoice_number"), value("amount_ex_vat").alias("amount_ex_vat"), F.round("mean_confidence", 4).alias("mean_confidence"))


@query("""WITH r AS (SELECT o_orderkey AS id, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS a, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 11 AS DOUBLE) / 10 END AS b FROM orders) SELECT id, CASE WHEN b IS NULL OR a >= 0.6 THEN 'primary' WHEN b > a THEN 'fallback' ELSE 'primary' END AS taken,
CASE WHEN b IS NULL OR a >= 0.6 OR b <= a THEN 'p' ELSE 'f' END AS payload FROM r""")
def iterative_choices(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    first = o.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("attempt"), ((F.col("o_orderkey") % 11) / 10.0).alias("confidence"), F.lit("p").alias("payload"))
    second = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("attempt"), ((F.col("o_custkey") % 11) / 10.0).alias("confidence"), F.lit("f").alias("payload"))
    return cascade.choose_iteratively(first.unionByName(second), "id")


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS position, l_returnflag || CAST(l_linenumber AS VARCHAR) AS strategy, l_discount AS confidence, CAST(l_quantity AS INTEGER) % 9 AS n_fields, l_partkey % 2 AS n_errors, l_quantity AS latency_ms, l_suppkey AS s, l_partkey AS p FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position, s, p, latency_ms) AS o FROM r),
a AS (SELECT doc_id, count(*) AS strategies, CAST(sum(CASE WHEN n_fields > 0 AND n_errors = 0 THEN 1 ELSE 0 END) AS BIGINT) AS successes, sum(latency_ms) AS total_latency_ms FROM n GROUP BY 1),
c AS (SELECT doc_id, strategy, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, o) AS k FROM n WHERE confidence > 0) WHERE k = 1), f AS (SELECT doc_id, strategy, n_fields FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_fields DESC, o) AS k FROM n WHERE n_fields > 0) WHERE k = 1)
SELECT a.*, c.strategy AS best_by_confidence, c.confidence, f.strategy AS best_by_fields, f.n_fields FROM a LEFT JOIN c ON c.doc_id = a.doc_id LEFT JOIN f ON f.doc_id = a.doc_id""")
def strategy_benchmark(spark, sf_dir):
    line = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("strategy"), F.col("l_discount").alias("confidence"), (F.col("l_quantity").cast("int") % 9).alias("n_fields"),
        (F.col("l_partkey") % 2).alias("n_errors"), F.col("l_quantity").alias("latency_ms"), F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity").alias("position"),
    )
    return cascade.strategy_benchmark(line)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Similar examples:' || chr(10) || 'e' || chr(10) || chr(10) ELSE '' END || 'Commodity: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'voda' ELSE 'unknown' END || chr(10) || chr(10) || o_orderpriority AS prompt FROM orders""")
def prompt_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    shown = F.when(k % 2 == 0, F.lit("Similar examples:\ne"))
    return views.table(spark, sf_dir, "orders").select(k.alias("id"), cascade.prompt_text(F.when(k % 3 == 0, "voda"), F.col("o_orderpriority"), shown).alias("prompt"))


@query("""SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 3 <> 2 THEN s_name END AS invoice_number, CASE WHEN s_suppkey % 3 <> 2 THEN CAST(0.9 AS DOUBLE) END AS sure, round(CAST(10 * CAST(0.4 AS DOUBLE) + 5 * CAST(1.6 AS DOUBLE) AS DOUBLE) / 1000000, 9) AS cost_usd FROM supplier""")
def model_strategy(spark, sf_dir):
    """D42 with a stand-in for the model, whose answers need repair or are no JSON."""
    from collections.abc import Iterator

    import pyarrow as pa

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, prompts = (c.to_pylist() for c in b.columns)
            names = [p.rpartition("\n\n")[2] for p in prompts]
            forms = ['{"invoice_number": "%s", "_confidence": {"invoice_number": 0.9}}', 'Here: {"invoice_number": "%s", "_confidence": {"invoice_number": 0.9}} done', "cannot read %s"]
            out = [forms[k % 3] % n for k, n in zip(keys, names, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out), *[pa.array([v] * len(out), t) for v, t in ((-0.1, pa.float64()), (10, pa.int64()), (5, pa.int64()), (900.0, pa.float64()), (None, pa.string()))]],
                ["doc_id", "answer", "logprob", "prompt_tokens", "completion_tokens", "latency_ms", "api_error"],
            )

    docs = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit("voda").alias("commodity"), F.col("s_name").alias("text"))
    out = cascade.ModelExtractor("stand-in", "gpt-4.1-mini", ask, ("invoice_number",))(docs)
    return out.select("doc_id", F.try_element_at("fields", F.lit("invoice_number")).alias("invoice_number"), F.try_element_at("confidences", F.lit("invoice_number")).alias("sure"), F.round("cost_usd", 9).alias("cost_usd"))


@query("SELECT p_type AS commodity, count(*) AS documents, round(count(*) * CAST(0.02 AS DOUBLE) + count(*) * CAST(0.15 AS DOUBLE) * CAST(0.05 AS DOUBLE), 4) AS expected_usd FROM part GROUP BY 1")
def dry_run_costs(spark, sf_dir):
    return cascade.dry_run_cost(views.table(spark, sf_dir, "part").withColumnRenamed("p_type", "commodity"), 0.02, 0.15, 0.05)


@query("""SELECT doc_id, CAST(page AS INTEGER) AS page, 'scanned' AS kind, CAST(0.5 AS DOUBLE) AS confidence FROM documents, range(2) AS r(page)""")
def aggressive_pages(spark, sf_dir):
    own = views.table(spark, sf_dir, "documents").select("doc_id", F.lit(2).alias("pages"), *[F.lit("native_pdf").alias(c) for c in ("kind_v1", "kind_v2")], *[F.lit(0.9).alias(c) for c in ("confidence_v1", "confidence_v2")])
    return classify.vote_pages(own, "aggressive")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY 1, 2), s AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS t FROM n),
e AS (SELECT doc_id, -sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t)) AS e FROM s GROUP BY 1),
o AS (SELECT d.doc_id, length(text) AS n, coalesce(e, 0) AS e, len(regexp_extract_all(text, '  +')) + len(regexp_extract_all(text, chr(10) || chr(10) || chr(10) || '+')) AS odd FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN n > 0 THEN round(least(1.0, CAST(doc_id % 9 AS DOUBLE) / n * CAST(0.4 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), (CAST(4.5 AS DOUBLE) - e) / 2) * CAST(0.35 AS DOUBLE) + least(CAST(1 AS DOUBLE), odd / greatest(CAST(n AS DOUBLE) / 100, CAST(1 AS DOUBLE))) * CAST(0.25 AS DOUBLE)), 6) ELSE CAST(0 AS DOUBLE) END AS corruption FROM o""")
def text_corruption(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.round(classify.corruption(F.col("text"), F.col("doc_id") % 9), 6).alias("corruption"))


@query(f"""WITH {I}, t(commodity, lim) AS (VALUES ('elektrina_nn', 0.40), ('elektrina_vn', 0.85), ('plyn_mo', 0.60), ('plyn_vo', 0.55), ('teplo', 0.41), ('voda', 0.45)),
f AS (SELECT id, CAST(lim AS DOUBLE) AS lim, CAST((id % 5) * 10 AS DOUBLE) / (10 + (id % 5) * 10) AS share FROM invoices JOIN t USING (commodity))
SELECT id, CASE WHEN share > lim THEN 'high_null:' || printf('%.2f', share) || '>' || CAST(lim AS VARCHAR) WHEN id % 3 = 0 THEN 'low_optional_conf:note' ELSE 'ok' END AS reason FROM f""")
def escalation_shares(spark, sf_dir):
    """Too many empty fields, doubted optional ones. Ten fields are filled, none to forty more are empty."""
    needed = rules.required_of(F.col("commodity"))
    filled = F.array_union(F.array_union(needed, F.array(F.lit("note"), F.lit("consumption_high_tariff"))), F.transform(F.sequence(F.lit(1), F.lit(8) - F.size(needed)), lambda k: F.concat(F.lit("f"), k.cast("string"))))
    empty = F.when(F.col("id") % 5 > 0, F.transform(F.sequence(F.lit(1), (F.col("id") % 5 * 10).cast("int")), lambda k: F.concat(F.lit("e"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    names = F.concat(filled, empty)
    value = lambda n: F.when(n.startswith("e"), F.lit(None).cast("string")).when(n == "period_from", "2024-01-01").when(n == "period_to", "2024-12-31").when(n == "consumption_gj", "12").otherwise("x")
    sure = F.create_map(F.lit("note"), F.when(F.col("id") % 3 == 0, 0.4).otherwise(0.9))
    reason = rules.escalation_reason(F.map_from_entries(F.transform(names, lambda n: F.struct(n, value(n)))), F.col("commodity"), confidence=sure)
    return views.invoices(spark, sf_dir).select("id", reason.alias("reason"))


# --- layout ---------------------------------------------------------------------------------------------------------

_LINES = f"""{W}, s AS (SELECT *, t // 30 AS line, CASE WHEN l - lag(l + w) OVER (PARTITION BY doc_id, page, t // 30 ORDER BY l) > 50 THEN 1 ELSE 0 END AS j FROM words),
g AS (SELECT *, sum(j) OVER (PARTITION BY doc_id, page, line ORDER BY l) AS seg FROM s), segs AS (SELECT doc_id, page, line, seg, string_agg(text, ' ' ORDER BY l) AS segment FROM g GROUP BY 1, 2, 3, 4),
lined AS (SELECT doc_id, page, line, list(segment ORDER BY seg) AS segments FROM segs GROUP BY 1, 2, 3)"""


@query(f"""WITH {_LINES} SELECT doc_id, page, string_agg(CASE WHEN len(segments) >= 2 THEN '| ' || array_to_string(segments, ' | ') || ' |' ELSE segments[1] END, chr(10) ORDER BY line) AS encoded FROM lined GROUP BY 1, 2""")
def markdown_pages(spark, sf_dir):
    ship_package(spark)
    return layout.markdown(layout.column_lines(views.words(spark, sf_dir)))


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, page, segments, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) - 1 AS row, array_to_string(segments, ' ') AS text FROM lined),
k AS (SELECT *, substr(regexp_replace(trim(regexp_replace(trim(split_part(text, ':', 1)), '[^\\w\\sÀ-ÿ]', '', 'g')), '\\s+', '_', 'g'), 1, 30) AS clean, trim(substr(text, strpos(text, ':') + 1)) AS value FROM r),
e AS (SELECT doc_id, page, row, CASE WHEN len(segments) < 2 AND strpos(text, ':') > 0 AND clean <> '' AND value <> '' THEN lower(clean) ELSE 'r' || CAST(row AS VARCHAR) END AS key, CASE WHEN len(segments) >= 2 THEN CAST(to_json(segments) AS VARCHAR) WHEN strpos(text, ':') > 0 AND clean <> '' AND value <> '' THEN CAST(to_json(value) AS VARCHAR) ELSE CAST(to_json(text) AS VARCHAR) END AS value FROM k),
d AS (SELECT doc_id, page, key, min(row) AS row, arg_max(value, row) AS value FROM e GROUP BY 1, 2, 3) SELECT doc_id, page, '{{' || string_agg(CAST(to_json(key) AS VARCHAR) || ':' || value, ',' ORDER BY row) || '}}' AS encoded FROM d GROUP BY 1, 2""")
def json_light(spark, sf_dir):
    ship_package(spark)
    return layout.json_light(layout.column_lines(views.words(spark, sf_dir)))


_GRID = f"""{W}, c AS (SELECT *, (t + t + h) // 2 AS cy, CAST(floor(l + CAST(w AS DOUBLE) / 2) AS BIGINT) AS cx FROM words),
jumps AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY doc_id, page ORDER BY cy, cx, text) > 12 THEN 1 ELSE 0 END AS jr, CASE WHEN cx - lag(cx) OVER (PARTITION BY doc_id, page ORDER BY cx, cy, text) > 40 THEN 1 ELSE 0 END AS jc FROM c),
placed AS (SELECT *, sum(jr) OVER (PARTITION BY doc_id, page ORDER BY cy, cx, text ROWS UNBOUNDED PRECEDING) AS row, sum(jc) OVER (PARTITION BY doc_id, page ORDER BY cx, cy, text ROWS UNBOUNDED PRECEDING) AS col FROM jumps),
cells AS (SELECT doc_id, page, row, col, string_agg(text, ' ' ORDER BY l, t, text) AS text FROM placed GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_GRID}, rows AS (SELECT doc_id, page, row, '<tr>' || string_agg(CASE WHEN row = 0 THEN '<th>' || text || '</th>' ELSE '<td>' || text || '</td>' END, '' ORDER BY col) || '</tr>' AS html FROM cells GROUP BY 1, 2, 3)
SELECT doc_id, page, '<table>' || string_agg(html, '' ORDER BY row) || '</table>' AS html FROM rows GROUP BY 1, 2""")
def table_html(spark, sf_dir):
    return layout.table_html(layout.grid_cells(views.words(spark, sf_dir)))


@query(f"""WITH {W}, {_BOXES}, hit AS (SELECT doc_id, page, box, l, t, w, h, text FROM words JOIN boxes USING (doc_id, page) WHERE conf >= 30 AND {_CENTRE}), outside AS (SELECT doc_id, page FROM words WHERE conf >= 30 AND NOT EXISTS (SELECT 1 FROM boxes WHERE boxes.doc_id = words.doc_id AND boxes.page = words.page AND {_CENTRE}))
SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id, page, box FROM hit)) AS tables, (SELECT CAST(sum(length(text)) AS BIGINT) FROM hit) AS inside, (SELECT count(*) FROM (SELECT DISTINCT doc_id, page FROM outside)) AS pages""")
def separated_pages(spark, sf_dir):
    """D34/D35, the whole page path: tables of the tokens in boxes, regions of the others."""
    words = views.words(spark, sf_dir).withColumn("confidence", F.col("conf").cast("double") / 100)
    out = layout.separated(words, _boxes(words))
    tables = out["tables"].agg(F.count("*").alias("tables"))
    inside = out["cells"].agg(F.sum(F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("inside"))
    pages = out["regions"].select("doc_id", "page").distinct().agg(F.count("*").alias("pages"))
    return tables.join(inside).join(pages)  # one row each


_REGIONS = f"""{W}, c AS (SELECT *, l + w AS x2, t + h AS y2, (t + t + h) // 2 AS cy FROM words), j AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY doc_id, page ORDER BY cy, l, text) > 12 THEN 1 ELSE 0 END AS j FROM c),
g AS (SELECT *, sum(j) OVER (PARTITION BY doc_id, page ORDER BY cy, l, text ROWS UNBOUNDED PRECEDING) AS line FROM j), lines AS (SELECT doc_id, page, line, min(l) AS x1, min(t) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(text, ' ' ORDER BY l, text) AS text FROM g GROUP BY 1, 2, 3),
k AS (SELECT *, (y1 + y2) // 2 AS cy FROM lines), jj AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY doc_id, page ORDER BY cy, line) > 36 THEN 1 ELSE 0 END AS j FROM k), gg AS (SELECT *, sum(j) OVER (PARTITION BY doc_id, page ORDER BY cy, line ROWS UNBOUNDED PRECEDING) AS region FROM jj),
found AS (SELECT doc_id, page, region, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, trim(string_agg(text, chr(10) ORDER BY line)) AS content FROM gg GROUP BY 1, 2, 3),
kinds AS (SELECT *, CASE WHEN (y1 + y2) / CAST(2 AS DOUBLE) < 240 THEN 'header' WHEN (y1 + y2) / CAST(2 AS DOUBLE) > 2850 THEN 'footer' ELSE 'text' END AS kind FROM found)"""


@query(f"""WITH {_REGIONS} SELECT doc_id, page, CAST(region AS INTEGER) AS region, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2, content, kind FROM kinds""")
def page_regions(spark, sf_dir):
    return layout.regions(views.words(spark, sf_dir), 3000)


@query(f"""WITH {_REGIONS} SELECT doc_id, page, string_agg(CASE kind WHEN 'header' THEN '[HEADER]' || chr(10) || content WHEN 'footer' THEN '[FOOTER]' || chr(10) || content ELSE content END, chr(10) || chr(10) ORDER BY CASE WHEN (x1 + x2) // 2 < 700 * 0.45 THEN 0 ELSE 1 END, y1, x1) AS payload FROM kinds WHERE trim(content) <> '' GROUP BY 1, 2""")
def region_payloads(spark, sf_dir):
    return layout.payload(layout.regions(views.words(spark, sf_dir), 3000), 700)


def _blocks(spark, sf_dir):
    k = F.col("l_linenumber")
    box = F.array((k * 100).cast("string"), F.lit("10"), (k * 100 + 50).cast("string"), F.when(k % 5 == 4, "x").otherwise("90"))
    n = F.col("l_partkey")
    line = F.concat(F.lit("p"), n.cast("string"))
    own = views.table(spark, sf_dir, "lineitem").withColumn("position", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1))
    return own.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "position", F.when(k % 3 == 0, "Table").when(k % 3 == 1, "title").alias("type"), box.alias("bbox"),
        F.when(n % 2 == 0, F.concat(F.lit("<tr>"), line, F.lit("</tr>"))).otherwise("").alias("html"), F.when(n % 7 == 0, F.array(F.lit(" "))).otherwise(F.array(line, F.lit(""), F.lit("more"))).alias("lines"),
    )


_PARSED = """blocks AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS position, l_linenumber AS k, l_partkey AS n FROM lineitem),
parsed AS (SELECT doc_id, position, k, k * 100 AS x1, k * 100 + 50 AS x2, CASE k % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'title' ELSE 'text' END AS kind, CASE WHEN k % 3 = 0 THEN '<tr>p' || CAST(n AS VARCHAR) || '</tr>' ELSE 'p' || CAST(n AS VARCHAR) || chr(10) || 'more' END AS content FROM blocks
 WHERE k % 5 <> 4 AND NOT (k % 3 = 0 AND n % 2 = 1) AND NOT (k % 3 <> 0 AND n % 7 = 0))"""


@query(f"WITH {_PARSED} SELECT doc_id, CAST(position AS INTEGER) AS position, kind, content, CAST(x1 AS INTEGER) AS x1, CAST(x2 AS INTEGER) AS x2 FROM parsed")
def parsed_blocks(spark, sf_dir):
    return layout.parsed_blocks(_blocks(spark, sf_dir)).select("doc_id", "position", "kind", "content", "x1", "x2")


@query(f"""WITH {_PARSED}, g AS (SELECT *, max(x2) OVER (PARTITION BY doc_id) * CAST(0.4 AS DOUBLE) AS gap FROM parsed) SELECT doc_id, string_agg(CASE WHEN kind = 'table' THEN '<table>' || content || '</table>' ELSE content END, chr(10) || chr(10) ORDER BY floor((x1 + x2) // 2 / gap), position) AS payload FROM g GROUP BY 1""")
def block_payloads(spark, sf_dir):
    return layout.block_payload(layout.parsed_blocks(_blocks(spark, sf_dir))).select("doc_id", "payload")


@query("""WITH p AS (SELECT conv_id AS doc_id, turn AS page, text, CASE WHEN turn % 2 = 0 THEN CAST(length(text) % 100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS conf FROM conversations)
SELECT doc_id, string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page, text) AS text, round(coalesce(avg(CASE WHEN conf > 0 THEN conf END) / 100, 0), 9) AS confidence FROM p GROUP BY 1""")
def document_texts(spark, sf_dir):
    conf = F.when(F.col("turn") % 2 == 0, (F.length("text") % 100).cast("double")).otherwise(0.0)
    pages = views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", conf.alias("conf"))
    return layout.document_text(pages).withColumn("confidence", F.round("confidence", 9))


@query("""WITH a AS (SELECT o_custkey AS doc_id, median((o_orderkey % 41 - 20) / CAST(4 AS DOUBLE)) AS m FROM orders GROUP BY 1) SELECT doc_id, CASE WHEN abs(m) BETWEEN 0.3 AND 10 THEN m ELSE CAST(0 AS DOUBLE) END AS angle FROM a""")
def skew_angles(spark, sf_dir):
    own = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), ((F.col("o_orderkey") % 41 - 20) / 4.0).alias("angle"))
    return layout.median_angle(own).select("doc_id", "angle")


@query("""WITH e AS (SELECT event_type AS model, event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS truth, CASE WHEN (CASE WHEN value > 10 THEN user_id ELSE event_id END) % 2 = 0 THEN 1 ELSE 0 END AS predicted FROM events),
l AS (SELECT model, list({'n': CAST(0 AS DOUBLE), 'fn': CAST(predicted AS DOUBLE), 'fp': CAST(truth AS DOUBLE), 'lim': CAST(0 AS DOUBLE)} ORDER BY event_id) AS xs FROM e GROUP BY 1),
r AS (SELECT model, list_reduce(list_prepend({'n': CAST(0 AS DOUBLE), 'fn': CAST(0 AS DOUBLE), 'fp': CAST(0 AS DOUBLE), 'lim': CAST(0.75 AS DOUBLE)}, xs), lambda s, x: {'n': s.n + 1, 'fn': CASE WHEN x.fp = 1 THEN CAST(0.1 AS DOUBLE) * (1 - x.fn) + CAST(0.9 AS DOUBLE) * s.fn ELSE s.fn END, 'fp': CASE WHEN x.fp = 0 THEN CAST(0.1 AS DOUBLE) * x.fn + CAST(0.9 AS DOUBLE) * s.fp ELSE s.fp END,
 'lim': CASE WHEN s.n + 1 >= 100 AND (CASE WHEN x.fp = 1 THEN CAST(0.1 AS DOUBLE) * (1 - x.fn) + CAST(0.9 AS DOUBLE) * s.fn ELSE s.fn END) > 0.02 THEN greatest(CAST(0.5 AS DOUBLE), s.lim - CAST(0.05 AS DOUBLE)) ELSE s.lim END}) AS o FROM l)
SELECT model, CAST(o.n AS BIGINT) AS n, round(o.fn, 6) AS fn_rate, round(o.fp, 6) AS fp_rate, round(o.lim, 6) AS threshold FROM r""")
def fn_ema(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    kind = lambda n: F.when(F.col(n) % 2 == 0, "scanned").otherwise("native_pdf")
    own = e.select(F.col("event_type").alias("model"), "event_id", kind("event_id").alias("truth"), F.when(F.col("value") > 10, kind("user_id")).otherwise(kind("event_id")).alias("predicted"))
    return classify.feedback_averages(own, "model", "event_id").select("model", "n", *[F.round(c, 6).alias(c) for c in ("fn_rate", "fp_rate", "threshold")])
