"""Registered queries of the invoice operators, each with the SQL that states the same for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom import views
from ledgerloom.functions import similarity, text
from ledgerloom.operators import analysis, cascade, classify, evaluate, extract, layout, retrieve, rules, stats, store, vat
from ledgerloom.plans import analytics
from ledgerloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


T, I, P, W = views.TRANSACTIONS, views.INVOICES, views.PREDICTIONS, views.WORDS


@query(f"WITH {T} SELECT status, count(*) AS count, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM transactions GROUP BY status")
def error_summary(spark, sf_dir):
    return analytics.error_summary(views.transactions(spark, sf_dir))


@query(f"WITH {T} SELECT error_message, count(*) AS occurrences FROM transactions WHERE status = 'error' AND error_message IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def common_errors(spark, sf_dir):
    return analytics.common_errors(views.transactions(spark, sf_dir))


@query(f"""WITH {T} SELECT CAST(created_at AS DATE) AS date, count(*) AS total, CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM transactions GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def daily_processing_volume(spark, sf_dir):
    return analytics.daily_processing_volume(views.transactions(spark, sf_dir))


@query("""WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS field_name FROM documents)
SELECT field_name, count(*) AS correction_count FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def corrected_fields_top(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(F.split(F.lower("text"), " ", -1).alias("fields_corrected"))
    return analytics.frequently_corrected_fields(docs)


@query("""SELECT l_returnflag AS engine_name, count(*) AS sample_size, round(avg(l_discount), 3) AS avg_confidence, round(avg(l_quantity), 1) AS avg_duration_ms,
round(avg(l_tax), 4) AS avg_cost_usd, round(avg(l_discount) / nullif(avg(l_tax), 0), 2) AS accuracy_per_dollar FROM lineitem GROUP BY 1""")
def engine_comparison(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("engine_name"), F.col("l_discount").alias("confidence"), F.col("l_quantity").alias("duration_ms"), F.col("l_tax").alias("cost_usd"), F.lit(None).cast("string").alias("error_message")
    )
    return analytics.ocr_engine_comparison(rows)


@query("""SELECT l_returnflag AS strategy_name, l_linestatus AS model_name, count(*) AS sample_size, round(avg(l_discount), 3) AS avg_accuracy, round(avg(l_tax), 3) AS avg_confidence,
round(avg(l_quantity), 1) AS avg_duration_ms, round(avg(l_tax), 4) AS avg_cost_usd, round(avg(CAST(l_linenumber AS DOUBLE)), 0) AS avg_tokens FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2""")
def strategy_comparison(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("strategy_name"), F.col("l_linestatus").alias("model_name"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("accuracy"), F.col("l_tax").alias("confidence"),
        F.col("l_quantity").alias("duration_ms"), F.col("l_tax").alias("cost_usd"), F.col("l_linenumber").alias("token_count"), F.lit(None).cast("string").alias("error_message"),
    )
    return analytics.extraction_strategy_comparison(rows)


@query("""WITH page AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC LIMIT 20 OFFSET 20)
SELECT id, status, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_quantity > 45) AS has_extraction FROM page""")
def results_page(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("created_at"))
    results = views.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("transaction_id"))
    rows, _ = analytics.list_transactions(orders, results, status="F", page=2, size=20)
    return rows.select("id", "status", "has_extraction")


@query("SELECT count(*) AS total, CAST(ceil(count(*) / CAST(20 AS DOUBLE)) AS BIGINT) AS total_pages FROM orders WHERE o_orderstatus = 'F'")
def results_total(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return analytics.list_transactions(orders, status="F")[1]


@query("SELECT o_orderkey AS id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS has_extraction FROM orders")
def has_extraction_flag(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return store.with_flag(orders, views.table(spark, sf_dir, "lineitem").filter("l_quantity > 45"), "id", "l_orderkey", "has_extraction")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS r FROM lineitem)
SELECT o_orderkey AS id, l_linenumber, l_partkey FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND r = 1""")
def latest_extraction(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    children = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_shipdate", "l_linenumber").alias("at"))
    return store.latest_child(orders, children, "id", "l_orderkey", "at", "l_partkey").select("id", "l_linenumber", "l_partkey")


@query("SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(spark, sf_dir):
    rows = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return analytics.by_id(rows, "id", 7)


# --- scalar library -------------------------------------------------------------------------------------------------

_RAW_NUMBERS = """raw AS (SELECT o_orderkey AS id, o_orderkey % 9999 AS n, CASE o_orderkey % 8 WHEN 0 THEN CAST(o_orderkey % 9999 AS VARCHAR) || ',50' WHEN 1 THEN '1 ' || lpad(CAST(o_orderkey % 999 AS VARCHAR), 3, '0') || ',5'
 WHEN 2 THEN '-1.' || lpad(CAST(o_orderkey % 999 AS VARCHAR), 3, '0') WHEN 3 THEN CAST(o_orderkey % 9999 AS VARCHAR) || '.25' WHEN 4 THEN 'abc' WHEN 5 THEN '' WHEN 6 THEN CAST(o_orderkey % 99 AS VARCHAR) || ',' ELSE '1.2.3' END AS raw FROM orders)"""


def _raw_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    s, three = (lambda n: (k % n).cast("string")), F.lpad((k % 999).cast("string"), 3, "0")
    forms = [F.concat(s(9999), F.lit(",50")), F.concat(F.lit("1 "), three, F.lit(",5")), F.concat(F.lit("-1."), three), F.concat(s(9999), F.lit(".25")), F.lit("abc"), F.lit(""), F.concat(s(99), F.lit(",")), F.lit("1.2.3")]
    raw = F.coalesce(*[F.when(k % 8 == n, c) for n, c in enumerate(forms)])
    return views.table(spark, sf_dir, "orders").select(k.alias("id"), raw.alias("raw"))


@query(f"""WITH {_RAW_NUMBERS}, s AS (SELECT id, replace(raw, ' ', '') AS s FROM raw),
p AS (SELECT id, CASE WHEN contains(s, ',') THEN replace(replace(s, '.', ''), ',', '.') WHEN regexp_full_match(s, '-?[0-9]{{1,3}}(\\.[0-9]{{3}})+') THEN replace(s, '.', '') ELSE s END AS s FROM s)
SELECT id, CASE WHEN regexp_full_match(s, '-?[0-9]+\\.?[0-9]*') THEN TRY_CAST(s AS DOUBLE) END AS number FROM p""")
def clean_number(spark, sf_dir):
    return _raw_numbers(spark, sf_dir).select("id", text.clean_number("raw").alias("number"))


@query("""WITH d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders)
SELECT id, CASE WHEN k IN (4, 5) THEN NULL ELSE d END AS parsed FROM d""")
def parse_date(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    forms = [F.date_format(d, "d.M.yyyy"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "d. M. yy"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "'31.2.'yyyy"), F.lit("soon")]
    raw = F.coalesce(*[F.when(k % 6 == n, c) for n, c in enumerate(forms)])
    return views.table(spark, sf_dir, "orders").select(k.alias("id"), text.parse_date(raw).alias("parsed"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'CZ ' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN '123 456 789' WHEN 2 THEN 'none' ELSE CAST(o_custkey AS VARCHAR) || '-' END AS raw FROM orders),
d AS (SELECT id, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM r) SELECT id, CASE WHEN length(d) BETWEEN 1 AND 8 THEN lpad(d, 8, '0') END AS tax_id FROM d""")
def clean_tax_id(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("CZ "), c)).when(k % 4 == 1, F.lit("123 456 789")).when(k % 4 == 2, F.lit("none")).otherwise(F.concat(c, F.lit("-")))
    return views.table(spark, sf_dir, "orders").select(k.alias("id"), text.clean_tax_id(raw).alias("tax_id"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, CASE o_orderkey % 5 WHEN 0 THEN '859' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') WHEN 1 THEN '27ZG-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
 WHEN 2 THEN '--' WHEN 3 THEN 'om ' || CAST(o_orderkey AS VARCHAR) ELSE '27zg' || lpad(CAST(o_orderkey AS VARCHAR), 12, 'a') END AS raw FROM orders)
SELECT id, nullif(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g'), '') AS code, k = 0 AS is_ean, k = 4 AS is_eic FROM r""")
def point_code(spark, sf_dir):
    k = F.col("o_orderkey")
    s = k.cast("string")
    forms = [F.concat(F.lit("859"), F.lpad(s, 15, "0")), F.concat(F.lit("27ZG-"), F.lpad(s, 12, "0")), F.lit("--"), F.concat(F.lit("om "), s), F.concat(F.lit("27zg"), F.lpad(s, 12, "a"))]
    raw = F.coalesce(*[F.when(k % 5 == n, c) for n, c in enumerate(forms)])
    return views.table(spark, sf_dir, "orders").select(k.alias("id"), text.clean_point_code(raw).alias("code"), text.valid_ean(raw).alias("is_ean"), text.valid_eic(raw).alias("is_eic"))


@query("""SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normal FROM documents""")
def normalised_strings(spark, sf_dir):
    ship_package(spark)
    return views.table(spark, sf_dir, "documents").select("doc_id", text.normalise_string("text").alias("normal"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY 1, 2),
s AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS t FROM n)
SELECT doc_id, round(-sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t)), 6) AS entropy FROM s GROUP BY 1""")
def entropy(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.round(text.shannon_entropy("text"), 6).alias("entropy"))


@query("""SELECT s_suppkey AS id, CAST(s_suppkey * 100 AS DOUBLE) * 0.4 / 1000000 + CAST(s_suppkey AS DOUBLE) * 1.6 / 1000000 AS usd FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, (CAST(s_suppkey * 100 AS DOUBLE) * 2.0 + CAST(s_suppkey AS DOUBLE) * 8.0) / 1000000 FROM supplier WHERE s_suppkey % 2 = 1""")
def token_costs(spark, sf_dir):
    k = F.col("s_suppkey")
    model = F.when(k % 2 == 0, "GPT-4.1-mini-2025").otherwise("gpt-4.1-2025")
    return views.table(spark, sf_dir, "supplier").select(k.alias("id"), cascade.model_cost(model, k * 100, k).alias("usd"))


# --- tax bands, rules, escalation -----------------------------------------------------------------------------------


@query(f"WITH {views.rated('period_to')} SELECT id, commodity, period_to, vat_rate FROM rated")
def vat_rate_lookup(spark, sf_dir):
    return vat.with_rate(views.invoices(spark, sf_dir), vat.vat_bands(spark)).select("id", "commodity", "period_to", "vat_rate")


@query(f"""WITH {views.rated('period_to')} SELECT id, CASE WHEN amount_ex_vat IS NULL AND amount_inc_vat IS NOT NULL AND vat_rate IS NOT NULL THEN round(amount_inc_vat / (1 + vat_rate / 100), 2) ELSE amount_ex_vat END AS amount_ex_vat,
CASE WHEN amount_inc_vat IS NULL AND amount_ex_vat IS NOT NULL AND vat_rate IS NOT NULL THEN round(amount_ex_vat * (1 + vat_rate / 100), 2) ELSE amount_inc_vat END AS amount_inc_vat,
(amount_ex_vat IS NULL) <> (amount_inc_vat IS NULL) AND vat_rate IS NOT NULL AS was_derived FROM rated""")
def derive_amounts(spark, sf_dir):
    rows = vat.with_rate(views.invoices(spark, sf_dir), vat.vat_bands(spark))
    return rows.select("id", *[c.alias(n) for n, c in vat.derive_amounts(F.col("amount_ex_vat"), F.col("amount_inc_vat"), F.col("vat_rate")).items()])


_CORRECTED = f"""WITH {views.rated('issue_date')}, c AS (SELECT *, round(amount_ex_vat * (1 + vat_rate / 100), 2) AS computed_value FROM rated),
d AS (SELECT *, computed_value IS NOT NULL AND (amount_inc_vat IS NULL OR abs(amount_inc_vat - computed_value) > 1) AS was_corrected FROM c)"""


@query(f"{_CORRECTED} SELECT id, CASE WHEN was_corrected THEN computed_value ELSE amount_inc_vat END AS amount_inc_vat, was_corrected FROM d")
def correct_inc_vat(spark, sf_dir):
    return vat.correct_invoices(views.invoices(spark, sf_dir), vat.vat_bands(spark)).select("id", "amount_inc_vat", "was_corrected")


@query(f"{_CORRECTED} SELECT id AS invoice_id, amount_inc_vat AS extracted_value, computed_value, vat_rate AS vat_rate_used FROM d WHERE was_corrected")
def vat_audit(spark, sf_dir):
    rows = vat.correct_invoices(views.invoices(spark, sf_dir), vat.vat_bands(spark)).filter("was_corrected")
    return rows.select(F.col("id").alias("invoice_id"), "extracted_value", "computed_value", F.col("vat_rate").alias("vat_rate_used"))


def _fields(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    k = F.col("id")
    pairs = {
        "invoice_number": F.when(k % 29 != 0, F.col("invoice_number")), "customer_tax_id": F.col("customer_tax_id"), "issue_date": day("issue_date"), "due_date": F.when(k % 31 == 0, "31.12.2024").otherwise(day("due_date")),
        "period_from": day("period_from"), "period_to": F.when(k % 37 != 0, day("period_to")), "amount_ex_vat": F.col("amount_ex_vat").cast("bigint").cast("string"), "amount_inc_vat": F.abs("amount_inc_vat").cast("bigint").cast("string"),
        "consumption_m3": F.when(k % 3 != 1, (k % 900 + 100).cast("string")), "consumption_mwh": F.format_string("%s,5", (k % 9 + 1).cast("string")), "conversion_coefficient": F.when(k % 41 == 0, "1.5").otherwise("1.05"), "combustion_heat": F.lit("10.5"),
        "consumption_high_tariff": F.when(k % 43 != 0, F.lit("5")), "consumption_low_tariff": F.lit(None).cast("string"), "supply_consumption": F.lit("7"), "supply_charge": F.when(k % 4 != 1, F.lit("9")),
        "consumption_gj": F.when(k % 5 == 0, "0").otherwise("12"), "consumption_vodne_m3": F.lit("3"), "power_factor": F.when(k % 8 == 1, "4").otherwise("0.3"),
    }
    return views.invoices(spark, sf_dir).select("id", "commodity", F.create_map(*[x for n, c in pairs.items() for x in (F.lit(n), c)]).alias("fields"), (-(k % 50) / 100.0).alias("logprob"), ((k % 61) / 60.0).alias("sure"))


_FIELDS = f"""{I}, f AS (SELECT id, commodity, CASE WHEN id % 29 <> 0 THEN invoice_number END AS num, customer_tax_id AS tid, issue_date AS iss, CASE WHEN id % 31 <> 0 THEN due_date END AS due, id % 31 = 0 AS bad_due,
 period_from AS pf, CASE WHEN id % 37 <> 0 THEN period_to END AS pt, amount_ex_vat AS ex, abs(amount_inc_vat) AS inc, CASE WHEN id % 3 <> 1 THEN id % 900 + 100 END AS m3, id % 9 + 1.5 AS mwh,
 CASE WHEN id % 41 = 0 THEN 1.5 ELSE 1.05 END AS coef, id % 43 = 0 AS no_vt, CASE WHEN id % 4 <> 1 THEN 1 END AS sc, id % 5 = 0 AS no_gj, id % 8 = 1 AS bad_pf FROM invoices)"""
_SHAPE = """CASE WHEN NOT regexp_full_match(tid, '[0-9]{8}') THEN 'customer_tax_id:not_8_digits' WHEN bad_due THEN 'due_date:not_iso_date' WHEN pf >= pt THEN 'period_from>=period_to' WHEN iss > due THEN 'issue_date>due_date'
 WHEN ex > 0 AND inc < ex * 0.97 THEN 'amount_inc_vat<amount_ex_vat' END"""
_GAS_OFF = "abs(CAST(mwh AS DOUBLE) - CAST(m3 AS DOUBLE) * coef * 10.5 / 1000) / (CAST(m3 AS DOUBLE) * coef * 10.5 / 1000) > 0.15"
_SUMS = f"""CASE WHEN commodity IN ('plyn_mo', 'plyn_vo') AND NOT coef BETWEEN 0.88 AND 1.15 THEN 'conversion_coefficient:range' WHEN commodity IN ('plyn_mo', 'plyn_vo') AND m3 > 0 AND {_GAS_OFF} THEN 'gas_mwh_mismatch'
 WHEN commodity = 'elektrina_vn' AND bad_pf THEN 'power_factor:range' WHEN commodity = 'teplo' AND no_gj THEN 'consumption_gj:range' END"""


@query(f"WITH {_FIELDS} SELECT id, {_SHAPE} AS first_error FROM f")
def format_checks(spark, sf_dir):
    return _fields(spark, sf_dir).select("id", F.get(rules.format_errors(F.col("fields")), F.lit(0)).alias("first_error"))


@query(f"WITH {_FIELDS} SELECT id, {_SUMS} AS first_error FROM f")
def arith_checks(spark, sf_dir):
    return _fields(spark, sf_dir).select("id", F.get(rules.arithmetic_errors(F.col("fields"), F.col("commodity")), F.lit(0)).alias("first_error"))


def _need(*parts: str) -> str:
    """SQL for the comma-joined names of missing required fields."""
    inner = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in (p.split("=", 1) for p in parts))
    return f"concat_ws(',', {inner})"


_MISSING = f"""CASE commodity WHEN 'elektrina_nn' THEN {_need('invoice_number=num IS NULL', 'amount_inc_vat=inc IS NULL', 'period_to=pt IS NULL')}
 WHEN 'elektrina_vn' THEN {_need('invoice_number=num IS NULL', 'supply_charge=sc IS NULL', 'period_to=pt IS NULL')}
 WHEN 'plyn_mo' THEN {_need('invoice_number=num IS NULL', 'amount_inc_vat=inc IS NULL', 'consumption_m3=m3 IS NULL')} WHEN 'plyn_vo' THEN {_need('invoice_number=num IS NULL', 'amount_inc_vat=inc IS NULL', 'consumption_m3=m3 IS NULL')}
 ELSE {_need('invoice_number=num IS NULL', 'amount_inc_vat=inc IS NULL')} END"""
_REASON = f"""{_FIELDS}, r AS (SELECT id, commodity, {_MISSING} AS missing, commodity = 'elektrina_nn' AND no_vt AS crossed, {_SHAPE} AS shape, {_SUMS} AS sums,
 -CAST(id % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS lp, CAST(id % 61 AS DOUBLE) / CAST(60 AS DOUBLE) AS sure FROM f),
reasons AS (SELECT id, commodity, CASE WHEN missing <> '' THEN 'required_missing:' || missing WHEN crossed THEN 'cross_field:at_least_one_null:consumption_high_tariff+consumption_low_tariff' WHEN lp < -0.4 THEN 'low_logprob'
 WHEN sure < 0.65 THEN 'low_required_conf' WHEN shape IS NOT NULL THEN 'format_error:' || shape WHEN sums IS NOT NULL THEN 'arith_error:' || sums ELSE 'ok' END AS reason FROM r)"""


def _reasons(spark, sf_dir):
    sure = F.create_map(F.lit("invoice_number"), F.col("sure"))
    reason = rules.escalation_reason(F.col("fields"), F.col("commodity"), logprob=F.col("logprob"), confidence=sure)
    own = _fields(spark, sf_dir).select("id", "commodity", reason.alias("reason"))
    return own.withColumn("reason", F.when(F.col("reason").rlike("^low_"), F.substring_index("reason", ":", 1)).otherwise(F.col("reason")))


@query(f"WITH {_REASON} SELECT id, commodity, reason FROM reasons")
def escalation_reason(spark, sf_dir):
    return _reasons(spark, sf_dir)


@query(f"WITH {_REASON} SELECT commodity, split_part(reason, ':', 1) AS reason, count(*) AS n FROM reasons GROUP BY 1, 2")
def escalation_summary(spark, sf_dir):
    return _reasons(spark, sf_dir).groupBy("commodity", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {I}, c AS (SELECT id, commodity, CASE WHEN id % 2 = 0 THEN '859' || lpad(CAST(id AS VARCHAR), 15, '0') ELSE '27ZG' || lpad(CAST(id AS VARCHAR), 12, '0') END AS code, CAST(id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS conf FROM invoices)
SELECT id, CASE WHEN (commodity LIKE 'elektrina%' AND id % 2 = 1) OR (commodity LIKE 'plyn%' AND id % 2 = 0) THEN greatest(CAST(0 AS DOUBLE), conf - CAST(0.15 AS DOUBLE)) ELSE conf END AS confidence FROM c""")
def confidence_penalty(spark, sf_dir):
    k = F.col("id")
    code = F.when(k % 2 == 0, F.concat(F.lit("859"), F.lpad(k.cast("string"), 15, "0"))).otherwise(F.concat(F.lit("27ZG"), F.lpad(k.cast("string"), 12, "0")))
    return views.invoices(spark, sf_dir).select("id", rules.penalised_confidence((k % 10) / 10.0, code, F.col("commodity")).alias("confidence"))


# --- splits and corrections -----------------------------------------------------------------------------------------


@query(f"""WITH {I}, y AS (SELECT *, unnest(generate_series(CAST(year(period_from) AS BIGINT), CAST(year(period_to) AS BIGINT))) AS y FROM invoices WHERE year(period_to) > year(period_from)),
s AS (SELECT *, greatest(period_from, CAST(CAST(y AS VARCHAR) || '-01-01' AS DATE)) AS a, least(period_to, CAST(CAST(y AS VARCHAR) || '-12-31' AS DATE)) AS b FROM y)
SELECT id, CAST(y AS INTEGER) AS year, a AS split_from, b AS split_to, CAST(date_diff('day', a, b) + 1 AS INTEGER) AS days, round(CAST(date_diff('day', a, b) + 1 AS DOUBLE) / (date_diff('day', period_from, period_to) + 1), 4) AS fraction,
round(round(amount_inc_vat * (CAST(date_diff('day', a, b) + 1 AS DOUBLE) / (date_diff('day', period_from, period_to) + 1)), 6), 1) AS amount_fraction FROM s""")
def year_split(spark, sf_dir):
    out = analysis.year_split(views.invoices(spark, sf_dir))
    exact = F.round(F.round(F.col("amount_inc_vat") * (F.col("days") / F.col("total_days")), 6), 1)  # engines part on ties of binary halves
    return out.withColumn("amount_fraction", exact).select("id", "year", "split_from", "split_to", "days", "fraction", "amount_fraction")


@query(f"""WITH {I}, t AS (SELECT id, coalesce(nullif(amount_inc_vat, 0), amount_to_pay, amount_inc_vat) AS v FROM invoices WHERE is_correction)
SELECT id, CASE WHEN v < 0 THEN 'dobropis' WHEN v > 0 THEN 'vrubopis' WHEN v = 0 THEN 'storno' END AS correction_type FROM t""")
def correction_type(spark, sf_dir):
    own = views.invoices(spark, sf_dir).filter("is_correction")
    return own.select("id", rules.correction_type(F.col("amount_inc_vat"), F.col("amount_to_pay")).alias("correction_type"))


@query(f"""WITH {I}, p AS (SELECT c.invoice_number, c.amount_inc_vat AS ci, o.amount_inc_vat AS oi, c.amount_ex_vat AS ce, o.amount_ex_vat AS oe, c.amount_to_pay AS cp, o.amount_to_pay AS op
 FROM invoices c JOIN invoices o ON c.original_number = o.invoice_number AND NOT o.is_correction WHERE c.is_correction),
m AS (SELECT invoice_number, 'amount_inc_vat' AS field_name, oi AS a, ci AS b FROM p UNION ALL SELECT invoice_number, 'amount_ex_vat', oe, ce FROM p UNION ALL SELECT invoice_number, 'amount_to_pay', op, cp FROM p)
SELECT invoice_number, field_name, a AS original_value, b AS corrected_value, round(coalesce(b, 0) - coalesce(a, 0), 2) AS delta,
CASE WHEN coalesce(a, 0) <> 0 THEN round((coalesce(b, 0) - a) / abs(a) * 100, 2) END AS delta_percent FROM m WHERE a IS NOT NULL OR b IS NOT NULL""")
def correction_deltas(spark, sf_dir):
    pairs = analysis.correction_pairs(views.invoices(spark, sf_dir))
    return analysis.correction_deltas(pairs, ("amount_inc_vat", "amount_ex_vat", "amount_to_pay"))


@query(f"""WITH {I}, d AS (SELECT c.id, CASE WHEN o.amount_inc_vat IS NULL THEN c.amount_inc_vat ELSE c.amount_inc_vat - o.amount_inc_vat END AS total_delta
 FROM invoices c LEFT JOIN invoices o ON c.original_number = o.invoice_number AND NOT o.is_correction WHERE c.is_correction)
SELECT id, total_delta, CASE WHEN total_delta < 0 THEN 'dobropis' WHEN total_delta > 0 THEN 'vrubopis' WHEN total_delta = 0 THEN 'neutrální' END AS correction_type FROM d""")
def correction_totals(spark, sf_dir):
    pairs = analysis.correction_pairs(views.invoices(spark, sf_dir))
    return pairs.select("id", *[c.alias(n) for n, c in analysis.total_delta(F.col("amount_inc_vat"), F.col("orig_amount_inc_vat")).items()])


@query(f"""WITH {I} SELECT id, year(period_from) <> year(period_to) AS cross_year, id % 25 = 0 OR year(period_from) <> year(period_to) AS is_transitional, is_correction,
CASE WHEN is_correction THEN 'opravna' WHEN id % 25 = 0 OR year(period_from) <> year(period_to) THEN 'prechodova' ELSE 'bezna' END AS invoice_type FROM invoices""")
def analysis_flags(spark, sf_dir):
    own = analysis.analysis_flags(F.col("period_from"), F.col("period_to"), F.col("id") % 25 == 0, F.col("is_correction"))
    return views.invoices(spark, sf_dir).select("id", *[c.alias(n) for n, c in own.items()])


# --- evaluation -----------------------------------------------------------------------------------------------------


def _flags(spark, sf_dir):
    own = views.predictions(spark, sf_dir)
    return own.withColumns(evaluate.match_flags(F.col("expected"), F.col("extracted"), F.col("field_name")))


_R = "round({}, 6)"
_FIELD = f"""WITH {P}, m AS (SELECT field_name, count(*) AS n_evaluable, CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, CAST(sum(CASE WHEN is_present THEN 1 ELSE 0 END) AS BIGINT) AS n_present,
CAST(sum(CASE WHEN is_correct AND is_present THEN 1 ELSE 0 END) AS BIGINT) AS n_true_positive, avg(cer) AS mean_cer FROM flags WHERE is_evaluable GROUP BY 1),
q AS (SELECT *, coalesce(CAST(n_true_positive AS DOUBLE) / nullif(n_present, 0), 0) AS p, CAST(n_true_positive AS DOUBLE) / n_evaluable AS r FROM m)
SELECT field_name, n_evaluable, n_correct, n_present, n_true_positive, round(mean_cer, 6) AS mean_cer, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
round(CAST(n_correct AS DOUBLE) / n_evaluable, 6) AS accuracy, round(CAST(n_present AS DOUBLE) / n_evaluable, 6) AS extraction_rate FROM q"""


@query(_FIELD)
def field_metrics(spark, sf_dir):
    own = evaluate.field_metrics(_flags(spark, sf_dir))
    return own.withColumns({c: F.round(c, 6) for c in ("mean_cer", "precision", "recall", "f1", "accuracy", "extraction_rate")})


_INVOICE = f"""{P}, per AS (SELECT filename, strategy, CAST(sum(CASE WHEN is_evaluable THEN 1 ELSE 0 END) AS BIGINT) AS n, sum(CASE WHEN is_evaluable AND is_exact_match THEN 1 ELSE 0 END) AS e, sum(CASE WHEN is_evaluable AND is_correct THEN 1 ELSE 0 END) AS c,
sum(CASE WHEN is_evaluable AND is_present THEN 1 ELSE 0 END) AS p, avg(CASE WHEN is_evaluable THEN cer END) AS mean_cer FROM flags GROUP BY 1, 2),
inv AS (SELECT filename, strategy, n AS n_evaluable, coalesce(CAST(e AS DOUBLE) / nullif(n, 0), 0) AS exact_accuracy, coalesce(CAST(c AS DOUBLE) / nullif(n, 0), 0) AS composite_accuracy, coalesce(CAST(p AS DOUBLE) / nullif(n, 0), 0) AS extraction_rate, mean_cer FROM per)"""


@query(f"WITH {_INVOICE} SELECT filename, strategy, n_evaluable, round(exact_accuracy, 6) AS exact_accuracy, round(composite_accuracy, 6) AS composite_accuracy, round(extraction_rate, 6) AS extraction_rate, round(mean_cer, 6) AS mean_cer FROM inv")
def invoice_accuracy(spark, sf_dir):
    own = evaluate.invoice_metrics(_flags(spark, sf_dir), "filename", "strategy")
    return own.withColumns({c: F.round(c, 6) for c in ("exact_accuracy", "composite_accuracy", "extraction_rate", "mean_cer")})


@query(f"""WITH {_INVOICE}, k AS (SELECT *, CAST(length(filename) * 100 + n_evaluable AS DOUBLE) AS latency_ms, CAST(n_evaluable AS DOUBLE) / 8 AS cost_usd, filename = 'f7' AS failed FROM inv)
SELECT strategy, count(*) AS n_invoices, CAST(sum(CASE WHEN failed THEN 0 ELSE 1 END) AS BIGINT) AS n_ok, round(avg(CASE WHEN NOT failed THEN composite_accuracy END), 6) AS composite_accuracy, round(1 - avg(CASE WHEN NOT failed THEN mean_cer END), 6) AS similarity,
round(avg(CASE WHEN NOT failed THEN latency_ms END), 6) AS mean_latency_ms, sum(cost_usd) AS total_cost_usd, round(sum(CASE WHEN failed THEN 0 ELSE 1 END) / nullif(sum(latency_ms) / 1000, 0), 6) AS throughput,
round(avg(CASE WHEN NOT failed THEN composite_accuracy END) / nullif(sum(cost_usd), 0), 6) AS cost_efficiency FROM k GROUP BY 1""")
def corpus_metrics(spark, sf_dir):
    own = evaluate.invoice_metrics(_flags(spark, sf_dir), "filename", "strategy")
    own = own.withColumns({"latency_ms": (F.length("filename") * 100 + F.col("n_evaluable")).cast("double"), "cost_usd": F.col("n_evaluable") / 8.0, "failed": F.col("filename") == "f7"})
    out = evaluate.corpus_metrics(own, "strategy")
    return out.select("strategy", "n_invoices", "n_ok", *[F.round(c, 6).alias(c) for c in ("composite_accuracy", "similarity", "mean_latency_ms")], "total_cost_usd", *[F.round(c, 6).alias(c) for c in ("throughput", "cost_efficiency")])


_STATUS = """CASE WHEN coalesce(a, '') = '' THEN 'no_gt' WHEN coalesce(b, '') = a THEN 'tp' WHEN coalesce(b, '') <> '' THEN 'fp' ELSE 'fn' END"""


@query(f"""WITH {P}, s AS (SELECT strategy, {_STATUS} AS status FROM norm),
c AS (SELECT strategy, CAST(sum(CASE status WHEN 'tp' THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE status WHEN 'fp' THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE status WHEN 'fn' THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM s WHERE status <> 'no_gt' GROUP BY 1),
q AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT strategy, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0), 0), 4) AS accuracy FROM q""")
def prf_micro(spark, sf_dir):
    own = views.predictions(spark, sf_dir).withColumn("status", evaluate.field_status(F.lower(F.trim("expected")), F.lower(F.trim("extracted"))))
    return evaluate.precision_recall(own, "strategy")


@query(f"""WITH {P}, s AS (SELECT field_name, avg(CASE WHEN {_STATUS} = 'tp' THEN 1.0 ELSE 0.0 END) AS share FROM norm GROUP BY 1) SELECT round(avg(share), 6) AS macro_mean, round(min(share), 6) AS worst FROM s""")
def macro_mean(spark, sf_dir):
    own = views.predictions(spark, sf_dir).withColumn("status", evaluate.field_status(F.lower(F.trim("expected")), F.lower(F.trim("extracted"))))
    shares = own.groupBy("field_name").agg(F.avg(F.when(F.col("status") == "tp", 1.0).otherwise(0.0)).alias("share"))
    return evaluate.macro(shares, "share").select(F.round("macro_mean", 6).alias("macro_mean"), F.round("worst", 6).alias("worst"))


@query(f"""WITH {P}, s AS (SELECT strategy, confidence, CASE WHEN is_correct THEN 1.0 ELSE 0.0 END AS ok, least(CAST(floor(confidence / (1.0 / CAST(10 AS DOUBLE))) AS INTEGER), 9) AS bin FROM flags),
b AS (SELECT strategy, bin, count(*) AS n, avg(confidence) AS c, avg(ok) AS a FROM s GROUP BY 1, 2), t AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY strategy) AS share FROM b)
SELECT strategy, bin, n, round(c, 6) AS mean_confidence, round(a, 6) AS mean_accuracy, round(share, 6) AS share, round(abs(c - a), 6) AS gap FROM t""")
def ece_bins(spark, sf_dir):
    own = _flags(spark, sf_dir).withColumn("ok", F.when(F.col("is_correct"), 1.0).otherwise(0.0))
    bins = evaluate.calibration_bins(own, "confidence", "ok", "strategy")
    return bins.select("strategy", "bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "mean_accuracy", "share", "gap")])


@query(f"""WITH {T}, g AS (SELECT event_type, avg(value) AS m, var_pop(value) AS v FROM transactions GROUP BY 1), p AS (SELECT a.event_type AS group_a, b.event_type AS group_b, (a.m - b.m) / sqrt((a.v + b.v) / 2) AS d FROM g a JOIN g b ON a.event_type < b.event_type)
SELECT group_a, group_b, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM p""")
def cohens_d_pairs(spark, sf_dir):
    return evaluate.effect_sizes(views.transactions(spark, sf_dir), "event_type", "value").withColumn("d", F.round("d", 6))


@query()
def bootstrap_ci(spark, sf_dir):
    return evaluate.bootstrap_intervals(views.table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", n=500)


@query(f"""WITH fm AS ({_FIELD}),
v AS (SELECT 'macro_f1' AS measure, avg(f1) AS value FROM fm UNION ALL SELECT 'latency_s', CAST(18.4 AS DOUBLE) UNION ALL SELECT 'json_validity', CAST(1 AS DOUBLE)),
c(criterion, measure, threshold, at_least) AS (VALUES ('K1', 'macro_f1', 0.60, true), ('K2', 'invoice_number', 0.85, true), ('K3', 'supplier_tax_id', 0.85, true), ('K4', 'customer_tax_id', 0.85, true), ('K5', 'amount_inc_vat', 0.85, true),
 ('K6', 'due_date', 0.85, true), ('K7', 'json_validity', 0.98, true), ('K8', 'latency_s', 60.0, false), ('K9', 'f1_q3', 0.45, true))
SELECT criterion, c.measure AS measure, round(v.value, 4) AS value, CASE WHEN at_least THEN coalesce(v.value, 0) >= threshold ELSE coalesce(v.value, 0) <= threshold END AS met FROM c LEFT JOIN v ON c.measure = v.measure""")
def acceptance(spark, sf_dir):
    own = evaluate.field_metrics(_flags(spark, sf_dir)).agg(F.avg("f1").alias("value")).select(F.lit("macro_f1").alias("measure"), "value")
    fixed = spark.createDataFrame([("latency_s", 18.4), ("json_validity", 1.0)], "measure string, value double")
    return evaluate.acceptance(own.unionByName(fixed)).select("criterion", "measure", F.round("value", 4).alias("value"), "met")


@query(f"""WITH {P}, a AS (SELECT strategy, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS accuracy, avg(confidence) AS confidence FROM flags GROUP BY 1), b AS (SELECT strategy, avg(CASE WHEN is_present THEN 1.0 ELSE 0.0 END) AS accuracy, avg(confidence) / 2 AS confidence FROM flags GROUP BY 1)
SELECT a.strategy, 'accuracy' AS metric, round(b.accuracy, 6) AS before, round(a.accuracy, 6) AS after, round(a.accuracy - b.accuracy, 6) AS delta FROM a JOIN b USING (strategy)
UNION ALL SELECT a.strategy, 'confidence', round(b.confidence, 6), round(a.confidence, 6), round(a.confidence - b.confidence, 6) FROM a JOIN b USING (strategy)""")
def before_after(spark, sf_dir):
    own = _flags(spark, sf_dir)
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0)).alias("accuracy")
    after, before = own.groupBy("strategy").agg(share("is_correct"), F.avg("confidence").alias("confidence")), own.groupBy("strategy").agg(share("is_present"), (F.avg("confidence") / 2).alias("confidence"))
    out = evaluate.before_after(before, after, "strategy", ["accuracy", "confidence"])
    return out.select("strategy", "metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@query(f"""WITH {P}, r AS (SELECT filename, strategy, confidence, row_number() OVER (PARTITION BY filename ORDER BY confidence DESC, key) AS r FROM predictions WHERE confidence > 0)
SELECT filename, strategy AS best_strategy, confidence AS best_score FROM r WHERE r = 1""")
def best_strategy(spark, sf_dir):
    return evaluate.best_strategy(views.predictions(spark, sf_dir), "filename", position="key")


# --- corpus statistics ----------------------------------------------------------------------------------------------


@query("""SELECT p_type, count(p_size) AS n, round(avg(p_size), 6) AS mean, CAST(median(p_size) AS DOUBLE) AS median, round(stddev_samp(p_size), 6) AS std, CAST(sum(p_size) AS BIGINT) AS total, max(p_size) AS largest, count(DISTINCT p_size) AS "distinct" FROM part GROUP BY 1""")
def group_summary(spark, sf_dir):
    out = stats.summary(views.table(spark, sf_dir, "part"), "p_type", value="p_size")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6), "median": F.col("median").cast("double")})


@query("""WITH q AS (SELECT quantile_cont(value, CAST(1 AS DOUBLE) / 3) AS a, quantile_cont(value, CAST(2 AS DOUBLE) / 3) AS b FROM events)
SELECT CASE WHEN value > b THEN 'Q1' WHEN value > a THEN 'Q2' ELSE 'Q3' END AS quality, count(*) AS n FROM events, q GROUP BY 1""")
def terciles(spark, sf_dir):
    return stats.terciles(views.table(spark, sf_dir, "events"), "value").groupBy("quality").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT event_type, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS "0", CAST(sum(CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS "1", CAST(sum(CASE WHEN user_id % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS "2" FROM events GROUP BY 1)
SELECT event_type, "0" AS a, "1" AS b, "2" AS c, round(CAST(100 AS DOUBLE) * "0" / ("0" + "1" + "2"), 2) AS pct_a, round(CAST(100 AS DOUBLE) * "1" / ("0" + "1" + "2"), 2) AS pct_b, round(CAST(100 AS DOUBLE) * "2" / ("0" + "1" + "2"), 2) AS pct_c FROM p""")
def pivot_share(spark, sf_dir):
    letter = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 3 + 1).cast("int"))
    return stats.pivot_shares(views.table(spark, sf_dir, "events").withColumn("third", letter), "event_type", "third", ["a", "b", "c"])


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS r FROM c)
SELECT CASE WHEN r <= 5 THEN p_brand ELSE 'other' END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top5_other(spark, sf_dir):
    counts = views.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return stats.top_and_other(counts, "p_brand", "n")


@query("""WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, p_brand, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (PARTITION BY p_type), 2) AS share FROM c""")
def share_of_total(spark, sf_dir):
    counts = views.table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return stats.share_of_total(counts, "n", "p_type")


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id FROM r WHERE r = 1""")
def keep_last(spark, sf_dir):
    return store.keep_last(views.table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('2|' || CAST(event_id AS VARCHAR)), event_id) AS r FROM events) SELECT event_type, event_id FROM r WHERE r <= 300")
def sample_n(spark, sf_dir):
    return stats.sample_per_group(views.table(spark, sf_dir, "events"), "event_type", "event_id", 300).select("event_type", "event_id")


@query("""SELECT l_returnflag, round(CAST(100 AS DOUBLE) * sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM lineitem GROUP BY 1""")
def rate_of_sums(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("ok"), F.lit(1).alias("one"))
    return stats.rate_of(rows, "ok", "one", "l_returnflag").withColumn("rate", F.round("rate", 6))


@query("""WITH c AS (SELECT p_type, CAST(sum(p_size) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1), b AS (SELECT s AS bs, n AS bn FROM c WHERE p_type = 'SMALL')
SELECT p_type, round((1 - s / bs) * 100, 2) AS saved_s, round((1 - n / bn) * 100, 2) AS saved_n FROM c, b""")
def savings(spark, sf_dir):
    own = views.table(spark, sf_dir, "part").groupBy("p_type").agg(F.sum("p_size").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    return stats.savings(own, "p_type", "SMALL", ["s", "n"])


@query("""WITH d(position, p_type) AS (VALUES (0, 'PROMO'), (1, 'SMALL'), (2, 'MISSING'), (3, 'ECONOMY')), c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT position, d.p_type, n FROM d LEFT JOIN c ON d.p_type = c.p_type""")
def aligned_categories(spark, sf_dir):
    counts = views.table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return stats.aligned(counts, ["PROMO", "SMALL", "MISSING", "ECONOMY"], "p_type")


@query("""SELECT o_orderstatus = 'F' AS escalated, count(*) AS n, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1""")
def latency_by_path(spark, sf_dir):
    return stats.latency_by_path(views.table(spark, sf_dir, "orders").withColumn("escalated", F.col("o_orderstatus") == "F"), ["o_totalprice"])


@query("""SELECT source, lang, CASE WHEN doc_id % 3 = 0 THEN 'scan' ELSE 'native' END AS kind, count(*) AS n FROM documents GROUP BY 1, 2, 3""")
def path_counts(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "scan").otherwise("plain")
    files = views.table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("/x/data"), "source", "lang", F.concat(kind, F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))).alias("path"))
    out = stats.path_counts(files)
    return out.select(F.col("commodity").alias("source"), F.col("supplier").alias("lang"), "kind", F.col("count").alias("n"))


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def union_by_name(spark, sf_dir):
    a = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    b = views.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    return stats.union_by_name([a, b])


@query("""SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""")
def distinct_sorted(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct().orderBy("l_returnflag", "l_linestatus")


# --- joins and storage ----------------------------------------------------------------------------------------------


@query(f"""WITH {I} SELECT id FROM invoices WHERE NOT EXISTS (SELECT 1 FROM invoices s WHERE s.id % 4 = 0 AND s.id % 6 <> 5 AND s.commodity = invoices.commodity AND s.invoice_number = invoices.invoice_number) OR (id % 4 = 0 AND id % 6 = 5)""")
def dedup_save(spark, sf_dir):
    own = views.invoices(spark, sf_dir).select("id", "invoice_number", "commodity", F.when(F.col("id") % 2 == 0, F.col("customer_tax_id")).alias("supplier_cin"))
    return store.new_invoices(own, own.filter("id % 4 = 0 AND id % 6 <> 5")).select("id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_leakage(spark, sf_dir):
    return retrieve.without_leakage(views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark, sf_dir):
    gone = views.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return store.cascade_delete(views.table(spark, sf_dir, "lineitem"), gone, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber % 2 AS odd, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber DESC, l_suppkey DESC, l_partkey DESC) AS r FROM lineitem)
SELECT o_orderkey AS stem, coalesce(a.l_partkey, b.l_partkey) AS part, coalesce(a.l_partkey, b.l_partkey) IS NOT NULL AS has_truth FROM orders LEFT JOIN t a ON a.l_orderkey = o_orderkey AND a.odd = 0 AND a.r = 1 LEFT JOIN t b ON b.l_orderkey = o_orderkey AND b.odd = 1 AND b.r = 1""")
def match_ground_truth(spark, sf_dir):
    files = views.table(spark, sf_dir, "orders").select(F.lit("x").alias("commodity"), F.col("o_orderkey").alias("stem"))
    lines = views.table(spark, sf_dir, "lineitem")
    truth = lines.select(F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise("").alias("commodity"), F.col("l_orderkey").alias("stem"), F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("position"), F.col("l_partkey").alias("part"))
    return store.match_ground_truth(files, truth).select("stem", "part", "has_truth")


@query("""WITH r AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END DESC) AS r FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT user_id, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'ocr' END AS state FROM r WHERE r = 1""")
def current_state(spark, sf_dir):
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "ocr").otherwise("unknown")
    return cascade.current_state(views.table(spark, sf_dir, "events").withColumn("state", state), "user_id", "ts").select("user_id", "state")


# --- classification -------------------------------------------------------------------------------------------------

_METRICS = """m AS (SELECT p_partkey AS id, p_size * 10 AS chars, p_size % 20 AS points, p_size % 4 AS fonts, CAST(p_partkey % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS text_pages, CAST(p_partkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS images,
 p_size * (p_partkey % 10) AS invisible, CAST(p_partkey % 7 AS DOUBLE) / CAST(7 AS DOUBLE) AS garbled FROM part)"""


def _metrics(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    return views.table(spark, sf_dir, "part").select(
        k.alias("id"), (n * 10).alias("total_chars"), (n % 20).alias("codepoint_diversity"), (n % 4).alias("font_count"), ((k % 11) / 10.0).alias("page_text_ratio"), ((k % 101) / 100.0).alias("image_area_ratio"),
        (n * (k % 10)).alias("invisible"), ((k % 7) / 7.0).alias("garbled"),
    )


_V1 = "CASE WHEN chars >= 200 AND points >= 15 AND fonts >= 2 AND text_pages >= 0.8 AND images <= 0.6 THEN 'native_pdf' ELSE 'scanned' END"


@query(f"WITH {_METRICS} SELECT id, {_V1} AS kind_v1 FROM m")
def classify_v1(spark, sf_dir):
    return _metrics(spark, sf_dir).withColumns(classify.classify_v1()).select("id", "kind_v1")


_V2 = f"""{_METRICS}, s AS (SELECT *, CASE WHEN CAST(invisible AS DOUBLE) / greatest(chars, 1) < 0.1 THEN 0.05 WHEN CAST(invisible AS DOUBLE) / greatest(chars, 1) < 0.3 THEN 0.3 WHEN CAST(invisible AS DOUBLE) / greatest(chars, 1) < 0.6 THEN 0.6 ELSE 0.9 END AS s1,
 CASE WHEN images < 0.2 THEN 0.0 WHEN images < 0.4 THEN 0.1 WHEN images < 0.6 THEN 0.3 WHEN images < 0.8 THEN 0.7 ELSE 0.95 END AS s3,
 CASE WHEN CAST(chars AS DOUBLE) / greatest(fonts, 1) < 50 THEN 0.0 WHEN CAST(chars AS DOUBLE) / greatest(fonts, 1) < 100 THEN 0.1 WHEN CAST(chars AS DOUBLE) / greatest(fonts, 1) < 200 THEN 0.3 WHEN CAST(chars AS DOUBLE) / greatest(fonts, 1) < 500 THEN 0.6 ELSE 0.9 END AS s4 FROM m),
v2 AS (SELECT id, {_V1} AS kind_v1, CAST(s1 AS DOUBLE) * CAST(0.35 AS DOUBLE) + garbled * CAST(0.3 AS DOUBLE) + CAST(s3 AS DOUBLE) * CAST(0.2 AS DOUBLE) + CAST(s4 AS DOUBLE) * CAST(0.15 AS DOUBLE) AS p FROM s),
k2 AS (SELECT id, kind_v1, p, CASE WHEN p < 0.25 THEN 'native_pdf' ELSE 'scanned' END AS kind_v2, CASE WHEN p > 0.75 THEN least(1.0, 0.7 + (p - 0.75) * 1.2) WHEN p < 0.25 THEN least(1.0, 0.7 + (0.25 - p) * 1.2) ELSE 0.4 + abs(p - 0.5) * 0.2 END AS c2 FROM v2)"""


def _judged(spark, sf_dir):
    own = _metrics(spark, sf_dir).withColumns(classify.classify_v1())
    return own.withColumns(classify.classify_v2(F.col("invisible"), F.col("total_chars"), F.lit(""), F.lit(0), F.col("image_area_ratio"), F.col("font_count"), garbled=F.col("garbled")))


@query(f"WITH {_V2} SELECT id, round(p, 6) AS scanned_likelihood, kind_v2, round(c2, 6) AS confidence_v2 FROM k2")
def classify_v2(spark, sf_dir):
    return _judged(spark, sf_dir).select("id", F.round("scanned_likelihood", 6).alias("scanned_likelihood"), "kind_v2", F.round("confidence_v2", 6).alias("confidence_v2"))


@query(f"""WITH {_V2}, c AS (SELECT id, CASE WHEN kind_v2 = 'scanned' THEN 'scanned' WHEN kind_v1 = 'native_pdf' AND c2 > 0.8 THEN 'native_pdf' ELSE 'scanned' END AS conservative,
 (CASE WHEN kind_v2 = 'scanned' THEN 0.7 * c2 ELSE 0 END) + (CASE WHEN kind_v1 = 'scanned' THEN 0.3 * 0.9 ELSE 0 END) AS w FROM k2) SELECT id, conservative, CASE WHEN w > 0.6 THEN 'scanned' ELSE 'native_pdf' END AS weighted FROM c""")
def ensemble_vote(spark, sf_dir):
    own = _judged(spark, sf_dir)
    kinds = {s: classify.vote(s, F.col("kind_v1"), F.lit(0.9), F.col("kind_v2"), F.col("confidence_v2"))["kind"] for s in ("conservative", "weighted")}
    return own.select("id", *[c.alias(s) for s, c in kinds.items()])


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, (CASE WHEN l_discount > 0.08 THEN 0.5 WHEN l_discount > 0.05 THEN 0.2 ELSE 0.0 END) + (CASE WHEN l_quantity > 35 THEN 0.4 WHEN l_quantity > 25 THEN 0.2 ELSE 0.0 END)
 + (CASE WHEN l_partkey % 3 <= 1 AND l_partkey % 100 > 50 THEN 0.3 ELSE 0.0 END) + (CASE WHEN l_partkey % 100 < 30 THEN 0.1 ELSE 0.0 END) AS s FROM lineitem)
SELECT doc_id, CAST(sum(CASE WHEN s < 0.2 THEN 0 ELSE 1 END) AS BIGINT) AS scanned_pages, CAST(sum(CASE WHEN s < 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS native_pages, round(avg(CASE WHEN s < 0.2 THEN 0.0 ELSE 1.0 END), 6) AS scanned_ratio,
 max(s) >= 0.2 AND min(s) < 0.2 AS is_hybrid, CASE WHEN max(s) >= 0.2 THEN 'scanned' ELSE 'native_pdf' END AS overall_kind FROM p GROUP BY 1""")
def hybrid_pages(spark, sf_dir):
    k = F.col("l_partkey")
    invisible = F.when(F.col("l_discount") > 0.08, 0.5).when(F.col("l_discount") > 0.05, 0.3).otherwise(0.0)
    images = F.when(F.col("l_quantity") > 35, 0.8).when(F.col("l_quantity") > 25, 0.6).otherwise(0.1)
    pages = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), *[c.alias(n) for n, c in classify.page_kind(k % 100, k % 3, images, invisible).items()])
    return classify.hybrid_documents(pages).withColumn("scanned_ratio", F.round("scanned_ratio", 6))


@query("""SELECT doc_id, CAST(CASE WHEN regexp_matches(lower(source || '.pdf'), 'scan|skc|image|jpg|png') THEN 0.7 ELSE 0.0 END AS DOUBLE) AS filename_signal, CAST(CASE WHEN n_chars * 1000 > 5000000 THEN 0.4 WHEN n_chars * 1000 < 500000 THEN -0.2 ELSE 0.0 END AS DOUBLE) AS size_signal,
CAST(CASE WHEN doc_id % 2 = 0 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS type_signal FROM documents""")
def metadata_signals(spark, sf_dir):
    own = classify.metadata_signals(F.concat("source", F.lit(".pdf")), F.col("n_chars") * 1000, F.when(F.col("doc_id") % 2 == 0, "Utility bill").otherwise("other"))
    return views.table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in own.items()])


# --- extraction -----------------------------------------------------------------------------------------------------


def invoice_texts(spark, sf_dir):
    """Invoices written out as text, with lines missing by their key."""
    day = lambda c: F.date_format(c, "d.M.yyyy")
    k = F.col("id")
    lines = [
        F.when(k % 10 != 0, F.concat(F.lit("Faktura za služby č. "), "invoice_number")), F.when(k % 6 == 0, F.lit("Dodávka elektřiny")).when(k % 6 == 5, F.lit("Vodné a stočné")).when(k % 6 == 2, F.lit("zemní plyn")),
        F.when(k % 7 != 0, F.concat(F.lit("EAN: 859"), F.lpad(k.cast("string"), 15, "0"))), F.when(k % 9 != 0, F.concat(F.lit("Období: "), day("period_from"), F.lit(" - "), day("period_to"))),
        F.concat(F.lit("Datum vystavení: "), day("issue_date")), F.concat(F.lit("IČO odběratele: "), "customer_tax_id"), F.concat(F.lit("Spotřeba VT: "), (k % 900).cast("string"), F.lit(",5 kWh")),
        F.concat(F.lit("Celkem k úhradě: "), F.abs("amount_inc_vat").cast("bigint").cast("string"), F.lit(",25 Kč")),
    ]
    # dealt evenly: what these texts cost to read is not told by their size
    return views.invoices(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "id").select("id", F.concat_ws("\n", *lines).alias("text"))


@query(f"""WITH {I} SELECT id, CASE WHEN id % 10 <> 0 THEN invoice_number ELSE 'UNKNOWN' END AS invoice_number, CASE WHEN id % 7 <> 0 THEN '859' || lpad(CAST(id AS VARCHAR), 15, '0') END AS ean_code,
CASE WHEN id % 9 <> 0 THEN period_from ELSE DATE '2025-06-01' END AS period_from, CASE WHEN id % 9 <> 0 THEN period_to ELSE DATE '2025-06-30' END AS period_to, issue_date,
CASE WHEN length(customer_tax_id) = 8 THEN customer_tax_id END AS customer_tax_id, abs(amount_inc_vat) + 0.25 AS total_amount_inc_vat FROM invoices""")
def regex_extract(spark, sf_dir):
    out = extract.extract_invoices(invoice_texts(spark, sf_dir), "2025-06-30")
    return out.select("id", "invoice_number", "ean_code", "period_from", "period_to", "issue_date", "customer_tax_id", "total_amount_inc_vat")


@query(f"WITH {I} SELECT id, CASE WHEN id % 6 = 0 THEN 'elektrina_nn' WHEN id % 6 = 5 THEN 'voda' WHEN id % 6 = 2 THEN 'plyn_MO' END AS commodity FROM invoices")
def detect_commodity(spark, sf_dir):
    return invoice_texts(spark, sf_dir).select("id", extract.detect_commodity(F.col("text")).alias("commodity"))


@query(f"""WITH {I}, k AS (SELECT id, amount_inc_vat, CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS e, CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS w FROM invoices WHERE id % 6 IN (0, 2, 5))
SELECT id, CAST(greatest(0.0, least(1.0, 1 - 0.2 * e - 0.05 * w - 0.15 * e - CASE WHEN id % 7 = 0 THEN 0.1 ELSE 0 END - CASE WHEN amount_inc_vat IS NULL THEN 0.15 ELSE 0 END)) AS DOUBLE) AS confidence FROM k""")
def regex_confidence(spark, sf_dir):
    out = extract.extract_invoices(invoice_texts(spark, sf_dir), "2025-06-30").filter("commodity IS NOT NULL")
    return out.select("id", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_REASON} SELECT id, commodity, split_part(reason, ':', 1) AS reason, reason <> 'ok' AS escalated, CASE WHEN reason = 'ok' THEN 'text' ELSE 'vision' END AS mode, CAST(CASE WHEN reason = 'ok' THEN 0.25 ELSE 1.25 END AS DOUBLE) AS cost_usd FROM reasons")
def cascade_documents(spark, sf_dir):
    """The cascade over already read fields: the second reader fills what the first left out, at four times the price."""

    def primary(docs):
        sure = F.create_map(F.lit("invoice_number"), F.col("sure"))
        return docs.withColumns({"confidences": sure, "api_error": F.lit(None).cast("string"), "cost_usd": F.lit(0.25), "latency_ms": F.lit(4000.0)})

    def fallback(docs):
        filled = F.transform_values("fields", lambda k, v: F.coalesce(v, F.lit("1")))
        return primary(docs).withColumns({"fields": filled, "cost_usd": F.lit(1.0), "latency_ms": F.lit(9000.0)})

    out = cascade.cascade(_fields(spark, sf_dir), primary, fallback, key="id")
    return out.select("id", "commodity", F.substring_index("reason", ":", 1).alias("reason"), "escalated", "mode", "cost_usd")


# --- layout ---------------------------------------------------------------------------------------------------------


@query(f"WITH {W} SELECT doc_id, page, text, l AS \"left\", t AS top FROM words WHERE trim(text) <> '' AND conf >= 30")
def confident_words(spark, sf_dir):
    return layout.confident_words(views.words(spark, sf_dir)).select("doc_id", "page", "text", "left", "top")


@query(f"""WITH {W}, n AS (SELECT *, t // 30 AS line, row_number() OVER (PARTITION BY doc_id, page, t // 30 ORDER BY l) - 1 AS position FROM words) SELECT doc_id, page, text, CAST(line AS INTEGER) AS line, CAST(position AS INTEGER) AS position FROM n""")
def line_groups(spark, sf_dir):
    ship_package(spark)
    return layout.group_lines(views.words(spark, sf_dir)).select("doc_id", "page", "text", "line", "position")


@query(f"""WITH {W}, s AS (SELECT *, t // 30 AS line, CASE WHEN l - lag(l + w) OVER (PARTITION BY doc_id, page, t // 30 ORDER BY l) > 50 THEN 1 ELSE 0 END AS j FROM words),
g AS (SELECT *, sum(j) OVER (PARTITION BY doc_id, page, line ORDER BY l) AS seg FROM s) SELECT doc_id, page, CAST(line AS INTEGER) AS line, CAST(max(seg) + 1 AS INTEGER) AS columns, string_agg(text, ' ' ORDER BY l) AS text FROM g GROUP BY 1, 2, 3""")
def line_columns(spark, sf_dir):
    ship_package(spark)
    return layout.column_lines(views.words(spark, sf_dir)).select("doc_id", "page", "line", F.size("segments").alias("columns"), "text")


@query(f"""WITH {W}, c AS (SELECT *, (t + t + h) // 2 AS cy, CAST(floor(l + CAST(w AS DOUBLE) / 2) AS BIGINT) AS cx FROM words),
r AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY doc_id, page ORDER BY cy, cx, text) > 12 THEN 1 ELSE 0 END AS jr, CASE WHEN cx - lag(cx) OVER (PARTITION BY doc_id, page ORDER BY cx, cy, text) > 40 THEN 1 ELSE 0 END AS jc FROM c),
g AS (SELECT *, sum(jr) OVER (PARTITION BY doc_id, page ORDER BY cy, cx, text ROWS UNBOUNDED PRECEDING) AS row, sum(jc) OVER (PARTITION BY doc_id, page ORDER BY cx, cy, text ROWS UNBOUNDED PRECEDING) AS col FROM r)
SELECT doc_id, page, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, string_agg(text, ' ' ORDER BY l, t, text) AS text FROM g GROUP BY 1, 2, 3, 4""")
def grid_cells(spark, sf_dir):
    return layout.grid_cells(views.words(spark, sf_dir))


_BOXES = "boxes AS (SELECT doc_id, page, b AS box, 0 AS x1, b * 90 AS y1, 250 AS x2, b * 90 + 60 AS y2 FROM (SELECT DISTINCT doc_id, page FROM words) CROSS JOIN (VALUES (0), (1), (2)) AS v(b))"


def _boxes(words):
    b = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return words.select("doc_id", "page").distinct().select("doc_id", "page", b.alias("box")).select("doc_id", "page", "box", F.lit(0).alias("x1"), (F.col("box") * 90).alias("y1"), F.lit(250).alias("x2"), (F.col("box") * 90 + 60).alias("y2"))


_CENTRE = "l + CAST(w AS DOUBLE) / 2 BETWEEN x1 AND x2 AND t + CAST(h AS DOUBLE) / 2 BETWEEN y1 AND y2"


@query(f"WITH {W}, {_BOXES} SELECT doc_id, page, box, count(*) AS n FROM words JOIN boxes USING (doc_id, page) WHERE {_CENTRE} GROUP BY 1, 2, 3")
def words_in_boxes(spark, sf_dir):
    words = views.words(spark, sf_dir)
    return layout.words_in_boxes(words, _boxes(words)).groupBy("doc_id", "page", "box").agg(F.count("*").alias("n"))


@query(f"WITH {W}, {_BOXES} SELECT doc_id, page, text, l AS \"left\", t AS top FROM words WHERE NOT EXISTS (SELECT 1 FROM boxes WHERE boxes.doc_id = words.doc_id AND boxes.page = words.page AND {_CENTRE})")
def words_outside(spark, sf_dir):
    words = views.words(spark, sf_dir)
    boxes = _boxes(words)
    boxes = boxes.select(*[F.col(c).alias(c) for c in boxes.columns])
    return layout.words_outside(words, boxes).select("doc_id", "page", "text", "left", "top")


# --- retrieval ------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS r FROM p) SELECT query_id, neighbour_id, round(s, 5) AS score, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 2""")
def knn_top2(spark, sf_dir):
    index = views.table(spark, sf_dir, "embeddings")
    return retrieve.top_neighbours(index.filter("vec_id % 20 = 0"), index, 2).withColumn("score", F.round("score", 5))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN s_name || ' ' ELSE 'unlike anything' END AS raw, CASE WHEN s_suppkey % 3 = 2 THEN 'unlike anything' ELSE s_name END AS canonical FROM supplier""")
def fuzzy_supplier(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.upper("s_name")).when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(" "))).otherwise("unlike anything")
    names = s.select(F.col("s_suppkey").alias("id"), raw.alias("raw"))
    return retrieve.canonical_names(names, s.select("s_name"), "raw", "s_name", "id").select("id", "raw", "canonical")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with derived and corrected amounts, checked and summed up by commodity."""
    rows = vat.with_rate(views.invoices(spark, sf_dir), vat.vat_bands(spark))
    rows = rows.withColumns(vat.derive_amounts(F.col("amount_ex_vat"), F.col("amount_inc_vat"), F.col("vat_rate"))).drop("vat_rate")
    checked = vat.correct_invoices(rows, vat.vat_bands(spark))
    reasons = _reasons(spark, sf_dir).select("id", F.substring_index("reason", ":", 1).alias("reason"))
    return checked.join(reasons, "id").groupBy("commodity").agg(
        F.count("*").alias("invoices"), F.sum(F.when(F.col("was_derived"), 1).otherwise(0)).alias("derived"), F.sum(F.when(F.col("was_corrected"), 1).otherwise(0)).alias("corrected"),
        F.sum(F.when(F.col("reason") != "ok", 1).otherwise(0)).alias("escalated"), F.round(F.avg("amount_inc_vat"), 2).alias("mean_amount"),
    )
