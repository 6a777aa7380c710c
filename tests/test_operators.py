import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import analysis, cascade, classify, evaluate, extract, layout, retrieve, rules, stats, store, vat
from ledgerloom.plans import analytics
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import streams

DAY = dt.date


def test_vat(spark):
    rows = [(1, "plyn_MO", DAY(2021, 11, 15), 100.0, None), (2, "voda", DAY(2024, 2, 1), None, 112.0), (3, "teplo", DAY(2020, 1, 1), 100.0, 999.0), (4, "x", DAY(2024, 1, 1), 1.0, None), (5, "voda", DAY(1999, 1, 1), 1.0, None)]
    df = vat.with_rate(spark.createDataFrame(rows, "id int, commodity string, period_to date, ex double, inc double"), vat.vat_bands(spark))
    got = {r.id: r for r in df.select("id", "vat_rate", *[c.alias(n) for n, c in vat.derive_amounts(F.col("ex"), F.col("inc"), F.col("vat_rate")).items()]).collect()}
    assert [got[k].vat_rate for k in range(1, 6)] == [0.0, 12.0, 10.0, None, None]
    assert (got[1].amount_inc_vat, got[2].amount_ex_vat, got[3].was_derived, got[4].was_derived) == (100.0, 100.0, False, False)
    assert all(r.contiguous for r in vat.contiguous(vat.vat_bands(spark)).collect())
    broken = vat.vat_bands(spark, {"a": [("2013-01-01", "2019-12-31", 1.0), ("2020-02-01", None, 2.0)], "b": [("2013-01-01", "2019-12-31", 1.0)]})
    assert not any(r.contiguous for r in vat.contiguous(broken).collect())


def test_bands_from_csv():
    block = "a;b;popis;do;sazba\n;;voda;2020-04-30;15\n;;voda;;12\n;;;2020-04-30;15\n;;2020-05-01;;12\n"
    bands = readers.bands_from_csv("﻿" + block)
    assert bands == {"voda": [(DAY(2013, 1, 1), DAY(2020, 4, 30), 15.0), (DAY(2020, 5, 1), None, 12.0)]} and readers.gapless(bands["voda"])
    assert readers.bands_from_csv(block + ";;2021-01-01;;3\n") is None


ESCALATE = [
    ({"invoice_number": "1"}, "x", None, None, None, "ok"),
    ({"invoice_number": ""}, "x", None, None, None, "required_missing:invoice_number"),
    ({"invoice_number": "1"}, "x", "timeout", None, None, "api_error"),
    ({"invoice_number": "1", "amount_inc_vat": "5", "period_from": "2024-01-01", "period_to": "2024-02-01"}, "elektrina_nn", None, None, None, "cross_field:at_least_one_null:consumption_high_tariff+consumption_low_tariff"),
    ({"invoice_number": "1", "a": None, "b": ""}, "x", None, None, None, "high_null:0.67>0.4"),
    ({"invoice_number": "1"}, "x", None, -0.5, None, "low_logprob:-0.500<-0.4"),
    ({"invoice_number": "1"}, "x", None, None, {"invoice_number": 0.5}, "low_required_conf:invoice_number"),
    ({"invoice_number": "1", "note": "z"}, "x", None, None, {"note": 0.1}, "low_optional_conf:note"),
    ({"invoice_number": "1", "supplier_tax_id": "12"}, "x", None, None, None, "format_error:supplier_tax_id:not_8_digits"),
    ({"invoice_number": "1", "amount_inc_vat": "9", "period_from": "2024-01-01", "consumption_gj": "0"}, "teplo", None, None, None, "arith_error:consumption_gj:range"),
]


def test_escalation(spark):
    rows = [(k, *r[:5]) for k, r in enumerate(ESCALATE)]
    df = spark.createDataFrame(rows, "k int, fields map<string,string>, commodity string, err string, lp double, conf map<string,double>")
    got = df.select("k", rules.escalation_reason(F.col("fields"), F.col("commodity"), F.col("err"), F.col("lp"), F.col("conf")).alias("r")).orderBy("k").collect()
    assert [r.r for r in got] == [r[5] for r in ESCALATE]


def test_escalation_makes_its_map_once_a_row(spark):
    """The map is an expression; each place that evaluates it anew costs as much as the first."""
    rows = [(1, "1", "2024-13-01", "x"), (2, "1", "2024-01-02", "x"), (3, "", None, "x"), (4, "1", "2024-01-02", None), (5, None, None, "voda")]
    df = spark.createDataFrame(rows, "k int, number string, due string, commodity string")
    made = F.when(F.col("k") < 5, F.map_from_arrays(F.array(F.lit("invoice_number"), F.lit("due_date")), F.array("number", "due")))
    out = df.select("k", rules.escalation_reason(made, F.col("commodity"), confidence=F.create_map(F.lit("due_date"), F.when(F.col("k") == 4, 0.1)), required_names=F.array(F.lit("due_date"))).alias("r"))
    assert out._jdf.queryExecution().analyzed().toString().count("map_from_arrays(") == 1
    assert [r.r for r in out.orderBy("k").collect()] == ["format_error:due_date:not_iso_date", "ok", "required_missing:invoice_number", "ok", "required_missing:invoice_number,amount_inc_vat,consumption_vodne_m3,period_from"]


def test_gas_balance(spark):
    rows = [({"consumption_m3": "100", "consumption_mwh": "1,1", "conversion_coefficient": "1.05", "combustion_heat": "10.5"},), ({"consumption_m3": "100", "consumption_mwh": "9", "conversion_coefficient": "2", "combustion_heat": "38"},)]
    got = spark.createDataFrame(rows, "f map<string,string>").select(rules.arithmetic_errors(F.col("f"), F.lit("plyn_MO"))).collect()
    assert got[0][0] == [] and got[1][0] == ["conversion_coefficient:range", "combustion_heat:range", "gas_mwh_mismatch"]


def test_year_split(spark):
    df = spark.createDataFrame([(1, DAY(2024, 11, 1), DAY(2025, 1, 31), 9200.0), (2, DAY(2025, 1, 1), DAY(2025, 12, 31), 1.0)], "id int, period_from date, period_to date, amount_inc_vat double")
    rows = analysis.year_split(df).orderBy("year").collect()
    assert [(r.year, r.days, r.total_days) for r in rows] == [(2024, 61, 92), (2025, 31, 92)]
    assert sum(r.amount_fraction for r in rows) == pytest.approx(9200) and sum(r.fraction for r in rows) == pytest.approx(1)
    details = spark.createDataFrame([([(100.0, 3.0)],)], "d array<struct<consumption_m3:double,price:double>>").select(analysis.scale_details(F.col("d"), F.lit(0.25), "plyn_MO", ["consumption_m3", "price"]).alias("d")).first().d
    assert (details[0].consumption_m3, details[0].price) == (25.0, 3.0)


def test_corrections(spark):
    rows = [("FV-1", False, None, 12100.0, 10000.0, None, None), ("FV-2", True, "FV-1", -605.0, -500.0, None, 5.0), ("FV-3", True, "FV-9", 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "invoice_number string, is_correction boolean, original_number string, amount_inc_vat double, amount_ex_vat double, vat_amount double, amount_to_pay double")
    pairs = analysis.correction_pairs(df)
    deltas = {r.field_name: (r.delta, r.delta_percent) for r in analysis.correction_deltas(pairs).collect()}
    assert deltas == {"amount_inc_vat": (-12705.0, -105.0), "amount_ex_vat": (-10500.0, -105.0), "amount_to_pay": (5.0, None)}
    kinds = df.filter("is_correction").select(rules.correction_type(F.col("amount_inc_vat"), F.col("amount_to_pay"))).collect()
    assert [k[0] for k in kinds] == ["dobropis", "storno"]


TEXTS = [
    """Faktura za elektřinu č. FV-2025-0042\nVariabilní symbol: 1234567890\nEAN: 859182400000000001\n\nOdběrné místo: OM-12345678\nDistribuční tarif: D02d\nJistič: 25 A\n
Období: 01.01.2025 - 30.06.2025\nDatum vystavení: 01.07.2025\nDatum splatnosti: 15.07.2025\nDUZP: 30.06.2025\n\nIČO odběratele: 12345678\nDIČ odběratele: CZ12345678\nIČO dodavatele: 87654321\n
Spotřeba VT: 800,5 kWh\nSpotřeba NT: 1 200,30 kWh\n\nZáklad daně: 10 000,00 Kč\nDPH 21%: 2 100,00 Kč\nCelkem k úhradě: 12 100,00 Kč\n""",
    """Faktura za zemní plyn č. FV-2025-G01\nEAN: 859182400099990001\nObdobí: 01.01.2025 - 31.03.2025\nDatum vystavení: 05.04.2025\nSpotřeba: 350,5 m³\nSpotřeba: 3,505 MWh\nPřepočítací koeficient: 10,55\nCelkem k úhradě: 8 500,00 Kč\n""",
    """Faktura za vodu a stočné\nFaktura č. FV-2025-W01\nObdobí: 01.01.2025 - 30.06.2025\nSpotřeba: 45 m³\nVodné: 2 500,00 Kč\nStočné: 2 200,00 Kč\nCelkem k úhradě: 4 700,00 Kč\n""",
    "nothing of the kind",
]


def test_extraction(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    a, b, c, d = extract.extract_invoices(df, "2025-08-15").orderBy("k").collect()
    assert (a.commodity, a.invoice_number, a.variable_symbol, a.ean_code) == ("elektrina_nn", "FV-2025-0042", "1234567890", "859182400000000001")
    assert (a.period_from, a.period_to, a.customer_tax_id, a.supplier_tax_id, a.total_amount_inc_vat) == (DAY(2025, 1, 1), DAY(2025, 6, 30), "12345678", "87654321", 12100.0)
    assert a.details == {"consumption_high_tariff": "800.5", "consumption_low_tariff": "1200.3", "distribution_tariff": "D02d", "circuit_breaker": "25.0"} and a.confidence == pytest.approx(1.0)
    assert (b.commodity, b.invoice_number, b.total_amount_inc_vat, b.details["consumption_m3"], b.details["consumption_mwh"]) == ("plyn_MO", "FV-2025-G01", 8500.0, "350.5", "3.505")
    assert (c.commodity, c.total_amount_inc_vat, c.issue_date, c.warnings) == ("voda", 4700.0, DAY(2025, 8, 15), ["default_issue_date"])
    assert (d.commodity, d.errors, d.confidence) == (None, ["no_commodity"], None)


def test_classification(spark):
    cols = "total_chars int, codepoint_diversity int, font_count int, page_text_ratio double, image_area_ratio double"
    rows = [(500, 40, 3, 1.0, 0.1), (199, 40, 3, 1.0, 0.1), (500, 14, 3, 1.0, 0.1), (500, 40, 1, 1.0, 0.1), (500, 40, 3, 0.7, 0.1), (500, 40, 3, 1.0, 0.61)]
    got = spark.createDataFrame(rows, cols).withColumns(classify.classify_v1()).collect()
    assert [(r.kind_v1, len(r.failed)) for r in got] == [("native_pdf", 0)] + [("scanned", 1)] * 5
    own = spark.createDataFrame([(0, 100, 0.0, 4, 0.0), (90, 100, 0.9, 0, 0.9), (20, 300, 0.5, 1, 0.5)], "i int, n int, img double, f int, g double")
    out = own.select(*[c.alias(k) for k, c in classify.classify_v2(F.col("i"), F.col("n"), F.lit(""), F.lit(0), F.col("img"), F.col("f"), F.col("g")).items()]).collect()
    assert [r.kind_v2 for r in out] == ["native_pdf", "scanned", "scanned"] and out[0].confidence_v2 == pytest.approx(0.7 + (0.25 - 0.0175) * 1.2)
    pages = spark.createDataFrame([(1, 500, 3, 0.1, 0.0), (1, 60, 1, 0.9, 0.9), (2, 500, 3, 0.0, 0.0)], "doc_id int, c int, f int, im double, inv double")
    kinds = pages.select("doc_id", *[c.alias(n) for n, c in classify.page_kind(F.col("c"), F.col("f"), F.col("im"), F.col("inv")).items()])
    assert {r.doc_id: (r.is_hybrid, r.overall_kind) for r in classify.hybrid_documents(kinds).collect()} == {1: (True, "scanned"), 2: (False, "native_pdf")}


def test_layout(spark):
    words = [("Total:", 0, 0, 40, 10), ("5", 60, 2, 10, 10), ("a", 0, 30, 10, 10), ("b", 200, 31, 10, 10), ("last", 0, 60, 30, 10)]
    df = spark.createDataFrame([(1, 1, t, x, y, w, h) for t, x, y, w, h in words], layout.WORDS)
    lines = layout.line_segments(layout.group_lines(df))
    assert json.loads(layout.json_light(lines).first().encoded) == {"total": "5", "r1": ["a", "b"], "r2": "last"}
    assert layout.markdown(lines).first().encoded == "Total: 5\n| a | b |\nlast"
    boxes = spark.createDataFrame([(1, 1, 7, 0, 0, 100, 20)], "doc_id long, page int, box int, x1 int, y1 int, x2 int, y2 int")
    assert {r.text for r in layout.words_in_boxes(df, boxes).collect()} == {"Total:", "5"}
    assert {r.text for r in layout.words_outside(df, boxes).collect()} == {"a", "b", "last"}
    assert layout.table_html(layout.grid_cells(df)).count() == 1
    regions = layout.regions(df, 1000)
    assert layout.payload(regions, 300).first().payload.startswith("[HEADER]")


def test_evaluation(spark):
    rows = [("f", "total_amount_inc_vat", "1 200,50", "1200.5"), ("f", "issue_date", "5.1.2024", "2024-01-05"), ("f", "invoice_number", "FV 1", "null"), ("f", "commodity", None, "x"), ("g", "commodity", "voda", "VODA")]
    long = spark.createDataFrame(rows, "filename string, field_name string, expected string, extracted string").withColumns(evaluate.match_flags(F.col("expected"), F.col("extracted"), F.col("field_name")))
    got = {(r.filename, r.field_name): (r.is_correct, r.is_present, r.is_evaluable) for r in long.collect()}
    assert got[("f", "total_amount_inc_vat")] == (True, True, True) and got[("f", "issue_date")] == (True, True, True)
    assert got[("f", "invoice_number")] == (False, False, True) and got[("f", "commodity")] == (False, True, False) and got[("g", "commodity")][0]
    own = {r.filename: r for r in evaluate.invoice_metrics(long, "filename").collect()}
    assert own["f"].composite_accuracy == pytest.approx(2 / 3) and own["f"].n_evaluable == 3
    samples = spark.createDataFrame([("a", float(k)) for k in range(20)] + [("b", float(k + 9)) for k in range(20)], "g string, v double")
    ci = {r.g: r for r in evaluate.bootstrap_intervals(samples, "g", "v", n=200).collect()}
    assert ci["a"].lower < 9.5 < ci["a"].upper and ci["b"].point == 18.5
    assert evaluate.effect_sizes(samples, "g", "v").first().effect == "large"


def test_storage(spark, tmp_path):
    stored = spark.createDataFrame([(1, "A", "voda", None)], "id int, invoice_number string, commodity string, supplier_cin string")
    incoming = spark.createDataFrame([(5, "A", "voda", None), (6, "A", "voda", "1"), (7, "B", "voda", None)], stored.schema)
    assert {r.id for r in store.new_invoices(incoming, stored).collect()} == {6, 7}
    assert {r.id: r.existing_id for r in store.existing_ids(incoming, stored).collect()} == {5: 1, 6: None, 7: None}
    assert [r.id for r in store.cascade_delete(incoming.withColumnRenamed("id", "k").withColumn("id", F.col("k")), stored.withColumn("id", F.lit(6)), "k").collect()]
    path = str(tmp_path / "t")
    sinks.append(spark.createDataFrame([(1, "x")], "a int, b string"), spark, path)
    sinks.append(spark.createDataFrame([(2, 3.5)], "a int, c double"), spark, path)
    assert {(r.a, r.b, r.c) for r in sinks.read_appended(spark, path).collect()} == {(1, "x", None), (2, None, 3.5)}


def test_reports_and_guard(spark):
    tx = spark.createDataFrame([(k, "error" if k % 3 == 0 else "completed", f"m{k % 2}" if k % 3 == 0 else None, dt.datetime(2024, 1, 1 + k % 4)) for k in range(30)], "id int, status string, error_message string, created_at timestamp")
    assert [(r.status, r["count"], r.percentage) for r in analytics.error_summary(tx).collect()] == [("completed", 20, 66.67), ("error", 10, 33.33)]
    rows, totals = analytics.list_transactions(tx, status="error", page=2, size=4)
    assert rows.count() == 4 and totals.first().total_pages == 3
    for bad in ("", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT 1; SELECT 2", "SELECT replace('a', 'b', 'c')", "select * from t where drop = 1"):
        with pytest.raises(ValueError):
            analytics.guarded(bad)
    assert analytics.custom_query(spark, "SELECT 1 AS updated_at;").first().updated_at == 1
    with pytest.raises(KeyError):
        analytics.run_report(spark, "nothing")


def test_retrieval(spark):
    vectors = spark.createDataFrame([(k, [float((k * 7 + j) % 5) for j in range(4)]) for k in range(23)], "vec_id long, embedding array<float>")
    whole = {(r.query_id, r["rank"]): r.neighbour_id for r in retrieve.top_neighbours(vectors, vectors, 3).collect()}
    split = {(r.query_id, r["rank"]): r.neighbour_id for r in retrieve.top_neighbours(vectors, vectors, 3, block=5).collect()}
    assert whole == split and len(whole) == 69
    names = spark.createDataFrame([(1, "energie CEZ"), (2, "Vodarna Plzen a.s"), (3, "zzz"), (4, "")], "id int, raw string")
    ref = spark.createDataFrame([("CEZ Energie",), ("Vodarna Plzen a.s.",)], "ref string")
    assert [r.canonical for r in retrieve.canonical_names(names, ref, "raw", "ref", "id").orderBy("id").collect()] == ["CEZ Energie", "Vodarna Plzen a.s.", "zzz", ""]


def test_statistics(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 4)], "g string, h string, n int")
    assert {r.g: (r.x, r.y, r.pct_x) for r in stats.pivot_shares(df, "g", "h", ["x", "y"], F.col("n")).collect()} == {"a": (1, 3, 25.0), "b": (4, 0, 100.0)}
    assert {r.g: r.n for r in stats.top_and_other(df.groupBy("g").agg(F.sum("n").alias("n")), "g", "n", 1).collect()} == {"a": 4, "other": 4}
    assert cascade.model_cost is not None and df.select(F.round(cascade.model_cost(F.lit("GPT-4.1-mini-x"), F.lit(1_000_000), F.lit(0)), 4)).first()[0] == 0.4


def test_sources_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.PDF").write_bytes(b"one")
    (folder / "b.txt").write_bytes(b"two")
    (folder / "c.png").write_bytes(b"x" * 10)
    files = readers.documents_in(spark, str(folder))
    assert {(r.suffix, r.mime_type) for r in files.collect()} == {(".pdf", "application/pdf"), (".png", "image/png")}
    (tmp_path / "t.csv").write_text("﻿Name;Amount \n007;1,5\n", encoding="utf-8")
    row = readers.csv_texts(spark, str(tmp_path / "t.csv")).first()
    assert (row.name, row.amount) == ("007", "1,5")
    assert readers.suppliers_fixture(spark).count() == 162
    query = streams.ingest(streams.landing(spark, str(folder)), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).first().status == 415
    feedback = spark.createDataFrame([("m", k, "native_pdf", "scanned") for k in range(120)], "model string, k int, predicted string, truth string")
    out = classify.feedback_averages(feedback, "model", "k").first()
    assert out.fn_rate > 0.99 and out.threshold == 0.5
