"""Year splits, corrections and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text

#: Measures that a split scales, with their decimals, by commodity; whatever is not named stays.
SCALED = {
    "elektrina_nn": {"consumption_low_tariff": 2, "consumption_high_tariff": 2, "total_consumption": 2, "amount_inc_vat": 2, "amount_ex_vat": 2},
    "elektrina_vn": {"supply_consumption": 3, "peak_consumption": 3, "off_peak_consumption": 3, "amount_inc_vat": 2},
    "plyn_mo": {"consumption_m3": 2, "consumption_mwh": 3, "amount_inc_vat": 2, "amount_ex_vat": 2},
    "plyn_vo": {
        "consumption_m3": 2, "consumption_mwh": 3, "other_supply_services_price": 2, "trade_reserved_capacity_price": 2, "distribution_service_price": 2,
        "distribution_reserved_capacity_price": 2, "market_operator_price": 2, "natural_gas_tax_total": 2, "amount_inc_vat": 2, "amount_ex_vat": 2,
    },
    "voda": {"consumption_m3": 2, "water_rate": 2, "sewage_rate": 2, "amount_inc_vat": 2, "amount_ex_vat": 2},
    "teplo": {"consumption_gj": 2, "heat_consumption": 2, "hot_water_heating": 2, "total_heat_consumption": 2, "amount_inc_vat": 2, "amount_ex_vat": 2},
}
AMOUNTS = ("amount_inc_vat", "amount_ex_vat", "vat_amount", "amount_to_pay")
#: Measures of the first detail that corrections compare, by commodity.
COMPARED = {
    "elektrina_nn": ("consumption_low_tariff", "consumption_high_tariff"),
    "elektrina_vn": ("supply_consumption",),
    "plyn_mo": ("consumption_m3", "consumption_mwh"),
    "plyn_vo": ("consumption_m3", "consumption_mwh"),
    "voda": ("consumption_m3",),
    "teplo": ("consumption_gj", "heat_consumption"),
}
#: Names of the kinds of correction in reports.
KINDS = {"dobropis": "DOBROPIS (kredit)", "vrubopis": "VRUBOPIS (debet)", "storno": "STORNO", "neutrální": "NEUTRÁLNÍ OPRAVA"}


def year_split(invoices: DataFrame, start: str = "period_from", end: str = "period_to", total: str = "amount_inc_vat") -> DataFrame:
    """One row per calendar year of a period that crosses years, with its days, its fraction (four decimals) and its
    amount (of the fraction before rounding). Other invoices give no rows."""
    crossing = invoices.filter((F.year(end) > F.year(start)))
    days = F.datediff(F.col(end), F.col(start)) + 1
    own = crossing.withColumn("total_days", days).withColumn("year", F.explode(F.sequence(F.year(start), F.year(end))))
    own = own.withColumns({"split_from": F.greatest(F.col(start), F.make_date("year", F.lit(1), F.lit(1))), "split_to": F.least(F.col(end), F.make_date("year", F.lit(12), F.lit(31)))})
    own = own.withColumn("days", F.datediff("split_to", "split_from") + 1)
    return own.withColumns({"fraction": F.round(F.col("days") / F.col("total_days"), 4), "amount_fraction": F.round(F.col(total) * (F.col("days") / F.col("total_days")), 2)})


def scale_details(details: Column, fraction: Column, commodity: str, names: list[str]) -> Column:
    """An array of detail structs with the commodity's measures times the rounded fraction."""
    scaled = SCALED.get(commodity.lower(), {})
    return F.transform(details, lambda d: F.struct(*[(F.round(d[n] * fraction, scaled[n]) if n in scaled else d[n]).alias(n) for n in names]))


def replaced_details(splits: DataFrame, key: str, details: str) -> DataFrame:
    """The scaled details of all years of an invoice, in order of years."""
    own = splits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("year", details))).alias("_own"))
    return own.select(key, F.flatten(F.transform("_own", lambda x: x[details])).alias(details))


def correction_pairs(invoices: DataFrame, number: str = "invoice_number", original: str = "original_number") -> DataFrame:
    """Corrections with their original invoice's columns under ``orig_``, null where it is not known."""
    corrections = invoices.filter("is_correction")
    base = invoices.filter("NOT coalesce(is_correction, false)").select(*[F.col(c).alias(f"orig_{c}") for c in invoices.columns])
    return corrections.join(base, corrections[original] == base[f"orig_{number}"], "left")


def delta(original: Column, corrected: Column) -> dict[str, Column]:
    """Difference (two decimals) and its percentage of the original's size; null if both are missing or it is 0."""
    a, b = F.coalesce(original, F.lit(0.0)), F.coalesce(corrected, F.lit(0.0))
    some = original.isNotNull() | corrected.isNotNull()
    return {"delta": F.when(some, F.round(b - a, 2)), "delta_percent": F.when(some & (a != 0), F.round((b - a) / F.abs(F.nullif(a, F.lit(0.0))) * 100, 2))}


def correction_deltas(pairs: DataFrame, measures: tuple[str, ...] = AMOUNTS, keys: tuple[str, ...] = ("invoice_number",)) -> DataFrame:
    """D21, long: one row per correction and measure that either side has."""
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("field_name"), F.col(f"orig_{m}").cast("double").alias("original_value"), F.col(m).cast("double").alias("corrected_value")) for m in measures]))
    rows = pairs.filter(F.col("orig_invoice_number").isNotNull()).select(*keys, named.alias("m")).select(*keys, "m.*")
    return rows.withColumns(delta(F.col("original_value"), F.col("corrected_value"))).filter("delta IS NOT NULL")


def detail_deltas(pairs: DataFrame, details: str = "details", keys: tuple[str, ...] = ("invoice_number",)) -> DataFrame:
    """D21, long: the compared measures of both sides' first detail (an array of maps or structs with all measures) by
    the correction's commodity; a measure that both sides lack or have as 0 is left out."""
    own, before = F.get(F.col(details), F.lit(0)), F.get(F.col(f"orig_{details}"), F.lit(0))
    every = sorted({m for v in COMPARED.values() for m in v})
    used = F.create_map(*[x for c, v in COMPARED.items() for x in (F.lit(c), F.array(*map(F.lit, v)))])
    sides = F.array(*[F.struct(F.lit(m).alias("field_name"), before[m].cast("double").alias("original_value"), own[m].cast("double").alias("corrected_value")) for m in every])
    chosen = F.filter(sides, lambda x: F.array_contains(F.try_element_at(used, F.lower("commodity")), x["field_name"]))
    some = F.filter(chosen, lambda x: (F.coalesce(x["original_value"], F.lit(0.0)) != 0) | (F.coalesce(x["corrected_value"], F.lit(0.0)) != 0))
    rows = pairs.filter(F.col("orig_invoice_number").isNotNull() & own.isNotNull() & before.isNotNull()).select(*keys, F.explode(some).alias("m")).select(*keys, "m.*")
    return rows.withColumns(delta(F.col("original_value"), F.col("corrected_value"))).filter("delta IS NOT NULL")


def linked_corrections(pairs: DataFrame) -> DataFrame:
    """Corrections (of :func:`correction_pairs`) whose original is known, with a ``correction_info`` that names it,
    its id, the total change and its kind; the others have none."""
    own = total_delta(F.col("amount_inc_vat"), F.col("orig_amount_inc_vat"))
    info = F.struct(F.col("orig_invoice_number").alias("original_invoice_number"), F.col("orig_id").alias("original_invoice_id"), own["correction_type"].alias("correction_type"), own["total_delta"].alias("total_delta"))
    return pairs.select(*[c for c in pairs.columns if not c.startswith("orig_")], F.when(F.col("orig_invoice_number").isNotNull(), info).alias("correction_info"))


def _signed(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), F.format_number(c, 2))


def correction_report(linked: DataFrame, deltas: DataFrame, key: str = "invoice_number") -> DataFrame:
    """(key, report): the linked correction as text, its deltas in order of their name. Amounts that are missing or 0
    are shown as N/A."""
    shown = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.format_number(c, 2)).otherwise("N/A")
    percent = F.when(F.col("delta_percent").isNotNull(), F.concat(F.lit(", "), F.when(F.col("delta") >= 0, "+").otherwise(""), F.col("delta_percent").cast("string"), F.lit("%"))).otherwise("")
    lines = F.concat(F.lit("  "), F.col("field_name"), F.lit(":\n    Původně: "), shown("original_value"), F.lit("\n    Nově: "), shown("corrected_value"), F.lit(" ("), _signed(F.col("delta")), percent, F.lit(")"))
    own = deltas.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("field_name", lines.alias("l")))).alias("_l"))
    info, rule = F.col("correction_info"), F.lit("=" * 60)
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    items = F.when(F.size("_l") > 0, F.concat(F.lit("\nZměny jednotlivých položek:\n" + "-" * 40 + "\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n")))
    text_ = F.concat_ws(
        "\n", rule, F.lit("ANALÝZA OPRAVNÉ FAKTURY"), rule,
        F.concat(F.lit("Původní faktura: "), info["original_invoice_number"]), F.concat(F.lit("Typ opravy: "), F.try_element_at(names, info["correction_type"])),
        F.concat(F.lit("Celková změna: "), _signed(info["total_delta"]), F.lit(" Kč")), items, rule,
    )
    return linked.join(own, key, "left").select(key, text_.alias("report"))


def total_delta(inc: Column, original: Column) -> dict[str, Column]:
    """Change of the amount with tax and its name."""
    change = F.when(original.isNull(), inc).otherwise(inc - original)
    return {"total_delta": change, "correction_type": F.when(change < 0, "dobropis").when(change > 0, "vrubopis").when(change == 0, "neutrální")}


def analysis_flags(start: Column, end: Column, is_transitional: Column, is_correction: Column) -> dict[str, Column]:
    """A period across years makes an invoice transitional."""
    cross = text.is_cross_year(start, end)
    moving = F.coalesce(is_transitional, F.lit(False)) | cross
    wrong = F.coalesce(is_correction, F.lit(False))
    return {"cross_year": cross, "is_transitional": moving, "is_correction": wrong, "invoice_type": text.invoice_type(wrong, moving)}
