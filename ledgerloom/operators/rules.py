"""Validation rules, escalation and confidence as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import text

#: Thresholds and required fields of the escalation decision.
NULL_THRESHOLDS = {"elektrina_nn": 0.40, "elektrina_vn": 0.85, "plyn_mo": 0.60, "plyn_vo": 0.55, "teplo": 0.41, "voda": 0.45}
NULL_DEFAULT = 0.40
AT_LEAST_ONE = {"elektrina_nn": [["consumption_high_tariff", "consumption_low_tariff"]]}
REQUIRED = {
    "elektrina_nn": ["invoice_number", "amount_inc_vat", "period_from", "period_to"],
    "elektrina_vn": ["invoice_number", "supply_consumption", "supply_charge", "period_from", "period_to"],
    "plyn_mo": ["invoice_number", "amount_inc_vat", "consumption_mwh", "consumption_m3", "period_from"],
    "plyn_vo": ["invoice_number", "amount_inc_vat", "consumption_mwh", "consumption_m3", "period_from"],
    "teplo": ["invoice_number", "amount_inc_vat", "consumption_gj", "period_from"],
    "voda": ["invoice_number", "amount_inc_vat", "consumption_vodne_m3", "period_from"],
}
LOGPROB, REQUIRED_CONFIDENCE, OPTIONAL_CONFIDENCE = -0.40, 0.65, 0.45
TAX_IDS = ("supplier_tax_id", "customer_tax_id")
DATES = ("issue_date", "due_date", "period_from", "period_to", "tax_point_date")


def _get(fields: Column, name: str) -> Column:
    return F.nullif(F.try_element_at(fields, F.lit(name)), F.lit(""))


def _bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of ``values``, each of which is evaluated once a row however often ``body`` reads it: Spark
    evaluates an expression anew at each place of a condition or a lambda function."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), F.lit(0))


def format_errors(fields: Column) -> Column:
    """D4 over a map of extracted texts: an array of codes, empty when all is well."""
    names = (*TAX_IDS, *DATES, "amount_ex_vat", "amount_inc_vat")
    return _bound({"fields": fields}, lambda own: _bound({f: _get(own["fields"], f) for f in names}, lambda got: _bound({f: text.safe_iso_date(got[f]) for f in DATES}, lambda day: _format_codes(got, day))))


def _format_codes(got: Column, day: Column) -> Column:
    found = [F.when(got[f].isNotNull() & ~F.trim(got[f]).rlike(r"^\d{8}$"), f"{f}:not_8_digits") for f in TAX_IDS]
    found += [F.when(got[f].isNotNull() & day[f].isNull(), f"{f}:not_iso_date") for f in DATES]
    found.append(F.when(day["period_from"] >= day["period_to"], "period_from>=period_to"))
    found.append(F.when(day["issue_date"] > day["due_date"], "issue_date>due_date"))
    ex, inc = text.safe_float(got["amount_ex_vat"]), text.safe_float(got["amount_inc_vat"])
    found.append(F.when((ex > 0) & (inc < ex * 0.97), "amount_inc_vat<amount_ex_vat"))
    return F.array_compact(F.array(*found))


def arithmetic_errors(fields: Column, commodity: Column) -> Column:
    """Physical ranges and the gas energy balance, as codes."""
    number = lambda f: text.safe_float(_get(fields, f))
    kind = F.lower(commodity)
    gas = kind.isin("plyn_mo", "plyn_vo")
    m3, mwh, coef, heat = (number(f) for f in ("consumption_m3", "consumption_mwh", "conversion_coefficient", "combustion_heat"))
    kwh = F.when(heat > 20, heat / 3.6).otherwise(heat)
    expected = m3 * coef * kwh / 1000
    off = F.when(expected > 0, F.abs(mwh - expected) / F.nullif(expected, F.lit(0.0))).otherwise(1.0)
    factor, gj = number("power_factor"), number("consumption_gj")
    return F.array_compact(
        F.array(
            F.when(gas & ~coef.between(0.88, 1.15), "conversion_coefficient:range"),
            F.when(gas & ~heat.between(7.5, 13.5), "combustion_heat:range"),
            F.when(gas & (m3 > 0) & (mwh != 0) & (coef != 0) & (heat != 0) & (off > 0.15), "gas_mwh_mismatch"),
            F.when((kind == "elektrina_vn") & ~factor.between(0.0, 3.0), "power_factor:range"),
            F.when((kind == "teplo") & ((gj <= 0) | (gj > 100_000)), "consumption_gj:range"),
        )
    )


def _by_commodity(commodity: Column, table: dict, default) -> Column:
    out = default
    for c, value in table.items():
        out = F.when(F.lower(commodity) == c, value).otherwise(out)
    return out


def required_of(commodity: Column) -> Column:
    return _by_commodity(commodity, {c: F.array(*map(F.lit, v)) for c, v in REQUIRED.items()}, F.array(F.lit("invoice_number")))


def escalation_reason(
    fields: Column, commodity: Column, api_error: Column | None = None, logprob: Column | None = None, confidence: Column | None = None, required_names: Column | None = None
) -> Column:
    """The first reason to escalate, else 'ok'. ``fields``: map of texts; ``confidence``: map of doubles;
    ``required_names``: the registry's required fields (for which low optional confidence does not count)."""
    given = {
        "fields": fields, "commodity": commodity, "needed": required_of(commodity),
        "api_error": api_error if api_error is not None else F.lit(None).cast("string"),
        "logprob": logprob if logprob is not None else F.lit(None).cast("double"),
        "confidence": confidence if confidence is not None else F.lit(None).cast("map<string,double>"),
    }
    if required_names is not None:
        given["required_names"] = required_names
    return _bound(given, lambda own: _reason(own, own["required_names" if required_names is not None else "needed"]))


def _reason(own: Column, settled: Column) -> Column:
    fields, commodity, needed, logprob, confidence = (own[n] for n in ("fields", "commodity", "needed", "logprob", "confidence"))
    missing = F.filter(needed, lambda f: ~text.truthy(F.try_element_at(fields, f)))
    crossed = [
        F.when((F.lower(commodity) == c) & ~F.greatest(*[text.truthy(F.try_element_at(fields, F.lit(f))) for f in group]), "+".join(group))
        for c, groups in AT_LEAST_ONE.items()
        for group in groups
    ]
    values = F.map_values(fields)
    share = F.when(F.size(values) > 0, F.size(F.filter(values, lambda v: ~text.truthy(v))) / F.size(values)).otherwise(1.0)
    limit = _by_commodity(commodity, {c: F.lit(v) for c, v in NULL_THRESHOLDS.items()}, F.lit(NULL_DEFAULT))
    low = F.filter(needed, lambda f: F.coalesce(F.try_element_at(confidence, f) < REQUIRED_CONFIDENCE, F.lit(False)))
    unsure = F.map_filter(fields, lambda f, v: text.truthy(v) & F.coalesce(F.try_element_at(confidence, f) < OPTIONAL_CONFIDENCE, F.lit(False)))
    doubted = F.array_except(F.map_keys(unsure), settled)
    shape, sums = format_errors(fields), arithmetic_errors(fields, commodity)
    return F.coalesce(
        F.when(text.truthy(own["api_error"]), "api_error"),
        F.when(F.size(missing) > 0, F.concat(F.lit("required_missing:"), F.array_join(missing, ","))),
        F.concat(F.lit("cross_field:at_least_one_null:"), F.coalesce(*crossed)),
        F.when(share > limit, F.format_string("high_null:%.2f>%s", share, limit.cast("string"))),
        F.when(logprob < LOGPROB, F.format_string("low_logprob:%.3f<%s", logprob, F.lit(str(LOGPROB)))),
        F.when(F.size(low) > 0, F.concat(F.lit("low_required_conf:"), F.array_join(low, ","))),
        F.when(F.size(doubted) > 0, F.concat(F.lit("low_optional_conf:"), F.array_join(doubted, ","))),
        F.when(F.size(shape) > 0, F.concat(F.lit("format_error:"), F.substring(F.get(shape, F.lit(0)), 1, 80))),
        F.when(F.size(sums) > 0, F.concat(F.lit("arith_error:"), F.substring(F.get(sums, F.lit(0)), 1, 80))),
        F.lit("ok"),
    )


def regex_confidence(errors: Column, warnings: Column, number: Column, ean: Column, eic: Column, inc: Column) -> Column:
    """D13"""
    points = F.when(text.truthy(ean) | text.truthy(eic), 0.0).otherwise(0.1)
    score = 1.0 - 0.2 * errors - 0.05 * warnings - F.when(F.coalesce(number, F.lit("UNKNOWN")) == "UNKNOWN", 0.15).otherwise(0.0) - points - F.when(text.truthy(inc, "number"), 0.0).otherwise(0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def model_confidence(number: Column, point: Column, start: Column, end: Column, issued: Column, inc: Column, tax_id: Column) -> Column:
    """Weights 2, 2, 2, 1, 2, 1 of ten."""
    part = lambda ok, w: F.when(F.coalesce(ok, F.lit(False)), float(w)).otherwise(0.0)
    total = part(text.truthy(number) & (number != "UNKNOWN"), 2) + part(text.truthy(point), 2) + part(start.isNotNull() & end.isNotNull(), 2)
    return F.least((total + part(issued.isNotNull(), 1) + part(text.truthy(inc, "number"), 2) + part(text.truthy(tax_id), 1)) / 10.0, F.lit(1.0))


def warnings(number: Column, point: Column, issued: Column, due: Column, inc: Column, is_correction: Column, cross_year: Column | None = None, original: Column | None = None) -> Column:
    """An array of codes; the last two only for the model's variant."""
    found = [
        F.when(~text.truthy(number) | (number == "UNKNOWN"), "missing_number"),
        F.when(~text.truthy(point), "no_supply_point"),
        F.when(due < issued, "due_before_issue"),
        F.when((inc < 0) & ~F.coalesce(is_correction, F.lit(False)), "negative_amount"),
        F.when(inc > 10_000_000, "high_amount"),
    ]
    if cross_year is not None:
        found.append(F.when(cross_year, "cross_year"))
    if original is not None:
        found.append(F.when(F.coalesce(is_correction, F.lit(False)) & ~text.truthy(original), "correction_without_reference"))
    return F.array_compact(F.array(*found))


def penalised_confidence(confidence: Column, point: Column, commodity: Column) -> Column:
    """0.15 less, at least 0, where a supply point's code does not have its commodity's form."""
    kind, code = F.lower(commodity), text.clean_point_code(point)
    bad = F.when(kind.isin("elektrina_nn", "elektrina_vn"), ~code.startswith("859") | (F.length(code) != 18)).when(kind.isin("plyn_mo", "plyn_vo"), ~code.startswith("27") | (F.length(code) < 16))
    return F.when(F.coalesce(bad, F.lit(False)), F.greatest(F.lit(0.0), confidence - 0.15)).otherwise(confidence)


def correction_type(inc: Column, to_pay: Column) -> Column:
    """By the sign of the amount, or of the amount to pay where that is missing or zero."""
    total = F.coalesce(F.nullif(inc, F.lit(0)), to_pay, inc)
    return F.when(total < 0, "dobropis").when(total > 0, "vrubopis").when(total == 0, "storno")


def iterative_choice(primary: Column, fallback: Column, least: float = 0.6) -> Column:
    """Which of two extractions to take: the first if sure enough or alone, else the fallback if strictly better."""
    return F.when(fallback.isNull() | (primary >= least), "primary").when(primary.isNull() | (fallback > primary), "fallback").otherwise("primary")
