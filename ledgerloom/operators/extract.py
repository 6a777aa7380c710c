"""Rule-based extraction from invoice texts.

Patterns run in the JVM with the flags (?iumU): case and white space in all of Unicode, ^ and $ at lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import rules

_DATE = r"(\d{1,2}\.\d{1,2}\.\d{4})"
_SEP = r"\s*[:\-]?\s*"
_NUMBER = r"([\d\s]+[,.]?\d*)"
_MONEY = _NUMBER + r"\s*(?:Kč|CZK)?"
_CODE = r"([A-Za-z0-9][A-Za-z0-9\-/]*\d[A-Za-z0-9\-/]*)"
#: The patterns of each field, tried in order.
PATTERNS = {
    "invoice_number": [
        r"(?:Číslo\s+(?:faktury|dokladu)|Faktura(?:\s+\w+){0,3}\s+č\.?|Doklad\s+č\.?)" + _SEP + _CODE,
        r"(?:Invoice\s+(?:No|Number)|Invoice\s*#)" + _SEP + _CODE,
    ],
    "variable_symbol": [r"(?:Variabilní\s+symbol|VS|Var\.?\s*sym\.?)" + _SEP + r"(\d{6,12})"],
    "ean_code": [r"(?:EAN|Kód\s+EAN)" + _SEP + r"(\d{13,18})", r"(859\d{15})"],
    "eic_code": [r"(?:EIC|Kód\s+EIC)" + _SEP + r"(27ZG[A-Z0-9]{12})"],
    "consumption_point_code": [r"(?:Odběrné\s+místo|Kód\s+odběrného\s+místa)" + _SEP + r"([A-Z0-9\-]{8,20})"],
    "issue_date": [r"(?:Datum\s+vystavení|Vystaveno)" + _SEP + _DATE],
    "due_date": [r"(?:Datum\s+splatnosti|Splatnost)" + _SEP + _DATE],
    "vat_date": [r"(?:Datum\s+(?:uskutečnění\s+)?zdanitelného\s+plnění|DUZP|Datum\s+UZP)" + _SEP + _DATE],
    "customer_tax_id": [r"(?:IČO?\s+odběratele|IČO?(?!\s+dodavatele))" + _SEP + r"(\d{8})"],
    "supplier_tax_id": [r"(?:IČO?\s+dodavatele)" + _SEP + r"(\d{8})"],
    "customer_vat_id": [r"(?:DIČ\s+odběratele|DIČ\s*[:\-]?\s*)(CZ\d{8,10})"],
    "supplier_vat_id": [r"(?:DIČ\s+dodavatele)" + _SEP + r"(CZ\d{8,10})"],
    "period": [r"(?:Období|Zúčtovací\s+období|Fakturační\s+období)" + _SEP + _DATE + r"\s*[-–]\s*" + _DATE, r"od\s+" + _DATE + r"\s+do\s+" + _DATE],
    "total_amount_inc_vat": [r"(?:Celkem\s+(?:k\s+)?(?:úhradě|zaplacení)|K\s+úhradě|Celková\s+částka)" + _SEP + _MONEY, r"(?:Částka\s+celkem)" + _SEP + _MONEY],
    "total_amount_ex_vat": [r"(?:Základ\s+daně|Celkem\s+bez\s+DPH)" + _SEP + _MONEY],
    "vat_amount": [r"(?:DPH\s+(?:\d+\s*%)?|Daň)" + _SEP + _MONEY],
    "consumption_low_tariff": [r"(?:Spotřeba\s+NT|Nízký\s+tarif|NT)" + _SEP + _NUMBER + r"\s*(?:kWh)?"],
    "consumption_high_tariff": [r"(?:Spotřeba\s+VT|Vysoký\s+tarif|VT)" + _SEP + _NUMBER + r"\s*(?:kWh)?"],
    "distribution_tariff": [r"(?:Distribuční\s+tarif|Sazba)" + _SEP + r"(D\d{2}[a-z]?)"],
    "circuit_breaker": [r"(?:Jistič|Hlavní\s+jistič)" + _SEP + r"(\d+)\s*(?:A|Amp)?"],
    "consumption_m3": [r"(?:Spotřeba|Odběr)" + _SEP + _NUMBER + r"\s*m[³3]"],
    "consumption_mwh": [r"(?:Spotřeba|Odběr)" + _SEP + _NUMBER + r"\s*MWh"],
    "conversion_factor": [r"(?:Přepočítací\s+koeficient|Koef\.?\s+přepočtu)" + _SEP + _NUMBER],
    "combustion_heat": [r"(?:Spalné\s+teplo)" + _SEP + _NUMBER + r"\s*(?:MJ/m[³3])?"],
    "water_rate": [r"(?:Vodné)" + _SEP + _MONEY],
    "sewage_rate": [r"(?:Stočné)" + _SEP + _MONEY],
    "consumption_gj": [r"(?:Spotřeba|Odběr)" + _SEP + _NUMBER + r"\s*GJ"],
    "heated_area": [r"(?:Vytápěná\s+plocha)" + _SEP + _NUMBER + r"\s*m[²2]"],
    "supply_consumption": [r"(?:Spotřeba\s+(?:silové\s+)?(?:elektřiny|SE))" + _SEP + _NUMBER + r"\s*(?:MWh)"],
    "annual_reserved_capacity": [r"(?:Roční\s+rezervovaná\s+kapacita|RK\s+roční)" + _SEP + _NUMBER + r"\s*(?:MW|kW)"],
    "monthly_reserved_capacity": [r"(?:Měsíční\s+rezervovaná\s+kapacita|RK\s+měsíční)" + _SEP + _NUMBER + r"\s*(?:MW|kW)"],
    "reactive_power_quantity": [r"(?:Jalová\s+energie|Jalový\s+výkon|Množství\s+jalové)" + _SEP + _NUMBER + r"\s*(?:kVArh)"],
    "power_factor": [r"(?:Účiník|tg\s*[φfi])" + _SEP + _NUMBER],
    "quarter_hour_max": [r"(?:Čtvrthodinové\s+maximum|1/4\s*hod\.?\s*max)" + _SEP + _NUMBER + r"\s*(?:MW|kW)"],
    "grid_usage_rate": [r"(?:Sazba\s+(?:za\s+)?použití\s+sítě?)" + _SEP + _NUMBER],
    "service_price": [r"(?:Cena\s+(?:za\s+)?služb[yí])" + _SEP + _NUMBER],
    "renewable_energy_fee": [r"(?:POZE|Podpora\s+(?:obnovitelných|OZE))" + _SEP + _NUMBER],
    "daily_reserved_capacity": [r"(?:Denní\s+rezervovaná\s+kapacita)" + _SEP + _NUMBER + r"\s*(?:m[³3]/den)?"],
    "market_operator_price": [r"(?:Činnost\s+operátora\s+trhu|OTE)" + _SEP + _NUMBER],
    "natural_gas_tax_total": [r"(?:Daň\s+(?:ze\s+)?zemního\s+plynu)" + _SEP + _NUMBER],
}
_GAS = ("consumption_m3", "consumption_mwh", "conversion_factor", "combustion_heat")
DETAILS = {
    "elektrina_nn": ("consumption_low_tariff", "consumption_high_tariff", "distribution_tariff", "circuit_breaker"),
    "elektrina_vn": (
        "supply_consumption", "annual_reserved_capacity", "monthly_reserved_capacity", "reactive_power_quantity", "power_factor", "quarter_hour_max", "grid_usage_rate", "service_price", "renewable_energy_fee",
    ),
    "plyn_MO": _GAS,
    "plyn_VO": (*_GAS, "daily_reserved_capacity", "market_operator_price", "natural_gas_tax_total"),
    "teplo": ("consumption_gj", "heated_area"),
    "voda": ("consumption_m3", "water_rate", "sewage_rate"),
}
TEXTUAL = ("distribution_tariff",)
#: The signs of each commodity.
SIGNS = {
    "elektrina_nn": [r"elektřin|elektrin|elektrick\w*\s+energi|silov\w*\s+elektřin", r"nízké\s+napětí|low\s+voltage", r"distribuční\s+tarif\s*[:\-]?\s*D\d{2}", r"vysoký\s+tarif|nízký\s+tarif"],
    "elektrina_vn": [r"vysoké\s+napětí|high\s+voltage", r"rezervovaná\s+kapacita"],
    "plyn_MO": [r"\bplyn\w*|zemn\w*\s+plyn|natural\s+gas", r"maloodběr", r"spalné\s+teplo|objemový\s+koeficient"],
    "plyn_VO": [r"velkoodběr"],
    "teplo": [r"\btepl[aou]\b|tepeln\w*\s+energi|dálkov\w*\s+vytápění|district\s+heat", r"gigajoul"],
    "voda": [r"\bvod[aouy]\b|vodné|vodného|stočné|stočného|water", r"vodovod|kanalizace", r"pitná\s+voda|odpadní\s+voda|srážková"],
}
#: Abbreviations that are alternatives of a sign, by its place (one more place: a sign of its own). As
#: published they never match, so they count only with ``strict_words``.
ABBREVIATIONS = {
    "elektrina_nn": {1: "nn", 4: "kWh"},
    "elektrina_vn": {0: "vn"},
    "plyn_MO": {1: "MO"},
    "plyn_VO": {0: "VO"},
    "teplo": {1: "GJ"},
}


def signs_of(commodity: str, strict_words: bool = False) -> list[str]:
    own = list(SIGNS[commodity])
    for place, short in ABBREVIATIONS.get(commodity, {}).items() if strict_words else ():
        if place < len(own):
            own[place] += rf"|\b{short}\b"
        else:
            own.append(rf"\b{short}\b")
    return own


def commodity_scores(c: Column, strict_words: bool = False) -> dict[str, Column]:
    """How many of each commodity's signs occur in the text."""
    return {k: sum((F.when(c.rlike(f"(?iuU){p}"), 1).otherwise(0) for p in signs_of(k, strict_words)), F.lit(0)) for k in SIGNS}


def once(c: Column) -> Column:
    """The same value, as an expression that the optimizer never copies into the expressions that read it."""
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def detect_commodity(c: Column, strict_words: bool = False) -> Column:
    """The commodity with most signs, the first declared of equals; null without any. Each sign is looked for once."""
    scores = commodity_scores(c, strict_words)
    names = F.array(*[F.lit(k) for k in scores])
    best = F.transform(F.array(F.array(*scores.values())), lambda s: F.when(F.array_max(s) > 0, F.get(names, (F.array_position(s, F.array_max(s)) - 1).cast("int"))))
    return F.get(best, F.lit(0))


def field(c: Column, name: str, group: int = 1) -> Column:
    return text.first_match(c, PATTERNS[name], group)


def period(c: Column) -> tuple[Column, Column]:
    """First and last day by the first period pattern that gives two dates."""
    found = []
    for p in PATTERNS["period"]:
        found.append([text.parse_date(text.first_match(c, [p], k)) for k in (1, 2)])
    both = [a.isNotNull() & b.isNotNull() for a, b in found]
    return tuple(F.coalesce(*[F.when(ok, pair[k]) for ok, pair in zip(both, found, strict=True)]) for k in (0, 1))


def extract_invoices(texts: DataFrame, as_of: str, text_col: str = "text", hint: str | None = None, strict_words: bool = False) -> DataFrame:
    """``texts`` with commodity, fields, errors, warnings, details (map of the commodity's own fields, null
    if none was found) and confidence. ``as_of`` stands for today in the defaults. Rows without a commodity have an error
    and no confidence."""
    c = F.col(text_col)
    found = detect_commodity(c, strict_words)
    names = ["variable_symbol", "ean_code", "eic_code", "consumption_point_code", "customer_tax_id", "supplier_tax_id", "customer_vat_id", "supplier_vat_id"]
    typed = ["total_amount_inc_vat", "total_amount_ex_vat", "vat_amount", "issue_date", "due_date", "vat_date"]
    users: dict[str, list[str]] = {}
    for k, v in DETAILS.items():
        for n in v:
            users.setdefault(n, []).append(k)
    periods = {f"_p{k}{g}": text.first_match(c, [p], g) for k, p in enumerate(PATTERNS["period"]) for g in (1, 2)}
    # The commodity comes first: patterns of details run only on its texts, and every pattern runs once.
    out = texts.withColumn("commodity", once(F.coalesce(F.col(hint), found) if hint else found))
    own = {n: F.when(F.col("commodity").isin(*ks), field(c, n)) for n, ks in users.items()}
    raw = F.struct(*[field(c, n).alias(n) for n in [*names, *typed, "invoice_number"]], *[v.alias(k) for k, v in (own | periods).items()])
    out = out.withColumn("_raw", once(raw))
    ends = [[text.parse_date(F.col(f"_raw._p{k}{g}")) for g in (1, 2)] for k in range(len(PATTERNS["period"]))]
    out = out.withColumn("_ends", F.coalesce(*[F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("a"), y.alias("b"))) for x, y in ends]))
    out = out.withColumns(
        {n: F.col(f"_raw.{n}") for n in names}
        | {n: text.clean_number(F.col(f"_raw.{n}")) for n in typed[:3]}
        | {n: text.parse_date(F.col(f"_raw.{n}")) for n in typed[3:]}
        | {"_number": F.col("_raw.invoice_number"), "_from": F.col("_ends.a"), "_to": F.col("_ends.b")}
    )
    known = F.col("commodity").isNotNull()
    errors = F.array_compact(F.array(F.when(~known, "no_commodity"), F.when(known & F.col("_number").isNull(), "missing_invoice_number")))
    notes = F.array_compact(F.array(F.when(known & F.col("_from").isNull(), "default_period"), F.when(known & F.col("issue_date").isNull(), "default_issue_date")))
    today = F.lit(as_of).cast("date")
    out = out.withColumns({"errors": errors, "warnings": notes}).withColumns(
        {"invoice_number": F.coalesce("_number", F.lit("UNKNOWN")), "period_from": F.coalesce("_from", F.trunc(today, "month")), "period_to": F.coalesce("_to", today), "issue_date": F.coalesce("issue_date", today)}
    )
    details = F.lit(None).cast("map<string,string>")
    for commodity, own in DETAILS.items():
        values = {n: F.col(f"_raw.{n}") if n in TEXTUAL else text.clean_number(F.col(f"_raw.{n}")).cast("string") for n in own}
        some = F.coalesce(*values.values()).isNotNull()
        pairs = F.map_filter(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]), lambda k, v: v.isNotNull())
        details = F.when((F.col("commodity") == commodity) & some, pairs).otherwise(details)
    sure = rules.regex_confidence(F.size("errors"), F.size("warnings"), F.col("invoice_number"), F.col("ean_code"), F.col("eic_code"), F.col("total_amount_inc_vat"))
    checks = rules.warnings(F.col("invoice_number"), F.coalesce("ean_code", "eic_code", "consumption_point_code"), F.col("issue_date"), F.col("due_date"), F.col("total_amount_inc_vat"), F.lit(False))
    return out.withColumns({"details": details, "confidence": F.when(known, sure), "checks": checks}).drop("_number", "_from", "_to", "_raw", "_ends")


def nested_invoice(flat: DataFrame) -> DataFrame:
    """Flat extracted columns as a nested invoice: reversed periods are swapped, one date stands for both, the
    point code falls back on EAN and EIC, a missing number is UNKNOWN."""
    a, b = F.coalesce("period_from", "period_to"), F.coalesce("period_to", "period_from")
    return flat.select(
        F.coalesce(F.nullif("invoice_number", F.lit("")), F.lit("UNKNOWN")).alias("invoice_number"), "commodity",
        F.struct(F.least(a, b).alias("period_from"), F.greatest(a, b).alias("period_to")).alias("period"),
        F.struct(F.coalesce("consumption_point_code", "ean_code", "eic_code").alias("code"), "ean_code", "eic_code").alias("supply_point"),
        "issue_date", "due_date", F.struct(F.col("total_amount_inc_vat").alias("value"), F.lit("CZK").alias("currency")).alias("total_inc_vat"),
    )
