"""The field registry and tiers as data: fixed values of the domain, in their natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMODITIES = ("elektrina_nn", "elektrina_vn", "plyn_mo", "plyn_vo", "teplo", "voda")

#: (name, type, required) of the fields that all commodities have.
BASE = (
    ("invoice_number", "string", True),
    ("period_from", "date", True),
    ("period_to", "date", True),
    ("issue_date", "date", False),
    ("due_date", "date", False),
    ("tax_point_date", "date", False),
    ("consumption_point_code", "string", True),
)
#: More of them, but for electricity at high voltage.
AMOUNTS_AND_IDS = (
    ("amount_ex_vat", "float", True),
    ("amount_inc_vat", "float", True),
    ("supplier_tax_id", "string", True),
    ("customer_tax_id", "string", True),
)
#: Those of one commodity.
OWN = {
    "elektrina_nn": (
        ("consumption_high_tariff", "float", False),
        ("consumption_low_tariff", "float", False),
        ("total_consumption", "float", False),
    ),
    "elektrina_vn": (
        ("supply_consumption", "float", True),
        ("supply_charge", "float", True),
        ("supply_tax_charge", "float", False),
        ("quarter_hour_max", "float", False),
        ("annual_reserved_capacity", "float", False),
        ("annual_reserved_capacity_charge", "float", False),
        ("monthly_reserved_capacity", "float", False),
        ("monthly_reserved_capacity_charge", "float", False),
        ("grid_usage_rate", "float", False),
        ("grid_usage_charge", "float", False),
        ("reserved_capacity_excess", "float", False),
        ("reserved_capacity_excess_rate", "float", False),
        ("power_factor", "float", False),
        ("reactive_power_quantity", "float", False),
        ("reactive_power_rate", "float", False),
        ("reactive_power_charge", "float", False),
        ("service_price", "float", False),
        ("operating_price", "float", False),
        ("renewable_energy_fee", "float", False),
    ),
    "plyn_mo": (
        ("conversion_coefficient", "float", True),
        ("combustion_heat", "float", True),
        ("consumption_mwh", "float", True),
        ("consumption_m3", "float", True),
        ("gas_tax_total", "float", True),
        ("unit_price_commodity", "float", False),
        ("commodity_price", "float", False),
        ("unit_price_standing_charge", "float", False),
        ("standing_charge", "float", False),
        ("unit_price_reserved_capacity", "float", False),
        ("reserved_capacity_price", "float", False),
        ("unit_price_distribution", "float", False),
        ("distribution_price", "float", False),
        ("market_operator_fee", "float", False),
    ),
    "plyn_vo": (
        ("conversion_coefficient", "float", True),
        ("combustion_heat", "float", True),
        ("consumption_mwh", "float", True),
        ("consumption_m3", "float", True),
        ("daily_reserved_capacity", "float", True),
        ("gas_tax_total", "float", True),
        ("other_supply_services", "float", False),
        ("unit_price_trade_reserved_capacity", "float", False),
        ("trade_reserved_capacity_price", "float", False),
        ("distribution_services_price", "float", False),
        ("unit_price_distr_services", "float", False),
        ("unit_price_distr_reserved_capacity", "float", False),
        ("distribution_reserved_capacity_price", "float", False),
        ("market_operator_fee", "float", False),
    ),
    "teplo": (
        ("consumption_gj", "float", True),
        ("hot_water_consumption", "float", True),
        ("cold_water_consumption", "float", False),
        ("reserved_capacity", "float", True),
        ("supplementary_water", "float", True),
        ("total_heat_consumption", "float", False),
    ),
    "voda": (
        ("consumption_vodne_m3", "float", True),
        ("consumption_stocne_m3", "float", True),
        ("consumption_odpadni_m3", "float", False),
        ("consumption_srazkove_m3", "float", False),
    ),
}
MANDATORY_BASE = ("invoice_number", "period_from", "period_to", "total_amount_ex_vat", "total_amount_inc_vat")
MANDATORY_OWN = {
    "elektrina_nn": ("consumption_low_tariff", "consumption_high_tariff"),
    "elektrina_vn": ("supply_consumption",),
    "plyn_mo": ("consumption_m3", "combustion_heat", "consumption_mwh"),
    "plyn_vo": ("consumption_m3", "combustion_heat", "consumption_mwh"),
    "voda": ("water_rate", "sewage_rate"),
    "teplo": ("heat_consumption", "variable_charge"),
}
#: Columns of ground-truth files that go by another name in the registry.
ALIASES = {"total_amount_ex_vat": "amount_ex_vat", "total_amount_inc_vat": "amount_inc_vat"}


def fields_of(commodity: str | None) -> list[tuple[str, str, bool]]:
    """(name, type, required) of a commodity's fields; of the common fields where it is unknown."""
    key = (commodity or "").lower()
    return [*BASE, *(() if key == "elektrina_vn" else AMOUNTS_AND_IDS), *OWN.get(key, ())]


def field_registry(spark: SparkSession) -> DataFrame:
    """(commodity, position, field_name, field_type, is_required): a small dimension."""
    rows = [(c, k, n, t, r) for c in COMMODITIES for k, (n, t, r) in enumerate(fields_of(c))]
    return spark.createDataFrame(rows, "commodity string, position int, field_name string, field_type string, is_required boolean")


def mandatory_fields(commodity: str) -> list[str]:
    return [*MANDATORY_BASE, *MANDATORY_OWN.get(commodity.lower(), ())]


def required_first(registry: DataFrame) -> DataFrame:
    """Required fields before the others, by name."""
    return registry.orderBy("commodity", F.desc("is_required"), "field_name")


def json_schema(commodity: str) -> dict:
    """every field a nullable string, with an object of confidences; nothing else allowed."""
    names = [n for n, _, _ in fields_of(commodity)]
    props = {n: {"type": ["string", "null"]} for n in names}
    props["_confidence"] = {"type": "object", "properties": {n: {"type": "number"} for n in names}, "required": names, "additionalProperties": False}
    return {"type": "object", "properties": props, "required": [*names, "_confidence"], "additionalProperties": False}


def extraction_struct(commodity: str) -> str:
    """The same schema as a Spark type."""
    names = [n for n, _, _ in fields_of(commodity)]
    return "struct<" + ",".join(f"{n}:string" for n in names) + ",_confidence:map<string,double>>"


def truth_record(truth: DataFrame, commodity: str, *keys: str) -> DataFrame:
    """``keys`` and one text per registered field of a row of ground truth: the field's own column, else the one that
    goes by its alias; numbers with two decimals, dates as ISO days, other texts trimmed; '' where there is nothing."""
    from ledgerloom.functions import text

    other = {field: column for column, field in ALIASES.items()}
    out = []
    for name, kind, _ in fields_of(commodity):
        sources = [F.col(c).cast("string") for c in (name, other.get(name, name)) if c in truth.columns]
        raw = F.coalesce(*sources[:1], F.lit("")) if sources else F.lit("")
        if kind == "float":
            value = text.format_amount(text.safe_float(raw))
        elif kind == "date":
            value = F.date_format(F.coalesce(text.safe_iso_date(raw), text.parse_date(raw)), "yyyy-MM-dd")
        else:
            value = F.trim(raw)
        out.append(F.coalesce(value, F.lit("")).alias(name))
    return truth.select(*keys, *out)
