"""Saving, deduplicating and linking stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.functions import text


def decimals(names: str, precision: int, scale: int) -> list[T.StructField]:
    return [T.StructField(n, T.DecimalType(precision, scale)) for n in names.split()]


def new_invoices(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("invoice_number", "commodity", "supplier_cin")) -> DataFrame:
    """Incoming rows without an equal stored one; null equals null."""
    a, b = incoming.alias("a"), stored.select(*keys).distinct().alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left_anti").select("a.*")


def existing_ids(incoming: DataFrame, stored: DataFrame, id_col: str = "id", keys: tuple[str, ...] = ("invoice_number", "commodity", "supplier_cin")) -> DataFrame:
    """Incoming rows with the least id of an equal stored row, null where there is none."""
    first = stored.groupBy(*keys).agg(F.min(id_col).alias("existing_id")).alias("b")
    return incoming.alias("a").join(first, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("a.*", "b.existing_id")


def cascade_delete(details: DataFrame, deleted: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Details without those of deleted parents."""
    return details.join(deleted.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def set_null(children: DataFrame, deleted: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children with the reference to a deleted parent removed."""
    gone = deleted.select(F.col(key).alias("_k")).distinct().withColumn("_gone", F.lit(True))
    return children.join(gone, children[foreign] == gone["_k"], "left").withColumn(foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).drop("_k", "_gone")


def keep_last(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row per key by position."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(position)))).filter("_r = 1").drop("_r")


def match_ground_truth(files: DataFrame, truth: DataFrame, commodity: str = "commodity", stem: str = "stem", position: str = "position") -> DataFrame:
    """The truth of (commodity, stem), else of ('', stem); of several rows the last counts; ``has_truth`` says if any."""
    last = keep_last(truth, [commodity, stem], position)
    values = [c for c in truth.columns if c not in (commodity, stem, position)]
    exact = last.select(commodity, stem, F.struct(*values).alias("_exact"))
    loose = last.filter(F.col(commodity) == "").select(stem, F.struct(*values).alias("_loose"))
    out = files.join(exact, [commodity, stem], "left").join(loose, stem, "left").withColumn("_t", F.coalesce("_exact", "_loose"))
    return out.withColumn("has_truth", F.col("_t").isNotNull()).select(*files.columns, "has_truth", *[F.col(f"_t.{v}").alias(v) for v in values])


def latest_child(parents: DataFrame, children: DataFrame, key: str, foreign: str, at: str, tie: str) -> DataFrame:
    """Parents with their newest child, nulls without one."""
    newest = children.withColumn("_r", F.row_number().over(Window.partitionBy(foreign).orderBy(F.desc(at), F.desc(tie)))).filter("_r = 1").drop("_r")
    return parents.join(newest, parents[key] == newest[foreign], "left")


def with_flag(parents: DataFrame, children: DataFrame, key: str, foreign: str, flag: str) -> DataFrame:
    """Whether a parent has any child."""
    some = children.select(F.col(foreign).alias(key)).distinct().withColumn(flag, F.lit(True))
    return parents.join(some, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order, missing ones as typed nulls, unknown ones after them."""
    own = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*own, *[c for c in df.columns if c not in schema.names])


def stored_name(content: str = "content", path: str = "path"):
    """Eight hex digits of the content's MD5, then the file's name."""
    return F.concat_ws("_", F.substring(F.md5(content), 1, 8), F.regexp_extract(path, r"([^/\\]*)$", 1))


#: The detail tables by commodity.
DETAIL_TABLES = {
    "elektrina_nn": "electricity_nn_details", "elektrina_vn": "electricity_vn_details", "plyn_mo": "gas_mo_details", "plyn_vo": "gas_vo_details", "voda": "water_details", "teplo": "heat_details",
}


def save_plan(invoices: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """What to append to each of the seven tables: new invoices with cleaned identifiers, their details exploded."""
    own = invoices.withColumns({"commodity": F.lower("commodity"), "supplier_cin": text.clean_tax_id("supplier_cin"), "customer_cin": text.clean_tax_id("customer_cin"), "supply_point_code": text.clean_point_code("supply_point_code")})
    fresh = new_invoices(own.dropDuplicates(["invoice_number", "commodity", "supplier_cin"]), stored)
    tables = {"invoices": fresh.drop("details")}
    for commodity, name in DETAIL_TABLES.items():
        tables[name] = fresh.filter(F.col("commodity") == commodity).select(F.col("id").alias("invoice_id"), F.explode("details").alias("d")).select("invoice_id", "d.*")
    return tables


def non_null_count(names: list[str], numbers: tuple[str, ...] = ()):
    """How many of the columns hold something; 0 and '' do not."""
    return sum((F.when(text.truthy(n, "number" if n in numbers else "string"), 1).otherwise(0) for n in names), F.lit(0))


def null_share(names: list[str], numbers: tuple[str, ...] = ()):
    """P12"""
    return 1 - non_null_count(names, numbers) / len(names)


#: What counts as extracted, of an invoice and of each of its details by commodity.
COUNTED = (
    "invoice_number", "variable_symbol", "ean_code", "eic_code", "period_from", "period_to", "issue_date", "due_date", "customer_tax_id", "supplier_tax_id", "total_amount_inc_vat", "total_amount_ex_vat",
)
COUNTED_DETAILS = {
    "elektrina_nn": ("consumption_low_tariff", "consumption_high_tariff", "distribution_tariff"),
    "elektrina_vn": ("supply_consumption", "annual_reserved_capacity", "peak_consumption"),
    "plyn_mo": ("consumption_m3", "consumption_mwh"),
    "plyn_vo": ("consumption_m3", "consumption_mwh"),
    "voda": ("consumption_m3",),
    "teplo": ("consumption_gj", "heat_consumption"),
}


def extracted_fields(invoices: DataFrame, details: str = "details", commodity: str = "commodity"):
    """How many of the counted fields an invoice and its details (an array of maps of texts) hold. An unknown number,
    zeros and empty texts are nothing."""
    def filled(c):
        return F.when(F.coalesce((c != "") & ~F.coalesce(c.try_cast("double") == 0, F.lit(False)), F.lit(False)), 1).otherwise(0)

    own = sum((filled(F.nullif(F.col(c).cast("string"), F.lit("UNKNOWN")) if c == "invoice_number" else F.col(c).cast("string")) for c in COUNTED if c in invoices.columns), F.lit(0))
    names = F.create_map(*[x for k, v in COUNTED_DETAILS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = F.coalesce(F.try_element_at(names, F.lower(commodity)), F.array().cast("array<string>"))
    inner = F.aggregate(F.col(details), F.lit(0), lambda n, d: n + F.aggregate(wanted, F.lit(0), lambda m, w: m + filled(F.try_element_at(d, w))))
    return own + F.coalesce(inner, F.lit(0))
