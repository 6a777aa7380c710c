"""Tax bands: range join, derived and corrected amounts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values: (first day, last day or None, rate in percent), both days inclusive.
_ENERGY = (("2013-01-01", "2021-10-31", 21.0), ("2021-11-01", "2021-12-31", 0.0), ("2022-01-01", None, 21.0))
BANDS = {
    "elektrina_nn": _ENERGY,
    "elektrina_vn": _ENERGY,
    "plyn_mo": _ENERGY,
    "plyn_vo": _ENERGY,
    "voda": (("2013-01-01", "2020-04-30", 15.0), ("2020-05-01", "2023-12-31", 10.0), ("2024-01-01", None, 12.0)),
    "teplo": (("2013-01-01", "2019-12-31", 15.0), ("2020-01-01", "2023-12-31", 10.0), ("2024-01-01", None, 12.0)),
}
TOLERANCE = 1.0


def vat_bands(spark: SparkSession, bands: dict = BANDS) -> DataFrame:
    """(commodity, valid_from, valid_to, rate): a dimension of a few rows."""
    day = lambda s: None if s is None else dt.date.fromisoformat(s) if isinstance(s, str) else s
    rows = [(c, day(a), day(b), float(r)) for c, own in bands.items() for a, b, r in own]
    return spark.createDataFrame(rows, "commodity string, valid_from date, valid_to date, rate double")


def contiguous(bands: DataFrame) -> DataFrame:
    """(commodity, contiguous): whether a commodity's bands leave no day out and only the last one is open."""
    follows = F.lead("valid_from").over(Window.partitionBy("commodity").orderBy("valid_from"))
    ok = F.when(follows.isNull(), F.col("valid_to").isNull()).otherwise(F.coalesce(follows <= F.date_add("valid_to", 1), F.lit(False)))
    return bands.select("commodity", ok.alias("ok")).groupBy("commodity").agg(F.bool_and("ok").alias("contiguous"))


def with_rate(df: DataFrame, bands: DataFrame, commodity: str = "commodity", day: str = "period_to", rate: str = "vat_rate") -> DataFrame:
    """Left range join with the band that holds the day; no such band, commodity or day gives a null rate.

    The commodity stays an equi-key, so the broadcast dimension is hashed and the dates are a residual filter.
    """
    b = F.broadcast(bands.select(F.col("commodity").alias("_c"), "valid_from", "valid_to", F.col("rate").alias(rate)))  # a few rows per commodity
    on = (F.lower(F.col(commodity)) == F.col("_c")) & (F.col(day) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(day) <= F.col("valid_to")))
    return df.join(b, on, "left").drop("_c", "valid_from", "valid_to")


def derive_amounts(ex: Column, inc: Column, rate: Column) -> dict[str, Column]:
    """With exactly one amount and a known rate, the other one to two decimals."""
    factor = 1 + rate / 100
    derived = (ex.isNull() != inc.isNull()) & rate.isNotNull()
    return {
        "amount_ex_vat": F.when(derived & ex.isNull(), F.round(inc / factor, 2)).otherwise(ex),
        "amount_inc_vat": F.when(derived & inc.isNull(), F.round(ex * factor, 2)).otherwise(inc),
        "was_derived": derived,
    }


def correct_inc(ex: Column, inc: Column, rate: Column, tolerance: float = TOLERANCE) -> dict[str, Column]:
    """D3: the amount with tax computed anew where it is missing or off by more than the tolerance."""
    computed = F.round(ex * (1 + rate / 100), 2)
    wrong = F.coalesce(computed.isNotNull() & (inc.isNull() | (F.abs(inc - computed) > tolerance)), F.lit(False))
    return {"amount_inc_vat": F.when(wrong, computed).otherwise(inc), "was_corrected": wrong, "computed_value": computed}


def correct_invoices(invoices: DataFrame, bands: DataFrame, tolerance: float = TOLERANCE, enabled: bool = True) -> DataFrame:
    """D3 over invoices: the rate of the issue date, else of the first day of the period; adds the audit columns
    extracted_value, computed_value, vat_rate, was_corrected. Switched off, nothing changes."""
    dated = with_rate(invoices.withColumn("_day", F.coalesce("issue_date", "period_from")), bands, day="_day")
    own = correct_inc(F.col("amount_ex_vat"), F.col("amount_inc_vat"), F.col("vat_rate"), tolerance)
    if not enabled:
        own |= {"amount_inc_vat": F.col("amount_inc_vat"), "was_corrected": F.lit(False)}
    return dated.withColumn("extracted_value", F.col("amount_inc_vat")).withColumns(own).drop("_day")
