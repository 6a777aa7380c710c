"""The six named reports, the read-only guard and listings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import store

#: Words that no custom query may contain, and the tables it may read.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "EXECUTE", "EXEC", "CALL", "MERGE", "REPLACE", "COPY")


def error_summary(transactions: DataFrame) -> DataFrame:
    """A1/W1"""
    own = transactions.groupBy("status").agg(F.count("*").alias("count"))
    share = F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 2)
    return own.withColumn("percentage", share.cast("double")).orderBy(F.desc("count"), "status")


def common_errors(transactions: DataFrame, k: int = 10) -> DataFrame:
    """A2"""
    own = transactions.filter((F.col("status") == "error") & F.col("error_message").isNotNull()).groupBy("error_message").agg(F.count("*").alias("occurrences"))
    return own.orderBy(F.desc("occurrences"), "error_message").limit(k)


def frequently_corrected_fields(results: DataFrame, k: int = 10) -> DataFrame:
    """``fields_corrected`` is an array of texts."""
    own = results.filter(F.col("fields_corrected").isNotNull()).select(F.explode("fields_corrected").alias("field_name")).groupBy("field_name").agg(F.count("*").alias("correction_count"))
    return own.orderBy(F.desc("correction_count"), "field_name").limit(k)


def ocr_engine_comparison(results: DataFrame) -> DataFrame:
    """A4"""
    own = results.filter(F.col("error_message").isNull()).groupBy("engine_name").agg(
        F.count("*").alias("sample_size"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.round(F.avg("duration_ms"), 1).alias("avg_duration_ms"),
        F.round(F.avg("cost_usd"), 4).alias("avg_cost_usd"), F.round(F.avg("confidence") / F.nullif(F.avg("cost_usd"), F.lit(0.0)), 2).alias("accuracy_per_dollar"),
    )
    return own.orderBy(F.desc("avg_confidence"), "engine_name")


def extraction_strategy_comparison(results: DataFrame) -> DataFrame:
    """A5"""
    own = results.filter(F.col("error_message").isNull() & F.col("accuracy").isNotNull()).groupBy("strategy_name", "model_name").agg(
        F.count("*").alias("sample_size"), F.round(F.avg("accuracy"), 3).alias("avg_accuracy"), F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        F.round(F.avg("duration_ms"), 1).alias("avg_duration_ms"), F.round(F.avg("cost_usd"), 4).alias("avg_cost_usd"), F.round(F.avg("token_count"), 0).alias("avg_tokens"),
    )
    return own.orderBy(F.desc("avg_accuracy"), "strategy_name", "model_name")


def daily_processing_volume(transactions: DataFrame, days: int = 30) -> DataFrame:
    """A6"""
    own = transactions.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("total"), F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).alias("completed"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors")
    )
    return own.orderBy(F.desc("date")).limit(days)


#: Report name -> the table it reads and how.
REPORTS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "error_summary": ("transactions", error_summary),
    "common_errors": ("transactions", common_errors),
    "frequently_corrected_fields": ("extraction_results", frequently_corrected_fields),
    "ocr_engine_comparison": ("ocr_results", ocr_engine_comparison),
    "extraction_strategy_comparison": ("extraction_results", extraction_strategy_comparison),
    "daily_processing_volume": ("transactions", daily_processing_volume),
}


def run_report(spark: SparkSession, name: str) -> DataFrame:
    """A named report over the session's table or view; an unknown name lists what there is."""
    if name not in REPORTS:
        raise KeyError(f"unknown report {name!r}; available: {', '.join(sorted(REPORTS))}")
    source, build = REPORTS[name]
    return build(spark.table(source))


def guarded(sql: str) -> str:
    """The statement if it is one SELECT without forbidden words, else ValueError."""
    cleaned = sql.strip().rstrip(";").strip()
    if not cleaned:
        raise ValueError("empty query")
    if not cleaned.upper().startswith("SELECT"):
        raise ValueError("only SELECT queries are allowed")
    if ";" in cleaned:
        raise ValueError("only one statement is allowed")
    found = sorted(set(re.findall(r"\b[A-Z_]+\b", cleaned.upper())) & set(FORBIDDEN))
    if found:
        raise ValueError(f"forbidden words: {', '.join(found)}")
    return cleaned


def custom_query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(guarded(sql))


def list_transactions(transactions: DataFrame, results: DataFrame | None = None, status: str | None = None, commodity: str | None = None, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """The page of newest rows (with ``has_extraction``), and one row of totals. Page numbers from 1, sizes 1 to 100."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page must be at least 1, size from 1 to 100")
    for name, wanted in (("status", status), ("commodity", commodity)):
        if wanted is not None:
            transactions = transactions.filter(F.col(name) == wanted)
    totals = transactions.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    rows = transactions.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size)
    if results is not None:
        rows = store.with_flag(rows, results, "id", "transaction_id", "has_extraction")
    return rows, totals


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """No row or one."""
    return df.filter(F.col(key) == value).limit(1)


def pending(transactions: DataFrame) -> DataFrame:
    """P3"""
    return transactions.filter("status = 'pending'")
