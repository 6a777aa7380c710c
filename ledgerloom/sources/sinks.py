"""Sinks: CSV and JSON reports, appends with a growing schema, vector tables, anonymised sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import store

#: Columns that an anonymised set does not have.
SENSITIVE = ("pdf_name", "supplier", "extracted", "gt", "gt_json", "extracted_json", "doc_id")


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None, files: int | None = 1) -> None:
    """With a header, rounded as asked, nulls as empty. Reports are small: one file, unless told otherwise."""
    out = df.withColumns({c: F.round(c, n) for c, n in (digits or {}).items()})
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """S9/S13"""
    df.write.mode("overwrite").json(path)


def json_report(evaluations: DataFrame, corpus: DataFrame, key: str = "strategy") -> DataFrame:
    """One JSON text per strategy with its evaluations, in order, and its corpus metrics. A report is one text, so this is
    meant for reports; tables of any size go to :func:`write_json_lines`."""
    own = evaluations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in evaluations.columns if c != key]))).alias("evaluations"))
    whole = corpus.select(key, F.struct(*[c for c in corpus.columns if c != key]).alias("corpus"))
    return own.join(whole, key, "full").select(key, F.to_json(F.struct("evaluations", "corpus")).alias("report"))


def append(df: DataFrame, spark: SparkSession, path: str) -> None:
    """Appends to a Parquet table; columns that either side lacks become typed nulls on reading."""
    try:
        known = spark.read.option("mergeSchema", "true").parquet(path).schema
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        known = None
    (store.conform(df, known) if known is not None else df).write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_vectors(df: DataFrame, path: str, id_col: str = "id", vector: str = "embedding") -> None:
    """Unit vectors as doubles with their metadata."""
    from ledgerloom.functions.similarity import unit

    df.withColumn(vector, unit(vector)).write.mode("overwrite").parquet(path)


def anonymised(df: DataFrame, id_col: str, sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """A ten-digit digest of the id first, sensitive columns gone."""
    return df.select(F.substring(F.sha1(F.col(id_col).cast("string")), 1, 10).alias("doc_id"), *[c for c in df.columns if c not in sensitive and c not in (id_col, "doc_id")])


def text_table(df: DataFrame, limit: int = 100) -> str:
    """A small aggregate as aligned text."""
    rows = [df.columns, *[["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(limit).collect()]]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def run_outputs(folder: str, results: DataFrame, summary: DataFrame, audit: DataFrame, digits: dict[str, int] | None = None) -> dict[str, str]:
    """A run's files under ``folder``: results as CSV and as JSON lines, the summary as JSON, the audit of corrected
    amounts as CSV; where each one is."""
    paths = {n: f"{folder.rstrip('/')}/{n}" for n in ("results_csv", "results_jsonl", "summary_json", "audit_csv")}
    write_csv(results, paths["results_csv"], digits)
    write_json_lines(results, paths["results_jsonl"])
    summary.coalesce(1).write.mode("overwrite").json(paths["summary_json"])  # a small aggregate
    write_csv(audit, paths["audit_csv"])
    return paths


def field_report(fields: DataFrame, title: str = "fields") -> str:
    """Per-field metrics as text, worst first."""
    return f"{title}\n" + text_table(fields.orderBy("f1", "field_name"))


def effect_report(effects: DataFrame) -> str:
    """Effect sizes as text, largest first."""
    return text_table(effects.orderBy(F.desc(F.abs("d")), "group_a", "group_b"))


def interval_report(intervals: DataFrame, group: str) -> str:
    """Point estimates with their intervals as text."""
    shown = F.format_string("%.4f [%.4f, %.4f]", "point", "lower", "upper")
    return text_table(intervals.orderBy(group).select(group, "n", shown.alias("interval")))
