"""Field evaluation: match flags, metrics at three levels, calibration, intervals, effect sizes."""

from __future__ import annotations

import math
import random
import statistics

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import similarity, text

#: Evaluated fields and those compared as numbers or dates as well.
EVAL_FIELDS = (
    "invoice_number", "variable_symbol", "customer_tax_id", "supplier_tax_id", "period_from", "period_to", "issue_date", "due_date",
    "total_amount_inc_vat", "total_amount_ex_vat", "commodity", "ean_code", "eic_code", "supply_point_code",
)
NUMERIC_FIELDS = ("total_amount_inc_vat", "total_amount_ex_vat")
DATE_FIELDS = ("period_from", "period_to", "issue_date", "due_date")


def match_flags(expected: Column, extracted: Column, field: Column, normal_form: bool = False) -> dict[str, Column]:
    """comparisons see the raw text, ``extracted`` is null where it is absent."""
    exact = similarity.exact_match(expected, extracted, normal_form)
    number, date = similarity.numeric_match(expected, extracted), similarity.date_match(expected, extracted)
    rate = similarity.char_error_rate(expected, extracted, normal_form)
    return {
        "is_present": text.present(extracted), "is_exact_match": exact, "is_fuzzy_match": F.coalesce(1 - rate >= 0.9, F.lit(False)), "is_numeric_match": number, "is_date_match": date,
        "is_correct": exact | (field.isin(*NUMERIC_FIELDS) & number) | (field.isin(*DATE_FIELDS) & date), "cer": rate, "is_evaluable": expected.isNotNull(),
    }


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def _n(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def field_metrics(long: DataFrame, *group: str) -> DataFrame:
    """Per field over evaluable rows with the flags of :func:`match_flags`."""
    own = long.filter("is_evaluable").groupBy(*group, "field_name").agg(
        F.count("*").alias("n_evaluable"), _n(F.col("is_correct")).alias("n_correct"), _n(F.col("is_present")).alias("n_present"),
        _n(F.col("is_correct") & F.col("is_present")).alias("n_true_positive"), F.avg("cer").alias("mean_cer"),
    )
    p, r = ratio(F.col("n_true_positive"), F.col("n_present")), ratio(F.col("n_true_positive"), F.col("n_evaluable"))
    return own.withColumns({"precision": p, "recall": r, "f1": f1(p, r), "accuracy": ratio(F.col("n_correct"), F.col("n_evaluable")), "extraction_rate": ratio(F.col("n_present"), F.col("n_evaluable"))})


def invoice_metrics(long: DataFrame, *keys: str) -> DataFrame:
    """Per invoice; 0 where no field is evaluable, and then a null error rate."""
    on = F.col("is_evaluable")
    own = long.groupBy(*keys).agg(
        _n(on).alias("n_evaluable"), _n(on & F.col("is_exact_match")).alias("n_exact"), _n(on & F.col("is_correct")).alias("n_correct"), _n(on & F.col("is_present")).alias("n_present"),
        F.avg(F.when(on, F.col("cer"))).alias("mean_cer"),
    )
    shares = {name: ratio(F.col(c), F.col("n_evaluable")) for name, c in (("exact_accuracy", "n_exact"), ("composite_accuracy", "n_correct"), ("extraction_rate", "n_present"))}
    return own.withColumns(shares).select(*keys, "n_evaluable", *shares, "mean_cer")


def corpus_metrics(invoices: DataFrame, *group: str) -> DataFrame:
    """A21-A23 from (composite_accuracy, exact_accuracy, extraction_rate, mean_cer, latency_ms, cost_usd, failed): means
    over invoices that did not fail; cost, and the latency in the throughput, over all."""
    ok = ~F.col("failed")
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    return invoices.groupBy(*group).agg(
        F.count("*").alias("n_invoices"), _n(ok).alias("n_ok"), mean("exact_accuracy").alias("exact_accuracy"), mean("composite_accuracy").alias("composite_accuracy"),
        mean("extraction_rate").alias("extraction_rate"), mean("mean_cer").alias("mean_cer"), (1 - mean("mean_cer")).alias("similarity"), mean("latency_ms").alias("mean_latency_ms"),
        F.sum("cost_usd").alias("total_cost_usd"), (_n(ok) / F.nullif(F.sum("latency_ms") / 1000, F.lit(0.0))).alias("throughput"),
        (mean("composite_accuracy") / F.nullif(F.sum("cost_usd"), F.lit(0.0))).alias("cost_efficiency"),
    )


def strategy_key(strategy: Column, model: Column, with_model: bool = True) -> Column:
    """A27"""
    return F.when(F.lit(with_model) & text.truthy(model), F.concat_ws("/", strategy, model)).otherwise(strategy)


def field_status(expected: Column, predicted: Column) -> Column:
    """Of normalised texts: no_gt, tp, fp or fn."""
    return F.when(~text.truthy(expected), "no_gt").when(F.coalesce(predicted, F.lit("")) == expected, "tp").when(text.truthy(predicted), "fp").otherwise("fn")


def rescored(status: Column, expected: Column, predicted: Column) -> Column:
    """A missing value is right where the truth is zero."""
    return F.when((status == "fn") & text.is_zero(expected) & ~text.truthy(predicted), "tp").otherwise(status)


def precision_recall(rows: DataFrame, *group: str, status: str = "status") -> DataFrame:
    """Counts, precision, recall, F1 and accuracy from statuses; no_gt rows count for nothing."""
    n = {s: _n(F.col(status) == s).alias(s) for s in ("tp", "fp", "fn")}
    own = rows.filter(F.col(status) != "no_gt").groupBy(*group).agg(*n.values())
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return own.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1(p, r), 4), "accuracy": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), 4)})


def macro(per_group: DataFrame, value: str) -> DataFrame:
    """Mean of group means and the worst group."""
    return per_group.agg(F.avg(value).alias("macro_mean"), F.min(value).alias("worst"))


def calibration_bins(samples: DataFrame, confidence: str, accuracy: str, *group: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with their mean confidence, mean accuracy and gap; groups without any confidence drop out."""
    at = F.least(F.floor(F.col(confidence) / (1.0 / bins)), F.lit(bins - 1)).cast("int").alias("bin")
    own = samples.groupBy(*group, at).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(accuracy).alias("mean_accuracy"), F.max(confidence).alias("_top"))
    over = Window.partitionBy(*group)
    own = own.withColumns({"_any": F.max("_top").over(over), "share": F.col("n") / F.sum("n").over(over)}).filter("_any > 0")
    return own.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("mean_accuracy"))).drop("_top", "_any")


def calibration(bins: DataFrame, *group: str) -> DataFrame:
    """Expected and largest calibration error."""
    return bins.groupBy(*group).agg(F.sum(F.col("share") * F.col("gap")).alias("ece"), F.max("gap").alias("mce"))


def bootstrap_values(values: list[float], rng: random.Random, n: int = 2000, level: float = 0.95, statistic: str = "mean") -> tuple[float, float, float]:
    """Point, lower and upper percentile of resampled means or medians."""
    pick = statistics.fmean if statistic == "mean" else statistics.median
    size, alpha = len(values), 1 - level
    found = sorted(pick([values[rng.randrange(size)] for _ in range(size)]) for _ in range(n))
    return pick(values), found[max(0, math.floor(alpha / 2 * n))], found[min(n - 1, math.ceil((1 - alpha / 2) * n) - 1)]


def bootstrap_intervals(samples: DataFrame, group: str, value: str, n: int = 2000, seed: int = 42, statistic: str = "mean") -> DataFrame:
    """One interval per group, each group with the seed of its own (so groups do not depend on their order)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(pdf[value].dropna().tolist())
        if not own:
            return pd.DataFrame({group: [], "point": [], "lower": [], "upper": [], "n": []})
        point, low, high = bootstrap_values(own, random.Random(seed), n, statistic=statistic)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "point": [point], "lower": [low], "upper": [high], "n": [len(own)]})

    return samples.groupBy(group).applyInPandas(one, f"{group} {dict(samples.dtypes)[group]}, point double, lower double, upper double, n long")


def effect_sizes(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Cohen's d of every two groups in order, by population variances, with its label."""
    own = samples.groupBy(group).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    a, b = (own.select(F.col(group).alias(f"group_{x}"), F.col("m").alias(f"m{x}"), F.col("v").alias(f"v{x}")) for x in "ab")
    spread = F.sqrt((F.col("va") + F.col("vb")) / 2)
    d = F.when(spread > 0, (F.col("ma") - F.col("mb")) / F.nullif(spread, F.lit(0.0))).otherwise(0.0)
    pairs = a.join(b, F.col("group_a") < F.col("group_b"))  # one row per group on either side
    label = F.when(F.abs("d") < 0.2, "negligible").when(F.abs("d") < 0.5, "small").when(F.abs("d") < 0.8, "medium").otherwise("large")
    return pairs.select("group_a", "group_b", d.alias("d")).withColumn("effect", label)


#: Fixed values: (criterion, measure, threshold, whether the measure must be at least the threshold).
CRITERIA = (
    ("K1", "macro_f1", 0.60, True), ("K2", "invoice_number", 0.85, True), ("K3", "supplier_tax_id", 0.85, True), ("K4", "customer_tax_id", 0.85, True),
    ("K5", "amount_inc_vat", 0.85, True), ("K6", "due_date", 0.85, True), ("K7", "json_validity", 0.98, True), ("K8", "latency_s", 60.0, False), ("K9", "f1_q3", 0.45, True),
)


def acceptance(measures: DataFrame, criteria=CRITERIA) -> DataFrame:
    """A28 from (measure, value): each criterion with its value (a missing one counts as 0) and whether it is met."""
    dim = measures.sparkSession.createDataFrame([(k, m, t, up) for k, m, t, up in criteria], "criterion string, measure string, threshold double, at_least boolean")
    met = F.when(F.col("at_least"), F.coalesce("value", F.lit(0.0)) >= F.col("threshold")).otherwise(F.coalesce("value", F.lit(0.0)) <= F.col("threshold"))
    return F.broadcast(dim).join(measures, "measure", "left").withColumn("met", met)


def before_after(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, before, after, delta) of two tables with one row per key."""
    long = lambda df, name: df.select(key, *[F.col(m).cast("double") for m in metrics]).unpivot(key, metrics, "metric", name)
    return long(before, "before").join(long(after, "after"), [key, "metric"]).withColumn("delta", F.col("after") - F.col("before"))


def best_strategy(results: DataFrame, key: str, strategy: str = "strategy", score: str = "confidence", position: str = "position") -> DataFrame:
    """The first of the best-scoring rows per key; scores must be above 0."""
    first = Window.partitionBy(key).orderBy(F.desc(score), position)
    return results.filter(F.col(score) > 0).withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(key, F.col(strategy).alias("best_strategy"), F.col(score).alias("best_score"))


def field_accuracy(results: DataFrame, statuses: str = "per_field_json") -> DataFrame:
    """(field_name, tp, present, accuracy) from JSON maps of field name to an object with its status; fields without
    truth count for nothing."""
    parsed = F.from_json(statuses, "map<string,struct<status:string>>")
    own = results.select(F.explode(parsed).alias("field_name", "o")).select("field_name", F.col("o.status").alias("status")).filter(F.col("status").isin("tp", "fp", "fn"))
    out = own.groupBy("field_name").agg(_n(F.col("status") == "tp").alias("tp"), F.count("*").alias("present"))
    return out.withColumn("accuracy", F.round(F.col("tp") / F.col("present"), 4))


def correction_effect(rows: DataFrame, truth: str, raw: str, corrected: str, tolerance: float = 0.005) -> DataFrame:
    """The share of known amounts that match before and after the correction (null where none is known), and how many
    it changed."""
    known = F.col(truth).isNotNull()
    hit = lambda c: _n(known & F.coalesce(F.abs(F.col(c) - F.col(truth)) < tolerance, F.lit(False)))
    own = rows.agg(_n(known).alias("present"), hit(raw).alias("before"), hit(corrected).alias("after"), _n(~F.col(raw).eqNullSafe(F.col(corrected))).alias("corrected"))
    share = lambda c: F.round(F.col(c) / F.nullif("present", F.lit(0)), 4)
    return own.select("present", "corrected", share("before").alias("accuracy_before"), share("after").alias("accuracy_after"))
