"""Native or scanned: four classifiers over page metrics, and the feedback averages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators.streamed import ordered_pass

#: Fixed values of the first classifier.
MIN_CHARS, MIN_CODE_POINTS, MIN_FONTS, MIN_TEXT_PAGES, MAX_IMAGES, MIN_PAGE_CHARS, PAGES = 200, 15, 2, 0.8, 0.6, 50, 20


def steps(value: Column, limits: list[tuple[float, float]], last: float) -> Column:
    """The score of the first limit that the value is under, else the last one."""
    out = F.lit(last)
    for limit, score in reversed(limits):
        out = F.when(value < limit, score).otherwise(out)
    return out


def document_metrics(pages: DataFrame, key: str = "doc_id", generation: str = "v1") -> DataFrame:
    """Per document from (key, page, text, fonts map<string,int>, image_area, page_area), up to 20 pages."""
    own = pages.filter(F.col("page") < PAGES)
    chars = own.select(key, F.explode(F.array_distinct(F.filter(F.split("text", ""), lambda x: x != ""))).alias("c")).groupBy(key).agg(F.count_distinct("c").alias("codepoint_diversity"))
    fonts = own.select(key, F.explode("fonts").alias("font", "n")).groupBy(key).agg(F.count_distinct("font").alias("font_count"))
    no_page = 1.0 if generation == "v1" else 0.0
    base = own.groupBy(key).agg(
        F.sum(F.length("text")).alias("total_chars"), F.count("*").alias("total_pages"), F.sum(F.when(F.length("text") >= MIN_PAGE_CHARS, 1).otherwise(0)).alias("pages_with_text"),
        F.coalesce(F.sum("image_area") / F.nullif(F.sum("page_area"), F.lit(0.0)), F.lit(no_page)).alias("image_area_ratio"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("codepoint_diversity", "font_count")}
    return base.join(chars, key, "left").join(fonts, key, "left").withColumns(zero).withColumn("page_text_ratio", F.col("pages_with_text") / F.col("total_pages"))


def classify_v1() -> dict[str, Column]:
    """D26 over document metrics: native only if all five criteria hold; ``failed`` names those that do not."""
    failed = F.array_compact(
        F.array(
            F.when(F.col("total_chars") < MIN_CHARS, "total_chars"), F.when(F.col("codepoint_diversity") < MIN_CODE_POINTS, "codepoint_diversity"),
            F.when(F.col("font_count") < MIN_FONTS, "font_count"), F.when(F.col("page_text_ratio") < MIN_TEXT_PAGES, "page_text_ratio"), F.when(F.col("image_area_ratio") > MAX_IMAGES, "image_area_ratio"),
        )
    )
    return {"failed": failed, "kind_v1": F.when(F.size(failed) == 0, "native_pdf").otherwise("scanned")}


def corruption(full_text: Column, invalid: Column) -> Column:
    """Invalid code points, low entropy and odd spacing, weighted; 0 for empty text."""
    n = F.greatest(F.length(full_text), F.lit(1))
    odd = F.size(F.regexp_extract_all(full_text, F.lit("  +"), F.lit(0))) + F.size(F.regexp_extract_all(full_text, F.lit("\n\n\n+"), F.lit(0)))
    spacing = F.least(F.lit(1.0), odd / F.greatest(n / 100, F.lit(1.0)))
    dull = F.greatest(F.lit(0.0), (4.5 - text.shannon_entropy(full_text)) / 2)
    return F.when(F.length(full_text) > 0, F.least(F.lit(1.0), invalid / n * 0.4 + dull * 0.35 + spacing * 0.25)).otherwise(0.0)


def classify_v2(invisible: Column, total_chars: Column, full_text: Column, invalid: Column, image_ratio: Column, fonts: Column, garbled: Column | None = None) -> dict[str, Column]:
    """Four scores, their weighted sum, the decision and its confidence. Uncertain documents count as scanned."""
    hidden = steps(invisible / F.greatest(total_chars, F.lit(1)), [(0.1, 0.05), (0.3, 0.30), (0.6, 0.60)], 0.90)
    garbled = garbled if garbled is not None else corruption(full_text, invalid)
    images = steps(image_ratio, [(0.20, 0.0), (0.40, 0.1), (0.60, 0.3), (0.80, 0.7)], 0.95)
    density = steps(total_chars / F.greatest(fonts, F.lit(1)), [(50, 0.0), (100, 0.1), (200, 0.3), (500, 0.6)], 0.9)
    p = hidden * 0.35 + garbled * 0.30 + images * 0.20 + density * 0.15
    sure = F.when(p > 0.75, F.least(F.lit(1.0), 0.7 + (p - 0.75) * 1.2)).when(p < 0.25, F.least(F.lit(1.0), 0.7 + (0.25 - p) * 1.2)).otherwise(0.4 + F.abs(p - 0.5) * 0.2)
    return {
        "invisible_font_score": hidden, "text_corruption_score": garbled, "image_dominance_score": images, "text_font_density_score": density,
        "scanned_likelihood": p, "kind_v2": F.when(p < 0.25, "native_pdf").otherwise("scanned"), "confidence_v2": sure,
    }


def vote(strategy: str, kind1: Column, conf1: Column, kind2: Column, conf2: Column) -> dict[str, Column]:
    """Conservative (adaptive is the same), weighted, or aggressive: scanned with 0.5, as published."""
    if strategy in ("conservative", "adaptive"):
        both = (kind1 == "scanned") & (kind2 == "scanned")
        native = (kind1 == "native_pdf") & (kind2 == "native_pdf") & (conf2 > 0.8)
        return {"kind": F.when(kind2 == "scanned", "scanned").when(native, "native_pdf").otherwise("scanned"), "confidence": F.when(both, F.least(conf1, conf2)).when((kind2 == "scanned") | native, conf2).otherwise(0.6)}
    if strategy == "weighted":
        p = F.when(kind2 == "scanned", 0.7 * conf2).otherwise(0.0) + F.when(kind1 == "scanned", 0.3 * conf1).otherwise(0.0)
        return {"kind": F.when(p > 0.6, "scanned").otherwise("native_pdf"), "confidence": F.when(p > 0.6, p).otherwise(1 - p)}
    if strategy != "aggressive":
        raise ValueError(f"unknown strategy {strategy!r}")
    return {"kind": F.lit("scanned"), "confidence": F.lit(0.5)}


def vote_pages(judged: DataFrame, strategy: str = "conservative", key: str = "doc_id") -> DataFrame:
    """D28 by page: each page has its document's vote (as published: pages have none of their own)."""
    own = vote(strategy, F.col("kind_v1"), F.col("confidence_v1"), F.col("kind_v2"), F.col("confidence_v2"))
    return judged.select(key, F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"), own["kind"].alias("kind"), own["confidence"].alias("confidence"))


def page_kind(chars: Column, fonts: Column, image_ratio: Column, invisible_ratio: Column) -> dict[str, Column]:
    """D29 for one page."""
    score = (
        F.when(invisible_ratio > 0.4, 0.5).when(invisible_ratio > 0.2, 0.2).otherwise(0.0) + F.when(image_ratio > 0.7, 0.4).when(image_ratio > 0.5, 0.2).otherwise(0.0)
        + F.when((fonts <= 1) & (chars > 50), 0.3).otherwise(0.0) + F.when(chars < 30, 0.1).otherwise(0.0)
    )
    return {"page_kind": F.when(score < 0.2, "native_pdf").otherwise("scanned"), "page_confidence": F.when(score > 0.6, F.least(F.lit(1.0), score)).when(score < 0.2, 1 - score).otherwise(0.5)}


def hybrid_documents(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """D29 per document, from judged pages: counts, whether both kinds occur, the overall kind."""
    scanned = F.col("page_kind") == "scanned"
    own = pages.groupBy(key).agg(
        F.sum(F.when(scanned, 1).otherwise(0)).alias("scanned_pages"), F.sum(F.when(scanned, 0).otherwise(1)).alias("native_pages"), F.count("*").alias("pages"),
    )
    return own.select(
        key, "scanned_pages", "native_pages", (F.col("scanned_pages") / F.col("pages")).alias("scanned_ratio"),
        ((F.col("scanned_pages") > 0) & (F.col("native_pages") > 0)).alias("is_hybrid"), F.when(F.col("scanned_pages") > 0, "scanned").otherwise("native_pdf").alias("overall_kind"),
    )


def metadata_signals(filename: Column, size: Column, kind: Column) -> dict[str, Column]:
    """D30"""
    return {
        "filename_signal": F.when(F.lower(filename).rlike("scan|skc|image|jpg|png"), 0.7).otherwise(0.0),
        "size_signal": F.when(size > 5_000_000, 0.4).when(size < 500_000, -0.2).otherwise(0.0),
        "type_signal": F.when(F.lower(kind).contains("utility"), 0.3).otherwise(0.0),
    }


def feedback_averages(feedback: DataFrame, group: str, order: str, alpha: float = 0.1, threshold: float = 0.75, fn_limit: float = 0.02, least: int = 100) -> DataFrame:
    """Per group, in order, the moving averages of missed scans and of false ones, and the threshold that each
    excess of missed scans lowers by 0.05 down to 0.5, from the ``least``-th classification on. A true recurrence: one
    ordered pass that holds four numbers per group."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, state = None, None
        for own, predicted, truth in rows:
            if state is None or own != key:
                if state is not None:
                    yield (key, *state)
                key, state = own, [0, 0.0, 0.0, threshold]
            state[0] += 1
            if truth is None:
                continue
            if truth == "scanned":
                state[1] = alpha * (predicted == "native_pdf") + (1 - alpha) * state[1]
            elif truth == "native_pdf":
                state[2] = alpha * (predicted == "scanned") + (1 - alpha) * state[2]
            if state[0] >= least and state[1] > fn_limit:
                state[3] = max(0.5, state[3] - 0.05)
        if state is not None:
            yield (key, *state)

    kind = dict(feedback.dtypes)[group]
    return ordered_pass(feedback, [group], [order], ["predicted", "truth"], f"{group} {kind}, n long, fn_rate double, fp_rate double, threshold double", fold)


def moving_average(values: Column, weight: float = 0.1) -> Column:
    """v = 0.9 * v + 0.1 * x over an ordered array, starting with its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), F.get(values, F.lit(0)), lambda s, x: s * (1 - weight) + x * weight)


def render_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """S17/D37 adapter boundary: pixel work needs an image library; offline there is nothing to render."""
    for b in batches:
        yield b.assign(image=None)
