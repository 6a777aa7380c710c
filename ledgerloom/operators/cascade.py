"""Primary extraction, escalation, fallback; adapters with deterministic offline backends."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import fields as registry
from ledgerloom.functions import text
from ledgerloom.operators import extract, rules
from ledgerloom.session import materialise


class Extractor(Protocol):
    """A strategy: adds ``fields`` (map of texts), ``confidences`` (map of doubles), ``logprob``, ``api_error``,
    ``cost_usd`` and ``latency_ms`` to rows that have an id, a text and a commodity."""

    name: str

    def __call__(self, docs: DataFrame) -> DataFrame: ...


class RegexExtractor:
    """The rule-based strategy: also what is used where no model can be reached."""

    name = "regex"

    def __init__(self, as_of: str, text_col: str = "text") -> None:
        self.as_of, self.text_col = as_of, text_col

    def __call__(self, docs: DataFrame) -> DataFrame:
        own = extract.extract_invoices(docs.drop("commodity"), self.as_of, self.text_col)
        day = lambda c: F.date_format(c, "yyyy-MM-dd")
        pairs = {
            "invoice_number": F.when(F.col("invoice_number") != "UNKNOWN", F.col("invoice_number")), "period_from": day("period_from"), "period_to": day("period_to"), "issue_date": day("issue_date"),
            "due_date": day("due_date"), "amount_ex_vat": text.format_amount("total_amount_ex_vat"), "amount_inc_vat": text.format_amount("total_amount_inc_vat"),
            "supplier_tax_id": F.col("supplier_tax_id"), "customer_tax_id": F.col("customer_tax_id"), "consumption_point_code": F.coalesce("consumption_point_code", "ean_code", "eic_code"),
        }
        base = F.create_map(*[x for n, c in pairs.items() for x in (F.lit(n), c)])
        whole = F.when(F.col("details").isNotNull(), F.map_concat(base, "details")).otherwise(base)
        sure = F.transform_values(whole, lambda k, v: F.when(text.truthy(v), F.col("confidence")))
        return own.withColumns({"fields": whole, "confidences": sure}).withColumns({"logprob": F.lit(None).cast("double"), "api_error": F.lit(None).cast("string"), "cost_usd": F.lit(0.0), "latency_ms": F.lit(0.0)})


def cascade(docs: DataFrame, primary: Callable[[DataFrame], DataFrame], fallback: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """The primary result, or the fallback's for rows that escalate; costs add up, latencies stay apart.

    The primary's results are stored before the decision is read. The paid fallback sees only the rows that need it: it runs on a filter of the first stage, and both are united.
    """
    kept = [key, "commodity", "fields", "confidences", "cost_usd", "latency_ms"]
    first = primary(docs)
    reason = rules.escalation_reason(F.col("fields"), F.col("commodity"), F.col("api_error"), F.col("logprob"), F.col("confidences"))
    judged = materialise(first.select(*kept, reason.alias("reason")), "primary")  # the primary reader is paid for once
    done = judged.filter("reason = 'ok'").select(*kept, "reason", F.lit(False).alias("escalated"), F.lit("text").alias("mode"), F.col("latency_ms").alias("text_ms"), F.lit(0.0).alias("vision_ms"))
    needed = judged.filter("reason <> 'ok'").select(key, "reason", F.col("cost_usd").alias("_cost"), F.col("latency_ms").alias("text_ms"))
    again = fallback(docs.join(needed.select(key), key, "left_semi")).select(*kept).join(needed, key)
    again = again.select(
        key, "commodity", "fields", "confidences", (F.col("cost_usd") + F.col("_cost")).alias("cost_usd"), (F.col("latency_ms") + F.col("text_ms")).alias("latency_ms"),
        "reason", F.lit(True).alias("escalated"), F.lit("vision").alias("mode"), "text_ms", F.col("latency_ms").alias("vision_ms"),
    )
    return done.unionByName(again)


def extract_documents(docs: DataFrame, primary: Callable, fallback: Callable, key: str = "doc_id") -> DataFrame:
    """Cascade, values normalised by the registry's types, then both kinds of checks."""
    out = cascade(docs, primary, fallback, key)
    kinds: dict[str, str] = {n: t for c in registry.COMMODITIES for n, t, _ in registry.fields_of(c)}
    by_kind = {k: F.array(*[F.lit(n) for n, t in sorted(kinds.items()) if t == k]) for k in ("float", "date")}

    def normal(name: Column, value: Column) -> Column:
        return F.when(F.array_contains(by_kind["float"], name), text.normalise_value(value, "float")).when(F.array_contains(by_kind["date"], name), text.normalise_value(value, "date")).otherwise(F.trim(value))

    out = out.withColumn("fields", F.transform_values("fields", normal))
    return out.withColumns({"format_errors": rules.format_errors(F.col("fields")), "arithmetic_errors": rules.arithmetic_errors(F.col("fields"), F.col("commodity")), "mean_confidence": text.mean_of_map("confidences")})


def choose_iteratively(results: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """D39 over long results (key, attempt 0 or 1, confidence, payload): one row per key with what is taken."""
    own = results.groupBy(key).agg(*[F.max(F.when(F.col("attempt") == k, F.struct("confidence", "payload"))).alias(f"a{k}") for k in (0, 1)])
    taken = rules.iterative_choice(F.col("a0.confidence"), F.col("a1.confidence"), least)
    return own.select(key, taken.alias("taken"), F.when(taken == "primary", F.col("a0.payload")).otherwise(F.col("a1.payload")).alias("payload"))


def strategy_benchmark(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the winners by confidence and by number of fields, successes and total latency."""
    from ledgerloom.operators.evaluate import best_strategy

    totals = results.groupBy(key).agg(F.count("*").alias("strategies"), F.sum(F.when((F.col("n_fields") > 0) & (F.col("n_errors") == 0), 1).otherwise(0)).alias("successes"), F.sum("latency_ms").alias("total_latency_ms"))
    sure = best_strategy(results, key).withColumnsRenamed({"best_strategy": "best_by_confidence", "best_score": "confidence"})
    most = best_strategy(results, key, score="n_fields").withColumnsRenamed({"best_strategy": "best_by_fields", "best_score": "n_fields"})
    return totals.join(sure, key, "left").join(most, key, "left")


#: Fixed value: the order of processing states; the last three end a document's way.
STATES = ("pending", "classifying", "ocr", "extracting", "analyzing", "completed", "failed", "error")


def current_state(log: DataFrame, key: str = "doc_id", at: str = "created_at") -> DataFrame:
    """The latest state per document from an append-only log, and when it was completed. Of entries at the same
    time the furthest state counts; unknown states are ignored."""
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    own = log.withColumn("_p", place).filter("_p > 0").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc("_p")))).filter("_r = 1")
    return own.select(key, "state", F.when(F.col("state") == "completed", F.col(at)).alias("completed_at"))


#: Prices per million tokens (prompt, completion) by part of the model's name; the longest part that occurs counts.
PRICES = {
    "gpt-4.1-mini": (0.40, 1.60), "gpt-4.1-nano": (0.10, 0.40), "gpt-4.1": (2.00, 8.00), "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "gpt-4-turbo": (10.00, 30.00),
    "claude-3-haiku": (0.25, 1.25), "claude-3-5-haiku": (0.80, 4.00), "claude-3-5-sonnet": (3.00, 15.00),
}
DEFAULT_PRICE = (0.40, 1.60)


def model_cost(model: Column, prompt: Column, completion: Column) -> Column:
    """the price by longest name part, else the default."""
    name, rate_in, rate_out = F.lower(model), F.lit(DEFAULT_PRICE[0]), F.lit(DEFAULT_PRICE[1])
    for part in sorted(PRICES, key=len):
        rate_in = F.when(name.contains(part), PRICES[part][0]).otherwise(rate_in)
        rate_out = F.when(name.contains(part), PRICES[part][1]).otherwise(rate_out)
    return text.token_cost(prompt, completion, rate_in, rate_out)


def dry_run_cost(documents: DataFrame, per_document: float, escalation: float, per_escalation: float) -> DataFrame:
    """Expected cost of a run by commodity."""
    n = F.count("*")
    return documents.groupBy("commodity").agg(n.alias("documents"), F.round(n * per_document + n * escalation * per_escalation, 4).alias("expected_usd"))


def prompt_text(commodity: Column, content: Column, examples: Column | None = None, limit: int = 24_000) -> Column:
    """D42, the data half: the user prompt with its examples and the capped text."""
    return F.concat_ws("\n\n", examples if examples is not None else F.lit(None).cast("string"), F.concat(F.lit("Commodity: "), F.coalesce(commodity, F.lit("unknown"))), F.substring(content, 1, limit))


class ModelExtractor:
    """A strategy around a caller's model: ``ask`` maps Arrow batches of (key, prompt) to batches of (key, answer,
    logprob, prompt_tokens, completion_tokens, latency_ms, api_error). Prompts and answers are built and read here."""

    def __init__(self, name: str, model: str, ask: Callable, commodity_fields: tuple[str, ...], key: str = "doc_id", text_col: str = "text", examples: str | None = None) -> None:
        self.name, self.model, self.ask, self.fields, self.key, self.text_col, self.examples = name, model, ask, commodity_fields, key, text_col, examples

    def __call__(self, docs: DataFrame) -> DataFrame:
        shown = F.col(self.examples) if self.examples else None
        asked = docs.select(F.col(self.key), prompt_text(F.col("commodity"), F.col(self.text_col), shown).alias("prompt"))
        kind = dict(docs.dtypes)[self.key]
        said = asked.mapInArrow(self.ask, f"{self.key} {kind}, answer string, logprob double, prompt_tokens long, completion_tokens long, latency_ms double, api_error string")
        read = text.json_object("answer", "map<string,string>")
        own = said.withColumn("_read", read).withColumn("confidences", F.from_json(F.try_element_at("_read", F.lit("_confidence")), "map<string,double>"))
        values = F.create_map(*[x for n in self.fields for x in (F.lit(n), F.try_element_at("_read", F.lit(n)))])
        out = own.withColumns({"fields": values, "cost_usd": model_cost(F.lit(self.model), F.col("prompt_tokens"), F.col("completion_tokens"))})
        return docs.join(out.drop("answer", "_read", "prompt_tokens", "completion_tokens"), self.key)
