"""Quality rules (7): counting rules, then a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Both multinomials are over hashed byte n-grams: the raw one counts every document, the target a bounded sample of
trusted ones. A document's score is its log-likelihood ratio per n-gram; it is kept if the score reaches a fixed
threshold, so every document is judged alike and the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean, small_batches
from ledgerloom.llm.grams import as_tables, class_counts, gram_sums
from ledgerloom.llm.minhash import word_hashes, window_hashes

GRAM, BITS = 4, 14
#: Trusted documents that the target is fitted on: those with the least hashed ids.
TRUSTED = 20_000
#: Least log-likelihood ratio per n-gram (nats) of a document that is kept.
THRESHOLD = -0.2
SMOOTHING = 0.5
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW = 8


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if len(words) > WINDOW:
        windows = window_hashes(word_hashes(words), WINDOW)
        _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = (times[place] > 1).astype(np.int64)
        if twice.any():
            edges = np.zeros(len(words) + 1, np.int64)
            edges[: len(twice)] += twice
            edges[WINDOW : WINDOW + len(twice)] -= twice
            repeated = int((np.cumsum(edges[:-1]) > 0).sum())
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log-ratio of target to raw probability of each bucket."""
    sample = trusted.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(TRUSTED)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    marked = texts.join(F.broadcast(sample.withColumn("class", F.lit("target"))), "_id", "left")  # at most TRUSTED ids
    counts = as_tables(class_counts(marked.select(F.coalesce("class", F.lit("other")).alias("class"), "text"), GRAM, BITS), ["target", "other"], BITS)
    target, raw = counts[0] + SMOOTHING, counts.sum(axis=0) + SMOOTHING
    if not counts[0].sum():
        return np.zeros(1 << BITS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept, score (null if there is no n-gram).

    ``trusted``: rows whose ids name trusted documents (at most TRUSTED of them are used; none: every score is 0). Null
    text counts as empty and fails the base rules; repeated rows are judged alike; null ids are allowed; other columns
    are ignored; no rows give no rows. Texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    ratio = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, trusted, id_col, text_col)[None, :])  # 1 << BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                t = t or ""
                counts = base_counts(t)
                bad = failed(counts[0], counts[4])
                total, n = gram_sums(t.encode(), GRAM, BITS, ratio.value)
                score = float(total[0] / n) if n else None
                rows.append((*counts, bad, not bad and score is not None and score >= threshold, score))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], OUT)

    schema = ", ".join(f"{c} {t}" for c, t in zip(OUT, [*["long"] * 6, "boolean", "boolean", "double"], strict=True))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(lean(run, "words"), schema)


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
