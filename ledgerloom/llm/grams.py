"""Hashed byte n-grams and word windows, shared by the language, quality and rule operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import lean
from ledgerloom.llm.suffix_dedup import gram_hashes

#: Bytes of a text that are hashed at once; grams that cross from one piece to the next are counted too.
PIECE = 1 << 20
#: Classes whose counts a task holds at once.
HELD = 64


def gram_buckets(text: bytes, gram: int, bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all ``gram``-byte strings of a text, piece by piece."""
    for a in range(0, max(0, len(text) - gram + 1), PIECE):
        part = np.frombuffer(text[a : a + PIECE + gram - 1], np.uint8)
        yield (gram_hashes(part, gram) >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(text: bytes, gram: int, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for buckets in gram_buckets(text, gram, bits):
        out += np.bincount(buckets, minlength=1 << bits)
    return out


def gram_sums(text: bytes, gram: int, bits: int, tables: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of each row of ``tables`` over the grams of a text, and the number of grams."""
    total, n = np.zeros(len(tables)), 0
    for buckets in gram_buckets(text, gram, bits):
        n += len(buckets)
        total += [t[buckets].sum() for t in tables] if len(buckets) < tables.shape[1] else tables @ np.bincount(buckets, minlength=tables.shape[1])
    return total, n


def class_counts(docs: DataFrame, gram: int, bits: int) -> DataFrame:
    """(class, bucket, n) over documents with columns ``class`` and ``text``: each task counts its share, HELD classes at a
    time, the counts are summed by a grouped aggregation."""

    def counted_of(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for c, s in sums.items():
            found = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(found), pa.string()), pa.array(found), pa.array(s[found])], ["class", "bucket", "n"])
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c not in sums:
                    if len(sums) == HELD:
                        yield from counted_of(sums)
                    sums[c] = np.zeros(1 << bits, np.int64)
                for buckets in gram_buckets((t or "").encode(), gram, bits):
                    if len(buckets) > 1 << bits:
                        sums[c] += np.bincount(buckets, minlength=1 << bits)
                    else:
                        np.add.at(sums[c], buckets, 1)
        yield from counted_of(sums)

    counted = docs.select(F.col("class").cast("string"), F.col("text").cast("string")).mapInArrow(lean(run), "class string, bucket long, n long")
    return counted.groupBy("class", "bucket").agg(F.sum("n").alias("n"))


def as_tables(counts: DataFrame, classes: list[str], bits: int) -> np.ndarray:
    """Counts as an array of one row per class; at most ``len(classes) << bits`` numbers reach the driver."""
    out = np.zeros((len(classes), 1 << bits))
    place = {c: k for k, c in enumerate(classes)}
    for r in counts.collect():
        if r["class"] in place:
            out[place[r["class"]], r["bucket"]] = r["n"]
    return out
