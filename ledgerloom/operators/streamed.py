"""Ordered passes over groups: one shuffle by the keys, then a sorted stream of rows through each task's worker.

Many small groups cost one Arrow batch, not one call each, and a pass holds no more than its own state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ledgerloom.session import ship_package

#: Rows of output that are sent at once.
SENT = 20_000
Rows = Iterator[tuple[tuple, list[tuple]]]


def ordered_pass(df: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``fold`` over the rows (keys, then ``columns``) of each task in order of ``keys`` and ``order``; all rows of a key are in
    one task, one after the other. It yields rows of ``schema``."""
    ship_package(df.sparkSession)
    names = [*keys, *[c for c in columns if c not in keys]]
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in fold(rows(batches)):
            held.append(row)
            if len(held) >= SENT:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    dealt = df.select(*dict.fromkeys([*names, *order])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*names).mapInArrow(run, schema)


def by_key(rows: Iterator[tuple], width: int) -> Rows:
    """(key, rows) of neighbouring rows that share their first ``width`` values."""
    key, held = None, []
    for row in rows:
        if held and row[:width] != key:
            yield key, held
            held = []
        key = row[:width]
        held.append(row)
    if held:
        yield key, held
