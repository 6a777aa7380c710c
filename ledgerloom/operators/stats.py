"""Corpus statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Values that may be sorted on the driver when a quantile is read off, and cells that a range of values is split into.
LAST, CELLS = 10_000, 1024


def medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The exact median per group: values are counted, and running counts say where the middle is. Sorting spills, so no
    buffer holds a group's values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    over = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.groupBy(*group).agg(F.sum("_c").alias("_t"))
    last = counts.withColumn("_e", F.sum("_c").over(over)).join(totals, group)
    # of n values the middle ones are those at (n - 1) // 2 and n // 2, from 0
    middle = [F.floor((F.col("_t") - 1) / 2), F.floor(F.col("_t") / 2)]
    at = [F.max(F.when((F.col("_e") - F.col("_c") <= m) & (m < F.col("_e")), F.col("_v"))) for m in middle]
    return last.groupBy(*group).agg(((at[0] + at[1]) / 2).alias("median"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """A10: exact quantiles with linear interpolation, of the whole column: counts in cells of a range of values, then of the
    one cell that a quantile's neighbours lie in, until few enough values are left to read. Nulls and NaN are left out."""
    own = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = own.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)

    def at(rank: int) -> float:
        a, b, before, held = low, high, 0, n
        while a < b and held > LAST:
            width = (b - a) / CELLS
            cell = F.least(F.floor((F.col("v") - a) / width), F.lit(CELLS - 1)) if width > 0 else F.lit(0)
            rows = own.filter(F.col("v").between(a, b)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
            for r in sorted(rows, key=lambda r: r.c):
                if rank < before + r.n:
                    a, b, held = r.a, r.b, r.n
                    break
                before += r.n
        if a == b:
            return a
        values = sorted(r.v for r in own.filter(F.col("v").between(a, b)).collect())  # at most LAST
        return values[rank - before]

    out = []
    for share in shares:
        place = share * (n - 1)
        below = int(place)
        x = at(below)
        out.append(x if place == below else x + (at(min(below + 1, n - 1)) - x) * (place - below))
    return out


def summary(df: DataFrame, *group: str, value: str) -> DataFrame:
    """Count, mean, median, sample deviation, sum, largest, distinct."""
    own = df.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.sum(value).alias("total"), F.max(value).alias("largest"), F.count_distinct(value).alias("distinct"),
    )
    return own.join(medians(df, list(group), value), list(group), "left").select(*group, "n", "mean", "median", "std", "total", "largest", "distinct")


def group_means(df: DataFrame, *group: str, means: list[str], firsts: list[str] = (), digits: int = 4) -> DataFrame:
    """Rounded means, the number of rows, and of ``firsts`` the least value (any, where a group has one)."""
    return df.groupBy(*group).agg(*[F.round(F.avg(m), digits).alias(m) for m in means], F.count("*").alias("n"), *[F.min(c).alias(c) for c in firsts])


def terciles(df: DataFrame, value: str, name: str = "quality") -> DataFrame:
    """Q1 above the upper tercile, Q2 above the lower one, else Q3; exact quantiles of the whole column."""
    low, high = quantiles(df, value, [1 / 3, 2 / 3])
    v = F.col(value)
    return df.withColumn(name, F.when(v > F.lit(high), "Q1").when(v > F.lit(low), "Q2").otherwise("Q3"))


def pivoted(df: DataFrame, row: str, column: str, values: list, measure: str, how: str = "sum") -> DataFrame:
    """Per row value the sum, mean, std (sample) or size by column value; 0 where there is none."""
    what = {"sum": F.sum(measure), "mean": F.avg(measure), "std": F.stddev_samp(measure), "size": F.count(F.lit(1))}[how]
    return df.groupBy(row).pivot(column, values).agg(what).fillna(0)


def pivot_shares(df: DataFrame, row: str, column: str, values: list, weight: Column | None = None) -> DataFrame:
    """Per row value the sums by column value (0 where there is none) and their percentages of the row."""
    weight = weight if weight is not None else F.lit(1)
    sums = df.groupBy(row).pivot(column, values).agg(F.sum(weight)).fillna(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return sums.withColumns({f"pct_{v}": F.round(100.0 * F.col(f"`{v}`") / F.nullif(total, F.lit(0)), 2) for v in values})


def share_of_total(df: DataFrame, value: str, *within: str, name: str = "share") -> DataFrame:
    """Percentage of the group's total, or of the whole; meant for aggregates."""
    if not within:
        total = F.broadcast(df.agg(F.sum(value).alias("_t")))  # one row
        return df.join(total).withColumn(name, F.round(100.0 * F.col(value) / F.nullif("_t", F.lit(0)), 2)).drop("_t")
    over = Window.partitionBy(*[F.col(w) for w in within])
    return df.withColumn(name, F.round(100.0 * F.col(value) / F.nullif(F.sum(value).over(over), F.lit(0)), 2))


def top_and_other(counts: DataFrame, label: str, value: str, n: int = 5, other: str = "other") -> DataFrame:
    """The n largest and the sum of the rest, of an aggregated table."""
    rank = F.row_number().over(Window.orderBy(F.desc(value), label))
    return counts.withColumn("_k", F.when(rank <= n, F.col(label)).otherwise(other)).groupBy(F.col("_k").alias(label)).agg(F.sum(value).alias(value))


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 2) -> DataFrame:
    """N rows per group in an order that depends on the seed and the key alone."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).filter(F.col("_r") <= n).drop("_r")


def aligned(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """One row per value of the list, in its order, nulls where ``df`` has none."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(k, v) for k, v in enumerate(order)], f"position int, {key} string")
    return F.broadcast(dim).join(df, key, "left").orderBy("position")


def rate_of(df: DataFrame, correct: str, total: str, *group: str) -> DataFrame:
    """Percentage of sums."""
    return df.groupBy(*group).agg((100.0 * F.sum(correct) / F.nullif(F.sum(total).cast("double"), F.lit(0.0))).alias("rate"))


def savings(df: DataFrame, label: str, base: str, measures: list[str]) -> DataFrame:
    """Percent saved against the base row."""
    row = F.broadcast(df.filter(F.col(label) == base).select(*[F.col(m).alias(f"_b_{m}") for m in measures]).limit(1))
    return df.join(row).select(label, *[F.round((1 - F.col(m) / F.nullif(F.col(f"_b_{m}").cast("double"), F.lit(0.0))) * 100, 2).alias(f"saved_{m}") for m in measures])


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """U1"""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def path_counts(files: DataFrame, path: str = "path", marker: str = "data") -> DataFrame:
    """Files by the two path segments after a marker and the kind in the name."""
    parts = F.split(path, r"[\\/]")
    at = F.array_position(parts, marker).cast("int")
    kind = F.when(F.lower(path).contains("scan"), "scan").otherwise("native")
    own = files.select(F.try_element_at(parts, at + 1).alias("commodity"), F.try_element_at(parts, at + 2).alias("supplier"), kind.alias("kind"))
    return own.groupBy("commodity", "supplier", "kind").count()


def latency_by_path(df: DataFrame, parts: list[str]) -> DataFrame:
    """A30"""
    return df.groupBy("escalated").agg(F.count("*").alias("n"), *[F.round(F.avg(p), 4).alias(p) for p in parts])


def limit_per_group(df: DataFrame, group: str, order: list, n: int | None) -> DataFrame:
    """The first ``n`` rows of each group in an order (best quality first); all of them without a limit."""
    if n is None:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def left_out(chosen: Column, every: list[str]) -> Column:
    """U4: the valid values that were not chosen, in order."""
    return F.array_except(F.array(*[F.lit(v) for v in every]), F.coalesce(chosen, F.array().cast("array<string>")))


def forbidden_words(statement: Column, words: list[str]) -> Column:
    """Which of the words a statement holds, in order."""
    return F.array_sort(F.array_intersect(F.regexp_extract_all(F.upper(statement), F.lit(r"\b([A-Z_]+)\b"), F.lit(1)), F.array(*[F.lit(w) for w in words])))


def zipped(df: DataFrame, left: str, right: str, *keys: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Two arrays element by element, up to the shorter one's end: (keys, position, left, right)."""
    pairs = F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b"))
    both = F.slice(pairs, F.lit(1), F.least(F.size(left), F.size(right)))
    own = df.filter((F.size(left) > 0) & (F.size(right) > 0)).select(*keys, F.posexplode(both).alias("position", "p"))
    return own.select(*keys, "position", F.col("p.a").alias(names[0]), F.col("p.b").alias(names[1]))
