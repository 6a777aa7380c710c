"""Exact dedup (10): an extendible-hash index of the distinct texts, kept as shared files.

1. One pass gives every row the 64-bit key and the digest of its normalised text; from there only those move.
2. The directory begins as one bucket. Wherever a bucket holds more than ``capacity`` keys the directory doubles and that
   bucket splits by the next bit of the key, until none is overfull or all its keys are equal.
3. A key of one row is an entry of its own. Rows of other keys bring their texts to the owner of their key's range and are
   compared byte by byte with the head of the key's chain, the text of its largest id; those that differ are compared
   with the next head, and so on: the chain is as long as there are different texts of one key.
4. Every document looks up its entry by bucket, key and digest; the entry says which id stays.

Only texts whose key occurs again are moved. Rows of a frequent key are salted and its head goes to each part, so a text
that a third of all rows have is compared in many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded, lower_ascii, stash

#: Bits of the key by which slots are counted at once; overfull ones are counted by so many more.
STEP = 16
#: Rows of one key that a task compares.
SALT_ROWS = 5_000


def key_of(norm: Column | str) -> Column:
    return F.xxhash64(norm)


def normal(text_col: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def directory(entries: DataFrame, capacity: int, key: str = "key") -> DataFrame:
    """(bits, slot, depth): the used directory slots, leading ``bits`` bits of keys; a slot's bucket is its first ``depth`` bits.

    Depths are as small as they can be: a bucket is split only if it holds over ``capacity`` keys that are not all equal.
    Slots have STEP bits, or more where buckets are deeper. No entries: no rows.
    """
    rest, bits, found = entries.select(key), 0, []
    while True:
        wide = bits + STEP
        counts = rest.groupBy(F.shiftrightunsigned(key, 64 - wide).alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        slots = stash(counts.withColumn("depth", F.lit(bits)), "slots")
        for depth in range(bits, wide):
            bucket = F.shiftrightunsigned("slot", wide - depth).alias("bucket")
            held = slots.filter(F.col("depth") == depth).groupBy(bucket).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            full = held.filter((F.col("n") > capacity) & (F.col("low") != F.col("high"))).select("bucket", F.lit(depth).alias("depth"), F.lit(1).alias("more"))
            if full.isEmpty():
                break
            split = slots.withColumn("bucket", bucket).join(full, ["bucket", "depth"], "left")
            slots = stash(split.select("slot", "n", "low", "high", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "slots")
        deeper = (F.col("depth") == wide) & (F.col("n") > capacity) & (F.col("low") != F.col("high")) if wide < 64 else F.lit(False)
        found.append(slots.filter(~deeper).select(F.lit(wide).alias("bits"), "slot", "depth"))
        again = slots.filter(deeper).select("slot")
        if again.isEmpty():
            return stash(reduce(DataFrame.unionByName, found), "directory")
        rest = rest.withColumn("slot", F.shiftrightunsigned(key, 64 - wide)).join(again, "slot", "left_semi").select(key)
        bits = wide


def with_bucket(rows: DataFrame, slots: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with the bucket (depth and prefix) that the directory gives their key."""
    levels = sorted(r.bits for r in slots.select("bits").distinct().collect())  # at most 64 / STEP
    out, depths = rows, []
    for bits in levels:
        own = slots.filter(F.col("bits") == bits).select(F.col("slot").alias(f"_slot{bits}"), F.col("depth").alias(f"_depth{bits}"))
        out = out.withColumn(f"_slot{bits}", F.shiftrightunsigned(key, 64 - bits)).join(bounded(own), f"_slot{bits}", "left")
        depths.append(F.col(f"_depth{bits}"))
    depth = F.coalesce(*depths, F.lit(0))
    prefix = F.when(depth > 0, F.expr(f"shiftrightunsigned(`{key}`, 64 - ({'coalesce(' + ', '.join(f'_depth{b}' for b in levels) + ', 0)' if levels else '0'}))")).otherwise(F.lit(0))
    named = F.concat_ws("/", depth.cast("string"), F.hex(prefix))
    return out.withColumn("bucket", named).drop(*[f"_{c}{b}" for b in levels for c in ("slot", "depth")])


def keyed(docs: DataFrame, id_col: str, text_col: str, key=key_of) -> DataFrame:
    """(doc_id, key, sha): every row, on shared files."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normal(text_col).alias("norm"))
    return stash(rows.select("doc_id", key("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")), "keyed")


def chained(docs: DataFrame, again: DataFrame, id_col: str, text_col: str, key=key_of) -> list[DataFrame]:
    """(bucket, key, chain, sha, keep_id, group_size) of the keys of ``again`` (bucket, key, n), link after link of their chains."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normal(text_col).alias("norm")).withColumn("key", key("norm"))
    parts = F.ceil(F.col("n") / SALT_ROWS)
    met = rows.join(bounded(again.withColumn("parts", parts).drop("n")), "key").withColumn("salt", F.pmod(F.monotonically_increasing_id(), "parts"))
    rest, links = stash(met, "repeated-keys"), []
    left = rest.count()
    while left:
        order = F.struct(F.col("doc_id").isNotNull(), "doc_id")
        heads = rest.groupBy("bucket", "key").agg(F.max_by("norm", order).alias("head"), F.max("parts").alias("parts"))
        heads = heads.select("bucket", "key", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
        compared = rest.join(heads, ["bucket", "key", "salt"])
        same = compared.filter("norm = head").groupBy("bucket", "key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.unhex(F.sha2(F.max("head"), 256)).alias("sha"))
        links.append(stash(same.select("bucket", "key", F.lit(len(links)).alias("chain"), "sha", "keep_id", "group_size"), "links"))
        left -= links[-1].agg(F.sum("group_size")).first()[0]
        if left:
            rest = stash(compared.filter("norm <> head").drop("head"), "other-texts")
    return links


def build_index(docs: DataFrame, seen: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, key=key_of) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, key, chain, sha, keep_id, group_size), one entry per distinct normalised text, dealt and sorted
    by bucket on shared files, and its directory. ``seen``: of :func:`keyed`."""
    keys = stash(seen.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.max("sha").alias("sha")), "keys")
    slots = directory(keys, capacity)
    placed = with_bucket(keys, slots)
    again = stash(placed.filter("n > 1").select("bucket", "key", "n"), "again")
    single = placed.filter("n = 1").select("bucket", "key", F.lit(0).alias("chain"), "sha", "keep_id", F.col("n").alias("group_size"))
    entries = reduce(DataFrame.unionByName, chained(docs, again, id_col, text_col, key), single)
    return stash(entries.repartition("bucket").sortWithinPartitions("bucket", "key", "chain"), "index"), slots


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, key=key_of) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical after lower-casing A-Z; null text counts as empty; the largest id of a group stays.
    Rows that repeat an id with an equal text share one verdict; a null id is never the one that stays unless the whole
    group has null ids (then keep_id is null and kept false). Other columns of ``docs`` are ignored. No rows: no rows.
    ``key``: the hash of a normalised text, a long.
    """
    seen = keyed(docs, id_col, text_col, key)
    index, slots = build_index(docs, seen, id_col, text_col, capacity, key)
    found = with_bucket(seen, slots).join(index, ["bucket", "key", "sha"])
    return found.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per group of equal texts, with their own columns.

    The verdict is of the row, by id and text: of rows that share an id each text is judged by itself, and a group that has
    only null ids keeps one of them. Of rows that share id and text one stays, by a hash of the row. Texts are not
    shuffled while the rows to drop can be broadcast.
    """
    seen = keyed(docs, id_col, text_col)
    index, slots = build_index(docs, seen, id_col, text_col)
    rows = with_bucket(seen, slots).join(index.select("bucket", "key", "sha", "keep_id"), ["bucket", "key", "sha"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    judged = stash(rows.groupBy("doc_id", "key", "sha").agg(F.max(stays).alias("stays"), F.count("*").alias("n")), "judged")
    by = {"_none": F.col(id_col).isNull(), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_key": key_of(normal(text_col))}

    def named(some: DataFrame) -> DataFrame:
        return some.select(F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("key").alias("_key"), F.col("sha").alias("_sha")).alias("b")

    def on() -> Column:
        return reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]) & (F.unhex(F.sha2(normal(f"a.{text_col}"), 256)) == F.col("b._sha"))

    own = docs.withColumns(by).alias("a")
    gone, several = judged.filter("NOT stays OR n > 1"), judged.filter("stays AND n > 1")
    out = own.join(bounded(named(gone)), on(), "left_anti").select(*[f"a.{c}" for c in docs.columns])
    if several.isEmpty():
        return out
    order = F.xxhash64(*[F.col(f"a.{c}") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    repeated = own.join(bounded(named(several)), on()).groupBy("b._none", "b._id", "b._key", "b._sha").agg(F.min_by(F.struct(*[f"a.{c}" for c in docs.columns]), order).alias("row"))
    return out.unionByName(repeated.select("row.*"))
