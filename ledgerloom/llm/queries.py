"""Queries of the corpus operators over the driver's tables, with SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import cotraining, exact_dedup, language_id, minhash, packing, piece_codec, quality_rules, sharding, suffix_dedup, url_filters
from ledgerloom.llm.common import table


def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), pages=table(spark, sf_dir, "pages"))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), targets=packing.EQUAL).drop("ids")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("capacity")


def op7_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_fusion, op2_suffix_repeats, op3_cotrained_quality, op4_mixture_packing, op5_piece_codec, op6_minimax_shards,
        op7_ngram_ratio_rules, op8_url_filters, op9_minhash_groups, op10_exact_dedup,
    )
}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _op8_sql() -> str:
    # written out by hand, so that the operator's translation of its patterns is held against another one
    start, sep = "^[a-z][a-z0-9+.-]*://([^/?#]*[.])?", "([^a-z0-9_.%-]|$)"
    block = [f"{start}ads-track[.]", f"{start}adult-x[.]", "/banner/.*[.]gif", f"{start}m[.].*[.]example[.]com{sep}de{sep}", "[?]utm_source=feed$", f"{sep}page=2{sep}ref=x$", f"/popup{sep}"]
    allow = [f"{start}blog[.].*[?]utm_source=feed$", f"[.]org/en/.*[?]page=2{sep}ref=x$"]
    matches = {side: "false" + "".join(f" OR regexp_matches(lower(url), '{p}')" for p in patterns) for side, patterns in ((False, block), (True, allow))}
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{rule}'"
        for _, rule in sorted(url_filters.HOST_RULES, key=lambda r: -len(r[1]))
        for h, _, p in [rule.partition("/")]
    )
    ruled = " ".join(f"WHEN rule = '{rule}' THEN '{verdict}'" for verdict, rule in url_filters.HOST_RULES)
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, url, translate(raw, '{_LETTERS}', '{_LETTERS.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE {fits} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {ruled} WHEN ({matches[False]}) AND NOT ({matches[True]}) THEN 'block' ELSE 'allow' END AS verdict FROM d"""


#: Every 50-byte string as hex digits with the least document that it starts in; removed ranges are united by a window.
_OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT doc_id, substr(h, 2 * k + 1, 100) AS s, k FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS k FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)), hit AS (SELECT doc_id, k FROM w JOIN m USING (s) WHERE least < doc_id),
j AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS j FROM hit), g AS (SELECT doc_id, k, sum(j) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM j),
r AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM g GROUP BY 1, 2),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM r UNION ALL SELECT doc_id, max(b), NULL FROM r GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, coalesce(2 * (b - a), length(h))), '' ORDER BY a) AS h FROM p JOIN d USING (doc_id) GROUP BY 1), n AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM r GROUP BY 1)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: All pairs of documents that share a shingle, by their whole sets.
_OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM c WHERE 100 * common >= 85 * (na + nb - common)), edges AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a), m AS (SELECT a, min(b) AS component FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component AS component_id, doc_id = component AS kept FROM s JOIN m ON m.a = doc_id"""


ORACLES = {
    "op2_suffix_repeats": _OP2_SQL,
    "op9_minhash_groups": _OP9_SQL,
    "op8_url_filters": _op8_sql(),
    "op10_exact_dedup": f"""
WITH a AS (SELECT doc_id, translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM a""",
}
