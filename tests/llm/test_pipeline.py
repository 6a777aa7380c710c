import public_tokenizers
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.common import ASCII_UPPER
from ledgerloom.llm import exact_dedup, language_id, minhash
from tests.llm.helpers import DOCS, documents, prose
from tests.llm.test_minhash import brute as near
from tests.llm.test_minhash import edited
from tests.llm.test_suffix_dedup import brute as repeats


def test_every_stage_against_plain_python(spark, tmp_path):
    base = [prose(k, 80 + 5 * k) for k in range(12)]
    passage = prose(77, 60)
    texts = base + [base[0].upper(), base[1], edited(base[2], 1, 5), edited(base[3], 2, 6)] + [f"{prose(300 + k, 70)} {passage} {prose(400 + k, 70)}" for k in range(5)] + [None, "", " \n"]
    rows = [(k, t, "en", f"s{k % 4}", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "http://a.example.org/en/3", '<html lang="en">')], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    left = {k: t for k, t in enumerate(texts) if t and t.strip()}

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert kept[0] == left

    lower = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
    last = {t.translate(lower): k for k, t in left.items()}
    left = {k: left[k] for k in sorted(last.values())}
    assert kept[1] == left

    order = sorted(left)
    left = {order[k]: left[order[k]] for k, (_, c) in enumerate(near([left[k] for k in order], 80)) if c == k}
    assert kept[2] == left and len(left) < len(order)

    order = sorted(left)
    lengths = {k: n - gone for k, (n, gone, _, _) in zip(order, repeats([left[k] for k in order], order), strict=True)}
    assert set(kept[3]) == set(left)
    assert all(kept[3][k] == left[k] or len(kept[3][k].encode()) <= lengths[k] < len(left[k].encode()) for k in order)
    assert sum(passage in t for t in kept[3].values()) == 1

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept[3].items()}
    for rows in (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), corpus_pipeline.run(spark, str(tmp_path)).collect()):
        got: dict[int, int] = {}
        for r in rows:
            got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert got == tokens


def test_rows_without_id_and_repeated_ids_stay(spark):
    a, b, c, d = (prose(k, 60) for k in range(4))
    docs = documents(spark, [a, a, b, c, c, d], ids=[7, 9, 7, None, None, None])
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_copies(docs).collect()) == sorted([(9, a), (7, b), (0, c), (0, d)])
    docs = documents(spark, [a, " ", b, c, None], ids=[7, 7, None, 8, None])
    kept = language_id.drop_rejected(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(7, a), (0, b), (8, c)])
    near = a + " more"
    docs = documents(spark, [a, near, b, c, near, d], ids=[3, 7, 7, None, None, 8])
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(3, a), (7, b), (0, c), (8, d)])


def test_every_stage_with_awkward_rows(spark, tmp_path):
    """Nulls in any column, repeated ids and rows, columns whose names the stages use themselves, an empty table."""
    a, b = prose(1, 70), prose(2, 70)
    extra = {c: F.lit("x") for c in ("key", "sha", "_id", "_digest", "scores", "chunk", "row", "kept", "queue", "tag", "bucket", "component", "_row")}
    rows = [(None, a, None, None, None), (None, a, "en", "s", 3), (4, None, "en", "s", None), (4, b, None, "s", 1), (4, b, None, "s", 1), (4, b + " tail", None, None, 2), (9, a + " end", "en", "t", 5), (None, None, None, None, None)]
    spark.createDataFrame([(1, None, None), (2, "http://a.b/4", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    docs = spark.createDataFrame(rows, DOCS).withColumns(extra)
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        left = frame
        for stage, function in corpus_pipeline.STAGES[:-1]:
            left = function(spark, left, str(tmp_path))
            assert left.columns == docs.columns
            left.write.parquet(str(tmp_path / f"{name}-{stage}"))
            left = spark.read.schema(left.schema).parquet(str(tmp_path / f"{name}-{stage}"))
        packed = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
        assert bool(packed) == (name == "some")
        if name == "some":
            assert sorted(r.text for r in left.collect()) == sorted([b, a + " end"])


def test_stages_begin_without_the_garbage_of_those_before(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    docs = documents(spark, [prose(1, 60), prose(2, 60)])
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
    for _, stage in corpus_pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in whole)
        stage(spark, docs, str(tmp_path))
        assert sum(b.getCollectionCount() for b in whole) > before
