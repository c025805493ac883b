import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from prunecluster.llm import queries
from prunecluster.llm.batches import public_tokenizer


@pytest.fixture(scope="module")
def whole(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_stages_in_order_keep_columns(spark, whole, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    docs = whole.unionByName(spark.createDataFrame([(10_001, "12 34", None, "s", 5), (10_002, None, None, None, None)], whole.schema))
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == whole.columns
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert kept.items() <= before.items()
        if name == "language ID":
            assert set(before) - set(kept) == {10_001, 10_002}
        if name == "exact dedup":
            lowered = {"".join(c.lower() if "A" <= c <= "Z" else c for c in t): 0 for t in before.values()}
            assert len(kept) == len(lowered)
        before = kept


def test_run_packs_what_stays(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    kept = {r.doc_id for r in rows}
    tokenizer = Tokenizer.from_file(public_tokenizer())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.doc_id in kept}
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert own == [(n, s, min(2048, len(ids) - s), zlib.crc32(data[4 * s : 4 * s + 8192])) for n, s in enumerate(range(0, len(ids), 2048))]
    assert max(Counter({r.sequence_id: 0 for r in rows}).keys()) < len(rows)


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_on_repeated_rows_and_an_empty_table(spark, whole, small):
    few = whole.orderBy("doc_id").limit(40)
    other = few.select(spark_null("doc_id", "long"), "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, few.limit(0), small).count() == 0
        once = sorted(map(repr, stage(spark, few, small).collect()))
        # a table that is loaded twice, and once more without ids
        if name != "language ID":
            assert sorted(map(repr, stage(spark, few.union(few).union(other).repartition(5), small).collect())) == once
            assert stage(spark, other.union(other), small).count() == len(once)
    assert corpus_pipeline.STAGES[-1][1](spark, few.limit(0), small).count() == 0


def spark_null(name, kind):
    from pyspark.sql import functions as F

    return F.lit(None).cast(kind).alias(name)
