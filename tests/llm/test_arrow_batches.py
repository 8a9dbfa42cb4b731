"""Operator 5 keeps Arrow batches and plans small."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.queries import tokenizer_file


def test_bpe_blocks_do_not_meet_in_one_batch(spark):
    """Rows as large as blocks reach Python a few at a time, not 64 MB of them."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(64 << 20))
    try:
        ranks = bpe.load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
        bpe.encode_blocks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), ranks)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

        rows = spark.range(0, 10, 1, 1).select(F.expr("sequence(1, 1000000)").alias("codes"))
        assert max(r[0] for r in rows.mapInArrow(sizes, "size long").collect()) < 16 << 20
        spark.conf.set(key, str(1 << 20))
        bpe.encode_blocks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), ranks)
        assert int(spark.conf.get(key)) == 1 << 20
    finally:
        spark.conf.set(key, before)


def test_bpe_tables_stand_once_in_the_plan(spark):
    """The driver keeps the text of each plan; the numbers of the hash table stood there twice."""
    ranks = bpe.load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    docs = spark.createDataFrame([(1, "words, unbelievablywordlike"), (2, None)], "doc_id long, text string")
    found = bpe.encode_texts(docs, ranks)
    number = str(max(bpe.pair_table(ranks)[1].tolist()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count(number) == 1
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in found.collect()} == {
        1: "words, unbelievablywordlike", 2: ""}
