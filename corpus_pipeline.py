"""A training-data pipeline in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result
is written as Parquet and read again. All but the last return the columns of ``documents``:
further columns are left behind at the first stage.

Edge cases: rows with a null or repeated id pass as their operators say; stage ``near_duplicates``
keeps all rows of a kept id and every row without an id; ``repeated_passages`` drops documents of
which only white space is left after it removed something; ``source_mix`` repeats a row for each
epoch in which it is read; null texts are empty texts in the last stage. Empty tables pass
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, minhash, mixture, quality_rank, suffix_dedup
from plumbline.llm.common import stored
from plumbline.llm.queries import MIX, source_domain, tokenizer_file

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string",
           "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[docs[c].cast(kind).alias(c) for c, kind in COLUMNS.items()])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the ranking rejects go."""
    rows = _documents(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rank.keep_good(rows, quality_rank.learn_quality(rows, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the document with the smallest id of each group stays."""
    rows = _documents(docs)
    gone = minhash.near_duplicates(rows).filter(~F.col("kept")).select("doc_id").distinct()
    return rows.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: passages that an earlier document has are cut out."""
    note = F.to_json(F.struct("lang", "source"))
    left = suffix_dedup.remaining_texts(_documents(docs), note)
    kept = left.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\s]"))
    named = kept.withColumn("note", F.from_json("note", "lang string, source string"))
    return named.select("doc_id", "text", "note.lang", "note.source",
                        F.length("text").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents of each source up to its share of the token budget."""
    return mixture.mix_sources(_documents(docs), source_domain(F.col("source")), MIX).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids, checked by decoding them."""
    ranks = bpe.load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    # Executors still hold what earlier stages took, so a task keeps fewer pieces.
    return bpe.encoding_report(docs, ranks, most_pieces=1 << 18)


STAGES = [
    ("good_quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

# The ranking, the shingle sets and the byte-pair merges have no SQL form; tests hold every stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
