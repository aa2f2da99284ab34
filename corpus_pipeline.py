"""Training-corpus pipeline: five operators, each stage written as Parquet and read back as the next one's input.

1. toxicity: documents that the ordinal model rejects go;
2. exact_dedup: of texts equal up to white space one stays (most code points, then smallest id);
3. near_dedup: of each group of near-duplicates the document with the smallest id stays;
4. mixing: sources are mixed to their target weights, so a document is there 0, 1 or 2 times;
5. sentencepiece: what stays is encoded; ids with begin and end id, and digests of ids and decoded text.

The first four return the columns of documents.  A stage takes (spark, docs, sf_dir).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wattle.llm import chosen_path, entropy_mix, ordinal_toxicity, quotient_dedup, sentencepiece_codec
from wattle.llm.registry import table
from wattle.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ordinal_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal_toxicity.score(docs, model).filter("not rejected").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quotient_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), sentencepiece_codec.load_model(), ids_col="ids", keep_text=False)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Model fitting, similarity joins and the tokenizer are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = scratch_path(spark, f"llm/pipeline-{name}-{uuid.uuid4().hex}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
