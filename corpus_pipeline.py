"""A training corpus from raw documents: rules, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

1. Documents that the quality rules reject go; lines frequent in their host go from the texts of those kept.
2. One document of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) stays.
3. Strings of 200 bytes or more that occur twice go from the texts: a passage of 50 words is longer than that.
4. The documents are put in the order of a mixture of their sources with the target weights; none is dropped.
5. They are tokenised and packed into sequences of 2048 tokens, which follow the order of the mixture.

Rows: null, empty and very short texts fail the rules and go in stage 1. Of repeated rows one stays in stage 2 (rows that
share an id are one document there, and all of them stay or go). Null ids pass every stage, but are linked with nothing.
Null sources are one source, "". Ties go as each operator's docstring says. An empty table gives an empty result with all
columns. Columns besides those of documents are kept up to stage 4, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexarium.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from lexarium.llm.queries import MIX_WEIGHTS
from lexarium.llm.tokenizing import public_path
from lexarium.session import shared_dir

#: Bytes of the shortest repeated string that is removed.
REPEAT_BYTES = 200


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, REPEAT_BYTES)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX_WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_mixed(docs, MIX_WEIGHTS, public_path("word_bpe_49k.json"), "words", cache=100_000, keep=False)


STAGES = [("quality_rules", rules), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("pfair_mixing", mixture), ("best_fit_packing", packed)]
#: SQL cannot express shingle components over all documents in reasonable time, nor BPE tokens; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
