"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``docs``. ``run`` writes each stage's result as Parquet into the shared folder and reads it again as the next one's input,
so a lost executor repeats no earlier stage.

1. ``language_id``: texts without a letter (NULL, empty, only signs) have no language and go.
2. ``exact_dedup``: of texts that are equal without white space, the longest stays, then the smallest doc_id.
3. ``near_dedup``: of linked texts, the smallest doc_id stays.
4. ``decontamination``: texts that hold a window of a benchmark item go.
5. ``packing``: one row per piece, as ``op1`` gives it.

Defined cases are those of the operators. Rows that repeat doc_id and text are one document from stage 2 on; extra columns
are carried along, whatever their names; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fanfold.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from fanfold.llm.common import in_remainder, keep_rows, table
from fanfold.llm.queries import tokenizer_file
from fanfold.session import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.reject_unknown(docs, language_id.train(docs.where(~in_remainder("doc_id", 4, 2))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, exact_dedup.deduplicate(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, near_dedup.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("decontamination", drop_contaminated), ("packing", pack_sequences)]

# Neither trained models nor local search can be told in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
