"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is reduced to a run: one row per digest with its best row and its count. Runs are merged in
binomial rounds: in round r the runs whose number agrees above the lowest r * FAN_BITS bits meet, so a row of a hot
digest never meets more than 2 ** FAN_BITS rows of its own digest in a merge. The same tree is walked down again
to hand each run its group's result, and the documents take it from their own run: no join or aggregate ever
gathers a group of copies in one place.

Two texts are equal if they are the same after deleting white space ``[\\x20\\x09-\\x0D]``. A digest is SHA-256 of the
normalised text together with its length in bytes and an independent 64-bit hash; the length and hash verify, at
every level, that rows merged under one SHA-256 are the same text.

Defined cases: NULL text counts as empty, so all empty, blank and NULL texts are one group. A NULL doc_id comes
after every other. Rows that repeat a doc_id and text are told apart by their place in the input, and one stays. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanfold.llm.common import WORD_GAPS, id_and_text, text_key
from fanfold.session import materialize

FAN_BITS = 4  # runs that meet in a merge: 2 ** FAN_BITS

DIGEST = ["text_sha256", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """The text without white space; NULL is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WORD_GAPS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One short row per document, written once: its digest, rank among equal texts, and run."""
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"), text_key("text").alias("text_key"),
        normalised(F.col("text")).alias("norm"))
    row = F.monotonically_increasing_id()
    return materialize(rows.select(
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check"), F.spark_partition_id().alias("run"), "text_key",
        # Smallest first: most code points, then doc_id with NULL last, then place in the input.
        F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id",
                 row.alias("row")).alias("rank")))


def merge_up(runs: DataFrame, level: int) -> DataFrame:
    """Merges the runs that share a parent at ``level``: smallest rank and total count per digest."""
    parent = F.shiftright("run", FAN_BITS * level).alias("run")
    return runs.select(*DIGEST, parent, "best", "n").groupBy(*DIGEST, "run").agg(
        F.min("best").alias("best"), F.sum("n").alias("n"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and text_key, which tells texts apart."""
    rows = digests(docs, id_col, text_col)
    leaves = rows.groupBy(*DIGEST, "run").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"))
    leaves = materialize(leaves)
    last = leaves.agg(F.max("run")).first()[0] or 0
    levels = [leaves]
    while last >> (FAN_BITS * (len(levels) - 1)):
        # Run numbers were shortened by the levels before, so each merge shortens them by one step.
        levels.append(materialize(merge_up(levels[-1], 1)))
    result = levels.pop().select(*DIGEST, "run", "best", "n")
    while levels:
        result = levels.pop().select(*DIGEST, "run", F.shiftright("run", FAN_BITS).alias("parent")).join(
            result.withColumnRenamed("run", "parent"), [*DIGEST, "parent"]).select(*DIGEST, "run", "best", "n")
    return rows.join(result, [*DIGEST, "run"]).select(
        F.col("rank.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rank.row") == F.col("best.row")).alias("kept"), "text_sha256", "text_key")


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
