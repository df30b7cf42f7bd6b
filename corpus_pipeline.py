"""A training corpus from raw documents: toxicity, lines, near-duplicates, passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give
the columns of ``docs``. The stages work on whatever their predecessor left.

In every stage null texts stay null and count nowhere, empty tables stay empty, extra
columns pass through whatever their names, and texts may be of any length. Two texts under
one id are two documents, but for near-duplicates, where an id is one vertex and goes or
stays with all its rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigflow.llm.lines import without_repeated_lines
from sigflow.llm.neardup import near_duplicates
from sigflow.llm.packing import best_fit_pack
from sigflow.llm.spans import without_repeats
from sigflow.llm.toxicity import fit_toxicity, without_toxic
from sigflow.session import checkpoint, table

#: Words in a passage that may not repeat.
PASSAGE = 50


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: counts from all labelled rows, linear fit on a bounded sample of them. Without labels nothing goes."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), fold=None))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, exactly or nearly, a line that stays: the first by (doc_id, line). Rows with a null id stay as they are."""
    return _measured(without_repeated_lines(docs))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id. Rows with a null id stay."""
    gone = checkpoint(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct())  # of a known size: if small, the texts stay where they are
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of PASSAGE words or more that occur elsewhere too, in whichever rows. Rows with a null id stay as they are."""
    return _measured(without_repeats(docs, length=PASSAGE))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 from what is left; a null or empty text is its end token. Rows with a null id are left out; of equal pieces any comes first."""
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: A learned classifier and a tokenizer are among the stages, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
