"""Raw documents to token ids: language, exact copies, near copies, benchmark passages, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of ``documents``; the last
returns doc_id, lang, source, n_tokens and the packed ids. ``run`` writes each stage to the shared folder and reads it
again, so a lost executor costs at most the tasks of one stage; what a stage wrote on its way, and the table of the stage before, are deleted.

All stages: documents are rows, so a null or repeated doc_id is a document like any other; further columns stay, whatever their names, until the
last; an empty table stays empty; whole texts are read, however long. Null and empty texts go at the first stage. Ties go as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from gridloom.llm import bpe, decontaminate, exact_dedup, language_id, simhash
from gridloom.llm.common import remove, scratch, shared_path, table, written


#: Rows in an Arrow batch: whole texts pass through several processes of an executor at once.
BATCH_ROWS = 1000


def _lean(spark: SparkSession) -> None:
    """For the session from here on: a stage's rows are made after the stage has returned, so the setting can't be taken back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With ``lang`` as inferred from the text, and without the documents whose text is in no language (null, empty, no letters). Ties: the language that sorts first."""
    _lean(spark)
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for blanks: the longest, then the least doc_id (nulls last), then the first in the files."""
    _lean(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id (nulls last, then the first in the files) of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Candidates share a block of sampled shingles and differ in at most ``simhash.LOOSE_BITS`` of 512 bits; the shingles decide.
    """
    _lean(spark)
    return simhash.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item, or all of a shorter item."""
    _lean(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids as little-endian unsigned 32-bit integers."""
    _lean(spark)
    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode(rows, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_dedup", near), ("decontaminate", clean), ("bpe", tokens)]

#: SQL has neither the language model, nor XXH64 and connected components, nor BPE: tests/llm checks against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
