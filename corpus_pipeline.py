"""A corpus pipeline of five stages over ``documents``.

Language ID (documents that it rejects go), SimHash near-duplicates (one document of each group stays), benchmark
decontamination, mixing of sources to target weights (documents repeated as often as they are taken), and the token file.
Each stage works on all that the one before kept, written as Parquet and read again; all but the last return the columns
of ``documents``.

The language model is fitted on the stage's own documents, whatever their fold: a pipeline has no held-out part.

Defined cases: texts that are null or have no letter go in the first stage; rows with a null doc_id go through all stages
and come first in the token file; a null source is a source; of repeated rows one stays; an empty table gives an empty
result; columns beside doc_id, text, lang and source are carried along, whatever their names, up to the token file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, language_id, simhash, source_mixing, token_file
from sparkloom.llm.common import staged, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit_languages(docs, F.lit(True)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.repeat_mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the token file."""
    return token_file.token_table(docs)


STAGES = [("language_id", identify), ("simhash", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("token_ids", tokenize)]

#: No SQL expresses a trained model, an alignment or a tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
