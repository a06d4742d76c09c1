"""Corpus cleaning in five stages; each works on what the stage before kept.

1. language_id: documents whose language the models reject go; the models learn from the stage's own labelled rows.
2. exact_dedup: of texts equal but for blanks, one row stays.
3. near_dedup: of each group linked by SimHash or by a 5-word shingle similarity of 0.8, one row with the least id stays.
4. decontaminate: documents that hold a benchmark item, copied or paraphrased, go.
5. encode: SentencePiece ids of what is left, beside the columns of documents.

Defined results, of every stage: rows stay or go each by itself, whatever other rows have the same id or none; columns
beyond those of documents are carried along, whatever their names (where one of them is called like a column that encode
adds, the new column gets underscores); empty tables give empty results. Null texts: language_id rejects them, as it
does all without a letter; exact_dedup takes them for empty; for near_dedup all texts without a word are one group;
decontaminate keeps them; encode gives them no ids. Repeated rows: language_id keeps or rejects all, decontaminate and
encode likewise; exact_dedup and near_dedup keep one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, exact_dedup, langid, nearcopies, sentencepieces
from tideline.llm.common import scratch, scratch_path, table, write_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.predict(docs, langid.fit(docs), keep=docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.drop_near(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_texts(docs, keep=docs.columns)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("encode", encode)]
#: Language models, near-copy links and latent retrieval have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage left there goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch(spark):
            write_table(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
