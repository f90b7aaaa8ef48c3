"""From raw documents to a training mix, in five stages of the operators in ``inkwell.llm``.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``; the last adds ``copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontam, line_dedup, mixing, near_dup, quality
from inkwell.llm._io import discard, durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.

    A null, empty or blank text goes, as it has fewer than ten words; repeated rows stay or go together; a text of any
    length is judged whole; a null id or source changes nothing; an empty table stays empty; all columns are kept.
    """
    return quality.filter_quality(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share.

    Every row stays; a null text stays null unless a line of it goes, which cannot be; a text that loses all lines is
    empty; repeated rows count as documents each, so that ten equal rows lose all their lines; rows with a null id are
    treated like others; a text of any length is split whole; an empty table stays empty; all columns are kept.
    """
    return line_dedup.dedup_lines(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more, that with the smallest id.

    A null, empty or blank text is linked with nothing and stays; so does a row with a null id; repeated rows of the
    document that stays all stay; a text of any length is one set; an empty table stays empty; all columns are kept.
    """
    return near_dup.dedup_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    A null or empty text holds none and stays; rows with one id, or all with a null id, go together if one of them holds
    a passage; a text of any length is searched whole; an empty table, or an empty benchmark, changes nothing; all
    columns are kept.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their ``copies``.

    A null, empty or blank text has no words and is not taken; a null source is a source of its own; repeated rows and
    rows with a null id are drawn one by one; equal draws come from hashes, so that reruns agree; texts of any length
    count whole; an empty table stays empty; all columns are kept.
    """
    return mixing.mix_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dup", near_dup_stage), ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, durable(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return docs


#: Dependent rounding and seeded similarity have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
