"""A training corpus from the documents table: five stages, each on what the last one kept.

Language ID drops documents that the character models reject; line dedup removes repeated
lines from the texts; near-dedup keeps one document of each group; decontamination drops
documents in which two or more benchmark items occur; mixing samples the sources to their
target weights and returns how often each chosen document is to be repeated.

Defined cases: documents without a text or without letters go in the first stage; rows of one
doc_id with different texts are judged one by one; what a doc_id, source or other column holds
decides nothing but the mix (by source); an empty table gives an empty result; every stage but
the last keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import decontaminate, language, lines, minhash, mixing
from quillmesh.llm._shared import delete, materialize, own_folder, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unknown(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs, exact_short=True)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of the documents that the mix takes."""
    mixed = mixing.mix_to_targets(docs)
    return mixed.where("copies > 0").select("doc_id", "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("op8_language_id", identify_language),
    ("op2_line_dedup", dedup_lines),
    ("op10_near_duplicates", dedup_documents),
    ("op5_decontamination", decontaminate_documents),
    ("op7_source_mixing", mix_sources),
]

#: The models of the first stage have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's own tables, and what it read, are deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outer, before = f"{shared_dir(spark)}/corpus", None
    for _, stage in STAGES:
        with own_folder(spark):
            docs = materialize(stage(spark, docs, sf_dir), outer)
        if before:
            delete(spark, before)
        before = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return docs
