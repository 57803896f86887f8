"""A corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages return the columns of documents; the last one returns each document as often as the mix takes
it, as one row with its number of copies. Empty tables go through all stages; other columns are carried along, whatever
their names, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join
from rasterloom.llm.storage import drop_ids, read_table, stage


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or without any letter) go; all others stay, whatever their ids."""
    model = language_id.fit(docs.select("lang", "text"))
    found = language_id.identify_with(docs, model)
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest id; so does one of repeated rows, and of rows without an id."""
    return exact_dedup.remove_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links the one with the smallest id stays.

    Texts without words link with nothing and stay, and so do rows without an id; of rows that repeat an id, all stay or
    all go.
    """
    groups = ngram_join.near_duplicates(docs.select("doc_id", "text"))
    return drop_ids(docs, groups.where("doc_id <> component_id").select("doc_id"), "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of two or more benchmark items go; rows without an id stay."""
    return decontaminate.remove_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of the documents that the mix takes.

    A document that it takes several times is one row. Texts of size 0 may be taken; they add nothing.
    """
    return mixing.plan(docs).where("copies > 0")


STAGES = [
    ("language ID", identify_languages),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: Language ID and the link components have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}")
    return docs
