"""A training corpus made in five stages, each one operator of ``graphloom.llm``.

Every stage is written as Parquet and read again as the documents of the next. All stages but the last return
the columns of documents, with further ones untouched, whatever they are called; the last returns where each piece of
each document is packed.

Defined results, on top of those in the operators' docstrings: documents without words (NULL, empty, blank) go in the first
stage; a NULL id is never a near duplicate and is packed like any other; NULL in another column stays as it is. Repeated
rows are one document to line dedup and near-dedup, which keep or take out both alike, and two documents to mixing and
packing. Ties go to the smaller id. Texts of any length are worked on whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import line_dedup, minhash, mixing, packing, quality
from graphloom.llm.common import table
from graphloom.storage import Rolling


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking of the labels rejects go; those without words have no score and go, too."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals are taken out, and long ones that it equals but for one word; a document that
    has no words left goes. Near duplicates of one earlier document stay whole: the next stage takes them out, which it
    could not if all they have in common were gone."""
    return line_dedup.without_repeats(docs, spare_copies=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest id stays. Documents without an id stay."""
    return minhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order: a source beyond its demand is cut, one short of it is repeated. A NULL source is one."""
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and the offset of every piece of every document; a document of several epochs is packed as often."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", sequence_packing),
]

#: SQL can express neither the trained classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage writes on the way goes with it, and its result once the next is written."""
    docs, tables = table(spark, sf_dir, "documents"), Rolling("stage")
    *most, (_, last) = STAGES
    for _, stage in most:
        docs = tables.step(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
