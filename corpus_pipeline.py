"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``,
the documents its predecessor kept.  All but the last return the columns of
documents.  ``run`` writes each stage as parquet in the shared folder and rereads it.

Defined cases: texts that are null or empty go through every stage (the
classifier rates them by its thresholds alone, they have no near duplicates and
nothing to remove, and pack as one end id); rows with a null doc_id stay
whatever they are near to; an empty table gives an empty result; columns beside
those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import table, written
from blockloom.llm.jaccard import similarity_classes
from blockloom.llm.packing import packed
from blockloom.llm.quality import scored, trained
from blockloom.llm.repeats import drop_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_CARRIED = ("text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = trained(docs, table(spark, sf_dir, "labels"))
    rated = scored(docs, model, carry=_CARRIED).where("keep")
    return rated.select("doc_id", *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(_CARRIED)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays.

    Rows that repeat an id stay or go together: they stay if one of them leads its group.
    """
    classes = similarity_classes(docs, "doc_id", "text")
    gone = classes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("leads")).where("not leads").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows go; a text that loses none stays as it is."""
    out = drop_repeats(docs, "doc_id", "text", carry=_CARRIED)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed along the curve."""
    return packed(docs, "doc_id", "text")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: The classifier, MinHash and the tokenizer have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
