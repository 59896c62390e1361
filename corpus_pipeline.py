"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet in the shared folder and gives it to the next.

Defined results, in every stage: columns beside doc_id and text come through untouched, whatever they are called (n_chars alone
follows a changed text); rows with a null doc_id or text stay rows; very long texts are taken whole; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import ngram_join, packing, quality_classifier, secret_scans, substring_dedup
from ledgerloom.llm.shared import free_name, materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on the labels, scores as good. Repeated rows have one fate; a null or empty text is
    scored as a text without words; without labels of both kinds all stay, unless all labels are bad."""
    model = quality_classifier.learn(docs, read(spark, sf_dir, "labels"))
    return _restored(quality_classifier.scored(_carried(docs), model).where(F.col("score") >= quality_classifier.GOOD), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id. Of rows that repeat both id and text, one.
    Rows are told apart by id and text: one text of an id may go and another one stay; a class's texts under its least id stay.
    Rows with a null doc_id and texts without words are in no class and stay, pairs at the very threshold are near duplicates."""
    classes = materialise(ngram_join.classed(docs).where("doc_id is not null"))
    other, key = free_name(docs, "_other"), free_name(docs, "_key")
    named = (F.col("doc_id").alias(other), F.col("key").alias(key))
    same = (F.col("doc_id") == F.col(other)) & (ngram_join.text_key() == F.col(key))
    gone = classes.where("class_id <> doc_id").select(*named).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), same, "left_anti")
    again = materialise(classes.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(*named))
    if again.isEmpty():
        return kept
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller doc_id holds; a text that loses nothing stays as it is, byte for byte.
    Rows of one doc_id remove nothing from each other; a row with a null doc_id neither removes nor loses anything."""
    out = substring_dedup.dedup_substrings(_carried(docs))
    return _restored(out, docs, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by a mark; overlapping spans become one. Null and empty texts stay."""
    out = secret_scans.scan(_carried(docs), secret_scans.learn(secret_scans.sample_of(docs)))
    return _restored(out, docs, F.col("clean_text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, n_tokens, bin, capacity, offset. A text without words is in no sequence."""
    return packing.pack(docs)


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no name of theirs meets one of an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(True).alias("_carried")).alias("_row"))


def _restored(out: DataFrame, docs: DataFrame, text=None) -> DataFrame:
    """docs' columns again, with another text if one is given."""
    columns = []
    for f in docs.schema.fields:
        if f.name.lower() == "text" and text is not None:
            column = text
        elif f.name.lower() == "n_chars" and text is not None:
            column = F.length(text).cast(f.dataType)
        elif f.name.lower() in ("doc_id", "text"):
            column = F.col(f.name)
        else:
            column = F.col("_row").getField(f.name)
        columns.append(column.alias(f.name))
    return out.select(*columns)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]
#: The classifier, the field and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
