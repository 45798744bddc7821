"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept. All but the last return the columns
of ``documents``; each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.llm import decontamination, language, ngram_join, packing, quality
from parcelmill.llm.common import field, fresh, table, written

#: Words known to the languages of their spans must have at least this share of a text's letters; else its language is unknown.
LEAST_KNOWN_SHARE = 0.5


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, trained on the labelled documents, scores below its threshold."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh(docs, "quality_score")
    return quality.score(docs, model, into=score).where(field(score) >= quality.THRESHOLD).drop(score)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose words are mostly in none of the learned languages.

    A text with insertions of another learned language stays: each span counts by its own language.
    """
    model = language.fit(table(spark, sf_dir, "documents"))
    lang = fresh(docs, "found_lang")
    found = language.identify(docs, model, into=lang)
    spans = field(f"{lang}_spans")
    letters = F.aggregate(spans, F.lit(0).cast("long"), lambda n, span: n + span["letters"])
    known = F.aggregate(spans, F.lit(0).cast("long"), lambda n, span: n + span["known"])
    kept = (field(f"{lang}_pred") != "und") & (known >= LEAST_KNOWN_SHARE * letters)
    return found.where(kept).drop(f"{lang}_pred", f"{lang}_score", f"{lang}_spans")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id."""
    return ngram_join.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words is benchmark text."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into training sequences; one row per piece of a document."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [
    ("quality classifier", keep_good_quality),
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Classifiers and packing can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
