"""A training corpus from raw documents: filter, deduplicate, mix and pack.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir), works on all
rows of ``docs`` and returns a DataFrame; the runner writes it as Parquet and reads it
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import exact, jaccard, mix, packing, toxicity
from sparkloom.llm.common import read, tokenizer_file
from sparkloom.staging import Stage

#: Near duplicates: words of a shingle, and the least similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees reject go; without usable labels all stay.

    Null and empty texts score as texts without features and stay. Repeated rows share their verdict; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, of repeated rows with that id one.

    A null text is an empty one; a null doc_id is the smallest. An empty table stays empty.
    """
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id stays; null ids lose to others.

    Null, empty and wordless texts are like nothing and stay. An empty table stays empty.
    """
    return jaccard.drop_near_duplicates(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document appears as often as the mix takes it.

    A null text has size 0 and takes no words, whatever its copies; a null source is a source. An empty table stays empty.
    """
    return mix.emit_copies(mix.mix_sources(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    A null or empty text is its end id alone, repeated rows are packed each for itself, and a null doc_id stays null. An empty table packs into nothing.
    """
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: The classifier and the vocabulary have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = read(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for i, (_, step) in enumerate(STAGES):
        docs = stage.write(step(spark, docs, sf_dir), f"stage{i}")
        stage.only(f"stage{i}")
    return docs
