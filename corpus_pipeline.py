"""A training-data pipeline over documents: five stages, each applying one operator to all it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm import mixing, pieces, secrets, simhash, toxicity
from lanewise.llm.common import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts toxic go; it learns from the labels of those given.

    Without labels of both kinds, or for texts without a word, a document stays.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, unchanged."""
    return simhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced and ``n_chars`` follows the text. Null and empty texts stay so."""
    return secrets.masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as the mixture of sources takes it, from not at all to three times.

    Null and empty texts occur once; which of several equal documents get a copy
    more is settled by the hash of the id, and rows that repeat are documents of
    their own.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as pieces: doc_id, n_pieces, pieces, and whether they decode to the text.

    Rows with equal id and text, as mixing makes them, are numbered and so cut into
    pieces each in its own way. Null texts have null pieces, empty ones none.
    """
    equal = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return pieces.encode(docs.withColumn("_nth", F.row_number().over(equal)), copy="_nth")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: A trained network, hashes of shingles and a compressor decide what stays; SQL has none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for the table of documents.

    Every stage but the last is written to the shared scratch folder and read again.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
