"""Cleans a corpus and encodes what is left; each stage calls one operator of the llm subpackage.

Each stage takes the documents that its predecessor kept, with all their columns, and the
folder of the other tables. All but the last return rows and columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resolver_audit.llm import toxicity, weak_quality
from resolver_audit.llm.decontamination import Decontamination
from resolver_audit.llm.queries import held_out, table, tokenizer_path
from resolver_audit.llm.sentencepiece_lattice import SentencePieceLattice
from resolver_audit.llm.signature_join import SignatureJoin, representatives
from resolver_audit.llm.storage import bounded_batches, ship_code, stored


def prepare(spark: SparkSession) -> None:
    """What the Python workers of every stage need."""
    ship_code(spark)
    bounded_batches(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality model accepts."""
    prepare(spark)
    return weak_quality.kept(docs, weak_quality.WeakQuality().fit(docs))


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar accepts; taught by the labels outside the held-out fifth."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return toxicity.kept(docs, toxicity.ToxicityTrainer().fit(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    prepare(spark)
    return representatives(docs, SignatureJoin())


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return Decontamination().kept(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's doc_id and ids, and length and checksum of the text decoded from these."""
    prepare(spark)
    return SentencePieceLattice(tokenizer_path("piece_bpe_32k.model")).round_trip(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", nontoxic),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", encoded),
]

#: Learned models and merges cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
