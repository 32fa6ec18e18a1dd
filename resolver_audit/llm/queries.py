"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolver_audit.llm import toxicity, weak_quality
from resolver_audit.llm.cross_tokenizer import CrossTokenizer
from resolver_audit.llm.decontamination import Decontamination
from resolver_audit.llm.license_scan import LicenseScan
from resolver_audit.llm.rans import TokenFiles
from resolver_audit.llm.ranked_search import RankedSearch
from resolver_audit.llm.resharding import Resharding, text_size, write_shards
from resolver_audit.llm.sentencepiece_lattice import SentencePieceLattice
from resolver_audit.llm.signature_join import SignatureJoin
from resolver_audit.llm.storage import free_name, shared_folder, ship_code
from resolver_audit.llm.token_counts import TokenCounts
from resolver_audit.llm.vp_search import VpSearch
from resolver_audit.llm.warc import WarcArchive

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


#: Measured against brute force: see README.
VP_FACTOR = 0.15


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark, sf_dir):
    return LicenseScan().scan(table(spark, sf_dir, "documents"))


@query
def op2_sentencepiece_lattice(spark, sf_dir):
    path = tokenizer_path("piece_bpe_32k.model")
    return SentencePieceLattice(path).digests(table(spark, sf_dir, "documents"))


def held_out(doc_id) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


@query
def op3_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = toxicity.ToxicityTrainer().fit(documents, labels)
    return toxicity.scored(documents, model, "score").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op4_signature_join(spark, sf_dir):
    return SignatureJoin().join(table(spark, sf_dir, "documents"))


@query
def op5_warc(spark, sf_dir):
    return WarcArchive().round_trip(table(spark, sf_dir, "pages"))


@query
def op6_decontamination(spark, sf_dir):
    return Decontamination().matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op7_rans_tokens(spark, sf_dir):
    return TokenFiles(tokenizer_path("word_bpe_49k.json")).round_trip(table(spark, sf_dir, "documents"))


@query
def op8_vp_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return VpSearch(factor=VP_FACTOR).search(vectors, F.pmod("vec_id", F.lit(20)) == 0)


@query
def op9_min_cost_resharding(spark, sf_dir):
    # The old layout: twelve shards by text, of which the sixteen new ones keep as much as they can.
    documents = table(spark, sf_dir, "documents")
    name, slot = (free_name(documents.columns, c) for c in ("shard", "slot"))
    old = F.pmod(F.xxhash64(F.lit("old"), F.coalesce("text", F.lit(""))), F.lit(12))
    shards = write_shards(documents, old, name, shared_folder(spark, "reshard-old"))
    rows = Resharding(shards=16).reshard(shards, name, shared_folder(spark, "reshard-new"), slot)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select(
        "doc_id", text_size().alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col(name).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        old.cast("int").alias("old"),
    )


@query
def op10_weak_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = weak_quality.WeakQuality().fit(documents)
    return weak_quality.scored(documents, model, "score").select(
        "doc_id", "score", (F.col("score") >= 0.5).alias("kept")
    )


@query
def op11_cross_tokenizer(spark, sf_dir):
    aligner = CrossTokenizer(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return aligner.align(table(spark, sf_dir, "documents"))


@query
def op12_token_counts(spark, sf_dir):
    return TokenCounts(tokenizer_path("word_bpe_49k.json")).count(table(spark, sf_dir, "documents"))


@query
def op13_ranked_search(spark, sf_dir):
    return RankedSearch().search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
