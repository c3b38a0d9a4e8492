"""The queries opN_<name> of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, html, langid, licenses, media, mixing, pq, simhash, toxicity, urls
from corpuscle.llm.shared import workers_import

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.concat_ws(",", "languages").alias("languages"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, of every document."""
    return bpe.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: by the stated rules, else by mined ones."""
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels that aren't held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = langid.held_out("doc_id", 5, 0)
    model = toxicity.train(docs.where(~out), labels.where(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted", "word")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-equal embeddings of one label."""
    return pq.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every document's payload, read back from the chunk store."""
    return media.features(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", mixing.word_count().alias("size"), F.array("source").alias("sources"))
    return mixing.mix(sized).drop("sources")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document's lines or whole text match best."""
    return licenses.documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


ALL = [op1_language_id, op2_main_text, op3_bpe, op4_url_filter, op5_toxicity, op6_embedding_dedup, op7_media_chunks, op8_mixing, op9_simhash, op10_license_scan]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_import(spark)
            return f(spark, sf_dir)

        run.__doc__ = f.__doc__
        return run

    return {f.__name__: ready(f) for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_dedup": pq.SQL, "op8_mixing": mixing.SQL, "op10_license_scan": licenses.sql()}
