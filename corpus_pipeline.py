"""A corpus pipeline in five stages, each an operator of corpuscle.llm over all that the stage before has kept.

Stages take and return tables with the columns of documents (the last returns
its own): language ID, toxicity, SimHash near-duplicates, mixing to target
weights, BPE. run() writes each stage to the shared folder and reads it again.

Every stage takes empty tables, null ids and texts, repeated rows and columns of
any further name; what becomes of such rows its docstring says. Internal columns
get names that the table doesn't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, langid, mixing, resemblance, toxicity
from corpuscle.llm.queries import tokenizer_path
from corpuscle.llm.shared import fresh, workers_import, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (und: null ones and those without a letter); all others stay, repeated rows and null ids too."""
    workers_import(spark)
    model = langid.train(docs.where(~langid.held_out()))
    prefix = fresh(docs, "language_lang_pred")[0].removesuffix("lang_pred")
    return langid.identify(docs, model, docs.columns, prefix).where(F.col(f"{prefix}lang_pred") != "und").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents predicted as toxic; learns from all labels that aren't held out.

    Texts without words are kept, repeated rows are judged alike, and a document without an id is judged by its text like any other.
    """
    workers_import(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = langid.held_out("doc_id", 5, 0)
    model = toxicity.train(docs.where(~out), labels.where(~out))
    prefix = fresh(docs, "toxicity_predicted")[0].removesuffix("predicted")
    return toxicity.score(docs, model, docs.columns, prefix).where(F.col(f"{prefix}predicted") == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a resemblance of 0.8 or more over five-word shingles.

    SimHash proposes links, exact resemblance decides, and a prefix join finds the couples that SimHash misses. The
    smallest id stays (ties: the smallest hash of the text), null ids come last; texts without words are one group;
    unlike texts of one id are two documents; of rows that agree in id and text one stays.
    """
    workers_import(spark)
    return resemblance.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those it doesn't take go.

    Rows that agree in id, text and source are taken alike. Null ids are mixed like any other. Texts
    without words cost nothing: they stay once if their source is taken at all.
    """
    key, size, copies, copy = fresh(docs, "key", "size", "copies", "copy")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = F.sha2(F.concat_ws("\x1f", F.col("doc_id").isNull().cast("string"), part("doc_id"), F.col("source").isNull().cast("string"), part("source"), F.col("text").isNull().cast("string"), part("text")), 256)
    keyed = docs.withColumn(key, name)
    rows = keyed.select(key, "doc_id", "source", mixing.word_count().alias("size")).groupBy(key).agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias(size), F.sum("size").alias("size"))
    sized = rows.select(key, size, "doc_id", "size", F.array("source").alias("sources"))
    found = mixing.mix(sized, carry=[key, size])
    taken = found.select(key, F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.signum("target")).cast("int").alias(copies)).where(F.col(copies) > 0)
    return keyed.join(taken, key).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each copy; a null text counts as empty, null ids and repeated rows stay."""
    workers_import(spark)
    return bpe.digests(docs, tokenizer_path())


STAGES = [("language ID", language), ("toxicity", toxic), ("SimHash near-dedup", near_duplicates), ("mixing", mix), ("BPE", encode)]

#: The stages learn models, so that no SQL tells the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
    return docs
