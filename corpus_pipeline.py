"""A training-data pipeline: five filtering and mixing stages over the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverflux.llm.common import discard, free_name, materialize
from riverflux.llm.decontaminate import contaminated
from riverflux.llm.language import LEAST_SCORE, UNDETERMINED, identify, learn_profiles
from riverflux.llm.mixing import mix_sources
from riverflux.llm.simhash import simhash_groups
from riverflux.llm.toxicity import THRESHOLD, score_toxicity, train
from riverflux.scratch import note, temporary_tables


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below the threshold."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "toxic")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < THRESHOLD).drop(score)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told; the documents' own columns are as they were, whatever their names."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    judged = identify(whole, learn_profiles(docs))
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def row_key(docs: DataFrame) -> Column:
    """Tells rows apart by id and text, rows without an id last; never null itself, so that nulls meet in a join."""
    return F.struct(docs["doc_id"].isNull().alias("no_id"), docs["doc_id"].alias("doc_id"), F.md5(docs["text"].cast("binary")).alias("text_md5"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest id, one without an id only where none has any."""
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, row_key(docs))
    groups = simhash_groups(keyed.select(F.col(key).alias("key"), "text"), id_col="key")
    first = groups.where(F.col("key") == F.col("component_id")).select(F.col("key").alias(key)).distinct()
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no window of a benchmark item."""
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    key = free_name(docs, "key")
    bad = hits.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5").alias(key))
    return docs.withColumn(key, row_key(docs)).join(bad, key, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it, so not at all where it takes none.

    The columns of documents, and size, source_size, target and taken as the mix reports them (taken: words of all
    copies of the document), copies, and copy, which counts them from 1. Columns of these names are replaced."""
    out = mix_sources(docs, keep=tuple(docs.columns))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int"))
    report = ["size", "source_size", "target", "taken", "copies"]
    own = [c for c in docs.columns if c not in (*report, "copy")]
    return out.where("copies > 0").select(*own, *report, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Three of the stages are trained or compare fingerprints, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each other stage is written as a table, and what it wrote on its way and the one before it are
    deleted then; a caller can put the whole run into temporary_tables() too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with temporary_tables(spark):
            out = materialize(stage(spark, docs, sf_dir), kept=True)
        discard(docs)  # a table of documents that was given is no table of ours
        note(out._scratch_path)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
