"""A training corpus from raw documents: toxicity, near duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.automaton_dedup import remove_repeated_windows
from panelforge.llm.jaccard import near_duplicates
from panelforge.llm.mixing import temperature_mix, word_count
from panelforge.llm.packing import pack_documents, public_vocabulary
from panelforge.llm.toxicity import fit_toxicity, toxicity_scores
from panelforge.session import ship_package, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.5 or more; null and empty texts stay, whatever the model says of them.

    Equal rows share their fate; without labels every text stays; an empty table stays empty.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if "bias" not in model:
        return docs.select(*COLUMNS)
    clean = (F.col("score") < 0.5) | (F.coalesce("text", F.lit("")) == "")
    return toxicity_scores(docs.select(*COLUMNS), model).filter(clean).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of every group under links of 80 % of five-word runs, and every text without words."""
    found = near_duplicates(docs.select(*COLUMNS), least=(80, 100), width=5).filter("_id = component")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return (found.dropDuplicates(["_id"]) if repeated else found).select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words or more that stand earlier in the corpus; a document that has lost all words stays, empty."""
    cut = remove_repeated_windows(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix of the sources that shows every document at least once and no source more than twice over."""
    counted = docs.select(*COLUMNS, word_count(F.col("text")).alias("tokens"))
    return temperature_mix(counted, max_repetition=2.0).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row a piece."""
    return pack_documents(docs, **public_vocabulary())


Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(step: Step) -> Step:
    """The step in a session that has this package and small batches of texts, also where it is called alone and not by ``run``."""
    return lambda spark, docs, sf_dir: step(ship_package(spark), docs, sf_dir)


STAGES: list[tuple[str, Step]] = [(name, _shipped(step)) for name, step in (
    ("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("repeated_passages", without_repeated_passages),
    ("mixing", mixed), ("packing", packed))]
#: Trained scores and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's rows are written to the shared folder and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
