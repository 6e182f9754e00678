"""The corpus pipeline: each stage applies one operator to all documents that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.llm import decontamination, mixing, near_copies, suffix_dedup, toxicity
from tripmart.session import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _restored(df: DataFrame, columns: list[str], **replaced) -> DataFrame:
    """The columns of documents, taken from ``row`` where they are not ``replaced``."""
    return df.select(*[replaced[c].alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay; the model learns from the labelled ones among them all."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score_toxicity(docs, model).where(F.col("score") < toxicity.THRESHOLD)
    return _restored(kept, docs.columns, text=F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more) stays: the one with the smallest id."""
    return near_copies.keep_one(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings go from the texts; every document stays, and ``n_chars`` follows its text."""
    cut = suffix_dedup.cut_repeats(docs)
    return _restored(cut, docs.columns, text=F.col("kept"), n_chars=F.char_length("kept").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window stay."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _restored(found.where(F.col("n_hit") == 0), docs.columns, text=F.col("text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each turn that a document gets."""
    return mixing.mix(docs, mixing.count_words(docs["text"]))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

# SQL cannot state a trained network, fingerprint components or removed byte spans.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each returns is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
