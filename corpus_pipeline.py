"""Training-corpus pipeline: stages that each read what the one before them kept.

quality    documents that the classifier rejects go (score below 0.3)
lines      later copies of repeated line runs go out of the texts; a document that loses its whole text goes
near_dups  one document of each class of exact and near copies stays
mix        documents are repeated or left out so that sources come near their target weights
pack       what is left is tokenized and packed into sequences of 2048 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfind.llm import line_dedup, mixing, packing, quality, simhash
from cinderfind.llm._common import Workspace, swept


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text that was blank before stays: it has lost nothing. n_chars follows the text."""
    cut = line_dedup.dedup(docs).filter((F.size("removed") == 0) | (F.trim("text") != ""))
    if "n_chars" not in docs.columns:
        return cut.select(*docs.columns)
    length = F.when(F.size("removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("lines", cut_lines), ("near_dups", drop_near_copies), ("mix", mix_sources), ("pack", pack)]
#: A classifier that is fitted, classes of near copies and random rounding are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents. What each keeps is a table in the cluster's shared folder, which goes once the
    next one is written; so do the stages' own tables. The last stays until the end of the process, or _common.sweep()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws, before = Workspace(spark, "pipeline"), None
    for name, stage in STAGES:
        with swept():
            docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return docs
