"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Stages keep the columns of their input; the last one adds the token ids.  Repeated rows are alike in every decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import decontaminate as winnowing
from stopwise.llm import line_dedup as lines
from stopwise.llm import near_dedup as near
from stopwise.llm import spm_tokens
from stopwise.llm import toxicity as toxic
from stopwise.llm.store import keep, marked, read

#: Documents from this probability up are rejected as toxic.
TOXIC_FROM = 0.5


def _decided(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id is not among the decided ones; rows with a null id are never decided by id and stay.

    Few ids go, so only the rows that a bitmap marks take part in the join and no other text is shuffled.
    """
    ids = keep(gone.filter("doc_id is not null").select("doc_id").distinct())
    told = marked(docs, "doc_id", ids)
    left = told.filter("marked").drop("marked").join(ids, "doc_id", "left_anti")
    return told.filter("not marked").drop("marked").unionByName(left)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 8 calls toxic go."""
    model = toxic.fit(docs, read(spark, sf_dir, "labels"), toxic.fold_of("doc_id", 5) != 0)
    return toxic.without_toxic(docs, model, TOXIC_FROM)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; a document whose text was made up of nothing else goes with them."""
    done = lines.run_dedup(docs)
    emptied = (F.col("n_removed_lines") > 0) & ~F.coalesce("text", F.lit("")).rlike(r"\S")
    return done.filter(~emptied).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return _decided(docs, near.near_dedup(docs).filter(~F.col("kept"))).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text by the rule of operator 9 go."""
    found = winnowing.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return _decided(docs, found.filter("contaminated")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with their number and whether they decode to the text."""
    return spm_tokens.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("tokenize", tokenize)]
#: The fitted classifier and the hashed chunk boundaries have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = keep(docs) if name != STAGES[-1][0] else docs
    return docs
