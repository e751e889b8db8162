"""From documents to packed training sequences: quality rules, toxicity, near duplicates, packing.

Each stage takes the documents that the one before it kept. Stages but the last return the columns that they got,
whatever their names; a stage's own columns never mix with them.

Defined results: a null text counts as empty, and goes with the quality rules; the stage for near duplicates judges
rows by their texts, whatever their ids: one row of a component stays, the one with the smallest id (a null id comes last), and
of the texts of that id the one with the smallest hash; a text without words is a duplicate only of one with its id and text;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import packing, quality, shingles, toxicity
from spindle.llm.common import dropped, table, written


def _apart(docs: DataFrame) -> DataFrame:
    """The columns of docs in one, beside those that an operator reads."""
    return docs.select(F.struct("*").alias("_row"), "doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules."""
    return quality.judged(_apart(docs)).filter("kept").select("_row.*")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold, scored by what the labelled ones among them teach."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(_apart(docs), model, into="_score").filter(F.col("_score") < toxicity.THRESHOLD).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id, and then text key, of each component of texts whose 5-word shingles are similar by 0.8 or more."""
    found = shingles.near_duplicates(docs)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x")).filter("component is not null")
    alone = found.filter("component is null").select("doc_id", "key")
    chosen = first.select("x.doc_id", "x.key").union(alone).select(F.col("doc_id").alias("_id"), F.col("key").alias("_chosen"))
    rows = _apart(docs).withColumn("_key", shingles.text_key())
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_chosen")), "left_semi")
    one = kept.groupBy("doc_id", "_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return one.select("_row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Toxicity scores, near duplicates and packing can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if "written_to" in vars(before):
            dropped(before)
    return docs
