"""Corpus preparation: five stages from raw documents to packed sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
works on all rows that the stage before it kept.  All but the last return the
columns of ``documents``.

* quality: learns from ``labels`` and drops the documents that the classifier
  rejects (score below 0.7); a text that no label can tell apart stays.
* near_dedup: keeps one document of each SimHash component, the one with the
  smallest doc_id; of rows that repeat an id one per distinct text stays, and
  rows without an id stay, as no decision can name them.
* substring: removes passages that repeat another document's; every document
  stays, if need be with an empty text.
* secrets: replaces the found spans by a mark; every document stays.
* pack: the packed pieces, one row each.

No stage can be written in SQL alone, so there is no oracle; tests compare the
stages with brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractus.llm import packing, quality, secrets, simhash, substring
from tractus.llm.common import crc_mod, documents, materialize

ACCEPT = 0.7
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    feats = materialize(quality.features(docs), "quality-features")
    model = quality.fit(feats, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    return quality.accepted(docs, model, ACCEPT)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(docs).select("doc_id", "component_id").where("doc_id is not null")
    # ids that need an action: dropped, or on several rows
    acts = materialize(found.groupBy(F.col("doc_id").alias("_id"))
                       .agg(F.max(F.col("doc_id") != F.col("component_id")).alias("_drop"), F.count(F.lit(1)).alias("_n"))
                       .where("_drop or _n > 1").select("_id", "_drop"), "near-duplicates")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"))
    tagged = rows.join(acts, F.col("d.doc_id").cast("long") == F.col("_id"), "left")
    once = tagged.where("_id is null").select("d.*")
    again = tagged.where("_id is not null and not _drop").select("d.*").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cut_spans(docs, substring.near_duplicate_spans(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, secrets.fit(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring", substring_stage),
    ("secrets", secrets_stage),
    ("pack", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
