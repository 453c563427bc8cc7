"""The corpus pipeline: quality rules, near-duplicates, private data, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` applies
them to ``documents`` and cuts the lineage between stages in the folder that the
cluster shares.  No stage can be said in SQL as a whole (a trained model, a
sampling design, a tokenizer), so ORACLE_SQL is None and tests hold the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.llm import pipeline_stages as stages
from corpusgraph.llm.common import cut_lineage, table
from corpusgraph.llm.queries import piece_model, pseudonym_key

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: stages.keep_good(docs, table(spark, sf_dir, "labels"))),
    ("near_duplicates", lambda spark, docs, sf_dir: stages.drop_near_copies(docs)),
    ("private_data", lambda spark, docs, sf_dir: stages.hide_private(docs, pseudonym_key(spark))),
    ("mixing", lambda spark, docs, sf_dir: stages.mix_sources(docs)),
    ("pieces", lambda spark, docs, sf_dir: stages.encode(docs, piece_model())),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
