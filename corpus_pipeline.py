"""Raw documents to a token store, in stages; each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewright.llm import decontaminate, language_id, mixing, ngram_join, token_store
from pricewright.llm.common import staged, table

STAGES = [
    ("language ID", language_id.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
    ("token-ID / binary output", token_store.stage),
]

#: A trained model and a tokenizer are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = staged(function(spark, docs, sf_dir), name.split("/")[0].strip().replace(" ", "-"))
    return docs
