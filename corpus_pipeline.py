"""Corpus pipeline: toxicity, near-dedup, decontamination, mixing, token store.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.
``run`` applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, mixing, simhash, tokenstore, toxicity
from plumbline.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing to target weights", mixing.stage),
    ("token store", tokenstore.stage),
]

#: The stages need a trained field, XXH64 and a tokenizer, which SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
