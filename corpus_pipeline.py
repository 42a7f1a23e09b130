"""A training corpus in five stages, each written as Parquet and read again.

language: documents whose language is told; lines: repeated passages cut; near: one
document of each near-duplicate group; mix: sources at their target weights; pack:
sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import op2_language_id, op5_mixing, op6_line_chunks, op8_packing, op9_signature_trees
from quarrystone.llm.common import materialize, read_table

STAGES = [
    ("language", op2_language_id.stage),
    ("lines", op6_line_chunks.stage),
    ("near", op9_signature_trees.stage),
    ("mix", op5_mixing.stage),
    ("pack", op8_packing.stage),
]
#: SQL cannot train the language model, roll hashes or tokenise; a test compares all rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
