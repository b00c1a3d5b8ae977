"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the
columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylake.llm import langid, linededup, minhash, packing, substring
from quarrylake.llm.scratch import Scratch, passing

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", linededup.stage),
    ("minhash_dedup", minhash.stage),
    ("substring_dedup", substring.stage),
    ("packing", packing.stage),
]

#: Language scores, sketches and token ids are not expressible in SQL; the tests hold stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next reads it; what a stage
    read and what it wrote on its way is deleted then."""
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with passing(spark):
            docs = s.keep(stage(spark, docs, sf_dir), name, arrow_rows=500)
        if before is not None:
            s.drop(before)
        before = docs
    return docs
