"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing to target weights, byte-level BPE.

``run`` applies the stages to ``documents``; each is written as Parquet to the shared folder and
read again as the next one's input.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from marketlens.llm.byte_bpe import RANKS, token_digests  # noqa: E402
from marketlens.llm.common import table  # noqa: E402
from marketlens.llm.lines import dedup_lines  # noqa: E402
from marketlens.llm.mixing import mix  # noqa: E402
from marketlens.llm.similar import one_of_similar  # noqa: E402
from marketlens.llm.toxicity import scored, trained  # noqa: E402
from marketlens.session import stored  # noqa: E402


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learned from the labelled documents, rejects go."""
    scorer = trained(spark, table(spark, sf_dir, "documents"), sf_dir)
    return scored(docs, scorer, drop=False).filter("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; the first of each class stays. ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    return out.select(*[F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return one_of_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those not taken go."""
    taken = mix(docs).filter("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, per row of the mix."""
    return token_digests(docs, RANKS)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dup", simhash),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

# SQL cannot express the learned grammar, the cube method's draws or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
