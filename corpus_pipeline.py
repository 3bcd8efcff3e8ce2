"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), calls one corpus operator, and returns a DataFrame
that is written and read again before the next one.  All but the last return the columns of
documents; what a stage decides takes effect on what the next one sees.

Defined cases, of every stage: null text is an empty one (which the quality rules reject), null
language and source are a language and a source of their own, null doc_ids are documents without
copies.  Rows that repeat others are rows of their own until a stage drops them.  An empty table
gives an empty one.  Very long texts are processed whole.  Further columns, whatever their names,
pass through all stages but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditflow.llm import linededup, mixing, neardup, packing, quality
from auditflow.llm.store import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go from all but one of them."""
    return linededup.dedup_lines(docs).select(docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at 80 % of five-word shingles, one document stays."""
    return neardup.drop_near_copies(docs, shingle=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Tokenizing and packing have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
