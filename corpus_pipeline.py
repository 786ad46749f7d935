"""A corpus from documents: toxic texts go, near copies go, sources are mixed, texts are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes what a stage
returns as Parquet and gives it to the next. All stages but the last return the columns of documents.
Rows with null texts or ids pass through as the operators define; an empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import mixing, packing, simhash, toxicity
from wattloom.llm.common import stored, table

#: A document goes if its toxicity reaches this.
TOXIC_FROM = 0.7
#: Words of a shingle and bits that near copies may differ in.
SHINGLE, RADIUS = 3, 3
#: The mixture holds this share of the tokens that are left; no document is repeated.
BUDGET_SHARE, EPOCHS = 0.9, 1
SEQUENCE = 4096


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``TOXIC_FROM``, by a classifier fitted on their labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs, model, out="__toxicity")
    return scored.where(F.col("__toxicity") < TOXIC_FROM).select(*_columns(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, then text hash.

    A row without an id gets one above all others, made from its text. Rows that repeat an id but not
    their text are documents of their own; of rows that repeat both one stays.
    """
    made = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 61) - 1) + F.lit(1 << 61)
    named = docs.withColumn("__id", F.struct(
        F.coalesce(F.col("doc_id").cast("bigint"), made).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    ))
    groups = simhash.near_duplicates(named, key="__id", words=SHINGLE, radius=RADIUS)
    chosen = groups.where("component_id = __id").groupBy("__id").agg(
        F.count(F.lit(1)).alias("__rows")
    )
    kept = named.join(chosen, "__id")
    # A row that a table repeats is rare; only then are its rows compared.
    return (
        kept.where("__rows = 1")
        .unionByName(kept.where("__rows > 1").dropDuplicates(["__id"]))
        .select(*_columns(docs))
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture of sources by target weights."""
    return mixing.mix(docs, budget_share=BUDGET_SHARE, max_epochs=EPOCHS).select(*_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of ``SEQUENCE`` tokens."""
    return packing.pack(docs, capacity=SEQUENCE)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("mixture", mixed),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
