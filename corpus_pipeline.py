"""From raw documents to packed training sequences, in five stages.

Every stage reads all rows that the one before has kept, written as Parquet; all but the last
return the columns of ``documents``. Null and empty texts and null languages or sources are
allowed anywhere; a text without letters has no language and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stforecast.llm.exact_dedup import drop_exact
from stforecast.llm.lang_id import keep_identified, train
from stforecast.llm.mixing import document_levels, drop_to_mix, with_domain
from stforecast.llm.near_dedup import drop_near
from stforecast.llm.packing import pack
from stforecast.llm.shared import columns_of, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is undecided."""
    return keep_identified(docs, train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 0.8 of their five-word shingles the smallest doc_id stays."""
    return drop_near(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken once, up to four fifths of all words, by the weights of their sources.

    A column named domain is put aside and comes back as it was.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() == "domain"}
    mixed = drop_to_mix(with_domain(docs.withColumnsRenamed(own)), document_levels(), percent=80, seed=17)
    if own:
        mixed = mixed.drop("domain").withColumnsRenamed({aside: c for c, aside in own.items()})
    return columns_of(docs, mixed)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 2048 tokens."""
    return pack(docs, with_ids=False)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL = None  # SQL cannot compress with a dictionary, nor pack


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
