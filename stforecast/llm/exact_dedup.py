"""Exact duplicates: groups by a 128-bit content hash, confirmed on the bytes of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stforecast.llm.shared import ascii_lower, columns_of, query, table, written

NO_ID = -(2**63)  # stands for a null doc_id inside joins


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs`` with the document that stays for its text.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. Texts are equal
    when their bytes are after lower-casing A-Z; a null text is an empty one. ``keep`` names
    the id that stays in a group: ``smallest`` or ``largest``.

    Returns doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text). Rows that
    repeat a doc_id with an equal text each count in group_size and each carry the same flag;
    a null doc_id loses against any other. An empty table gives an empty result.

    Only hashes of all documents are shuffled by hash, after a partial aggregate. Texts move
    once, by doc_id, to compare the bytes of the documents whose hash occurs more than once;
    copies of a text are combined before they are shuffled, and the joins on the hash have a
    small side per key, so that Spark can split a hot group.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    norm = ascii_lower(F.col("text"))
    digest = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(norm)).alias("hash"),
        F.unhex(F.sha2(norm, 256)).alias("sha"),
    ))
    # written, so that the join below has an exchange on either side and a hot hash can be split
    repeated = written(digest.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    suspects = digest.join(repeated, "hash").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "hash")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")

    # a doc_id given to several texts may meet a hash that is not its own: compare it again
    def members() -> DataFrame:
        found = texts.join(suspects.distinct(), "id").withColumn("norm", ascii_lower(F.col("text")))
        return found.where(F.unhex(F.md5("norm")) == F.col("hash")).select(
            F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "hash", "norm"
        )

    by_bytes = members().groupBy("hash", "norm").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("n"))
    classes = written(by_bytes.groupBy("hash").agg(
        F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"),
    ))
    out = digest.join(classes.where("texts = 1"), "hash", "left")
    collided = classes.where("texts > 1").select("hash")
    if not collided.isEmpty():  # one hash, several texts: these documents are told apart by their bytes
        out = out.join(collided, "hash", "left_anti")
        apart = members().join(collided, "hash", "left_semi")
        texts_of = apart.groupBy("hash", "norm").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("n"))
        apart = apart.join(texts_of, ["hash", "norm"]).withColumn("sha", F.unhex(F.sha2("norm", 256)))
        out = out.select("doc_id", "sha", "keep_id", "n").unionByName(apart.select("doc_id", "sha", "keep_id", "n"))
    return out.select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "sha",
    ).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a repeated row stays once."""
    stay = exact_groups(docs, keep).where("kept").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.unhex("text_sha256").alias("__sha")
    )
    rows = docs.withColumns({
        "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
        "__sha": F.unhex(F.sha2(ascii_lower(F.col("text")), 256)),
    })
    return columns_of(docs, rows.join(stay, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


@query("op9_exact_dedup", SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")
