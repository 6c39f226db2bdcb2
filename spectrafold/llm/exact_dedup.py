"""Exact deduplication: local, then salted, then global combining of equal contents.

A group of copies of any size is combined where it lies (map side), then per salt, then once
more over the salts; the content itself is a grouping key at each of these steps, the digest
only places it. The way back is salted as well: the verdict of a group reaches its (digest,
salt) parts first and the documents from there, so that no task sees a whole hot group.

Results for odd input: a null text counts as empty; all empty texts are one group; of rows that
repeat the smallest id one stays; a null id counts as larger than any other and stays only in a
group without other ids; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable
from .registry import WHITE, query, table

SALTS = 32  # parts of a group of copies


def one_space(text: Column) -> Column:
    """Each run of white space as one space; lone spaces need no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D][{WHITE}]*+|\x20[{WHITE}]++", " ")


def _contents(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), one_space(F.col(text_col)).alias("content"))
    return (rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
            .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    contents = _contents(docs, id_col, text_col, salts)
    salted = contents.groupBy("digest", "salt", "content").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = salted.repartition("digest").groupBy("digest", "content").agg(
        F.min("first").alias("first"), F.sum("size").alias("size"))
    # different contents under one digest would mix two groups: that stops the job
    verdicts = whole.groupBy("digest").agg(F.min("first").alias("keep_id"), F.sum("size").alias("group_size"),
                                           F.count(F.lit(1)).alias("contents"))
    verdicts = verdicts.filter(F.when(F.col("contents") == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit("two contents share a SHA-256 digest")).cast("boolean"))).drop("contents")

    light = durable(contents.select("doc_id", "digest", "salt"))
    parts = light.select("digest", "salt").distinct().join(verdicts, "digest")
    same = W.partitionBy("digest", "salt", "doc_id").orderBy("doc_id")
    out = light.join(parts, ["digest", "salt"]).withColumn("_turn", F.row_number().over(same))
    return out.select("doc_id", "keep_id", "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_turn") == 1)).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


@query("op3_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
""")
def op3(spark, folder):
    return exact_dedup(table(spark, folder, "documents"))
