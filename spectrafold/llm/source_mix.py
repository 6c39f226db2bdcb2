"""Mixing sources to target weights by hash keys, prefix sums and exact cuts.

Every document gets a hash-random key. Within its source the keys are cut into equal ranges, so
many that a range holds a bounded number of rows whatever the size of the source. Token counts
are summed per (source, range), the sums of the ranges before give each range its offset, and a
window inside the range gives each document its first position. A source's budget is then whole
epochs plus a cut at an exact position. All steps are functions of the rows, so reruns agree.

Results for odd input: a null text has no words; a null source is a source of its own, sorted
last; rows that repeat an id are separate rows; a source without words has target and taken 0;
an empty table gives an empty result; columns with clashing names stay in the payload untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import with_index
from ..session import durable
from .registry import WHITE, query, table

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST = 3  # times a document may be taken
RANGE_ROWS = 20_000  # rows that a key range holds on average


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no white space."""
    bare = F.rtrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.length(F.regexp_replace(bare, rf"[{WHITE}]*+[^{WHITE}]++", "x")).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, payload: bool) -> DataFrame:
    """doc_id, source, src (never null), size, key and, on wish, the whole row."""
    cols = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("src"),
            word_count(F.col(text_col)).alias("size")]
    if payload:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return docs.select(*cols).withColumn("key", F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """src, source_size, target from src, source, source_size.

    Budgets follow the weights; what a source cannot take within ``most`` epochs is dealt out
    again by weight among the others until none is above. Only sums reach the driver.
    """
    ranked, _ = with_index(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = durable(ranked.select("src", "source_size", weight.alias("weight"),
                                   (F.col("source_size") * most).alias("cap")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(rate) > F.col("cap")
        row = ranked.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))),
                         F.sum(above.cast("int"))).first()
        if row[2] == full or not row[1]:
            break
        rate, full = (total - row[0]) / row[1], row[2]
    return ranked.select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(rate))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, most: int = MOST, seed: str = "mix", payload: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken per row, and ``row`` if the payload is wanted."""
    light = durable(_keyed(docs, id_col, text_col, source_col, seed, False))
    rows = light.count()
    digits = max(0, math.ceil(math.log(max(rows, 1) / RANGE_ROWS, 16))) + 1
    part = F.substring("key", 1, digits)

    sums = light.groupBy("src", part.alias("part")).agg(F.sum("size").alias("part_size"), F.first("source").alias("source"))
    sums = durable(sums)
    sizes = sums.groupBy("src").agg(F.first("source").alias("source"), F.sum("part_size").alias("source_size"))
    before = W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (sums.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
              .join(source_targets(sizes, weights, most), "src")
              .select("src", "part", "part_start", "source_size", "target"))

    full = _keyed(docs, id_col, text_col, source_col, seed, True) if payload else light
    inside = W.partitionBy("src", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (full.withColumn("part", part).join(starts, ["src", "part"])
              .withColumn("start", F.col("part_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    cut = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("start")))
    keep = ["doc_id", "size", "source_size", "target", (whole * F.col("size") + cut).cast("long").alias("taken")]
    return placed.select(*keep, "row") if payload else placed.select(*keep)


def mixed_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: every epoch of a document is a row.

    The one document per source that the budget cuts comes with the words before the cut (and
    its own number of characters). Documents without words are not part of a mixture.
    """
    mixed = mix(docs, text_col=text_col, payload=True, **options).filter("taken > 0")
    turns = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = mixed.withColumn("turn", F.explode(F.sequence(F.lit(1), turns)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("turn") - 1) * F.col("size"))
    text = F.col(f"row.`{text_col}`")
    # only the cut rows evaluate the pattern
    head = F.expr(f"regexp_extract(row.`{text_col}`, concat('^(?:[\\\\x20\\\\x09-\\\\x0D]*+[^\\\\x20\\\\x09-\\\\x0D]++){{', _words, '}}+'), 0)")
    each = each.withColumn("_words", words.cast("string")).withColumn("_cut", words < F.col("size"))
    each = each.withColumn("_text", F.when(F.col("_cut"), head).otherwise(text))
    out = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text_col:
            value = F.col("_text")
        elif c == chars_col:
            value = F.when(F.col("_cut"), F.length("_text").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return each.select(*out)


@query("op2_source_mix", r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
k AS (SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source),
r AS (SELECT *, CAST(3 * source_size AS DOUBLE) / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s),
l AS (SELECT *, row_number() OVER o AS i, CAST(total - (sum(3 * source_size) OVER o - 3 * source_size) AS DOUBLE)
  / (all_w - (sum(w) OVER o - w)) AS rate FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT rate FROM l WHERE ratio >= rate ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * (SELECT rate FROM f)) AS target FROM s),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
  + least(size, greatest(0, budget % source_size - start)) END AS BIGINT) AS taken FROM p
""")
def op2(spark, folder):
    return mix(table(spark, folder, "documents"))
