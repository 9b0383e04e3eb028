"""Documents in blocks, each joined with the rows of a word table that it needs.

A block holds about so many tokens, and what a task gets is one block and the rows of its
distinct words, so that neither the driver nor a task ever holds the table. Blocks are ranges
of doc_id, which keeps documents that lie together in one block (its words are then told
apart before they are exchanged); ids that are spread too unevenly are hashed instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20


def block_of(docs: DataFrame, size: Column, most: int = BLOCK) -> Column:
    """The block of a document(doc_id): about `most` in sum of sizes; a function of doc_id alone."""
    size = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")
    r = docs.agg(F.sum(size).alias("all"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-(r["all"] or 0) // most), min(cores, (r["all"] or 0) // (most // 8)))
    if n == 1:
        return F.lit(0).cast("long")
    if r["hi"] - r["lo"] < 1 << 62:
        by_range = F.expr(f"(doc_id - ({r['lo']}L)) div {(r['hi'] - r['lo']) // n + 1}L")
        if docs.groupBy(by_range.alias("b")).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] <= 4 * most:
            return by_range
    return F.pmod(F.xxhash64("doc_id"), F.lit(n))


def needed(docs: DataFrame, block: Column, words: str | Column, name: str) -> DataFrame:
    """block, name: the distinct words of every block."""
    return docs.select(block.alias("block"), F.explode(F.array_distinct(words)).alias(name)).distinct()


def joined(docs: DataFrame, rows: DataFrame, function, schema: str) -> DataFrame:
    """function(documents, rows) -> table over the Arrow tables of every block."""
    return docs.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(function, schema)
