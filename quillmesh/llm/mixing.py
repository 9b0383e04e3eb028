"""Mixing sources to target weights by Pareto order sampling.

Each source gets a word target by weight; no source exceeds ``max_copies`` times its own
size, and what a full source cannot take goes to the others (water filling). A source's
target is met by whole copies for certain plus a fixed-size sample of unequal inclusion
probabilities: every document gets the ranking value

    Q = odds(u) / odds(lam),    u uniform from a hash of doc_id, lam its inclusion probability

and documents are taken in the order of Q until one exceeds the source's remaining words.
What it leaves open goes, in up to PASSES passes, to the next ones in the order that fit.
``lam`` grows with the square root of the document's size class, up to 1.

Scale: the text is read once; a slim (doc_id, source, size) table is kept. Targets and
inclusion probabilities come from tables of sources and size classes, which are ranked with
one row a source, and are broadcast up to MAX_BROADCAST rows. The cut along Q is found in
two steps, by sums over BINS ranges of Q and then inside the one range in which the target
is crossed, so that no window holds more than about 1/BINS of a source.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last;
empty documents are never taken; equal doc_ids share their random number and are ordered
by size; repeated rows are taken one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, text_of

#: Single characters, not a range: they are looked up in a table.
WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
BINS, PASSES = 4096, 4
MAX_BROADCAST = 1_000_000


def water_level(df: DataFrame, budget: Column, cap: Column, weight: Column, keys: list[str], tie: str) -> DataFrame:
    """Adds ``level`` with sum(least(cap, level * weight)) = budget within keys."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy()
    order = by.orderBy(cap / weight, tie)
    full = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_cap", cap).withColumn("_weight", weight).withColumn("_try", (budget - full) / open_weight)
    fits = F.col("_cap") / F.col("_weight") >= F.col("_try")
    return df.withColumn("level", F.coalesce(F.max(F.when(fits, F.col("_try"))).over(by), F.lit(0.0)))


def _beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of a written table that has one row a key; keys may be null."""
    named = small.withColumnsRenamed({k: f"{k}_of" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(named[f"{k}_of"])
    few = small.count() <= MAX_BROADCAST
    return rows.join(F.broadcast(named) if few else named, same, "left").drop(*[f"{k}_of" for k in keys])


def take_in_order(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """rows(doc_id, source, size, q, bin, extra), extra 1 for those that the order of q takes within budget(source, rest)."""
    for step in range(PASSES):
        # what is taken so far
        used = rows.where("extra = 1").groupBy("source").agg(F.sum("size").alias("used"))
        left = _beside(budget, materialize(used), ["source"]) if step else budget.withColumn("used", F.lit(0))
        left = materialize(left.select("source", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("left")))
        wide = _beside(rows, left, ["source"])
        fits = F.coalesce((F.col("q").isNotNull()) & (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("left")), F.lit(False))
        sums = wide.where(fits).groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        upto = Window.partitionBy("source").orderBy("bin")
        sums = materialize(sums.withColumn("before", F.sum("words").over(upto) - F.col("words")))
        if not sums.take(1):
            break
        cross = sums.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
        cross = materialize(cross.select("source", F.col("bin").alias("cross_bin"), "before"))
        wide = _beside(wide.withColumn("fits", fits), cross, ["source"])
        at = F.col("fits") & F.coalesce(F.col("bin") == F.col("cross_bin"), F.lit(False))
        run = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = wide.where(at).withColumn("extra", (F.col("before") + F.sum("size").over(run) <= F.col("left")).cast("int"))
        sure = F.col("fits") & (F.col("cross_bin").isNull() | (F.col("bin") < F.col("cross_bin")))
        others = wide.where(~at).withColumn("extra", F.when(sure, 1).otherwise(F.col("extra")).cast("int"))
        rows = materialize(others.unionByName(edge).drop("left", "fits", "cross_bin", "before"))
    return rows


def mix_to_targets(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_copies: int = 2,
    seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, lam."""
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")
    slim = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")))

    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weight)
    total = F.sum("source_size").over(Window.partitionBy())
    cap = F.col("source_size") * F.lit(float(max_copies))
    sources = water_level(sources, total * share, cap, F.col("w"), [], "source")
    sources = sources.select("source", "source_size", F.least("_cap", F.col("level") * F.col("w")).alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = materialize(sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))

    rank_class = F.char_length(F.bin("size"))
    grow = F.ceil(F.sqrt(F.pow(F.lit(2.0), F.col("class")))).cast("long")
    slim = slim.withColumn("class", rank_class)
    classes = slim.where("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words")).withColumn("g", grow)
    classes = _beside(classes, sources.select("source", "rest"), ["source"])
    classes = water_level(classes, F.col("rest"), F.col("words").cast("double"), (F.col("g") * F.col("words")).cast("double"), ["source"], "class")
    classes = classes.select("source", "class", F.least(F.lit(1.0), F.col("level") * F.col("g")).alias("lam"))

    classes = materialize(classes)
    full = _beside(_beside(slim, sources, ["source"]), classes, ["source", "class"])
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    lam = F.coalesce("lam", F.lit(0.0))
    full = full.withColumn("lam", lam).withColumn("q", F.when(lam > 0, u * (1 - lam) / ((1 - u) * lam)))
    spot = F.when(F.col("q") == 0, -1).otherwise(F.floor(F.col("q") / (1 + F.col("q")) * BINS)).cast("int")
    full = full.withColumn("bin", spot).withColumn("extra", F.lit(0))
    full = materialize(full.select("doc_id", "source", "size", "source_size", "target", "whole", "lam", "q", "bin", "extra"))
    out = take_in_order(full, sources.select("source", "rest"))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long"))
    return out.select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "lam",
    )
