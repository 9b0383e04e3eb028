"""Benchmark decontamination by winnowing.

Texts become lower-cased words. Of the hashes of K consecutive words, the minimum of every
WINDOW - K + 1 consecutive ones is kept as a fingerprint, on both sides: any shared run of
WINDOW words has such a minimum in common, so no shared window is missed. Fingerprints of
documents are joined to those of the benchmark. In documents with a match, every K words
whose hash is a fingerprint of the benchmark are extended to the windows around them, which
are joined as text to the windows of the benchmark; the covered words are counted. Items of
fewer than WINDOW words are one window each: they have no fingerprint, so all runs of their
length are hashed and joined whole.

Scale: documents are tokenised once, in one narrow pass, and their fingerprints (about one in
three words) stream into the join with partial aggregation per document behind it, so that a
row per document is shuffled, not the fingerprints. The benchmark's fingerprints and windows
are broadcast up to MAX_BROADCAST rows and joined by shuffle beyond; the results are the
same. Only documents with a match are read again. A document's hits are at most its words.

Defined cases: a null or empty text has no words and is never hit; a null item_id counts
as the item "null"; rows that repeat (also with equal doc_ids and other texts) are judged
each by its own text; null doc_ids too; an empty benchmark hits nothing; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER, ascii_lower, bind, fresh, materialize, text_of

#: All ASCII but digits and letters, one by one: a class of single characters is looked up in a table, which takes a
#: quarter of the time of one of ranges.
BREAKS = "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in "0123456789" + LOWER)
WORD = f"[^{BREAKS}]+"
WINDOW, K = 8, 4
MAX_BROADCAST = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _positions(n: Column, span: int) -> Column:
    """0 .. n - span, empty if span does not fit."""
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))


def gram_hashes(words: Column, k: int = K) -> Column:
    return F.transform(_positions(F.size(words), k), lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))


def fingerprints(words: Column) -> Column:
    """The least hash of every WINDOW - K + 1 consecutive ones; neighbours with the same one share it."""
    span = WINDOW - K + 1
    least = lambda h: F.transform(_positions(F.size(h), span), lambda i: F.least(*[h[i + j] for j in range(span)]))
    thin = lambda m: F.filter(m, lambda x, i: (i == 0) | (x != m[F.greatest(i - 1, F.lit(0))]))
    return bind(gram_hashes(words), lambda h: bind(least(h), lambda m: thin(m)))


def _marks(words: Column, short: list[int]) -> Column:
    """What a text is looked up by: its fingerprints, and all runs as long as short items."""
    return F.concat(fingerprints(words), *[gram_hashes(words, n) for n in short])


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """item, span (words), win (text): the windows of every item."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(text_of(bench)).alias("words"))
    items = items.where(F.size("words") > 0)
    n = F.size("words")
    long = items.where(n >= WINDOW).select("item", F.lit(WINDOW).alias("span"), F.explode(F.transform(_positions(n, WINDOW), lambda i: F.array_join(F.slice("words", i + 1, WINDOW), " "))).alias("win"))
    short = items.where(n < WINDOW).select("item", n.alias("span"), F.array_join("words", " ").alias("win"))
    return long.unionByName(short).distinct()


def benchmark_fingerprints(bench: DataFrame) -> DataFrame:
    """span (K, or the length of a short item), fp."""
    words = bench.select(words_of(text_of(bench)).alias("words"))
    long = words.where(F.size("words") >= WINDOW).select(F.lit(K).alias("span"), F.explode(fingerprints(F.col("words"))).alias("fp"))
    short = words.where(F.size("words").between(1, WINDOW - 1)).select(F.size("words").alias("span"), F.col("words"))
    hashed = F.coalesce(*[F.when(F.col("span") == n, F.xxhash64(*[F.get("words", F.lit(j)) for j in range(n)])) for n in range(1, WINDOW)])
    return long.unionByName(short.select("span", hashed.alias("fp"))).distinct()


def _texts(words: Column, places: Column, span: int) -> Column:
    """struct(pos, win): the runs of span words that start at the places."""
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(words, i + 1, span), " ").alias("win")))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["d"]) & (a["t"] == b["h"])


def find_hits(docs: DataFrame, bench: DataFrame, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n_words of every document, once for equal rows; d, h, n_hit, items of those with an occurring window)."""
    near = lambda side: F.broadcast(side) if side.count() <= max_broadcast else side
    windows, prints = materialize(benchmark_windows(bench)), materialize(benchmark_fingerprints(bench))
    short = sorted(r["span"] for r in windows.where(F.col("span") < WINDOW).select("span").distinct().collect())  # at most WINDOW - 1 rows
    rows = docs.select("doc_id", text_of(docs).alias("text")).withColumn("t", F.xxhash64("text"))
    read = bind(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _marks(w, short).alias("marks")))
    # explode_outer: explode would add a filter that evaluates the array a second time
    marked = rows.select("doc_id", "t", read.alias("r")).select("doc_id", "t", F.col("r.n").alias("n_words"), F.explode_outer("r.marks").alias("fp"))
    known = prints.select("fp").distinct().withColumn("known", F.lit(1))
    seen = marked.join(near(known), "fp", "left").groupBy("doc_id", "t", "n_words").agg(F.max("known").alias("known"))
    seen = materialize(seen)
    keys = seen.where("known = 1").select(F.col("doc_id").alias("d"), F.col("t").alias("h"))
    found = rows.join(near(keys), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["t"] == F.col("h")), "left_semi")
    found = materialize(found.dropDuplicates(["doc_id", "t"]).select("doc_id", "t", words_of(F.col("text")).alias("words")))
    starts = None
    for span in [WINDOW, *short]:
        k = K if span == WINDOW else span
        at = found.select("doc_id", "t", F.size("words").alias("n"), F.posexplode(gram_hashes(F.col("words"), k)).alias("p", "fp"))
        at = at.join(near(prints.where(F.col("span") == k).select("fp")), "fp", "left_semi")
        if span == WINDOW:
            # extend to all windows that hold the matched words
            reach = F.sequence(F.greatest(F.col("p") - (WINDOW - K), F.lit(0)), F.least("p", F.col("n") - WINDOW))
            at = at.where(F.col("n") >= WINDOW).select("doc_id", "t", F.explode(F.filter(reach, lambda s: (s <= F.col("p")) & (s + WINDOW <= F.col("n")))).alias("p"))
        at = at.groupBy("doc_id", "t").agg(F.collect_set("p").alias("p")).select(F.col("doc_id").alias("d"), F.col("t").alias("h"), "p")
        here = found.join(at, _same(found, at))
        here = here.select("doc_id", "t", F.lit(span).alias("span"), F.explode(_texts(F.col("words"), F.col("p"), span)).alias("w")).select("doc_id", "t", "span", "w.pos", "w.win")
        starts = here if starts is None else starts.unionByName(here)
    hits = starts.join(near(windows), ["span", "win"]).select("doc_id", "t", F.struct("pos", "span").alias("at"), "item")
    hits = hits.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("at")).alias("at"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))

    def cover(a, x):
        end = x["pos"] + x["span"]
        return F.struct((a["hit"] + F.greatest(F.lit(0), end - F.greatest(a["reach"], x["pos"]))).alias("hit"), F.greatest(a["reach"], end).alias("reach"))

    n_hit = F.aggregate("at", zero, cover)["hit"].cast("long")
    return seen.select("doc_id", "t", "n_words"), hits.select(F.col("doc_id").alias("d"), F.col("t").alias("h"), n_hit.alias("n_hit"), "items")


def contamination(docs: DataFrame, bench: DataFrame, min_items: int = 2, **limits) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row per document."""
    seen, hits = find_hits(docs, bench, **limits)
    each = materialize(seen.join(hits, _same(seen, hits), "left").select(F.col("doc_id").alias("d"), F.col("t").alias("h"), "n_words", "n_hit", "items"))
    slim = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("t"))
    both = slim.join(each, _same(slim, each), "left")
    n_items = F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long")
    return both.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, min_items: int = 2, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents, all columns, without those in which min_items items occur."""
    _, hits = find_hits(docs, bench, max_broadcast)
    d, h = fresh(docs, "hit_doc"), fresh(docs, "hit_text")
    bad = materialize(hits.where(F.size("items") >= min_items).select(F.col("d").alias(d), F.col("h").alias(h)))
    few = bad.count() <= max_broadcast
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(text_of(docs)) == F.col(h)), "left_anti")
