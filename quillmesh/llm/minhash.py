"""Near-duplicate documents by min-max hashing.

Texts become sets of distinct 5-word shingles. Under each of PERMUTATIONS hash functions
both the minimum and the maximum are kept: two signature values for one evaluation. Bands
of ROWS values from minima, and as many from maxima, give BANDS keys a document. Pairs at
similarity 0.85 miss all bands with a probability below 1e-9; candidates are confirmed on
the full sets, and links are joined to components.

Groups without all pairs: documents with equal sets are one node. In every bucket, members
are compared with one centre and components are joined, ROUNDS times, from the second time
on with a centre that has not been linked yet; so large groups of copies are settled by few
pairs. Members of buckets that still hold several components, as of documents that merely
share a frequent passage, go through an exact prefix join: every set's shingles are ordered
from rare to frequent, sets at the similarity share one of the first n - ceil(0.85 n) + 1,
and what both have from their first common one on must be able to reach the overlap. Only
such pairs are made. Frequent shingles stand last and bring no pairs together; nothing is
capped. Pairs are confirmed only if the numbers of shingles in BINS classes of hashes, an
upper bound of what two sets share, leave them a chance.

Scale: one narrow pass for signatures; shuffles of 8-byte band keys; full sets only for
nodes that share a bucket. Signatures, sets, links and labels are written to the shared
folder between steps; labels are found by hooking and pointer jumping on DataFrames.

Defined cases: null or wordless texts have no shingles and no links; texts of 1 to 4 words
are one shingle; repeated rows share a component; null doc_ids are linked but never name a
component; a doc_id that several texts share does not link them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, release, text_of
from .shingles import chunks, mix, set_key, shingle_sets

ROWS, BANDS = 5, 36
PERMUTATIONS = ROWS * BANDS // 2
SHARE = 85  # percent
SLICE = 2048
#: Rounds with one centre a bucket.
ROUNDS = 3
BINS = 128
#: Ids are broadcast up to this number (16 MB); beyond, texts are shuffled to them.
MAX_BROADCAST_IDS = 2_000_000

_RNG = np.random.default_rng(20240613)
_MULT = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BAND = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima and then the maxima under all hash functions."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), SLICE):
        values = _MULT[:, None] * shingles[None, at : at + SLICE] + _ADD[:, None]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = (signature.reshape(BANDS, ROWS) * _BAND).sum(1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def spread(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall into each of BINS classes of hashes; none for sets too large for bytes."""
    counts = np.bincount((shingles & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column, texts = batch.column(0), batch.column(1), batch.column(2)
        for first, data, offsets in chunks(column):
            sets = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.array([band_keys(signature(s)) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    texts.slice(first, len(sets)),
                ],
                names=["doc_id", "n", "k", "bands", "t"],
            )
    release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in chunks(batch.column(0)):
            sets = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([spread(s) for s in sets], pa.binary())], names=["k", "items", "bins"])


def _confirm(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(100 * both >= share * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bounded(share: int):
    """Of (a, b, n, m, x, y) the pairs that can reach the similarity: sizes and classes of hashes bound what both share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            both = np.minimum(n, m)
            known = np.array([x is not None and y is not None for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], bool)
            if known.any():
                mask = pa.array(known)
                x, y = (np.frombuffer(b"".join(batch.column(i).filter(mask).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
                both[known] = np.minimum(x, y).sum(1, dtype=np.int64)
            keep = 100 * both >= share * (n + m - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, n, c) of (id, items, n, c)."""
    for whole in batches:
        for first in range(0, len(whole), 512):
            batch = whole.slice(first, 512)
            items = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            at = pa.array(np.repeat(np.arange(len(items)), [len(x) for x in items]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), *[batch.column(j).take(at) for j in (0, 2, 3)]], names=["token", "id", "n", "c"])


def _prefix_pairs(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Distinct (a, b, n, m) of members(id, n, c) of different components that share a shingle of their prefixes."""
    held = materialize(sets.select("id", "items").dropDuplicates(["id"]).join(members, "id").select("id", "items", "n", "c"))
    rows = held.mapInArrow(_tokens, "token long, id long, n long, c long")
    shared = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    # shingles that no other member has come first, and need not be ordered
    mine = Window.partitionBy("id")
    place = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("often", "token")) - 1
    rows = rows.join(shared, "token").withColumn("at", place)
    rows = rows.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * share / 100)).select("token", "id", "n", "c", "at")
    rows = materialize(rows)
    several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("k > 1 and lo <> hi").select("token")
    rows = materialize(rows.join(several, "token", "left_semi"))
    other = rows.select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("c").alias("c2"), F.col("at").alias("at2"))
    enough = (100 + share) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("at2")) >= share * (F.col("n") + F.col("m"))
    close = enough & (100 * F.least("n", "m") >= share * F.greatest("n", "m")) & (F.col("id") < F.col("b")) & (F.col("c") != F.col("c2"))
    return rows.join(other, "token").where(close).select(F.col("id").alias("a"), "b", "n", "m").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of longs -> (v, label) with the smallest reachable value, for all end points."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("seen"))
        hooked = labels.join(near, "v").select("v", "label", F.least("label", "seen").alias("new"))
        # whoever was a label is itself hooked to the least value seen by its followers
        root = hooked.groupBy(F.col("label").alias("r")).agg(F.min("new").alias("up"))
        jumped = hooked.join(root, hooked["label"] == root["r"], "left").select("v", F.col("label").alias("old"), F.least("new", "up").alias("new"))
        far = materialize(jumped)
        up = far.select(F.col("v").alias("w"), F.col("new").alias("top"))
        step = far.join(up, far["new"] == up["w"], "left").select("v", "old", F.least("new", "top").alias("label"))
        step = materialize(step)
        labels = step.select("v", "label")
        if not step.where("label <> old").take(1):
            return labels


def _report(docs: DataFrame, share: int) -> DataFrame:
    """doc_id, t (hash of the text), k (key of its set), n_shingles, component_id, kept."""
    text = text_of(docs)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("raw"), F.xxhash64(text).alias("t"))
    signed = materialize(raw.mapInArrow(_sign, "doc_id long, n long, k binary, bands array<bigint>, t long"))
    nodes = signed.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # a node is a set, not a doc_id: one that is given to several texts does not link them
    nodes = materialize(nodes.where("doc is not null").withColumn("id", F.xxhash64("k")))
    member = nodes.select("k", "id", "doc", "n", F.explode("bands").alias("b"))
    shared = member.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("b")
    member = materialize(member.join(shared, "b", "left_semi"))
    wanted = materialize(member.select("id", "k", "doc").distinct())
    n_wanted = wanted.count()
    labels = nodes.select(F.col("id").alias("v"), F.col("id").alias("label")).limit(0)
    if n_wanted:
        ids = wanted.select("doc").distinct()
        ids = F.broadcast(ids) if n_wanted <= MAX_BROADCAST_IDS else ids
        texts = raw.join(ids, raw["doc_id"] == ids["doc"], "left_semi").select("raw")
        sets = texts.mapInArrow(_sets, "k binary, items binary, bins binary").join(wanted.select("id", "k"), "k")
        sets = materialize(sets.select("id", "k", "items", "bins"))
        # repeated rows bring a set twice; pairs are made distinct after their confirmation
        labels = _link(member.select("b", "id", "n"), sets, share)
    labelled = materialize(nodes.select("k", "id", "doc").join(labels, F.col("id") == F.col("v"), "left").select("k", "doc", F.coalesce("label", "id").alias("label")))
    # of a component the set with the smallest doc_id stays, of several such the one with the smallest key
    top = labelled.groupBy("label").agg(F.min(F.struct("doc", "k")).alias("top"))
    component = labelled.join(top, "label").select("k", F.col("top.doc").alias("component"), (F.col("top.k") == F.col("k")).alias("chosen"))
    out = signed.select("doc_id", "t", "n", "k").join(materialize(component), "k", "left")
    component_id = F.coalesce("component", "doc_id")
    kept = F.coalesce((F.col("doc_id") == component_id) & F.coalesce("chosen", F.lit(True)), F.lit(False))
    return out.select("doc_id", "t", "k", F.col("n").alias("n_shingles"), component_id.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return _report(docs, share).drop("t", "k")


def _link(member: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Labels (v, label) of the ids that are linked to others.

    Centres are those members whose buckets are the largest, as the source of many copies
    shares more buckets than any one copy.
    """
    sizes = member.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
    weight = member.join(sizes, "b").groupBy("id").agg(F.sum("m").alias("deg"))
    bins = materialize(sets.groupBy("id").agg(F.first("bins").alias("bins")))
    member = materialize(member.join(weight, "id"))
    labels, links, tried = None, None, None
    for step in range(ROUNDS + 1):
        state = member
        if labels is not None:
            state = member.join(labels.withColumn("linked", F.lit(1)), F.col("id") == F.col("v"), "left").drop("v")
        state = state.withColumn("c", F.coalesce("label", "id") if labels is not None else F.col("id"))
        mixed = state.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("b")
        state = materialize(state.join(mixed, "b", "left_semi").select("b", "id", "n", "deg", "c", *(["linked"] if labels is not None else [])))
        if not state.take(1):
            break
        if step < ROUNDS:
            linked = F.coalesce(F.col("linked"), F.lit(0)) if labels is not None else F.lit(0)
            middle = state.groupBy("b").agg(F.min(F.struct(linked, -F.col("deg"), "id", "n", "c")).alias("m"))
            middle = middle.select("b", *[F.col(f"m.{x}").alias(f"m_{x}") for x in ("id", "n", "c")])
            close = 100 * F.least("n", "m_n") >= share * F.greatest("n", "m_n")
            pairs = state.join(middle, "b").where((F.col("c") != F.col("m_c")) & close)
            pairs = pairs.select(F.least("id", "m_id").alias("a"), F.greatest("id", "m_id").alias("b"), "n", F.col("m_n").alias("m")).dropDuplicates(["a", "b"])
        else:
            pairs = _prefix_pairs(state.select("id", "n", "c").distinct(), sets, share)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        end = lambda name, column: bins.select(F.col("id").alias(name), F.col("bins").alias(column))
        pairs = pairs.join(end("a", "x"), "a").join(end("b", "y"), "b").select("a", "b", "n", "m", "x", "y")
        pairs = materialize(pairs.mapInArrow(_bounded(share), "a long, b long"))
        if pairs.take(1):
            found = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
            found = found.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
            found = materialize(found.mapInArrow(_confirm(share), "a long, b long").distinct())
            tried = pairs if tried is None else tried.union(pairs)
            if found.take(1):
                links = found if links is None else materialize(links.union(found))
                labels = components(links)
    if labels is None:
        labels = member.select(F.col("id").alias("v"), F.col("id").alias("label")).limit(0)
    return labels


def drop_near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents, all columns: of every component one stays, the one with the smallest doc_id.

    Rows are told apart by doc_id and text. Those without a doc_id or without words stay.
    """
    report = materialize(_report(docs, share).where("doc_id is not null and n_shingles > 0"))
    kept = report.where("kept").groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).agg(F.min("t").alias("_t"), F.count(F.lit(1)).alias("m"))
    repeated = kept.where("m > 1")
    gone = report.where("not kept").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
    again = repeated.take(1)
    if again:
        repeated = materialize(repeated)
        # texts of one set that differ in case or spaces: the one with the smallest hash stays
        other = report.where("kept").join(repeated, (F.col("doc_id") == F.col("_d")) & (F.col("k") == F.col("_k")) & (F.col("t") != F.col("_t")))
        gone = gone.union(other.select("doc_id", "t").distinct())
    row = lambda x: (docs["doc_id"].cast("long") == x["_d"]) & (F.xxhash64(text_of(docs)) == x["_t"])
    if not again:
        return docs.join(gone, row(gone), "left_anti").select(*docs.columns)
    same = repeated.select("_d", "_t")
    single = docs.join(gone.union(same), row(gone), "left_anti").select(*docs.columns)
    whole = F.struct(*docs.columns)
    twice = docs.join(same, row(same), "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return single.unionByName(twice.select("row.*"))
