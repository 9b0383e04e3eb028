"""Topic models over docs(doc_id, words): LDA, LDA with Gaussian emissions, and HDP.

Sweeps are synchronous: within a sweep every document is sampled from the parameters of the
last one, then counts are aggregated. Documents and their topics stay in a written table, as
do the vocabulary and the word-topic counts; blocks of documents are joined with the counts of
their own words, and only totals per topic reach the driver. Random numbers are a function of
(seed, sweep, doc_id, position), so results do not depend on partitioning. Tokens of one
document are drawn one after the other where the model asks for it; the documents of a batch
advance together, position by position.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pack import pack, unpack
from ..functions.rng import uniform_np
from ..functions.sampling import AliasRows, break_stick, concentration, crp_tables, root_sticks
from ..functions.stirling import Stirling
from ..plans.store import written
from .blocks import BLOCK, block_of, joined
from .mixture import KAPPA0, NU0, SIGMA0

MAX_TOPICS = 2000
#: Provisional topics that a sweep can find.
NEW = 16
STATE = "doc_id long, words array<int>, z array<int>"


class Batch:
    """Documents of a batch, the longest first: their tokens in one array, position i of the first live(i) documents."""

    def __init__(self, ids: np.ndarray, lists: list[np.ndarray], values: list[np.ndarray]):
        """lists: start offsets and values of every column, all of the lengths of the first one (the words)."""
        sizes = np.diff(lists[0])
        self.order = np.argsort(-sizes, kind="stable")
        self.ids, self.sizes = ids[self.order], sizes[self.order]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), self.sizes)
        self.pos = np.arange(self.starts[-1]) - self.starts[self.doc]
        at = lists[0][self.order][self.doc] + self.pos
        self.columns = [v[at] for v in values]

    def uniform(self, seed: int, step: int, shift: int = 0) -> np.ndarray:
        """A number per token, a function of document and position."""
        return uniform_np(seed, step, self.ids[self.doc], self.pos + shift)

    def positions(self) -> Iterator[np.ndarray]:
        """Places of all tokens at position 0, 1, ...: row d belongs to document d."""
        live = np.searchsorted(-self.sizes, -np.arange(int(self.sizes[0]) if len(self.sizes) else 0), "left")
        for i, n in enumerate(live):
            yield self.starts[:n] + i

    def counts(self, z: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(self.doc * k + z, minlength=len(self.ids) * k).reshape(-1, k)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, values, len(self.ids))

    def lists(self, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), pa.array(values.astype(np.int32)))


#: Documents and tokens that are sampled together at most (a longer document is alone).
BATCH_DOCS, BATCH_TOKENS = 2048, 1 << 17
#: Numbers of a matrix that a step of a batch works on.
CELLS = 1 << 21


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null([]) if column.null_count else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets, column.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(rows: pa.RecordBatch, columns: int, extra: bool) -> Iterator[tuple]:
    """Batches of these documents; with the lists of an extra column, if there is one."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(rows):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + BATCH_DOCS]), BATCH_TOKENS, "right")))
        part = rows.slice(at, upto - at)
        at = upto
        flat = [_flat(part.column(i)) for i in range(1, columns)]
        batch = Batch(part.column(0).to_numpy(), [f[0] for f in flat], [f[1] for f in flat])
        lists = part.column(columns).to_pylist() if extra else []
        yield (batch, [lists[i] or [] for i in batch.order]) if extra else (batch,)


def per_batch(docs: DataFrame, function, schema: str, names: list[str], columns: list[str]) -> DataFrame:
    """Maps function(batch) -> doc_ids and arrays of the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for parts in _parts(rows, len(columns), False):
                ids, *out = function(*parts)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *out], names=names)

    return docs.select(*columns).mapInArrow(run, schema)


def _dense(ks: pa.Array, ns: pa.Array, width: int) -> np.ndarray:
    """A row per list of places and numbers; null: zeros."""
    out = np.zeros((len(ks), width))
    sizes = pa.compute.fill_null(pa.compute.list_value_length(ks), 0).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(ks)), sizes), ks.flatten().to_numpy(zero_copy_only=False)] = ns.flatten().to_numpy(zero_copy_only=False)
    return out


def _same(rows: np.ndarray) -> np.ndarray:
    return rows


class Weights:
    """Weights of v words under k topics, as a function of the rows of a table(word_id, ks, ns).

    A row is sparse: numbers ns at places ks below width, zeros elsewhere and where a word has
    no row. shift(rows), if given, is a logarithm per word that the weights leave out. A table
    that is a function is made and written when its rows are first asked for.
    """

    def __init__(self, v: int, k: int, table: DataFrame | Callable | np.ndarray | None, weigh: Callable = _same, width: int | None = None, shift: Callable | None = None):
        self.v, self.k, self.table, self.weigh, self.width, self.shift = v, k, table, weigh, width or k, shift

    @classmethod
    def of(cls, value: Weights | np.ndarray) -> Weights:
        return value if isinstance(value, cls) else cls(*np.shape(value), np.asarray(value, float))

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = "word_id int, ks array<int>, ns array<double>"
        if isinstance(self.table, np.ndarray):
            places = list(range(self.width))
            return spark.createDataFrame([(w, places, row.tolist()) for w, row in enumerate(self.table)], schema)
        if callable(self.table):
            self.table = written(self.table())
        return spark.createDataFrame([], schema) if self.table is None else self.table

    def of_words(self, words: DataFrame) -> DataFrame:
        """word_id, k, p of all topics of these words(word_id)."""
        k, width, weigh = self.k, self.width, self.weigh

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for at in range(0, len(rows), max(1, CELLS // max(k, width))):
                    part = rows.slice(at, max(1, CELLS // max(k, width)))
                    p = weigh(_dense(part.column(1), part.column(2), width))
                    ids = np.repeat(part.column(0).to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(k, dtype=np.int32), len(part))), pa.array(p.ravel())], names=["word_id", "k", "p"])

        rows = words.select("word_id").join(self.frame(words.sparkSession), "word_id", "left").select("word_id", "ks", "ns")
        return rows.mapInArrow(run, "word_id int, k int, p double")

    def matrix(self, spark: SparkSession) -> np.ndarray:
        """All weights, v by k, on the driver: for models of a size that fits there."""
        if isinstance(self.table, np.ndarray) and self.weigh is _same:
            return self.table
        rows = np.zeros((self.v, self.width))
        for r in self.frame(spark).toLocalIterator():
            rows[r["word_id"], r["ks"]] = r["ns"]
        return self.weigh(rows)


class Needs:
    """The blocks of documents(doc_id, words) and, by word, those that it occurs in, once for all sweeps."""

    def __init__(self, docs: DataFrame, k: int):
        self.block: Column = block_of(docs, F.size("words"), max(1 << 14, min(BLOCK, (1 << 25) // max(k, 1))))
        # dealt first, as lists of one part hardly shrink what is exchanged
        pairs = _distinct(docs.select(self.block.alias("block"), "words")).repartition("word_id")
        self.words = written(pairs.groupBy("word_id").agg(F.collect_set("block").alias("blocks")))

    def rows(self, weights: Weights) -> DataFrame:
        """block, word_id, ks, ns; without words that the weights do not know."""
        some = self.words.where(F.col("word_id").between(0, weights.v - 1))
        some = some.join(weights.frame(some.sparkSession), "word_id", "left")
        block = F.explode("blocks").alias("block") if "blocks" in some.columns else "block"
        return some.select(block, "word_id", "ks", "ns")


def _distinct(docs: DataFrame) -> DataFrame:
    """block, word_id of docs(block, words); a pair may come once from every batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = pa.compute.fill_null(pa.compute.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False)
            block, of = np.unique(rows.column(0).to_numpy(), return_inverse=True)
            words = rows.column(1).flatten().to_numpy(zero_copy_only=False)
            found = np.unique(np.repeat(of.astype(np.int64) << 32, sizes) + (words.astype(np.int64) + (1 << 31)))
            yield pa.RecordBatch.from_arrays([pa.array(block[found >> 32]), pa.array(((found & 0xFFFFFFFF) - (1 << 31)).astype(np.int32))], names=["block", "word_id"])

    return docs.mapInArrow(run, "block long, word_id int")


def per_block(docs: DataFrame, needs: Needs | None, weights: Weights, function, schema: str, names: list[str], columns: list[str], extra: str | None = None) -> DataFrame:
    """Maps function(batch, e, at, shift[, lists of the extra column]) -> doc_ids and arrays of the other columns.

    e has the weights of the words of a block, at says which row is a token's (-1: unknown
    word), shift what the weights leave out.
    """
    needs = Needs(docs, weights.k) if needs is None else needs
    width, weigh, shift = weights.width, weights.weigh, weights.shift

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.combine_chunks().sort_by("word_id")
        ids = right.column("word_id").to_numpy()
        lists = [right.column(c).combine_chunks() for c in ("ks", "ns")]
        dense = _dense(*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists], width) if len(ids) else np.zeros((0, width))
        e, left_out = weigh(dense), shift(dense) if shift else None
        out = []
        for rows in left.select([*columns, *([extra] if extra else [])]).combine_chunks().to_batches():
            for batch, *more in _parts(rows, len(columns), extra is not None):
                words = batch.columns[0]
                at = np.minimum(np.searchsorted(ids, words), max(len(ids) - 1, 0))
                at = np.where(ids[at] == words, at, -1) if len(ids) else np.full(len(words), -1)
                doc_ids, *arrays = function(batch, e, at, left_out, *more)
                out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids), *arrays], names=names))
        return pa.Table.from_batches(out)

    return joined(docs.select(needs.block.alias("block"), *columns, *([extra] if extra else [])), needs.rows(weights), run, schema)


def init_topics(docs: DataFrame, k: int, seed: int, spread: int = 15) -> DataFrame:
    """First topics: (doc_id + a draw below spread) modulo k, or uniform where spread is 0."""

    def draw(batch: Batch):
        u = batch.uniform(seed, 0)
        z = (u * k).astype(np.int64) if not spread else (batch.ids[batch.doc] + (u * spread).astype(np.int64)) % k
        return batch.ids, batch.lists(batch.columns[0]), batch.lists(z)

    return written(per_batch(docs, draw, STATE, ["doc_id", "words", "z"], ["doc_id", "words"]))


def word_topic_counts(state: DataFrame) -> DataFrame:
    """word_id, k, n"""
    tokens = state.select(F.explode(F.arrays_zip("words", "z")).alias("t"))
    return tokens.groupBy(F.col("t.words").alias("word_id"), F.col("t.z").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def doc_topic_counts(state: DataFrame) -> DataFrame:
    tokens = state.select("doc_id", F.explode("z").alias("k"))
    return tokens.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"))


def count_rows(state: DataFrame) -> DataFrame:
    """word_id, ks, ns: the counts of a word's topics as one row."""
    pairs = F.collect_list(F.struct("k", F.col("n").cast("double").alias("n"))).alias("p")
    return word_topic_counts(state).groupBy("word_id").agg(pairs).select("word_id", F.col("p.k").alias("ks"), F.col("p.n").alias("ns"))


def topic_totals(state: DataFrame, k: int) -> np.ndarray:
    out = np.zeros(k)
    for r in state.select(F.explode("z").alias("k")).groupBy("k").count().collect():  # one row per topic
        out[r["k"]] = r["count"]
    return out


def _smoothed(beta: float, totals: np.ndarray, v: int, counts: np.ndarray) -> np.ndarray:
    return (counts + beta) / (totals + v * beta)


def smoothed(state: DataFrame, v: int, k: int, beta: float, totals: np.ndarray | None = None) -> Weights:
    """Shares of the words in every topic of the state."""
    totals = topic_totals(state, k) if totals is None else totals
    return Weights(v, k, partial(count_rows, state), partial(_smoothed, beta, totals, v))


def _even(v: int, counts: np.ndarray) -> np.ndarray:
    return np.full(counts.shape, 1 / max(v, 1))


def _by_alias(batch: Batch, words: np.ndarray, emission: np.ndarray, prior: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Topics with odds n_dk * emission from those of the document alone, or prior * emission from alias tables of words."""
    z = batch.columns[1]
    pairs, count = np.unique(batch.doc * emission.shape[1] + z, return_counts=True)
    doc, topic = pairs // emission.shape[1], pairs % emission.shape[1]
    first = np.searchsorted(doc, np.arange(len(batch.ids) + 1))
    width = int(np.diff(first).max()) if len(batch.ids) else 0
    have = np.zeros((len(batch.ids), max(width, 1)), np.int64)
    n = np.zeros(have.shape)
    have[doc, np.arange(len(doc)) - first[doc]], n[doc, np.arange(len(doc)) - first[doc]] = topic, count
    weights = emission * prior
    tables, new = AliasRows(weights, words), np.empty(len(words), np.int64)
    rows = max(1, CELLS // have.shape[1])
    for at in range(0, len(words), rows):
        s = slice(at, at + rows)
        own = have[batch.doc[s]]
        cum = np.cumsum(n[batch.doc[s]] * emission[words[s, None], own], 1)
        inner, outer = cum[:, -1], weights[words[s]].sum(1)
        x = u[s] * (inner + outer)
        place = np.minimum((cum < x[:, None]).sum(1), own.shape[1] - 1)
        new[s] = np.where(x < inner, own[np.arange(len(place)), place], tables.draw(words[s], np.clip((x - inner) / outer, 0, 1 - 1e-12)))
    return new


def sweep(state: DataFrame, emission: Weights | np.ndarray, prior: np.ndarray, seed: int, step: int, sampler: str = "dense", needs: Needs | None = None) -> DataFrame:
    """Resamples every token with odds (n_dk + prior_k) * emission[word, k].

    sampler 'alias' splits the odds into the topics of the document and a part that depends on
    the word alone, drawn from alias tables; the odds are the same.
    """
    if sampler not in ("dense", "alias"):
        raise ValueError(f"unknown sampler: {sampler}")
    weights = Weights.of(emission)
    k = weights.k
    rows = max(1, CELLS // k)

    def draw(batch: Batch, e: np.ndarray, places: np.ndarray, _):
        words, z = batch.columns
        if sampler == "alias":
            return batch.ids, batch.lists(words), batch.lists(_by_alias(batch, places, e, prior, batch.uniform(seed, step)))
        n, u, new = batch.counts(z, k) + prior, batch.uniform(seed, step), np.empty(len(z), np.int64)
        for at in range(0, len(words), rows):
            s = slice(at, at + rows)
            cum = np.cumsum(n[batch.doc[s]] * e[places[s]], 1)
            new[s] = np.minimum((cum < u[s, None] * cum[:, -1:]).sum(1), k - 1)
        return batch.ids, batch.lists(words), batch.lists(new)

    return written(per_block(state, needs, weights, draw, STATE, ["doc_id", "words", "z"], ["doc_id", "words", "z"]))


def fold_in(docs: DataFrame, emission: Weights | np.ndarray, prior: np.ndarray, seed: int, sweeps: int, rest: float = 0.0, mass: float | None = None) -> DataFrame:
    """doc_id, words, z, score (summed log likelihood), size after collapsed sweeps over unseen documents.

    rest is what topics that are not there yet give to any word, mass the prior's in all.
    """
    weights = Weights.of(emission)
    k, total = weights.k, float(prior.sum()) if mass is None else mass

    def draw(batch: Batch, e: np.ndarray, places: np.ndarray, shift: np.ndarray | None):
        known = places >= 0
        if not known.all():
            starts = np.concatenate([[0], np.cumsum(batch.sums(known).astype(np.int64))])
            batch = Batch(batch.ids, [starts, starts], [batch.columns[0][known], places[known]])
            places = batch.columns[1]
        words = batch.columns[0]
        z = np.minimum((batch.uniform(seed, 1) * k).astype(np.int64), k - 1)
        n = batch.counts(z, k).astype(float)
        for s in range(sweeps):
            u = batch.uniform(seed, s + 2)
            for at in batch.positions():
                row = np.arange(len(at))
                n[row, z[at]] -= 1
                cum = np.cumsum((n[: len(at)] + prior) * e[places[at]], 1)
                z[at] = np.minimum((cum < u[at, None] * cum[:, -1:]).sum(1), k - 1)
                n[row, z[at]] += 1
        score = _scores(batch, places, n + prior, e, rest, total)
        score = score + batch.sums(shift[places]) if shift is not None and len(places) else score
        return batch.ids, batch.lists(words), batch.lists(z), pa.array(score), pa.array(batch.sizes)

    return written(per_block(docs, None, weights, draw, STATE + ", score double, size long", ["doc_id", "words", "z", "score", "size"], ["doc_id", "words"]))


def _scores(batch: Batch, words: np.ndarray, n: np.ndarray, e: np.ndarray, rest: float, total: float) -> np.ndarray:
    out = np.empty(len(words))
    rows = max(1, CELLS // n.shape[1])
    for at in range(0, len(words), rows):
        s = slice(at, at + rows)
        out[s] = np.log((n[batch.doc[s]] * e[words[s]]).sum(1) + rest + 1e-300)
    return batch.sums(out) - batch.sizes * np.log(batch.sizes + total)


def score_given_topics(state: DataFrame, emission: Weights | np.ndarray, prior: np.ndarray, rest: float = 0.0, mass: float | None = None) -> float:
    """Log likelihood per word of documents whose topics are given."""
    weights, total = Weights.of(emission), float(prior.sum()) if mass is None else mass
    k = weights.k

    def score(batch: Batch, e: np.ndarray, places: np.ndarray, _):
        return batch.ids, pa.array(_scores(batch, places, batch.counts(batch.columns[1], k) + prior, e, rest, total)), pa.array(batch.sizes)

    out = per_block(state, None, weights, score, "doc_id long, score double, size long", ["doc_id", "score", "size"], ["doc_id", "words", "z"]).agg(F.sum("score"), F.sum("size")).first()
    return float(out[0] or 0.0) / max(out[1] or 0, 1)


class _Topics:
    sampler = "dense"
    needs: Needs | None = None

    def __init__(self, k: int, iters: int, vocab: DataFrame, alpha: float, seed: int):
        if k > 65535:
            raise ValueError("too many topics")
        self.vocab = written(vocab.select("word_id", "word"))
        n, ids, least, most = self.vocab.agg(F.count(F.lit(1)), F.count_distinct("word_id"), F.min("word_id"), F.max("word_id")).first()
        if n and (ids, least, most) != (n, 0, n - 1):
            raise ValueError("word ids must count from 0")
        self.size = n
        self.k, self.iters, self.alpha, self.seed, self.state = k, iters, alpha, seed, None

    @property
    def words(self) -> list[str]:
        """The whole vocabulary, on the driver."""
        return [r["word"] for r in self._vocab().orderBy("word_id").toLocalIterator()]

    def _vocab(self, spark: SparkSession | None = None) -> DataFrame:
        if isinstance(self.vocab, list):
            spark = spark or SparkSession.active()
            self.vocab = written(spark.createDataFrame(list(enumerate(self.vocab)), "word_id int, word string"))
        return self.vocab

    def weights(self) -> Weights:
        """Weights of words under topics, held as a table."""
        return self.held

    def emission(self) -> np.ndarray:
        """The weights as a matrix, on the driver: for models of a size that fits there."""
        return self.weights().matrix(SparkSession.active())

    @property
    def phi(self) -> np.ndarray:
        return self.emission()

    @phi.setter
    def phi(self, value: np.ndarray) -> None:
        self.held = Weights.of(value)

    def prior(self) -> np.ndarray:
        return np.full(self.k, self.alpha / self.k)

    def fit(self, docs: DataFrame, valid: DataFrame | None = None, snapshot: str | None = None, every: int = 200) -> float | None:
        state, began, history = self.start(docs), time.time(), []
        for step in range(1, self.iters + 1):
            state = self.advance(state, step)
            if snapshot and (step % every == 0 or step == self.iters):
                self.save(docs.sparkSession, f"{snapshot}-{step}")
                self.get_top_words(docs.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{snapshot}-{step}-words")
                seconds = time.time() - began
                history.append((step, seconds, float(self.evaluate(valid)) if valid is not None else None))
                docs.sparkSession.createDataFrame(history, "step int, seconds double, score double").coalesce(1).write.mode("overwrite").parquet(f"{snapshot}-history")
        self.state = state
        return self.evaluate(valid) if valid is not None else None

    def start(self, docs: DataFrame) -> DataFrame:
        """First topics, and the parameters that follow from them."""
        state = init_topics(docs, self.k, self.seed)
        self.needs = Needs(state, self.k) if self.iters else None
        self.update(state)
        return state

    def advance(self, state: DataFrame, step: int) -> DataFrame:
        state = sweep(state, self.weights(), self.prior(), self.seed, step, self.sampler, self.needs)
        self.update(state)
        return state

    def evaluate(self, docs: DataFrame, sweeps: int = 50) -> float:
        """Log likelihood per word of held-out documents."""
        out = fold_in(docs, self.weights(), self.prior(), self.seed, sweeps).agg(F.sum("score"), F.sum("size")).first()
        return float(out[0] or 0.0) / max(out[1] or 0, 1)

    def predict(self, docs: DataFrame, sweeps: int = 50) -> DataFrame:
        """doc_id, pos, word_id, topic"""
        state = fold_in(docs, self.weights(), self.prior(), self.seed, sweeps)
        rows = state.select("doc_id", F.posexplode(F.arrays_zip("words", "z")).alias("pos", "t"))
        return rows.select("doc_id", "pos", F.col("t.words").alias("word_id"), F.col("t.z").alias("topic"))

    def _ranking(self) -> Weights:
        return self.weights()

    def get_top_words(self, spark: SparkSession, number: int = 15) -> DataFrame:
        """k, rank, word; clipped to the vocabulary."""
        best = top_words(self._ranking().of_words(self._vocab(spark)), number)
        return best.join(self._vocab(spark), "word_id").select("k", "rank", "word")

    def get_topic_matrix(self, spark: SparkSession) -> DataFrame:
        """word_id, k, p"""
        return self.weights().of_words(self._vocab(spark))

    def _fields(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("state", "needs", "vocab", "held", "vectors")}

    def to_bytes(self) -> bytes:
        """The model with its vocabulary and matrix, which have to fit the driver; save() writes them as tables."""
        spark = SparkSession.active()
        return pack(self._fields() | {"vocab": self.words} | {name: getattr(self, name).matrix(spark) for name in ("held", "vectors") if name in self.__dict__})

    @classmethod
    def from_bytes(cls, data: bytes):
        model = cls.__new__(cls)
        fields = unpack(data)
        fields |= {name: Weights.of(fields[name]) for name in ("held", "vectors") if name in fields}
        model.__dict__.update(fields, state=None)
        return model

    def save(self, spark: SparkSession, path: str) -> None:
        """Tables model (one row), vocab and words (the rows of the weights)."""
        spark.createDataFrame([(pack(self._fields()),)], "model binary").write.mode("overwrite").parquet(f"{path}/model")
        self._vocab(spark).write.mode("overwrite").parquet(f"{path}/vocab")
        self._stored(spark).write.mode("overwrite").parquet(f"{path}/words")

    def _stored(self, spark: SparkSession) -> DataFrame:
        pairs = self.weights().of_words(self._vocab(spark)).groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("x"))
        return pairs.select("word_id", F.col("x.k").alias("ks"), F.col("x.p").alias("ns"))

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        model = cls.__new__(cls)
        model.__dict__.update(unpack(bytes(spark.read.parquet(f"{path}/model").first()["model"])), state=None)
        model.vocab = spark.read.parquet(f"{path}/vocab")
        model._restored(spark.read.parquet(f"{path}/words"))
        return model

    def _restored(self, rows: DataFrame) -> None:
        self.held = Weights(self.size, self.k, rows)


class LDA(_Topics):
    def __init__(self, k: int, iters: int, vocab: DataFrame, alpha: float = 50.0, beta: float = 0.1, seed: int = 0, sampler: str = "dense"):
        super().__init__(k, iters, vocab, alpha, seed)
        self.sampler = sampler
        self.beta, self.held = beta, Weights(self.size, k, None, partial(_even, self.size))

    def update(self, state: DataFrame) -> None:
        self.held = smoothed(state, self.size, self.k, self.beta)

    def with_topic_matrix(self, matrix: DataFrame) -> LDA:
        given = matrix.select("word_id", "k", F.col("p").alias("new"))
        pairs = self.get_topic_matrix(matrix.sparkSession).join(given, ["word_id", "k"], "left").groupBy("word_id")
        rows = pairs.agg(F.collect_list(F.struct("k", F.coalesce("new", "p").alias("p"))).alias("x"))
        self.held = Weights(self.size, self.k, written(rows.select("word_id", F.col("x.k").alias("ks"), F.col("x.p").alias("ns"))))
        return self


def _log_density(means: np.ndarray, precision: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Word by topic, without the constant."""
    q = precision
    return 0.5 * np.log(q).sum(1) - (x * x) @ q.T + 2 * x @ (q * means).T - (q * means**2).sum(1)


def _odds(means: np.ndarray, precision: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = _log_density(means, precision, x)
    # odds over topics do not change with a factor per word
    return np.exp(s - s.max(1, keepdims=True)) + 1e-300


def _top_density(means: np.ndarray, precision: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _log_density(means, precision, x).max(1) - 0.5 * x.shape[1] * np.log(np.pi)


class GLDA(_Topics):
    """Topics are diagonal Gaussians over word vectors; the exact posterior is sampled."""

    def __init__(self, k: int, iters: int, vocab: DataFrame, word_vec: DataFrame, alpha: float = 1.0, seed: int = 0, sampler: str = "dense"):
        super().__init__(k, iters, vocab, alpha, seed)
        self.sampler = sampler
        v = F.col("v").cast("array<double>")
        rows = written(word_vec.select(F.col("word_id").cast("int").alias("word_id"), F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: i.cast("int")).alias("ks"), v.alias("ns")))
        if rows.join(self.vocab, "word_id", "left_semi").select("word_id").distinct().count() != self.size or rows.count() != self.size:
            raise ValueError("every word needs a vector")
        self.means = np.array([r["ns"] for r in rows.where(F.col("word_id") < k).orderBy("word_id").collect()], float)  # k rows
        spread = rows.select(F.posexplode("ns").alias("d", "x")).groupBy("d").agg(F.var_pop("x").alias("x")).orderBy("d").collect()  # one row per dimension
        self.vectors = Weights(self.size, len(spread), rows)
        self.precision = np.full(self.means.shape, 0.5 / np.maximum(np.array([r["x"] for r in spread]), 1e-6))

    def log_density(self) -> np.ndarray:
        """Word by topic, without the constant, on the driver."""
        return _log_density(self.means, self.precision, self.vectors.matrix(SparkSession.active()))

    def update(self, state: DataFrame) -> None:
        k, d = self.k, self.vectors.width

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, k, d))
            for rows in batches:
                n, x = _dense(rows.column(0), rows.column(1), k), _dense(rows.column(2), rows.column(3), d)
                total += np.stack([n.T @ x, n.T @ x**2])
            place = np.arange(k * d)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[0].ravel()), pa.array(total[1].ravel())], names=["at", "s1", "s2"])

        rows = count_rows(state).join(self.vectors.frame(state.sparkSession).withColumnsRenamed({"ks": "ds", "ns": "xs"}), "word_id").select("ks", "ns", "ds", "xs")
        s1, s2 = np.zeros((2, k * d))
        for r in rows.mapInArrow(sums, "at long, s1 double, s2 double").groupBy("at").agg(F.sum("s1"), F.sum("s2")).collect():  # k times d rows
            s1[r[0]], s2[r[0]] = r[1], r[2]
        s1, s2, n = s1.reshape(k, d), s2.reshape(k, d), topic_totals(state, k)
        self.means = s1 / (n + KAPPA0)[:, None]
        self.precision = 0.5 / ((s2 - (n + KAPPA0)[:, None] * self.means**2 + NU0 * SIGMA0) / (3 + NU0 + n)[:, None])

    def _weigh(self, weigh: Callable, shift: Callable | None = None) -> Weights:
        bound = [partial(f, self.means, self.precision) if f else None for f in (weigh, shift)]
        return Weights(self.size, self.k, self.vectors.table, bound[0], self.vectors.width, bound[1])

    def weights(self) -> Weights:
        return self._weigh(_odds, _top_density)

    def _ranking(self) -> Weights:
        return self._weigh(_log_density)

    def get_topic_matrix(self, spark: SparkSession) -> DataFrame:
        rows = [(k, m.tolist(), (0.5 / q).tolist()) for k, (m, q) in enumerate(zip(self.means, self.precision, strict=True))]
        return spark.createDataFrame(rows, "k int, v array<double>, var array<double>")

    def _stored(self, spark: SparkSession) -> DataFrame:
        return self.vectors.frame(spark)

    def _restored(self, rows: DataFrame) -> None:
        self.vectors = Weights(self.size, self.means.shape[1], rows)


class HDP(_Topics):
    """Topics without a fixed number; method 'simple' (direct assignment) or 'stc' (tables).

    'alias' and 'stc-alias' draw from the same odds: topics that the document has are weighed
    one by one, the part that depends on the word alone comes from alias tables.

    In a sweep every document may open a new topic. Documents are dealt to NEW provisional
    ones by a hash of (seed, sweep, doc_id), so that a sweep can find up to NEW topics; those
    that any token chose are kept. This is a frozen-count approximation of sequential sampling.
    """

    def __init__(self, k: int, iters: int, vocab: DataFrame, alpha: float = 50.0, beta: float = 0.1, gamma: float = 1.0, method: str = "simple", seed: int = 0):
        super().__init__(k, iters, vocab, alpha, seed)
        if method not in ("simple", "alias", "stc", "stc-alias"):
            raise ValueError(f"unknown method: {method}")
        self.beta, self.gamma, self.method = beta, gamma, method
        self.held, self.tau, self.left = Weights(self.size, k, None, partial(_even, self.size)), np.full(k, 1 / (k + 1)), 1 / (k + 1)
        self.tables = np.ones(k)

    def prior(self) -> np.ndarray:
        return self.alpha * self.tau

    def rest(self) -> float:
        """What a topic that is not there yet gives to any word."""
        return self.alpha * self.left / max(self.size, 1)

    def evaluate(self, docs: DataFrame, sweeps: int = 50) -> float:
        """Log likelihood per word of held-out documents, with the new topic's share; alpha is the whole prior."""
        out = fold_in(docs, self.weights(), self.prior(), self.seed, sweeps, self.rest(), self.alpha).agg(F.sum("score"), F.sum("size")).first()
        return float(out[0] or 0.0) / max(out[1] or 0, 1)

    def _sweep(self, state: DataFrame, step: int) -> DataFrame:
        v, k, seed = self.size, self.k, self.seed
        alpha, tau, left, gamma = self.alpha, self.tau, self.left, self.gamma
        total = float(self.tables.sum())
        share = alpha * self.tables**2 / (self.tables + 1) / (total + gamma)
        by_alias = self.method.endswith("alias")

        def finished(batch: Batch, z: np.ndarray, t: np.ndarray):
            """The new topic of each document at its provisional place."""
            slot = (uniform_np(seed, step, batch.ids, np.full(len(batch.ids), -1)) * NEW).astype(np.int64)
            wide = np.zeros((len(batch.ids), k + NEW), np.int64)
            wide[:, :k] = t[:, :k]
            wide[np.arange(len(slot)), k + slot] = t[:, k]
            z = np.where(z == k, k + slot[batch.doc], z)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(slot) + 1) * (k + NEW), pa.int32()), pa.array(wide.reshape(-1).astype(np.int32)))
            return batch.ids, batch.lists(batch.columns[0]), batch.lists(z), flat

        def direct(batch: Batch, weights: np.ndarray, words: np.ndarray, _, __):
            z = batch.columns[1]
            z, n, u = z.copy(), batch.counts(z, k + 1).astype(float), batch.uniform(seed, step)
            odds = np.append(alpha * tau, 0.0)
            if by_alias:
                # the new topic is a last column of the words' tables
                alone = np.concatenate([weights * odds[:k], np.full((len(weights), 1), alpha * left / v)], 1)
                tables, mass = AliasRows(alone, words), alone.sum(1)
            for at in batch.positions():
                row = np.arange(len(at))
                n[row, z[at]] -= 1
                e = np.concatenate([weights[words[at]], np.full((len(at), 1), 1 / v)], 1)
                if by_alias:
                    cum = np.cumsum(n[: len(at)] * e, 1)
                    inner, outer = cum[:, -1], mass[words[at]]
                    x = u[at] * (inner + outer)
                    z[at] = np.where(x < inner, np.minimum((cum < x[:, None]).sum(1), k), tables.draw(words[at], np.clip((x - inner) / outer, 0, 1 - 1e-12)))
                else:
                    p = (n[: len(at)] + odds) * e
                    p[:, k] += alpha * left / v
                    cum = np.cumsum(p, 1)
                    z[at] = np.minimum((cum < u[at, None] * cum[:, -1:]).sum(1), k)
                n[row, z[at]] += 1
            full, t = np.append(tau, left), np.zeros((len(batch.ids), k + 1), np.int64)
            for d, doc_id in enumerate(batch.ids):
                rng = np.random.default_rng([seed, step, int(doc_id) & 0x7FFFFFFF])
                for j in np.flatnonzero(n[d]):
                    t[d, j] = crp_tables(int(n[d, j]), alpha * full[j], rng)
            return finished(batch, z, t)

        def seated(batch: Batch, weights: np.ndarray, words: np.ndarray, _, before: list):
            z = batch.columns[1]
            z, n = z.copy(), batch.counts(z, k + 1)
            t = np.zeros_like(n)
            for d, have in enumerate(before):
                t[d, : min(len(have), k)] = have[:k]
            t = np.minimum(np.maximum(t, n > 0), n)
            if by_alias:
                alone = weights * share
                by_word, mass, again = AliasRows(alone, words), alone.sum(1), batch.uniform(seed, step, 1 << 25)
            u, leave = batch.uniform(seed, step), batch.uniform(seed, step, 1 << 24)
            for at in batch.positions():
                live, row = len(at), np.arange(len(at))
                j = z[at]
                mine, tables = n[row, j], t[row, j]
                # the customer leaves; with odds t / n the table was theirs alone
                alone = (tables == mine) | ((tables > 1) & (leave[at] * mine < tables - 1))
                t[row, j] -= alone
                n[row, j] -= 1
                a, b = n[:live], t[:live]
                some = a > 0
                grow, join = np.ones((live, k + 1)), np.zeros((live, k + 1))
                join[some], grow[some] = _STIRLING.ratios(a[some], np.minimum(np.maximum(b[some], 1), a[some]))
                e = np.concatenate([weights[words[at]], np.full((live, 1), 1 / v)], 1)
                old = join * (a + 1 - b) / (a + 1) * e
                new = np.empty((live, k + 1))
                new[:, :k] = share * e[:, :k] * grow[:, :k] * (b[:, :k] + 1) / (a[:, :k] + 1)
                new[:, k] = alpha * gamma / v / (total + gamma)
                if by_alias:
                    # topics that the document lacks come from the word's table; one that it has is drawn anew among the others
                    lacks = np.concatenate([a[:, :k] == 0, np.zeros((live, 1), bool)], 1)
                    inner, absent = np.where(lacks, 0, new), np.where(lacks, new, 0)
                    cum = np.cumsum(np.concatenate([old, inner], 1), 1)
                    outer = np.maximum(mass[words[at]] - (share * e[:, :k] * ~lacks[:, :k]).sum(1), 0)
                    x = u[at] * (cum[:, -1] + outer)
                    topic = by_word.draw(words[at], np.clip((x - cum[:, -1]) / np.maximum(outer, 1e-300), 0, 1 - 1e-12))
                    had = ~lacks[row, topic]
                    if had.any():
                        among = np.cumsum(absent[had], 1)
                        topic[had] = np.minimum((among < again[at[had], None] * among[:, -1:]).sum(1), k - 1)
                    to = np.where(x < cum[:, -1], np.minimum((cum < x[:, None]).sum(1), 2 * k + 1), k + 1 + topic)
                else:
                    cum = np.cumsum(np.concatenate([old, new], 1), 1)
                    to = np.minimum((cum < u[at, None] * cum[:, -1:]).sum(1), 2 * k + 1)
                z[at] = j = to % (k + 1)
                n[row, j] += 1
                t[row, j] = np.maximum(t[row, j] + (to > k), 1)
            return finished(batch, z, t)

        rule = direct if self.method in ("simple", "alias") else seated
        return written(per_block(state, self.needs, self.weights(), rule, STATE + ", t array<int>", ["doc_id", "words", "z", "t"], ["doc_id", "words", "z"], "t"))

    def _reconcile(self, state: DataFrame, step: int) -> DataFrame:
        """Counts, tables and sticks; empty topics go, provisional ones stay if used."""
        width = self.k + NEW
        counts = topic_totals(state, width)
        tables = np.zeros(width)
        for r in state.select(F.posexplode("t").alias("k", "t")).groupBy("k").agg(F.sum("t").alias("t")).collect():
            tables[r["k"]] = r["t"] or 0
        alive = np.flatnonzero(counts > 0)
        if len(alive) > MAX_TOPICS:
            raise RuntimeError("ran out of topics")
        rng = np.random.default_rng([self.seed, step])
        self.k, counts, tables = len(alive), counts[alive], np.maximum(tables[alive], 1)
        self.tables = tables
        self.tau, self.left = root_sticks(tables, self.gamma, rng)
        if self.left < 1e-9:
            part, self.left = break_stick(1e-3, self.gamma, rng)
            self.tau *= 1 - 1e-3
        self.gamma = concentration(self.gamma, int(tables.sum()), self.k, rng)
        new = F.array(*[F.lit(int(np.searchsorted(alive, i)) if i in set(alive.tolist()) else -1) for i in range(width)])
        keep = F.array(*[F.lit(int(i)) for i in alive])
        state = written(state.select("doc_id", "words", F.transform("z", lambda x: F.get(new, x)).alias("z"), F.transform(keep, lambda i: F.coalesce(F.get("t", i), F.lit(0))).alias("t")))
        self.held = smoothed(state, self.size, self.k, self.beta, counts)
        return state

    def start(self, docs: DataFrame) -> DataFrame:
        state = init_topics(docs, self.k, self.seed, spread=0)
        self.needs = Needs(state, self.k + NEW)
        seen = F.transform(F.sequence(F.lit(0), F.lit(self.k)), lambda i: F.array_contains("z", i).cast("int"))
        return self._reconcile(written(state.withColumn("t", seen)), 0)

    def advance(self, state: DataFrame, step: int) -> DataFrame:
        return self._reconcile(self._sweep(state, step), step)

    def get_topic_matrix(self, spark: SparkSession) -> DataFrame:
        share = F.element_at(F.array(*[F.lit(float(x)) for x in self.tau]), F.col("k") + 1)
        return super().get_topic_matrix(spark).withColumn("p", F.col("p") * share)


_STIRLING = Stirling(256)


def top_words(word_topic: DataFrame, number: int = 15) -> DataFrame:
    """k, rank, word_id of word_topic(word_id, k, p), ties by id."""
    order = Window.partitionBy("k").orderBy(F.desc("p"), "word_id")
    return word_topic.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number).select("k", "rank", "word_id")
