"""Language identification by interpolated Kneser-Ney character models.

One model of order ORDER per language, trained on a bounded sample of labelled documents:
of every language, pieces of PIECE code points from anywhere in its texts, chosen by a hash
of (doc_id, place), of SAMPLE_BYTES characters in expectation. Every label gets a model,
however long its texts; with more than about a dozen the sample of each shrinks so that the
model stays within CELLS numbers. All languages share one
sorted array of hashed n-grams per order, whose rows hold a log2 probability (interpolated
down to the uniform distribution) per language; a missing n-gram falls back to the next
shorter one with the context's back-off weights.

The language with the lowest cross-entropy per character wins. A text is rejected if that
entropy is above the language's limit: the mean over calibration documents (every fifth
of the sample, not trained on) plus MARGIN bits plus a term for short texts.

Scale: scoring is one narrow pass with a broadcast model whose size follows from the
sample's bound, not from the data; a worker holds SLICE texts at a time. Counting labels is
a partial aggregation, sampling a filter. ``drop_unknown`` sends texts only through Python;
the rows are kept by a join on the hash of the text, as the verdict depends on nothing else.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected;
languages that are null are not learnt; without any labelled text all is ``und``; repeated
rows get equal results; other columns are ignored (``drop_unknown`` keeps them all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, materialize, release

ORDER = 4
SAMPLE_BYTES, PIECE, CELLS = 400_000, 2_000, 1 << 26
DISCOUNT, MARGIN, SHORT = 0.75, 1.5, 8.0
CHUNK, SLICE = 1 << 18, 256
#: Hashes of rejected texts are broadcast up to this number (16 MB).
MAX_BROADCAST = 2_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LUT: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> lower-cased code point if a letter, else space."""
    if not _LUT:
        table = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _LUT.append(table)
    return _LUT[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points, every text after ORDER - 1 spaces; start offsets."""
    gap = " " * (ORDER - 1)
    joined = gap + gap.join(texts)
    points = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.array([len(t) for t in texts], np.int64)
    return points, np.concatenate([[0], np.cumsum(sizes + ORDER - 1)])


class Model:
    """Kneser-Ney tables of all languages; plain arrays, so that it is cheap to broadcast."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        self.alphabet = np.unique(np.concatenate([code_points(t)[0] for t in texts.values()] + [np.array([32], np.uint32)]))
        counts = [self._counts(texts[lang]) for lang in self.langs]
        n = len(self.langs)
        vocab = len(self.alphabet) + 1
        self.uniform = 1.0 / vocab
        self.keys, self.logs, self.context_keys, self.back = [], [], [], []
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for order in range(1, ORDER + 1):
            grams = np.unique(np.concatenate([c[order][0] for c in counts]))
            contexts = np.unique(grams >> np.uint64(16))
            at = np.searchsorted(contexts, grams >> np.uint64(16))
            probs, back = np.zeros((len(grams), n)), np.ones((len(contexts), n))
            # the shorter n-gram drops the first character
            tail = grams & np.uint64((1 << 16 * (order - 1)) - 1)
            for j, c in enumerate(counts):
                own, value = c[order]
                number = np.zeros(len(grams))
                number[np.searchsorted(grams, own)] = value
                total = np.bincount(at, number, len(contexts))
                kinds = np.bincount(at, number > 0, len(contexts))
                some = total > 0
                back[some, j] = np.minimum(1.0, DISCOUNT * kinds[some] / total[some])
                base = self.uniform if order == 1 else self._lower(lower, tail, order - 1, j)
                with np.errstate(divide="ignore", invalid="ignore"):
                    first = np.where(some[at], np.maximum(number - DISCOUNT, 0) / total[at], 0.0)
                probs[:, j] = first + back[at, j] * base
            lower = (grams, probs)
            hashed = grams * _MULT
            order_by = np.argsort(hashed)
            self.keys.append(hashed[order_by])
            self.logs.append(np.log2(probs[order_by]).astype(np.float32))
            hashed = contexts * _MULT
            order_by = np.argsort(hashed)
            self.context_keys.append(hashed[order_by])
            self.back.append(np.log2(back[order_by]).astype(np.float32))
        self.limits = np.full(n, np.inf)

    @staticmethod
    def _lower(lower, tail: np.ndarray, order: int, j: int) -> np.ndarray:
        grams, probs = lower
        return probs[np.searchsorted(grams, tail), j]

    def _codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        # 0 stands for unknown characters
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(np.uint64)

    @staticmethod
    def _grams(codes: np.ndarray, order: int) -> np.ndarray:
        """The n-gram that ends at each position from ORDER - 1 on."""
        n = len(codes) - ORDER + 1
        out = np.zeros(n, np.uint64)
        for j in range(order):
            out = (out << np.uint64(16)) | codes[ORDER - order + j : ORDER - order + j + n]
        return out

    def _counts(self, texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Counts of the longest n-grams; of shorter ones, the number of characters seen before them."""
        codes = self._codes(code_points(texts)[0])
        out = {ORDER: np.unique(self._grams(codes, ORDER), return_counts=True)}
        for order in range(ORDER - 1, 0, -1):
            longer = out[order + 1][0]
            out[order] = np.unique(longer & np.uint64((1 << 16 * order) - 1), return_counts=True)
        return out

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Negative log2 probability of each character from ORDER - 1 on, per language."""
        n = len(codes) - ORDER + 1
        out = np.zeros((n, len(self.langs)), np.float32)
        left = np.arange(n)
        for order in range(ORDER, 0, -1):
            grams = self._grams(codes, order)[left]
            hashed = grams * _MULT
            keys = self.keys[order - 1]
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            hit = keys[at] == hashed
            out[left[hit]] -= self.logs[order - 1][at[hit]]
            left, hashed = left[~hit], (grams[~hit] >> np.uint64(16)) * _MULT
            if not len(left):
                return out
            contexts = self.context_keys[order - 1]
            at = np.minimum(np.searchsorted(contexts, hashed), len(contexts) - 1)
            hit = contexts[at] == hashed
            out[left[hit]] -= self.back[order - 1][at[hit]]
        out[left] -= np.float32(np.log2(self.uniform))
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character by text and language, number of letters by text)."""
        points, starts = code_points(texts)
        codes = self._codes(points)
        sizes = np.diff(starts) - (ORDER - 1)
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for i, (a, size) in enumerate(zip(starts[:-1], sizes, strict=True)):
            for at in range(0, size, CHUNK):
                part = codes[a + at : a + min(at + CHUNK, size) + ORDER - 1]
                total[i] += self.bits(part).sum(0, dtype=np.float64)
        marks = np.concatenate([[0], np.cumsum(points != 32)])
        count = marks[starts[1:]] - marks[starts[:-1]]
        return total / np.maximum(sizes, 1)[:, None], count


def train(rows: list[tuple[str, str]]) -> Model | None:
    """A model with limits from (lang, text) rows; every fifth text of a language calibrates."""
    fit: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    seen: dict[str, int] = {}
    for lang, text in rows:
        seen[lang] = seen.get(lang, 0) + 1
        (held if seen[lang] % 5 == 0 else fit).setdefault(lang, []).append(text)
    if not fit:
        return None
    model = Model(fit)
    for j, lang in enumerate(model.langs):
        known = [t for t in held.get(lang, fit[lang]) if t]
        bits, count = model.entropies(known) if known else (np.zeros((0, 1)), np.zeros(0))
        good = bits[count >= 20, j] if known else bits
        # the median, so that mislabelled or junk documents do not lift the limit
        model.limits[j] = (np.median(good) if len(good) else 8.0) + MARGIN
    return model


def _predict(holder) -> object:
    names = ["doc_id", "lang_pred", "score", "bits", "rejected"]
    types = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def judged(model: Model | None, texts: list[str]) -> list[tuple]:
        if model is None:
            return [("und", 0.0, 0.0, True)] * len(texts)
        bits, count = model.entropies(texts)
        best = bits.argmin(1)
        low = bits[np.arange(len(texts)), best]
        limit = model.limits[best] + SHORT / np.sqrt(np.maximum(count, 1))
        # posterior over languages, as if 20 characters had been seen at most
        weight = np.exp2(-(bits - low[:, None]) * np.minimum(count, 20)[:, None])
        score = np.where(low <= limit, 1.0, np.exp2(limit - low)) / weight.sum(1)
        return [(model.langs[b], float(s), float(h), bool(h > m)) if c else ("und", 0.0, 0.0, True) for b, s, h, m, c in zip(best, score, low, limit, count, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = holder.value
        for whole in batches:
            for first in range(0, len(whole), SLICE):
                batch = whole.slice(first, SLICE)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                rows: list[tuple] = []
                while len(rows) < len(texts):
                    last, size = len(rows), 0
                    while last < len(texts) and (last == len(rows) or size + len(texts[last]) <= CHUNK):
                        size += len(texts[last])
                        last += 1
                    rows += judged(model, texts[len(rows) : last])
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True)]], names=names)
        release()

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_languages(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Train on pieces of documents that have a language and are not held out."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    size = F.char_length("text")
    sizes = known.groupBy("lang").agg(F.sum(size).alias("size")).where("size > 0").collect()  # a row for each label
    if not sizes:
        return None
    bound = min(sample_bytes, CELLS // len(sizes) ** 2)
    chances = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, bound / r["size"])) for r in sizes], "lang string, chance double")
    unit = lambda i: F.pmod(F.xxhash64("doc_id", F.lit("language sample"), i), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pieces = F.filter(F.sequence(F.lit(0), F.floor((size - 1) / PIECE).cast("int")), lambda i: unit(i) < F.col("chance"))
    some = known.where(size > 0).join(F.broadcast(chances), "lang").select("lang", "doc_id", "text", F.explode(pieces).alias("i"))
    rows = some.select("lang", "doc_id", "i", F.substr("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("piece")).collect()
    return train([(r["lang"], r["piece"]) for r in sorted(rows, key=lambda r: (r["lang"], str(r["doc_id"]), r["i"], r["piece"]))])


def predict_languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, bits, rejected."""
    holder = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(holder), "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected."""
    out = predict_languages(docs, fit_languages(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def drop_unknown(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those whose language is rejected."""
    holder = docs.sparkSession.sparkContext.broadcast(fit_languages(docs))
    text = F.col("text").cast("string")
    texts = docs.where("text is not null").select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
    out = texts.mapInArrow(_predict(holder), "doc_id long, lang_pred string, score double, bits double, rejected boolean")
    name = fresh(docs, "rejected_text")
    bad = materialize(out.where("rejected").select(F.col("doc_id").alias(name)).distinct())
    few = bad.count() <= MAX_BROADCAST
    return docs.where("text is not null").join(F.broadcast(bad) if few else bad, F.xxhash64(text) == F.col(name), "left_anti")
