"""Corpora as DataFrames: tokens, vocabularies, counts, and the text formats they come from."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators.blocks import block_of, joined, needed
from ..plans.store import written

DELIMITERS = r"[ \t\n\r\f]+"
#: Characters of text in a block of documents.
BLOCK_CHARS = 1 << 23
#: A short list of our own; pass another table of words for other needs.
STOPWORDS = (
    "a an and are as at be but by for from has have he her his i if in into is it its me my no not of on or our she so "
    "that the their them then there these they this to was we were what when which who will with you your"
).split()


def with_ordinal(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds 0, 1, 2, ... by the order, with a distributed sort: no task holds all rows."""
    at = F.monotonically_increasing_id()
    df = written(df.orderBy(*order).withColumn("_part", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted(df.groupBy("_part").count().collect())  # one row per partition
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    base = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _base long")
    return df.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_row")).drop("_part", "_row", "_base")


def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, word; split at space, tab, newline, return and form feed only."""
    return docs.select("doc_id", F.posexplode(words_of(text)).alias("pos", "word"))


def words_of(text: str = "text") -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), DELIMITERS), lambda w: w != "")


def drop_stopwords(tokens: DataFrame, stopwords) -> DataFrame:
    if isinstance(stopwords, DataFrame):
        return tokens.join(stopwords.select("word").distinct(), "word", "left_anti").select("doc_id", "pos", "word")
    return tokens.where(~F.col("word").isin(list(stopwords))) if stopwords else tokens


def word_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def min_count(tokens: DataFrame, trunc: int) -> DataFrame:
    """Tokens whose word occurs more than trunc times."""
    return tokens.join(word_counts(tokens).where(F.col("n") > trunc).select("word"), "word", "left_semi").select("doc_id", "pos", "word")


def build_vocab(tokens: DataFrame, known: DataFrame | None = None, trunc: int = 0) -> DataFrame:
    """word_id, word in order of first appearance, of words that occur more than trunc times; a known vocabulary keeps its ids and grows."""
    return _numbered(tokens, F.count(F.lit(1)), known, trunc)


def _numbered(seen: DataFrame, n: Column, known: DataFrame | None, trunc: int) -> DataFrame:
    """build_vocab() of rows seen(word, doc_id, pos), of which n is the number of tokens they stand for."""
    # (doc_id, pos) as one number: a least struct would make Spark sort all tokens. Decimals are for ids that a long has no room for
    near = F.col("doc_id").between(0, (1 << 31) - 1)
    wide = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    least = [F.min(F.when(near, F.shiftleft(F.col("doc_id").cast("long"), 32) + F.col("pos"))).alias("a"), F.min(F.when(~near, wide)).alias("b")]
    first = seen.groupBy("word").agg(*least, *([n.alias("n")] if trunc else []))
    first = first.where(F.col("n") > trunc) if trunc else first
    first = first.select("word", F.least(F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)")).alias("first"))
    if known is None:
        return with_ordinal(first, ["first"], "n").select(F.col("n").cast("int").alias("word_id"), "word")
    start = known.agg(F.coalesce(F.max("word_id") + 1, F.lit(0))).first()[0]
    fresh = with_ordinal(first.join(known, "word", "left_anti"), ["first"], "n")
    return known.select("word_id", "word").unionByName(fresh.select((F.col("n") + start).cast("int").alias("word_id"), "word"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists (null: 0) and all their values."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()


def _looked_up(sizes: np.ndarray, values: pa.Array, keys: pa.Array, found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The same lists of what is found for their values; values without a key are dropped."""
    place = pa.compute.index_in(values, value_set=keys)
    known = pa.compute.is_valid(place)
    ends = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(sizes)])]
    return ends, found.take(place.filter(known))


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _split(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """As words_of(), but with empty words, which no vocabulary has."""
    return _flat(pa.compute.split_pattern_regex(texts, DELIMITERS))


def _encoded(docs: DataFrame, column: str, block: Column, words: str | Column, vocab: DataFrame, lists) -> DataFrame:
    """A block of documents meets only its own words, so that tokens are not exchanged one by one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, values = lists(left.column(column))
        ends, ids = _looked_up(sizes, values, _one(right.column("word")), _one(right.column("word_id")))
        some = pa.array(np.flatnonzero(np.diff(ends)))
        coded = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
        return pa.table({"doc_id": _one(left.column("doc_id")).take(some), "words": coded.take(some)})

    rows = needed(docs, block, words, "word").join(vocab.select("word", F.col("word_id").cast("int").alias("word_id")), "word")
    return joined(docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), column), rows, run, "doc_id long, words array<int>")


def encode_texts(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, words of docs(doc_id, text), tokenized."""
    return _encoded(docs, "text", block_of(docs, F.length("text"), BLOCK_CHARS), words_of(), vocab.where("word <> ''"), _split)


#: Characters of text that share a dictionary of their own.
PART_CHARS = 1 << 24
_PARTS = "block long, doc_id long, words array<int>, code int, word string, pos int, n long"


def _part(block: int, docs: pa.Table) -> list[pa.RecordBatch]:
    """Rows of these documents, coded by their own dictionary, and rows of its words: where each is first and how often it occurs."""
    docs = docs.take(pa.compute.sort_indices(docs, [("doc_id", "ascending")], null_placement="at_end"))
    ids = _one(docs.column("doc_id"))
    sizes, values = _split(docs.column("text"))
    some = pa.compute.not_equal(values, "")
    ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(sizes)])]
    coded = values.filter(some).dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    first = np.empty(len(words), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    doc = np.searchsorted(ends, first, "right") - 1
    kinds = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("words", pa.list_(pa.int32())), ("code", pa.int32()), ("word", pa.string()), ("pos", pa.int32()), ("n", pa.int64())])

    def rows(size: int, **columns) -> pa.RecordBatch:
        columns |= {"block": pa.array(np.full(size, block))}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds], schema=kinds)

    number = np.bincount(codes, minlength=len(words))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int32()))
    return [
        rows(len(ids), doc_id=ids, words=lists),
        rows(len(words), doc_id=ids.take(pa.array(doc)), code=pa.array(np.arange(len(words))), word=words, pos=pa.array(first - ends[doc]), n=pa.array(number)),
    ]


def _parts(most: int, batches):
    from pyspark import TaskContext

    block, kept, chars = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            upto = max(at + 1, int(np.searchsorted(ends, most - chars + (ends[at - 1] if at else 0), "right")))
            kept.append(table.slice(at, upto - at))
            chars += int(ends[upto - 1] - (ends[at - 1] if at else 0))
            at = upto
            if chars >= most or at < len(batch):
                yield from _part(block, pa.concat_tables(kept))
                block, kept, chars = block + 1, [], 0
    if kept:
        yield from _part(block, pa.concat_tables(kept))


def encode_corpus(docs: DataFrame, trunc: int = 0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, words, vocabulary) as build_vocab() and encode_texts() give them, but texts are split once and tokens are not exchanged.

    What meets is one row for each word of a part of the texts, and not one for each token.
    """
    split = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_parts, PART_CHARS), _PARTS))
    own = split.where(F.col("word").isNotNull())
    vocab = written(_numbered(own.select("word", "doc_id", "pos", "n"), F.sum("n"), None, trunc))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, codes = _flat(left.column("words"))
        codes, at = codes.to_numpy(zero_copy_only=False), right.column("code").to_numpy()
        ids = np.full(max(at.max(initial=-1), codes.max(initial=-1)) + 1, -1, np.int32)
        ids[at] = right.column("word_id").to_numpy()
        found = ids[codes]
        ends = np.concatenate([[0], np.cumsum(found >= 0)])[np.concatenate([[0], np.cumsum(sizes)])]
        some = pa.array(np.flatnonzero(np.diff(ends)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[found >= 0]))
        return pa.table({"doc_id": _one(left.column("doc_id")).take(some), "words": lists.take(some)})

    rows = own.select("block", "code", "word").join(vocab, "word").select("block", "code", "word_id")
    # both come from one table: a new name tells their columns apart
    left = split.where(F.col("word").isNull()).select((F.col("block") + 0).alias("block"), "doc_id", "words")
    return joined(left, rows, run, "doc_id long, words array<int>"), vocab


def encode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, words: array of word ids in order; words outside the vocabulary are dropped."""
    lists = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    lists = written(lists.select("doc_id", F.col("w.word").alias("words")))
    return _encoded(lists, "words", block_of(lists, F.size("words")), "words", vocab, _flat)


def decode(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, text: the words joined by single spaces."""
    block = block_of(docs, F.size("words"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, values = _flat(left.column("words"))
        ends, words = _looked_up(sizes, values, _one(right.column("word_id")), _one(right.column("word")))
        some = pa.array(np.flatnonzero(np.diff(ends)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)
        return pa.table({"doc_id": _one(left.column("doc_id")).take(some), "text": pa.compute.binary_join(lists, " ").take(some)})

    rows = needed(docs, block, "words", "word_id").join(vocab.select("word_id", "word"), "word_id")
    return joined(docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "words"), rows, run, "doc_id long, text string")


def read_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """doc_id, text of a file with one document per line; header drops a first line of counts."""
    at = F.monotonically_increasing_id()
    lines = with_ordinal(spark.read.text(path).select(at.alias("_at"), F.col("value").alias("text")), ["_at"], "doc_id").drop("_at")
    return lines.where("doc_id > 0").withColumn("doc_id", F.col("doc_id") - 1) if header else lines


def read_corpus(spark: SparkSession, path: str, vocab: DataFrame | None = None, stopwords=(), header: bool = False) -> tuple[DataFrame, DataFrame]:
    """(docs(doc_id, words), vocab(word_id, word)) of a text file."""
    tokens = drop_stopwords(tokenize(read_lines(spark, path, header)), stopwords)
    vocab = build_vocab(tokens, vocab)
    return encode(tokens, vocab), vocab


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select(F.col("doc_id").cast("int").alias("word_id"), F.col("text").alias("word"))


def clean_word(word: Column) -> Column:
    return F.regexp_replace(word, "[^A-Za-z0-9]", "")


def read_uci(spark: SparkSession, docword: str, vocab: str) -> tuple[DataFrame, DataFrame]:
    """(counts(doc_id, word_id, n) from 0, vocab) of a header-and-triples file; checks its bounds."""
    lines = spark.read.text(docword).select(F.split(F.trim("value"), r"\s+").alias("p"))
    heads = [int(r["value"]) for r in spark.read.text(docword).limit(3).collect()]
    counts = lines.where(F.size("p") == 3).select(*[(F.col("p")[i].cast("int") - d).alias(c) for i, (c, d) in enumerate((("doc_id", 1), ("word_id", 1), ("n", 0)))])
    words = read_vocab(spark, vocab)
    if words.count() != heads[1]:
        raise ValueError("the vocabulary's size differs from the header")
    if counts.where(~F.col("doc_id").between(0, heads[0] - 1) | ~F.col("word_id").between(0, heads[1] - 1)).limit(1).count():
        raise ValueError("a document or word is out of range")
    return counts, words


def read_ldac(spark: SparkSession, path: str) -> DataFrame:
    """counts(doc_id, word_id, n) of lines such as "2 0:1 5:3"."""
    pairs = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: F.contains(x, F.lit(":")))
    rows = read_lines(spark, path).select("doc_id", F.explode(pairs).alias("p"))
    return rows.select("doc_id", F.split("p", ":")[0].cast("int").alias("word_id"), F.split("p", ":")[1].cast("int").alias("n"))


def read_ldac_vocab(spark: SparkSession, path: str) -> DataFrame:
    """word_id, word, n1, n2 of lines such as "word = 3 = 12 7", whose ids must count from 0; words keep letters and digits only."""
    parts = read_lines(spark, path).where(F.trim("text") != "").select(F.split(F.trim("text"), r"\s+").alias("p"))
    if parts.where((F.size("p") != 6) | (F.col("p")[1] != "=") | (F.col("p")[3] != "=")).limit(1).count():
        raise ValueError("a line is not of the form: word = id = n1 n2")
    number = lambda i: F.col("p")[i].cast("int")
    words = written(parts.select(number(2).alias("word_id"), clean_word(F.col("p")[0]).alias("word"), number(4).alias("n1"), number(5).alias("n2")))
    r = words.agg(F.count(F.lit(1)), F.count_distinct("word_id"), F.min("word_id"), F.max("word_id")).first()
    if r[0] and (r[1], r[2], r[3]) != (r[0], 0, r[0] - 1):
        raise ValueError("word ids must count from 0")
    return words


def preprocess(counts: DataFrame, vocab: DataFrame, num_test: int, trunc: int = 0, shuffle: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) as doc_id, text: words repeated by count, rare ones and blank documents dropped.

    Words are in the order of their ids, or, with shuffle, drawn one after the other with odds
    by what is left of their counts: a random order of all copies.
    """
    if not shuffle:
        return preprocess_bags(written(bags_of(counts)), vocab, num_test, trunc)
    rows = counts.join(kept_words(counts, vocab, trunc), "word_id").where("n > 0")
    copies = rows.select("doc_id", "word_id", "word", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    u = uniform(seed, 0, F.col("doc_id"), F.xxhash64("word_id", "copy"))
    rows = copies.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(u.alias("u"), "word_id", "copy", "word"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    rows = rows.select("doc_id", text.alias("text")).where("text <> ''")
    return rows.where(F.col("doc_id") >= num_test), rows.where(F.col("doc_id") < num_test)


def kept_words(counts: DataFrame, vocab: DataFrame, trunc: int) -> DataFrame:
    """word_id, word: cleaned words that are not blank and occur more than trunc times."""
    frequent = counts.groupBy("word_id").agg(F.sum("n").alias("all")).where(F.col("all") > trunc)
    named = vocab.select("word_id", clean_word(F.col("word")).alias("word")).where("word <> ''")
    return named.join(frequent, "word_id", "left_semi")


def bags_of(counts: DataFrame) -> DataFrame:
    """doc_id, words, ns of counts(doc_id, word_id, n), by word id."""
    pairs = F.array_sort(F.collect_list(F.struct("word_id", "n"))).alias("p")
    return counts.groupBy("doc_id").agg(pairs).select("doc_id", F.col("p.word_id").alias("words"), F.col("p.n").alias("ns"))


def bags_of_lists(docs: DataFrame) -> DataFrame:
    """doc_id, words, ns of docs(doc_id, words): the distinct word ids of every document, in order, and their counts."""

    def run(batches):
        for batch in batches:
            sizes, values = _flat(pa.chunked_array([batch.column(1)]))
            doc, word = np.repeat(np.arange(len(batch)), sizes), values.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((word, doc))
            doc, word = doc[order], word[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(doc) else np.zeros(0, int)
            starts = pa.array(np.searchsorted(doc[new], np.arange(len(batch) + 1)), pa.int32())
            ns = np.diff(np.append(new, len(doc)))
            lists = [pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (word[new], ns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "words", "ns"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "words").mapInArrow(run, "doc_id long, words array<int>, ns array<int>")


def preprocess_bags(bags: DataFrame, vocab: DataFrame, num_test: int, trunc: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) of bags(doc_id, words, ns), as preprocess() without shuffle."""
    counts = bags.select("doc_id", F.explode(F.arrays_zip("words", "ns")).alias("p")).select("doc_id", F.col("p.words").alias("word_id"), F.col("p.ns").alias("n"))
    block = block_of(bags, F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, values = _flat(left.column("words"))
        ns = _flat(left.column("ns"))[1].to_numpy(zero_copy_only=False)
        place = pa.compute.index_in(values, value_set=_one(right.column("word_id")))
        times = np.where(pa.compute.is_valid(place).to_numpy(zero_copy_only=False), np.maximum(ns, 0), 0)
        ends = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(sizes)])]
        at = np.repeat(place.fill_null(0).to_numpy(zero_copy_only=False), times)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _one(right.column("word")).take(pa.array(at)))
        some = pa.array(np.flatnonzero(np.diff(ends)))
        return pa.table({"doc_id": _one(left.column("doc_id")).take(some), "text": pa.compute.binary_join(lists, " ").take(some)})

    rows = needed(bags, block, "words", "word_id").join(kept_words(counts, vocab, trunc), "word_id")
    rows = joined(bags.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "words", "ns"), rows, run, "doc_id long, text string")
    return rows.where(F.col("doc_id") >= num_test), rows.where(F.col("doc_id") < num_test)


def split_at(docs: DataFrame, num_test: int) -> tuple[DataFrame, DataFrame]:
    return docs.where(F.col("doc_id") >= num_test), docs.where(F.col("doc_id") < num_test)


def write_packs(train: DataFrame, test: DataFrame, path: str, packs: int, stopwords=()) -> DataFrame:
    """Encodes train (in packs) and test with one vocabulary; returns the vocabulary."""
    vocab = written(build_vocab(drop_stopwords(tokenize(train).unionByName(tokenize(test)), stopwords)))
    encode_texts(train, vocab).repartition(packs, "doc_id").write.mode("overwrite").parquet(f"{path}/train")
    encode_texts(test, vocab).write.mode("overwrite").parquet(f"{path}/test")
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    return vocab
