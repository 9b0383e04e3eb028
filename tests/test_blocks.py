"""Encoders and topic models by blocks: no table of words reaches the driver, and results do not depend on the blocks."""

import numpy as np
import pytest
from pyspark.sql.classic import dataframe

from quillmesh.operators import blocks, topics
from quillmesh.sources import corpus

WORDS = 3000


@pytest.fixture
def fetched(monkeypatch):
    """The most rows that reached the driver at once."""
    most, cls = [0], dataframe.DataFrame

    def collect(self):
        rows = real_collect(self)
        most[0] = max(most[0], len(rows))
        return rows

    def frame(self):
        out = real_pandas(self)
        most[0] = max(most[0], len(out))
        return out

    real_collect, real_pandas = cls.collect, cls.toPandas
    monkeypatch.setattr(cls, "collect", collect)
    monkeypatch.setattr(cls, "toPandas", frame)
    return most


@pytest.mark.parametrize("kind", ["lda", "glda", "simple", "stc"])
def test_models_leave_the_vocabulary_on_the_executors(spark, fetched, kind):
    r = np.random.default_rng(0)
    docs = spark.createDataFrame([(d, [int(w) for w in r.integers(0, WORDS, 60)]) for d in range(120)], "doc_id long, words array<int>")
    vocab = spark.range(WORDS).selectExpr("cast(id as int) word_id", "concat('w', id) word")
    if kind == "glda":
        vectors = vocab.selectExpr("word_id", "array(cast(word_id % 7 as double), cast(word_id % 3 as double)) v")
        model = topics.GLDA(2, 1, vocab, vectors)
    else:
        model = topics.LDA(2, 1, vocab) if kind == "lda" else topics.HDP(2, 1, vocab, method=kind)
    assert np.isfinite(model.fit(docs, docs.where("doc_id < 5")))
    model.predict(docs, 1).write.format("noop").mode("overwrite").save()
    model.get_top_words(spark, 3).write.format("noop").mode("overwrite").save()
    assert fetched[0] < 200


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(d * 997 % 5000 - 100, [int(w) for w in r.integers(0, 50, 30)]) for d in range(200)] + [(1 << 61, [3, 4]), (9999, [])]
    docs = spark.createDataFrame(rows, "doc_id long, words array<int>")
    emission, prior = r.dirichlet(np.ones(3), 50), np.ones(3)
    got = []
    for most in (1 << 20, 64):
        monkeypatch.setattr(topics, "Needs", lambda docs, k, most=most: _needs(docs, most))
        state = topics.init_topics(docs, 3, 5)
        got.append(sorted(map(tuple, topics.sweep(state, emission, prior, 5, 1).select("doc_id", "z").collect()), key=repr))
    assert got[0] == got[1] and len(got[0]) == 202


def _needs(docs, most):
    needs = object.__new__(REAL)
    needs.block = blocks.block_of(docs, topics.F.size("words"), most)
    needs.words = blocks.needed(docs, needs.block, "words", "word_id")
    return needs


REAL = topics.Needs


def test_snapshots_hold_the_tables(spark, tmp_path):
    docs = spark.createDataFrame([(0, [0, 1, 1]), (1, [2, 2])], "doc_id long, words array<int>")
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(3)], "word_id int, word string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "word_id int, v array<double>")
    for i, model in enumerate((topics.LDA(2, 2, vocab), topics.HDP(2, 2, vocab), topics.GLDA(2, 2, vocab, vectors))):
        model.fit(docs)
        model.save(spark, f"file://{tmp_path}/{i}")
        back = type(model).load(spark, f"file://{tmp_path}/{i}")
        again = type(model).from_bytes(model.to_bytes())
        assert back.evaluate(docs, 3) == pytest.approx(model.evaluate(docs, 3)) == again.evaluate(docs, 3)
        assert again.get_top_words(spark, 2).count() == back.get_top_words(spark, 2).count() == 2 * model.k
    matrix = spark.createDataFrame([(1, 0, 0.5)], "word_id int, k int, p double")
    lda = topics.LDA(2, 0, vocab).with_topic_matrix(matrix)
    assert np.allclose(lda.phi, [[1 / 3] * 2, [0.5, 1 / 3], [1 / 3] * 2])


def test_vocabulary_is_hashed_and_encoders_round_trip(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK_CHARS", 16)
    texts = [(-(1 << 60), " b a  b\n"), (0, None), (1, " \t"), (7, "c\x0bx a é\r\na"), (1 << 62, "z b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tokens = corpus.tokenize(docs)
    vocab = corpus.build_vocab(tokens)
    assert [r["word"] for r in vocab.orderBy("word_id").collect()] == ["b", "a", "c\x0bx", "é", "z"]
    plans = []
    monkeypatch.setattr(corpus, "with_ordinal", lambda df, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.withColumn("n", topics.F.lit(0)))
    corpus.build_vocab(tokens)
    assert "SortAggregate" not in plans[0]
    monkeypatch.undo()
    for coded in (corpus.encode_texts(docs, vocab), corpus.encode(tokens, vocab)):
        assert {r["doc_id"]: r["words"] for r in coded.collect()} == {-(1 << 60): [0, 1, 0], 7: [2, 1, 3, 1], 1 << 62: [4, 0]}
        assert {r["doc_id"]: r["text"] for r in corpus.decode(coded, vocab).collect()} == {-(1 << 60): "b a b", 7: "c\x0bx a é a", 1 << 62: "z b"}
    assert [r["word"] for r in corpus.build_vocab(tokens, trunc=1).orderBy("word_id").collect()] == ["b", "a"]
    bags = {r["doc_id"]: (r["words"], r["ns"]) for r in corpus.bags_of_lists(corpus.encode_texts(docs, vocab)).collect()}
    assert bags[7] == ([1, 2, 3], [2, 1, 1]) and bags[1 << 62] == ([0, 4], [1, 1])


def test_whole_corpora_are_encoded_by_parts(spark, monkeypatch):
    texts = [(7, "c a a \ta"), (-(1 << 60), " b a  b\n"), (0, None), (1, " \t"), (3, "b é c\r\nc é"), (1 << 62, "z b"), (5, "q c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for most in (4, 1 << 24):
        monkeypatch.setattr(corpus, "PART_CHARS", most)
        for trunc in (0, 1):
            coded, vocab = corpus.encode_corpus(docs.coalesce(2), trunc)
            known = corpus.build_vocab(corpus.tokenize(docs), trunc=trunc)
            assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, known.collect()))
            again = {r["doc_id"]: r["words"] for r in corpus.encode_texts(docs, known).collect()}
            assert {r["doc_id"]: r["words"] for r in coded.collect()} == again and len(again) == 5


def test_words_meet_once_for_a_part_and_counts_only_where_asked(spark, monkeypatch):
    """What is exchanged is words of parts, not tokens; count rows are written only where weights are used."""
    docs = spark.createDataFrame([(d, "a b a " * 50) for d in range(40)], "doc_id long, text string").coalesce(1)
    seen = []
    real = corpus._numbered
    monkeypatch.setattr(corpus, "_numbered", lambda rows, *rest: seen.append(rows.count()) or real(rows, *rest))
    coded, vocab = corpus.encode_corpus(docs)
    assert seen == [2] and vocab.count() == 2
    made = []
    rows = topics.count_rows
    monkeypatch.setattr(topics, "count_rows", lambda state: made.append(1) or rows(state))
    model = topics.LDA(2, 1, vocab)
    model.fit(coded)
    assert len(made) == 1  # those of the first topics; after the last sweep nobody asked
    assert model.phi.shape == (2, 2) and model.phi.sum(0) == pytest.approx([1, 1]) and len(made) == 2
    model.get_top_words(spark, 1).collect()
    assert len(made) == 2
    needs = topics.Needs(model.state, 2)
    assert needs.words.count() == 2
