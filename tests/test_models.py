"""Invariants and edge cases of searches, mixtures, topic models, samplers and files."""

import math

import numpy as np
import pytest

from quillmesh.functions import rng, sampling, vec
from quillmesh.functions.stirling import Stirling
from quillmesh.operators import covertree, mixture, search, topics
from quillmesh.sources import binary, corpus


def frame(spark, x, ids=None):
    rows = [(int(i), [float(c) for c in row]) for i, row in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def asked(spark, x):
    return frame(spark, x).withColumnsRenamed({"id": "qid", "v": "qv"})


def test_search_edges(spark):
    x = np.array([[0.0, 0], [1, 0], [1, 0], [5, 5]])
    got = [tuple(r) for r in search.k_nearest(frame(spark, x), asked(spark, [[1, 0]]), 9).orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 2), (3, 0), (4, 3)]  # ties by id, fewer than k
    assert search.range_search(frame(spark, x), asked(spark, [[0, 0]]), 1.0).count() == 1  # strictly nearer
    with pytest.raises(Exception, match="dimension"):
        search.nearest(frame(spark, x), asked(spark, [[1, 2, 3]])).collect()


def test_tree_equals_brute_force(spark):
    r = np.random.default_rng(3)
    x, q = r.normal(size=(800, 5)), r.normal(size=(30, 5))
    tree = covertree.Tree(np.arange(800), x)
    assert tree.covering() and len(set(tree.spread(40).tolist())) == 40
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(q)):
        assert [j for _, j in tree.search(q[i], 5)] == np.lexsort((np.arange(800), d[i]))[:5].tolist()
        assert {j for _, j in tree.search(q[i], 800, 1.5)} == set(np.flatnonzero(d[i] < 1.5).tolist())
    assert covertree.Tree.from_bytes(tree.to_bytes()).search(q[0], 3) == tree.search(q[0], 3)


def test_forest_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(60, 3))
    tree = covertree.CoverTree.from_matrix(frame(spark, x))
    tree.save(f"file://{tmp_path}/tree")
    back = covertree.CoverTree.load(spark, f"file://{tmp_path}/tree")
    q = asked(spark, x[:5])
    assert sorted(map(tuple, back.k_nearest(q, 3).collect())) == sorted(map(tuple, tree.k_nearest(q, 3).collect()))
    assert tree.remove(frame(spark, [[9, 9, 9]]))[1] is False
    assert covertree.CoverTree.from_matrix(frame(spark, [[1, 2, 3]])).nearest(q).count() == 5


def test_kmeans_and_gmm(spark, tmp_path):
    r = np.random.default_rng(0)
    means = np.array([[0.0, 0], [8, 8], [-8, 8]])
    x = np.concatenate([m + r.normal(size=(80, 2)) for m in means])
    pts = frame(spark, x)
    for init in ("firstk", "random", "kmeanspp", "covertree", means):
        model = mixture.KMeans(3, 6, init, pts)
        before = model.evaluate(pts)
        assert model.fit(pts, pts) >= before - 1e-6
    model.save(spark, f"file://{tmp_path}/km")
    assert mixture.KMeans.load(spark, f"file://{tmp_path}/km").evaluate(pts) == pytest.approx(model.evaluate(pts), rel=1e-9)
    assert np.allclose(sorted(model.centers.tolist()), sorted(means.tolist()), atol=0.5)
    empty = mixture.KMeans(2, 1, [[0.0, 0.0], [1e6, 1e6]])
    empty.fit(pts)
    assert empty.centers[1].tolist() == [0, 0]
    for mode in ("sampled", "map", "soft"):
        g = mixture.GMM(3, 6, means, pts, mode=mode)
        g.fit(pts)
        assert np.allclose(g.means, means, atol=0.6) and abs(np.exp(g.log_pi).sum() - 1) < 1e-9
        back = mixture.GMM.from_bytes(g.to_bytes())
        assert back.evaluate(pts) == pytest.approx(g.evaluate(pts)) and g.evaluate(pts, "logsumexp") >= g.evaluate(pts)


@pytest.fixture(scope="module")
def talk(spark):
    r = np.random.default_rng(2)
    docs = [(d, [int(w) for w in r.integers(10 * (d % 2), 10 * (d % 2) + 10, 40)]) for d in range(30)] + [(30, []), (31, [3])]
    return spark.createDataFrame(docs, "doc_id long, words array<int>"), spark.createDataFrame([(i, f"w{i}") for i in range(20)], "word_id int, word string")


@pytest.mark.parametrize("kind", ["lda", "glda", "simple", "stc"])
def test_topics(spark, talk, kind):
    docs, vocab = talk
    vectors = spark.createDataFrame([(i, [float(i // 10 * 5), float(i % 3)]) for i in range(20)], "word_id int, v array<double>")
    model = {"lda": lambda: topics.LDA(2, 8, vocab, alpha=1.0), "glda": lambda: topics.GLDA(2, 4, vocab, vectors)}.get(kind, lambda: topics.HDP(3, 3, vocab, alpha=1.0, method=kind))()
    score = model.fit(docs, docs)
    assert math.isfinite(score)
    assert topics.word_topic_counts(model.state).agg({"n": "sum"}).first()[0] == 1201
    assert model.predict(docs, 2).count() == 1201
    if kind != "glda":
        assert np.allclose(model.emission().sum(0), 1)
        again = type(model).from_bytes(model.to_bytes())
        assert again.evaluate(docs, 5) == pytest.approx(model.evaluate(docs, 5))
    if kind == "lda":
        assert score > -math.log(20)
        assert model.get_top_words(spark, 99).count() == 40  # clipped to the vocabulary


def test_samplers():
    w, u = np.array([1.0, 2, 3, 4]), rng.uniform_np(5, 0, np.arange(40_000), 1)
    for drawn in (sampling.inverse_cdf(w, u), sampling.AliasTable(w).draw(u), np.array([sampling.SumTree(w).draw(x) for x in u[:4000]])):
        share = np.bincount(drawn, minlength=4) / len(drawn)
        assert np.abs(share - w / 10).max() < 0.03
    tree = sampling.SumTree(w)
    tree.update(3, 0.0)
    assert max(tree.draw(x) for x in u[:1000]) == 2
    assert vec.matrix is not None


def test_stirling():
    s = [[1] + [0] * 24]
    for n in range(24):
        s.append([(s[n][m - 1] if m else 0) + n * s[n][m] for m in range(25)])
    t = Stirling(8)
    for n in range(1, 22):
        for m in range(1, n + 1):
            assert t.log(n, m) == pytest.approx(math.log(s[n][m]), abs=1e-9)
            assert t.u(n, m) == pytest.approx(s[n + 1][m] / s[n][m])
            assert t.v(n, m) == pytest.approx(s[n + 1][m + 1] / s[n + 1][m])
    assert t.log(3, 5) == -10000 and t.v(3, 5) == 0 and t.u(3, 5) == float("inf") and t.w(4, 4) == 1


def test_files(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(50, 4))
    (tmp_path / "p.bin").write_bytes(binary.points_bytes(x))
    back = binary.read_points(spark, f"file://{tmp_path}/p.bin").orderBy("id").collect()
    assert np.array_equal(np.array([r["v"] for r in back]), x)
    docs = [np.array([1, 2, 3], np.uint32), np.array([], np.uint32)]
    (tmp_path / "c.bin").write_bytes(binary.corpus_bytes(docs))
    assert [r["words"] for r in binary.read_corpus_file(spark, f"file://{tmp_path}/c.bin").orderBy("doc_id").collect()] == [[1, 2, 3], []]
    with pytest.raises(ValueError, match="version"):
        binary.parse_corpus(b"\3\0\0\0\0\0\0\0")


def test_text_formats(spark, tmp_path):
    (tmp_path / "t.txt").write_text("2\nthe cat\tsat\n\nléo the\x0bcat\n")
    docs, vocab = corpus.read_corpus(spark, f"file://{tmp_path}/t.txt", stopwords=["the"], header=True)
    assert [r["word"] for r in vocab.orderBy("word_id").collect()] == ["cat", "sat", "léo", "the\x0bcat"]
    (tmp_path / "docword").write_text("2\n3\n3\n1 1 2\n1 3 1\n2 2 1\n")
    (tmp_path / "vocab").write_text("a-b\nc\nd\n")
    counts, words = corpus.read_uci(spark, f"file://{tmp_path}/docword", f"file://{tmp_path}/vocab")
    train, test = corpus.preprocess(counts, words, 1)
    assert [tuple(r) for r in test.collect()] == [(0, "ab ab d")] and [tuple(r) for r in train.collect()] == [(1, "c")]
    (tmp_path / "ldac").write_text("2 0:1 5:3\n0\n1 2:2\n")
    assert sorted(map(tuple, corpus.read_ldac(spark, f"file://{tmp_path}/ldac").collect())) == [(0, 0, 1), (0, 5, 3), (2, 2, 2)]


@pytest.mark.parametrize("copies", [0, 400])
def test_many_queries_at_once_equal_single_searches(copies):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(600, 4)), np.zeros((copies, 4)) + 0.5, r.normal(size=(100, 4)) * 50 + 300])
    q = np.concatenate([r.normal(size=(40, 4)), x[:5], x[600:605], x[-3:]])
    tree = covertree.Tree(np.arange(len(x))[::-1] * 3, x)
    tree.drop(x[10:60])
    for k, radius in ((1, np.inf), (3, np.inf), (5, 0.9), (2000, np.inf), (0, 1.5)):
        rows, ids, dist = tree.search_many(q, k, radius)
        for i in range(len(q)):
            got = sorted(zip(dist[rows == i].tolist(), ids[rows == i].tolist(), strict=True))
            assert got == tree.search(q[i], k or len(x), radius)
