"""Alias samplers, Stirling ratios of long documents, online forests, histories, formats and the command line."""

import numpy as np
import pytest
from test_models import asked, frame

from quillmesh import cli
from quillmesh.functions import pack, sampling
from quillmesh.functions.stirling import LIMIT, Stirling
from quillmesh.operators import covertree, mixture, topics
from quillmesh.sources import binary, corpus


def test_stirling_beyond_the_table():
    n, logs = 1500, np.array([0.0])
    for i in range(n):
        logs = np.logaddexp(np.append(-np.inf, logs), np.append(logs + (np.log(i) if i else -np.inf), -np.inf))
    m = np.arange(2, n + 1)
    exact = np.exp(logs[m - 1] - logs[m])
    table = Stirling(8)
    assert np.abs(table.steps(np.full(len(m), n), m) / exact - 1).max() < 2e-4
    assert len(table.logs) <= LIMIT + 2 and table.low.shape[1] < 50  # linear in n
    u, w = table.ratios(np.array([n, 5, 3]), np.array([40, 2, 3]))
    assert u[1] == pytest.approx(274 / 50) and w[1] == pytest.approx(225 / 50) and w[2] == 1


def test_alias_rows():
    w = np.array([[1.0, 2, 3, 4], [4, 0, 0, 1], [1, 1, 1, 1]])
    rows = sampling.AliasRows(w, np.array([0, 1, 1]))
    u = (np.arange(20_000) + 0.5) / 20_000
    for r in (0, 1):
        share = np.bincount(rows.draw(np.full(len(u), r), u), minlength=4) / len(u)
        assert np.allclose(share, w[r] / w[r].sum(), atol=1e-3)


def shares(rows, k):
    """How often each topic was drawn, per (document, word)."""
    out = {}
    for r in rows:
        for w, z in zip(r["words"], r["z"], strict=True):
            out.setdefault((r["doc_id"] % 3, w), np.zeros(k))[z] += 1
    return {key: n / n.sum() for key, n in out.items()}


def test_alias_sweep_has_the_same_odds(spark):
    """Many documents of three kinds: both samplers draw topics equally often."""
    kinds = [([0, 1, 1], [0, 0, 1]), ([2], [2]), ([3, 3, 0, 2], [3, 2, 2, 0])]
    rows = [(d, kinds[d % 3][0], kinds[d % 3][1]) for d in range(12_000)]
    state = spark.createDataFrame(rows, "doc_id long, words array<int>, z array<int>")
    emission = np.random.default_rng(1).dirichlet(np.ones(4), 4)
    prior = np.array([0.5, 0.2, 1.0, 0.1])
    dense, alias = (shares(topics.sweep(state, emission, prior, 3, s, kind).collect(), 4) for s, kind in ((1, "dense"), (2, "alias")))
    assert dense.keys() == alias.keys()
    for key, p in dense.items():
        assert np.abs(p - alias[key]).max() < 0.04, key


@pytest.mark.parametrize("pair", [("simple", "alias"), ("stc", "stc-alias")])
def test_hdp_alias_has_the_same_odds(spark, pair):
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(4)], "word_id int, word string")
    rows = [(d, [0, 1, 1, 3][: 2 + d % 3], [0, 1, 0, 1][: 2 + d % 3], [1, 1, 0]) for d in range(9000)]
    state = spark.createDataFrame(rows, "doc_id long, words array<int>, z array<int>, t array<int>")
    drawn = []
    for i, method in enumerate(pair):
        model = topics.HDP(3, 1, vocab, alpha=2.0, method=method, seed=5 + i)
        model.phi = np.random.default_rng(2).dirichlet(np.ones(4), 3).T
        model.tables = np.array([40.0, 10.0, 5.0])
        got = model._sweep(state, 1).collect()
        drawn.append(shares([{"doc_id": r["doc_id"], "words": r["words"], "z": [min(z, 3) for z in r["z"]]} for r in got], 4))
        assert all(sum(r["t"]) >= 1 and len(r["t"]) == 3 + topics.NEW for r in got[:50])
    for key, p in drawn[0].items():
        assert np.abs(p - drawn[1][key]).max() < 0.05, key


def test_several_new_topics_a_sweep(spark):
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(60)], "word_id int, word string")
    docs = spark.createDataFrame([(d, [d % 6 * 10 + j % 10 for j in range(30)]) for d in range(120)], "doc_id long, words array<int>")
    for method, least in (("simple", 5), ("stc", 2)):
        model = topics.HDP(1, 3, vocab, alpha=5.0, gamma=5.0, method=method, seed=1)
        model.fit(docs)
        assert model.k >= least, method


def test_online_forest(spark):
    x = np.random.default_rng(4).normal(size=(400, 5))
    x[50:80] = x[50]
    forest = covertree.CoverTree.from_matrix(frame(spark, x[:300]), rows=80)
    before = {r["block"]: r["tree"] for r in forest.trees.collect()}
    one = forest.insert(frame(spark, x[300:301], [300]))
    changed = [b for b, t in ((r["block"], r["tree"]) for r in one.trees.collect()) if t != before[b]]
    assert len(changed) == 1  # the other trees stay as they were
    more = one.insert(frame(spark, x[301:] * 3, list(range(301, 400))))
    left, any_gone = more.remove(frame(spark, x[40:90], list(range(40, 90))))
    assert any_gone and left.points.count() == 350
    y = np.concatenate([x[:301], x[301:] * 3])
    keep = np.r_[0:40, 90:400]
    got = {}
    for r in left.k_nearest(asked(spark, x[:30]), 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for q in range(30):
        d = np.sqrt(((y[keep] - x[q]) ** 2).sum(1))
        assert [i for _, i in sorted(got[q])] == keep[np.lexsort((keep, d))[:4]].tolist()
    assert left.nodes().count() == 350 and left.test_covering()


def test_many_copies_make_no_chain(spark):
    tree = covertree.Tree(np.arange(20_000), np.concatenate([np.zeros((19_000, 2)), np.random.default_rng(1).normal(size=(1000, 2))]))
    assert len(tree.search(np.zeros(2), 5)) == 5 and [i for _, i in tree.search(np.zeros(2), 3)] == [0, 1, 2]
    assert max(len(c) for c in tree.copies.values()) == 18_999 and tree.covering()
    back = covertree.Tree.from_bytes(tree.to_bytes())
    assert back.search(np.ones(2), 7) == tree.search(np.ones(2), 7)


def test_bytes_run_no_code():
    fields = {"a": np.arange(3.0), "b": [1, "x", None], "c": 2}
    back = pack.unpack(pack.pack(fields))
    assert back["a"].tolist() == [0, 1, 2] and back["b"] == [1, "x", None] and back["c"] == 2
    with pytest.raises(ValueError):
        pack.unpack(__import__("pickle").dumps(fields))


def test_history(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(60, 2))
    mixture.KMeans(2, 5, "firstk", frame(spark, x)).fit(frame(spark, x), frame(spark, x), snapshot=f"file://{tmp_path}/km", every=2)
    rows = sorted(spark.read.parquet(f"file://{tmp_path}/km-history").collect())
    assert [r["step"] for r in rows] == [2, 4, 5] and all(r["seconds"] > 0 for r in rows) and rows[0]["score"] <= rows[2]["score"] + 1e-9
    assert mixture.KMeans.load(spark, f"file://{tmp_path}/km-4").k == 2


def test_ldac(spark, tmp_path):
    (tmp_path / "words").write_text("a-b = 0 = 5 2\nc! = 1 = 3 1\n\nd = 2 = 1 1\n")
    (tmp_path / "docs").write_text("2 0:2 1:1\n1 2:3\n2 0:1 1:4\n")
    vocab = corpus.read_ldac_vocab(spark, f"file://{tmp_path}/words")
    assert [tuple(r) for r in vocab.orderBy("word_id").collect()] == [(0, "ab", 5, 2), (1, "c", 3, 1), (2, "d", 1, 1)]
    counts = corpus.read_ldac(spark, f"file://{tmp_path}/docs")
    train, test = corpus.preprocess(counts, vocab, 1, 0, shuffle=True, seed=3)
    texts = {r["doc_id"]: r["text"].split(" ") for r in train.unionByName(test).collect()}
    assert {d: sorted(t) for d, t in texts.items()} == {0: ["ab", "ab", "c"], 1: ["d"] * 3, 2: ["ab", "c", "c", "c", "c"]}
    orders = {corpus.preprocess(counts, vocab, 0, 0, True, s)[0].where("doc_id = 2").first()["text"] for s in range(12)}
    assert len(orders) > 2
    (tmp_path / "bad").write_text("a = 1 = 5 2\n")
    with pytest.raises(ValueError, match="count from 0"):
        corpus.read_ldac_vocab(spark, f"file://{tmp_path}/bad")


def test_command_line(spark, tmp_path):
    out = f"file://{tmp_path}"
    cli.main(["datagen", "--dataset", "-", "--output-model", f"{out}/data", "--num-clusters", "2"], spark)
    assert spark.read.parquet(f"{out}/data/truth").count() == 2 and spark.read.parquet(f"{out}/data/points").count() == 2000
    some = spark.read.parquet(f"{out}/data/points").where("id < 300")
    some.write.parquet(f"{out}/some")
    binary.write_points(some.repartition(2), f"{out}/packs")
    assert cli.points(spark, f"{out}/packs/*.dat").select("id").distinct().count() == 300
    for program in ("k_means", "gmm"):
        score = cli.main([program, "--dataset", f"{out}/some", "--test", f"{out}/some", "--output-model", f"{out}/{program}", "--num-clusters", "2", "--num-iterations", "2", "--init-type", "firstk"], spark)
        assert np.isfinite(score) and spark.read.parquet(f"{out}/{program}-2").count() == 1
    cli.main(["cover_tree", "--dataset", f"{out}/some", "--test", f"{out}/some", "--output-model", f"{out}/tree"], spark)
    assert spark.read.parquet(f"{out}/tree/nearest").count() == 900
    (tmp_path / "talk").write_text("a b c\nb c d\n" * 5)
    for program, method in (("lda", "simple"), ("lda", "alias"), ("hdp", "stc"), ("hdp", "alias")):
        args = [program, "--dataset", f"{out}/talk", "--test", f"{out}/talk", "--output-model", f"{out}/{program}{method}", "--num-topics", "2", "--num-iterations", "2", "--num-top-words", "3", "--method", method]
        assert np.isfinite(cli.main(args, spark))
        assert spark.read.parquet(f"{out}/{program}{method}-words").groupBy("k").count().first()["count"] == 3
    with pytest.raises(SystemExit):
        cli.main(["lda", "--dataset", "x", "--num-topics", "0"], spark)
