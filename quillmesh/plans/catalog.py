"""Registered queries over the driver's tables.

Points are the embeddings, queries of searches the rows whose id is divisible by 20,
corpora the documents (or the conversations, for models that are sampled token by token).
Every query reads whole tables; doubles are rounded to six places, so that another engine
can compare them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.rng import uniform
from ..functions.stirling import stirling_table
from ..operators import covertree, mixture, search, seeds, topics
from ..sources import binary, corpus
from ..streaming import score
from . import oracles
from .store import scratch, written

QUERIES: dict = {}
ORACLES: dict[str, str] = oracles.ORACLES
K, G, T, RADIUS, TRUNC = oracles.K, oracles.G, oracles.T, oracles.RADIUS, oracles.TRUNC


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vec.vector("embedding").alias("v"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))


def r6(column: str) -> F.Column:
    return F.round(column, 6).alias(column)


def rows_of(spark: SparkSession, values, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def long_form(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    return df.select(key, F.posexplode(column).alias("pos", name)).select(key, "pos", r6(name))


# --- search


@query
def nn_1(spark, sf_dir):
    return search.nearest(points(spark, sf_dir), asked(spark, sf_dir), skip_self=True).select("qid", "id", r6("dist"))


@query
def knn_k3(spark, sf_dir):
    return search.k_nearest(points(spark, sf_dir), asked(spark, sf_dir), 3, skip_self=True).select("qid", "rank", "id", r6("dist"))


@query
def range_search(spark, sf_dir):
    return search.range_search(points(spark, sf_dir), asked(spark, sf_dir), RADIUS, skip_self=True).select("qid", "id", r6("dist"))


@query
def range_counts(spark, sf_dir):
    """Neighbours within the radius per query, zero included."""
    found = search.range_search(points(spark, sf_dir), asked(spark, sf_dir), RADIUS, skip_self=True)
    return asked(spark, sf_dir).join(found, "qid", "left").groupBy("qid").agg(F.count("id").alias("n"))


@query
def furthest(spark, sf_dir):
    return search.furthest(points(spark, sf_dir), asked(spark, sf_dir)).select("qid", "id", r6("dist"))


@query
def knn_label_vote(spark, sf_dir):
    pts = points(spark, sf_dir)
    near = search.k_nearest(pts, asked(spark, sf_dir), 3, skip_self=True).join(pts.select("id", "label"), "id")
    votes = near.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("qid").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("qid", "best.label")


@query
def returned_points(spark, sf_dir):
    """The nearest point's vector comes with the answer."""
    pts = points(spark, sf_dir)
    return long_form(search.with_points(search.nearest(pts, asked(spark, sf_dir), skip_self=True), pts), "qid", "v", "x")


@query
def tree_knn_k3(spark, sf_dir):
    return covertree.CoverTree.from_matrix(points(spark, sf_dir)).k_nearest(asked(spark, sf_dir), 3).select("qid", "rank", "id", r6("dist"))


@query
def tree_range_search(spark, sf_dir):
    return covertree.CoverTree.from_matrix(points(spark, sf_dir)).range_search(asked(spark, sf_dir), RADIUS).select("qid", "id", r6("dist"))


@query
def tree_insert_remove(spark, sf_dir):
    """Odd rows are inserted, rows divisible by three removed, then nearest neighbours asked."""
    pts = points(spark, sf_dir).select("id", "v")
    tree = covertree.CoverTree.from_matrix(pts.where("id % 2 = 0")).insert(pts.where("id % 2 = 1"))
    tree, _ = tree.remove(pts.where("id % 3 = 0"))
    return tree.nearest(asked(spark, sf_dir)).select("qid", "id", r6("dist"))


FOREST_ROWS = 150


def forest(spark, sf_dir, where: str = "true") -> covertree.CoverTree:
    """Trees of so few rows that every table makes several."""
    return covertree.CoverTree.from_matrix(points(spark, sf_dir).where(where), rows=FOREST_ROWS)


@query
def forest_knn_k3(spark, sf_dir):
    return forest(spark, sf_dir).k_nearest(asked(spark, sf_dir), 3).select("qid", "rank", "id", r6("dist"))


@query
def forest_range_search(spark, sf_dir):
    return forest(spark, sf_dir).range_search(asked(spark, sf_dir), RADIUS).select("qid", "id", r6("dist"))


@query
def forest_insert_remove(spark, sf_dir):
    """Odd rows are inserted into a forest, rows divisible by three removed from it."""
    pts = points(spark, sf_dir).select("id", "v")
    trees = forest(spark, sf_dir, "id % 2 = 0").insert(pts.where("id % 2 = 1"))
    trees, _ = trees.remove(pts.where("id % 3 = 0"))
    return trees.nearest(asked(spark, sf_dir)).select("qid", "id", r6("dist"))


@query
def tree_root(spark, sf_dir):
    """The root of one tree of all points, its furthest descendant and its level."""
    nodes = covertree.CoverTree.from_matrix(points(spark, sf_dir), rows=1 << 40).nodes()
    return nodes.where("parent is null").select("id", r6("max_dist"), "level")


@query
def tree_nodes_checked(spark, sf_dir):
    """Per point: its number of nodes, and whether they keep to what a cover tree is."""
    nodes = written(forest(spark, sf_dir).nodes())
    v = written(points(spark, sf_dir).select("id", "v"))
    up = nodes.select(F.col("block").alias("b"), F.col("id").alias("p"), F.col("level").alias("p_level"), F.col("max_dist").alias("p_max"))
    both = nodes.join(up, (F.col("block") == F.col("b")) & (F.col("parent") == F.col("p")), "left").join(v, "id")
    both = both.join(v.select(F.col("id").alias("p"), F.col("v").alias("pv")), "p", "left")
    d = vec.l2(F.col("v"), F.col("pv"))
    holds = lambda c: F.bool_and(F.coalesce(c, F.lit(True)))
    near = d <= F.pow(F.lit(covertree.BASE), F.col("p_level").cast("double")) + 1e-9
    return both.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), holds(near).alias("near_parent"), holds(F.col("level") < F.col("p_level")).alias("levels_fall"), holds(d <= F.col("p_max") + 1e-9).alias("radius_holds")
    )


@query
def tree_level_total(spark, sf_dir):
    return forest(spark, sf_dir).level_counts().agg(F.sum("n").alias("n"))


@query
def tree_spread_checked(spark, sf_dir):
    """Spread-out seeds are rows of the table, all different."""
    found = rows_of(spark, [(c.tolist(),) for c in seeds.spread_out(points(spark, sf_dir), K)], "v array<double>")
    member = points(spark, sf_dir).select("v").distinct().withColumn("known", F.lit(1))
    return found.join(member, "v", "left").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("distinct_rows"), F.count("known").alias("members"))


@query
def tree_merge_distinct(spark, sf_dir):
    """Merging a forest with itself drops exact duplicates."""
    pts = points(spark, sf_dir).select("id", "v")
    return covertree.CoverTree.from_matrix(pts.unionByName(pts), dedup=True).points.select("id")


@query
def tree_nodes(spark, sf_dir):
    return covertree.CoverTree.from_matrix(points(spark, sf_dir)).nodes()


@query
def tree_level_counts(spark, sf_dir):
    return covertree.CoverTree.from_matrix(points(spark, sf_dir)).level_counts()


@query
def tree_covering(spark, sf_dir):
    return rows_of(spark, [(covertree.CoverTree.from_matrix(points(spark, sf_dir)).test_covering(),)], "covering boolean")


@query
def tree_spread_seeds(spark, sf_dir):
    return rows_of(spark, [(i, c.tolist()) for i, c in enumerate(seeds.spread_out(points(spark, sf_dir), K))], "k int, v array<double>")


# --- vector aggregates


def moments(spark, sf_dir) -> DataFrame:
    entries = points(spark, sf_dir).select(F.posexplode("v").alias("pos", "x"))
    return entries.groupBy("pos").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


@query
def mean_vector(spark, sf_dir):
    return moments(spark, sf_dir).select("pos", r6("mean"))


@query
def var_vector(spark, sf_dir):
    return moments(spark, sf_dir).select("pos", r6("var"))


@query
def dist_to_mean_order(spark, sf_dir):
    """Rows from the furthest to the nearest to the mean; the order in which a tree is built."""
    mean = [r["mean"] for r in moments(spark, sf_dir).orderBy("pos").select("mean").collect()]  # one row per dimension
    far = points(spark, sf_dir).select("id", F.round(vec.l2(F.col("v"), vec.literal(mean)), 6).alias("dist"))
    return corpus.with_ordinal(far, [F.desc("dist"), "id"], "n").select("id", "dist", F.col("n").cast("long").alias("n"))


@query
def point_count(spark, sf_dir):
    return points(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


# --- seeding


@query
def firstk_seeds(spark, sf_dir):
    return seeds.first_k(points(spark, sf_dir), K).select("id")


@query
def random_seeds(spark, sf_dir):
    return seeds.random_k(points(spark, sf_dir), K, 5).select("id")


@query
def kmeanspp_d2_weights(spark, sf_dir):
    pts = points(spark, sf_dir)
    centers = [r["v"] for r in seeds.first_k(pts, 3).select("v").collect()]
    return seeds.d2_weights(pts, centers).select("id", r6("d2"))


@query
def kmeanspp_seeds(spark, sf_dir):
    return long_form(rows_of(spark, [(i, c.tolist()) for i, c in enumerate(seeds.plus_plus(points(spark, sf_dir), K, 3))], "k int, v array<double>"), "k", "v", "x")


# --- k-means


def kmeans_after(spark, sf_dir, steps: int) -> mixture.KMeans:
    pts = points(spark, sf_dir)
    model = mixture.KMeans(K, steps, "firstk", pts)
    if steps:
        model.fit(pts)
    return model


@query
def kmeans_assign(spark, sf_dir):
    return kmeans_after(spark, sf_dir, 0).predict(points(spark, sf_dir))


@query
def kmeans_iter1_centers(spark, sf_dir):
    return long_form(kmeans_after(spark, sf_dir, 1).get_centers(spark), "k", "v", "x")


@query
def kmeans_iter3_centers(spark, sf_dir):
    return long_form(kmeans_after(spark, sf_dir, 3).get_centers(spark), "k", "v", "x")


@query
def kmeans_sse(spark, sf_dir):
    return rows_of(spark, [(round(kmeans_after(spark, sf_dir, 1).evaluate(points(spark, sf_dir)), 6),)], "score double")


@query
def kmeans_cluster_sizes(spark, sf_dir):
    return kmeans_after(spark, sf_dir, 1).predict(points(spark, sf_dir)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query
def kmeans_label_purity(spark, sf_dir):
    """Rows of the commonest label in every cluster."""
    found = kmeans_after(spark, sf_dir, 1).predict(points(spark, sf_dir)).join(points(spark, sf_dir).select("id", "label"), "id")
    return found.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max("n").alias("most"))


@query
def kmeans_lineitem(spark, sf_dir):
    """One iteration over three columns of lineitem."""
    pts = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).cast("array<double>").alias("v")
    )
    model = mixture.KMeans(4, 1, [[5.0, 1.0, 1.0], [20.0, 9.0, 3.0], [33.0, 2.0, 6.0], [47.0, 7.0, 5.0]])
    model.fit(pts)
    return long_form(model.get_centers(spark), "k", "v", "x")


@query
def kmeans_fit_covertree(spark, sf_dir):
    pts = points(spark, sf_dir)
    model = mixture.KMeans(10, 10, "covertree", pts)
    model.fit(pts)
    return model.get_centers(spark)


@query
def kmeans_fit_kmeanspp(spark, sf_dir):
    pts = points(spark, sf_dir)
    model = mixture.KMeans(10, 10, "kmeanspp", pts)
    model.fit(pts)
    return model.predict(pts)


# --- Gaussian mixtures


def gmm(spark, sf_dir, mode: str = "map", steps: int = 0) -> mixture.GMM:
    pts = points(spark, sf_dir)
    model = mixture.GMM(G, steps, "firstk", pts, mode=mode, seed=11)
    for _ in range(steps):
        model.step(pts)
    return model


@query
def gmm_logdens(spark, sf_dir):
    """Scores of all components by Column expressions."""
    model = gmm(spark, sf_dir)
    each = [F.struct(F.lit(k).alias("k"), (vec.gaussian(F.col("v"), vec.literal(model.means[k]), vec.literal(model.precision[k])) + float(model.log_pi[k])).alias("s")) for k in range(G)]
    return points(spark, sf_dir).select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.k", F.round("x.s", 6).alias("s"))


@query
def gmm_map_assign(spark, sf_dir):
    return gmm(spark, sf_dir).predict(points(spark, sf_dir))


def gmm_parameters(spark, model: mixture.GMM) -> DataFrame:
    rows = [(k, d, round(float(m), 6), round(float(0.5 / q), 6)) for k in range(G) for d, (m, q) in enumerate(zip(model.means[k], model.precision[k], strict=True))]
    return rows_of(spark, rows, "k int, pos int, mean double, var double")


@query
def gmm_mstep(spark, sf_dir):
    return gmm_parameters(spark, gmm(spark, sf_dir, "map", 1))


@query
def gmm_sampled_mstep(spark, sf_dir):
    return gmm_parameters(spark, gmm(spark, sf_dir, "sampled", 1))


@query
def gmm_log_weights(spark, sf_dir):
    return rows_of(spark, [(k, round(float(w), 6)) for k, w in enumerate(gmm(spark, sf_dir, "map", 1).log_pi)], "k int, log_pi double")


@query
def gmm_score_max(spark, sf_dir):
    return rows_of(spark, [(round(float(gmm(spark, sf_dir).evaluate(points(spark, sf_dir))), 6),)], "score double")


@query
def gmm_score_lse(spark, sf_dir):
    return rows_of(spark, [(round(float(gmm(spark, sf_dir).evaluate(points(spark, sf_dir), "logsumexp")), 6),)], "score double")


@query
def gmm_fit_soft(spark, sf_dir):
    return long_centers(gmm(spark, sf_dir, "soft", 5).get_centers(spark), "log_pi")


def long_centers(df: DataFrame, *more: str) -> DataFrame:
    """k, pos, mean, var of centres with array columns v and var."""
    rows = df.select("k", *more, F.posexplode(F.arrays_zip("v", "var")).alias("pos", "x"))
    return rows.select("k", "pos", F.round("x.v", 6).alias("mean"), F.round("x.var", 6).alias("var"), *[r6(c) for c in more])


# --- corpora


def docs(spark, sf_dir, name: str = "documents") -> DataFrame:
    if name == "conversations":
        return table(spark, sf_dir, name).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return table(spark, sf_dir, name).select("doc_id", "text")


@query
def tokenize(spark, sf_dir):
    return corpus.tokenize(docs(spark, sf_dir))


@query
def vocab_first_seen(spark, sf_dir):
    return corpus.build_vocab(corpus.tokenize(docs(spark, sf_dir)))


@query
def vocab_extended(spark, sf_dir):
    """The benchmark's vocabulary, extended by the documents'."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    known = written(corpus.build_vocab(corpus.tokenize(bench)))
    return corpus.build_vocab(corpus.tokenize(docs(spark, sf_dir)), known)


@query
def word_freq(spark, sf_dir):
    return corpus.word_counts(corpus.tokenize(docs(spark, sf_dir)))


@query
def min_count_filter(spark, sf_dir):
    return corpus.min_count(corpus.tokenize(docs(spark, sf_dir)), TRUNC)


@query
def stopword_filter(spark, sf_dir):
    return corpus.drop_stopwords(corpus.tokenize(docs(spark, sf_dir)), corpus.STOPWORDS)


@query
def train_test_split(spark, sf_dir):
    train, test = corpus.split_at(docs(spark, sf_dir), 100)
    side = lambda df, name: df.select("doc_id", F.lit(name).alias("side"))
    return side(train, "train").unionByName(side(test, "test"))


@query
def encode_decode(spark, sf_dir):
    """Texts through word ids and back: tokens joined by single spaces."""
    texts = docs(spark, sf_dir)
    vocab = written(corpus.build_vocab(corpus.tokenize(texts)))
    return corpus.decode(written(corpus.encode_texts(texts, vocab)), vocab).select("doc_id", F.md5("text").alias("digest"))


@query
def preprocess_counts(spark, sf_dir):
    """Bag-of-words counts to texts: alphanumeric words by id, repeated by count, rare ones dropped."""
    texts = docs(spark, sf_dir)
    vocab = written(corpus.build_vocab(corpus.tokenize(texts)))
    bags = written(corpus.bags_of_lists(corpus.encode_texts(texts, vocab)))
    train, test = corpus.preprocess_bags(bags, vocab, 100, TRUNC)
    return train.unionByName(test).select("doc_id", F.md5("text").alias("digest"))


@query
def packed_corpus(spark, sf_dir):
    """Documents from 100 on are packed, the others kept for tests; sizes as read back."""
    train, test = corpus.split_at(docs(spark, sf_dir), 100)
    path = scratch(spark)
    corpus.write_packs(train, test, path, 4)
    read = lambda side: spark.read.parquet(f"{path}/{side}").select("doc_id", F.lit(side).alias("side"), F.size("words").cast("long").alias("n"))
    return read("train").unionByName(read("test"))


@query
def synthetic_points(spark, sf_dir):
    return binary.synthetic_clusters(spark, 10_000, 16, 10)


@query
def synthetic_points_checked(spark, sf_dir):
    """Counts of synthetic points, and whether each lies around the mean of its label."""
    pts = written(binary.synthetic_clusters(spark, 10_000, 16, 10))
    each = pts.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.stddev("x").alias("s"))
    near = each.agg(F.bool_and(F.col("s").between(0.9, 1.1)).alias("near_means"))
    sizes = pts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.max(F.size("v")).alias("dim"), F.count_distinct("label").alias("labels"))
    return sizes.crossJoin(near)  # one row each


# --- topic models


def coded(spark, sf_dir, name: str = "documents") -> tuple[DataFrame, DataFrame]:
    """Words that occur more than TRUNC times, encoded; and their vocabulary."""
    words, vocab = corpus.encode_corpus(docs(spark, sf_dir, name), TRUNC)
    return written(words), vocab


def lda_state(spark, sf_dir, sweeps: int = 0) -> tuple[topics.LDA, DataFrame]:
    words, vocab = coded(spark, sf_dir)
    model = topics.LDA(T, sweeps, vocab, seed=7)
    model.fit(words)
    return model, model.state


@query
def lda_init_topics(spark, sf_dir):
    return lda_state(spark, sf_dir)[1].select("doc_id", F.posexplode("z").alias("pos", "topic"))


@query
def lda_counts_nwk(spark, sf_dir):
    return topics.word_topic_counts(lda_state(spark, sf_dir)[1])


@query
def lda_counts_nmk(spark, sf_dir):
    return topics.doc_topic_counts(lda_state(spark, sf_dir)[1])


@query
def lda_phi(spark, sf_dir):
    return lda_state(spark, sf_dir)[0].get_topic_matrix(spark).select("word_id", "k", F.round("p", 9).alias("p"))


@query
def lda_sweep1_counts(spark, sf_dir):
    return topics.word_topic_counts(lda_state(spark, sf_dir, 1)[1])


@query
def lda_top_words(spark, sf_dir):
    return lda_state(spark, sf_dir)[0].get_top_words(spark, 15)


@query
def lda_heldout_given_z(spark, sf_dir):
    model, state = lda_state(spark, sf_dir)
    return rows_of(spark, [(round(topics.score_given_topics(state, model.weights(), model.prior()), 6),)], "score double")


def word_vectors(spark, sf_dir, vocab: DataFrame) -> DataFrame:
    """A stand-in embedding: the row word_id modulo the number of embeddings."""
    pts = points(spark, sf_dir)
    return vocab.join(pts.select("id", "v"), F.col("word_id") % F.lit(pts.count()) == F.col("id")).select("word_id", "v")


@query
def glda_sweep1_counts(spark, sf_dir):
    words, vocab = coded(spark, sf_dir, "conversations")
    model = topics.GLDA(G, 1, vocab, word_vectors(spark, sf_dir, vocab), seed=7)
    state = topics.init_topics(words, G, 7)
    return topics.word_topic_counts(topics.sweep(state, model.weights(), model.prior(), 7, 1))


@query
def glda_fit(spark, sf_dir):
    words, vocab = coded(spark, sf_dir, "conversations")
    model = topics.GLDA(G, 3, vocab, word_vectors(spark, sf_dir, vocab), seed=7)
    model.fit(words)
    return long_centers(model.get_topic_matrix(spark))


@query
def lda_fit_counts(spark, sf_dir):
    """Word and topic counts after three sweeps."""
    words, vocab = coded(spark, sf_dir)
    model = topics.LDA(T, 3, vocab, seed=7)
    model.fit(words)
    return topics.word_topic_counts(model.state)


@query
def lda_predict_sizes(spark, sf_dir):
    """Per document: tokens that got a topic, and whether all are topics of the model."""
    words, vocab = coded(spark, sf_dir)
    model = topics.LDA(T, 2, vocab, seed=7)
    model.fit(words)
    return model.predict(words, 2).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("topic").between(0, T - 1)).alias("in_range"))


def hdp_totals(spark, sf_dir, method: str, source: str) -> DataFrame:
    words, vocab = coded(spark, sf_dir, source)
    model = topics.HDP(G, 2, vocab, method=method, seed=7)
    model.fit(words)
    counts = topics.word_topic_counts(model.state)
    return counts.agg(F.sum("n").alias("n"), F.bool_and(F.col("k").between(0, model.k - 1)).alias("in_range"))


@query
def hdp_simple_totals(spark, sf_dir):
    """Tokens with a topic after two sweeps, and whether all are active ones."""
    return hdp_totals(spark, sf_dir, "simple", "documents")


@query
def hdp_stc_totals(spark, sf_dir):
    return hdp_totals(spark, sf_dir, "stc", "conversations")


@query
def hdp_heldout_given_z(spark, sf_dir):
    """The held-out score with the share of topics that are not there yet, topics given."""
    words, vocab = coded(spark, sf_dir, "conversations")
    model = topics.HDP(G, 0, vocab, seed=7)
    state = topics.init_topics(words, G, 7)
    phi = topics.smoothed(state, model.size, G, model.beta)
    return rows_of(spark, [(round(topics.score_given_topics(state, phi, model.prior(), model.rest(), model.alpha), 6),)], "score double")


@query
def lda_fit_predict(spark, sf_dir):
    words, vocab = coded(spark, sf_dir)
    model = topics.LDA(T, 5, vocab, seed=7)
    model.fit(words)
    return model.predict(words, 2)


@query
def hdp_fit_simple(spark, sf_dir):
    words, vocab = coded(spark, sf_dir, "conversations")
    model = topics.HDP(G, 2, vocab, method="simple", seed=7)
    model.fit(words)
    return model.get_top_words(spark, 10)


@query
def hdp_fit_stc(spark, sf_dir):
    words, vocab = coded(spark, sf_dir, "conversations")
    model = topics.HDP(G, 2, vocab, method="stc", seed=7)
    model.fit(words)
    return model.get_top_words(spark, 10)


# --- numerics


@query
def stirling_ratios(spark, sf_dir):
    return stirling_table(spark, 20).select("n", "m", *[r6(c) for c in ("log_s", "u", "v", "w")])


@query
def log_sum_exp_pairs(spark, sf_dir):
    near = vec.log_add(F.col("value"), F.col("value") - 1)
    return table(spark, sf_dir, "events").select("event_id", F.round(near, 6).alias("both"))


@query
def level_powers(spark, sf_dir):
    """Cover distances 1.3^level, and the level that covers each event's value."""
    level = F.ceil(F.log("value") / float(np.log(1.3))).cast("long")
    return table(spark, sf_dir, "events").where("value > 0").select("event_id", level.alias("level"), F.round(F.pow(F.lit(1.3), level.cast("double")), 6).alias("cover"))


@query
def uniform_draws(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r6_of(uniform(3, 1, F.col("event_id"), F.col("user_id")), "u"))


def r6_of(column, name: str):
    return F.round(column, 6).alias(name)


@query
def categorical_draws(spark, sf_dir):
    """A draw per order from the priorities' frequencies by the inverse distribution function."""
    orders = table(spark, sf_dir, "orders")
    weights = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("o_orderpriority"))  # one row per priority
    cum = weights.withColumn("cum", upto).agg(F.array_sort(F.collect_list(F.struct("cum", "o_orderpriority"))).alias("c"), F.sum("n").alias("total"))
    u = uniform(9, 0, F.col("o_orderkey"), F.lit(1))
    drawn = F.filter("c", lambda x: x["cum"] >= u * F.col("total"))[0]["o_orderpriority"]
    return orders.crossJoin(F.broadcast(cum)).select("o_orderkey", drawn.alias("drawn"))  # one row


# --- streaming (2.11)


@query
def stream_assign(spark, sf_dir):
    """Components of a stream of points, scored by a fitted model and written by micro-batches."""
    model, base = kmeans_after(spark, sf_dir, 0), scratch(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings.parquet*")
    rows = stream.select(F.col("vec_id").alias("id"), vec.vector("embedding").alias("v"))
    run = score.score_stream(model, rows).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("id long, k int").parquet(f"{base}/out")
