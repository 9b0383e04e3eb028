"""The same queries as SQL for another engine, over views with the names of the tables."""

from __future__ import annotations

import math

from ..functions.rng import uniform_sql
from ..sources.corpus import STOPWORDS

#: Clusters, mixture components, topics, radius of range queries, count above which words are kept.
K, G, T, RADIUS, TRUNC = 8, 4, 8, 1.2, 5
KAPPA0, NU0, SIGMA0 = 0.0001, 3.0, 0.001

PTS = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), asked AS (SELECT id AS qid, v AS qv FROM pts WHERE id % 20 = 0)"
PAIRS = f"{PTS}, pairs AS (SELECT qid, id, label, list_distance(qv, v) AS dist FROM asked, pts WHERE qid <> id), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM pairs)"
WITH_SELF = f"{PTS}, ranked AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT qid, id, list_distance(qv, v) AS dist FROM asked, pts))"
ENTRIES = f"{PTS}, entries AS (SELECT id, unnest(range(len(v)))::INT AS pos, unnest(v) AS x FROM pts)"
MOMENTS = f"{ENTRIES}, moments AS (SELECT pos, avg(x) AS mean, var_pop(x) AS var FROM entries GROUP BY pos)"
TALK = "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
LINES = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


FIRST_K = [f"c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, v FROM (SELECT * FROM pts ORDER BY id LIMIT {K}))"]


def plus_plus(k: int, seed: int) -> list[str]:
    """k-means++ seeds as c0(k, v): every step draws by the least of -ln(u) / d2."""
    parts = [f"seed0 AS MATERIALIZED (SELECT id, v FROM pts ORDER BY {uniform_sql(seed, 0, 'id', '1')}, id LIMIT 1)"]
    parts.append("odds1 AS MATERIALIZED (SELECT pts.id, pts.v, power(list_distance(pts.v, seed0.v), 2) AS d2 FROM pts, seed0)")
    for step in range(1, k):
        parts.append(f"seed{step} AS MATERIALIZED (SELECT id, v FROM odds{step} WHERE d2 > 0 ORDER BY -ln(greatest({uniform_sql(seed, step, 'id', '2')}, 1e-12)) / d2, id LIMIT 1)")
        parts.append(f"odds{step + 1} AS MATERIALIZED (SELECT w.id, w.v, least(w.d2, power(list_distance(w.v, s.v), 2)) AS d2 FROM odds{step} w, seed{step} s)")
    return [*parts, "c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i}::INT AS k, v FROM seed{i}" for i in range(k)) + ")"]


def centers_after(steps: int, first: list[str] = FIRST_K) -> str:
    parts = [ENTRIES, *first]
    for s in range(steps):
        parts.append(f"a{s} AS (SELECT id, arg_min(k, (d, k)) AS k FROM (SELECT id, k, list_distance(pts.v, c{s}.v) AS d FROM pts, c{s}) GROUP BY id)")
        parts.append(f"s{s} AS (SELECT k, pos, sum(x) / (count(*) + {KAPPA0}) AS x FROM entries JOIN a{s} USING (id) GROUP BY k, pos)")
        parts.append(f"c{s + 1} AS (SELECT c{s}.k, coalesce(n.v, list_transform(c{s}.v, lambda x: 0.0::DOUBLE)) AS v FROM c{s} LEFT JOIN (SELECT k, list(x ORDER BY pos) AS v FROM s{s} GROUP BY k) n USING (k))")
    parts.append(f"near AS (SELECT id, arg_min(k, (d, k)) AS k, min(d * d) AS d2 FROM (SELECT id, k, list_distance(pts.v, c{steps}.v) AS d FROM pts, c{steps}) GROUP BY id)")
    return "WITH " + ", ".join(parts)


GMM = (
    f"WITH {MOMENTS}, m0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, id AS cid FROM (SELECT id FROM pts ORDER BY id LIMIT {G})),"
    " dens AS (SELECT e.id, m0.k, sum(0.5 * ln(0.5 / var) - 0.5 / var * (e.x - c.x) * (e.x - c.x)) - ln("
    f"{G}) AS s FROM entries e JOIN moments USING (pos) CROSS JOIN m0 JOIN entries c ON c.id = m0.cid AND c.pos = e.pos GROUP BY e.id, m0.k),"
    " best AS (SELECT id, arg_max(k, (s, -k)) AS k, max(s) AS top FROM dens GROUP BY id),"
    " odds AS (SELECT id, k, exp(s - top) AS p FROM dens JOIN (SELECT id, top FROM best) USING (id)),"
    " shares AS (SELECT id, k, p / sum(p) OVER (PARTITION BY id) AS p FROM odds),"
    " cdf AS (SELECT id, k, sum(p) OVER (PARTITION BY id ORDER BY k) AS c FROM shares),"
    f" drawn AS (SELECT id, least(count(*) FILTER (WHERE c < {uniform_sql(11, 0, 'id', '0')}), {G - 1})::INT AS k FROM cdf GROUP BY id)"
)


def mstep(assigned: str) -> str:
    return (
        f"{GMM}, n AS (SELECT k, count(*) AS n FROM {assigned} GROUP BY k), s AS (SELECT k, pos, sum(x) AS s1, sum(x * x) AS s2 FROM entries JOIN {assigned} USING (id) GROUP BY k, pos),"
        f" full_s AS (SELECT m0.k, p.pos, coalesce(n, 0) AS n, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM m0 CROSS JOIN (SELECT pos FROM moments) p LEFT JOIN s ON s.k = m0.k AND s.pos = p.pos LEFT JOIN n ON n.k = m0.k)"
        f" SELECT k, pos, round(s1 / (n + {KAPPA0}), 6) AS mean, round((s2 - (n + {KAPPA0}) * power(s1 / (n + {KAPPA0}), 2) + {NU0 * SIGMA0}) / ({3 + NU0} + n), 6) AS var FROM full_s"
    )


def soft_em(steps: int) -> str:
    """c(k, pos, mean, var, log_pi) after so many steps of EM with whole responsibilities, from the first points."""
    first = "SELECT m0.k, c.pos, c.x AS mean, moments.var, -ln(%d::DOUBLE) AS log_pi FROM m0 JOIN entries c ON c.id = m0.cid JOIN moments USING (pos)" % G
    parts = [MOMENTS, f"m0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, id AS cid FROM (SELECT id FROM pts ORDER BY id LIMIT {G}))", f"g0 AS MATERIALIZED ({first})"]
    for s in range(steps):
        parts.append(f"l{s} AS (SELECT e.id, g.k, any_value(g.log_pi) + sum(0.5 * ln(0.5 / g.var) - 0.5 / g.var * (e.x - g.mean) * (e.x - g.mean)) AS s FROM entries e JOIN g{s} g USING (pos) GROUP BY e.id, g.k)")
        parts.append(f"e{s} AS (SELECT id, k, exp(s - max(s) OVER (PARTITION BY id)) AS p FROM l{s})")
        parts.append(f"r{s} AS MATERIALIZED (SELECT id, k, p / sum(p) OVER (PARTITION BY id) AS p FROM e{s})")
        parts.append(f"t{s} AS (SELECT k, pos, sum(p) AS n, sum(p * x) AS s1, sum(p * x * x) AS s2 FROM r{s} JOIN entries USING (id) GROUP BY k, pos)")
        mean = f"s1 / (n + {KAPPA0})"
        parts.append(
            f"g{s + 1} AS MATERIALIZED (SELECT k, pos, {mean} AS mean, (s2 - (n + {KAPPA0}) * power({mean}, 2) + {NU0 * SIGMA0}) / ({3 + NU0} + n) AS var,"
            f" ln(n + 1.0) - ln((SELECT count(*) FROM pts) + {float(G)}) AS log_pi FROM t{s})"
        )
    return "WITH " + ", ".join(parts)


def tokens(source: str = "(SELECT doc_id, text FROM documents)") -> str:
    return f"WITH tokens AS (SELECT doc_id, unnest(range(len(ws)))::INT AS pos, unnest(ws) AS word FROM (SELECT doc_id, {LINES} AS ws FROM {source}))"


def vocab(of: str) -> str:
    return f"vocab AS (SELECT word, (row_number() OVER (ORDER BY min(doc_id::HUGEINT * 1000000000 + pos)) - 1)::INT AS word_id FROM {of} GROUP BY word)"


def coded(source: str = "(SELECT doc_id, text FROM documents)") -> str:
    return (
        f"{tokens(source)}, kept AS (SELECT * FROM tokens WHERE word IN (SELECT word FROM tokens GROUP BY word HAVING count(*) > {TRUNC})), {vocab('kept')},"
        " coded AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, word_id FROM kept JOIN vocab USING (word))"
    )


def started(k: int, source: str = "(SELECT doc_id, text FROM documents)") -> str:
    draw = f"((doc_id + floor({uniform_sql(7, 0, 'doc_id', 'pos')} * 15)::BIGINT) % {k})::INT"
    return f"{coded(source)}, z AS (SELECT doc_id, pos, word_id, {draw} AS topic FROM coded)"


def lda_after(steps: int, source: str = "(SELECT doc_id, text FROM documents)") -> str:
    """z{steps}(doc_id, pos, word_id, topic) after so many synchronous sweeps from z."""
    parts = [started(T, source).replace("WITH ", "", 1), f"ks AS (SELECT unnest(range({T}))::INT AS k)", "z0 AS MATERIALIZED (SELECT * FROM z)"]
    for s in range(steps):
        parts.append(f"nw{s} AS (SELECT word_id, topic AS k, count(*) AS n FROM z{s} GROUP BY ALL)")
        parts.append(f"nk{s} AS (SELECT k, sum(n) AS n FROM nw{s} GROUP BY k)")
        parts.append(
            f"p{s} AS MATERIALIZED (SELECT v.word_id, ks.k, (coalesce(a.n, 0) + 0.1) / (coalesce(b.n, 0) + (SELECT count(*) FROM vocab) * 0.1::DOUBLE) AS p"
            f" FROM vocab v CROSS JOIN ks LEFT JOIN nw{s} a ON a.word_id = v.word_id AND a.k = ks.k LEFT JOIN nk{s} b ON b.k = ks.k)"
        )
        parts += resampled(s, f"p{s}", 50.0 / T, T)
    return "WITH " + ", ".join(parts)


def resampled(s: int, weight: str, prior: float, k: int) -> list[str]:
    """z{s + 1} from z{s}: every token anew with odds (n_dk + prior) * weight."""
    return [
        f"nd{s} AS (SELECT doc_id, topic AS k, count(*) AS n FROM z{s} GROUP BY ALL)",
        f"m{s} AS (SELECT z.doc_id, z.pos, z.word_id, ks.k, sum((coalesce(n, 0) + {prior}) * p) OVER (PARTITION BY z.doc_id, z.pos ORDER BY ks.k) AS c"
        f" FROM z{s} z CROSS JOIN ks LEFT JOIN nd{s} d ON d.doc_id = z.doc_id AND d.k = ks.k JOIN {weight} w ON w.word_id = z.word_id AND w.k = ks.k)",
        f"z{s + 1} AS MATERIALIZED (SELECT doc_id, pos, word_id, least(count(*) FILTER (WHERE c < u * top), {k - 1})::INT AS topic FROM"
        f" (SELECT *, max(c) OVER (PARTITION BY doc_id, pos) AS top, {uniform_sql(7, s + 1, 'doc_id', 'pos')} AS u FROM m{s}) GROUP BY doc_id, pos, word_id)",
    ]


def glda_after(steps: int) -> str:
    """g(k, pos, mean, var) of topics as Gaussians over word vectors, after so many sweeps."""
    parts = [started(G, TALK).replace("WITH ", "", 1), f"ks AS (SELECT unnest(range({G}))::INT AS k)", "z0 AS MATERIALIZED (SELECT * FROM z)"]
    parts.append("vecs AS (SELECT word_id, embedding::DOUBLE[] AS v FROM vocab JOIN embeddings ON word_id % (SELECT count(*) FROM embeddings) = vec_id)")
    parts.append("ve AS MATERIALIZED (SELECT word_id, unnest(range(len(v)))::INT AS pos, unnest(v) AS x FROM vecs)")
    for s in range(steps + 1):
        mean = f"s1 / (n + {KAPPA0})"
        parts.append(f"h{s} AS (SELECT topic AS k, ve.pos, count(*) AS n, sum(x) AS s1, sum(x * x) AS s2 FROM z{s} z JOIN ve ON ve.word_id = z.word_id GROUP BY topic, ve.pos)")
        parts.append(f"f{s} AS (SELECT ks.k, d.pos, coalesce(n, 0) AS n, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM ks CROSS JOIN (SELECT DISTINCT pos FROM ve) d LEFT JOIN h{s} h ON h.k = ks.k AND h.pos = d.pos)")
        parts.append(f"g{s} AS MATERIALIZED (SELECT k, pos, {mean} AS mean, (s2 - (n + {KAPPA0}) * power({mean}, 2) + {NU0 * SIGMA0}) / ({3 + NU0} + n) AS var FROM f{s})")
        if s < steps:
            parts.append(f"l{s} AS (SELECT a.word_id, g.k, sum(0.5 * ln(0.5 / g.var) - 0.5 / g.var * (a.x - g.mean) * (a.x - g.mean)) AS s FROM ve a JOIN g{s} g USING (pos) GROUP BY a.word_id, g.k)")
            parts.append(f"p{s} AS MATERIALIZED (SELECT word_id, k, exp(s - max(s) OVER (PARTITION BY word_id)) + 1e-300 AS p FROM l{s})")
            parts += resampled(s, f"p{s}", 1.0 / G, G)
    return "WITH " + ", ".join(parts)


def swept(k: int, weight: str, alpha: float) -> str:
    """Tokens' topics after one sweep; weight is a relation (word_id, k, p) for every pair."""
    return (
        f" ks AS (SELECT unnest(range({k}))::INT AS k), nmk AS (SELECT doc_id, topic AS k, count(*) AS n FROM z GROUP BY ALL),"
        f" mass AS (SELECT z.doc_id, z.pos, z.word_id, ks.k, sum((coalesce(n, 0) + {alpha / k}) * p) OVER (PARTITION BY z.doc_id, z.pos ORDER BY ks.k) AS c"
        f" FROM z CROSS JOIN ks LEFT JOIN nmk ON nmk.doc_id = z.doc_id AND nmk.k = ks.k JOIN {weight} w ON w.word_id = z.word_id AND w.k = ks.k),"
        f" new_z AS (SELECT doc_id, pos, word_id, least(count(*) FILTER (WHERE c < u * top), {k - 1})::INT AS k FROM"
        f" (SELECT *, max(c) OVER (PARTITION BY doc_id, pos) AS top, {uniform_sql(7, 1, 'doc_id', 'pos')} AS u FROM mass) GROUP BY doc_id, pos, word_id)"
    )


PHI = (
    f"{started(T)}, nwk AS (SELECT word_id, topic AS k, count(*) AS n FROM z GROUP BY ALL), nk AS (SELECT k, sum(n) AS n FROM nwk GROUP BY k),"
    f" phi AS (SELECT v.word_id, v.word, t.k, (coalesce(nwk.n, 0) + 0.1) / (coalesce(nk.n, 0) + (SELECT count(*) FROM vocab) * 0.1::DOUBLE) AS p"
    f" FROM vocab v CROSS JOIN (SELECT unnest(range({T}))::INT AS k) t LEFT JOIN nwk ON nwk.word_id = v.word_id AND nwk.k = t.k LEFT JOIN nk ON nk.k = t.k)"
)
GLDA = (
    f"{started(G, TALK)}, vecs AS (SELECT word_id, embedding::DOUBLE[] AS v FROM vocab JOIN embeddings ON word_id % (SELECT count(*) FROM embeddings) = vec_id),"
    " ve AS (SELECT word_id, unnest(range(len(v)))::INT AS pos, unnest(v) AS x FROM vecs), va AS (SELECT pos, greatest(var_pop(x), 1e-6) AS var FROM ve GROUP BY pos),"
    f" gd AS (SELECT a.word_id, b.word_id AS k, sum(0.5 * ln(0.5 / var) - 0.5 / var * (a.x - b.x) * (a.x - b.x)) AS s FROM ve a JOIN ve b ON a.pos = b.pos AND b.word_id < {G} JOIN va ON va.pos = a.pos GROUP BY ALL),"
    " gw AS (SELECT word_id, k, exp(s - max(s) OVER (PARTITION BY word_id)) + 1e-300 AS p FROM gd),"
)
STIRLING = (
    "WITH RECURSIVE s(n, m, c) AS (SELECT 0, x::INT, (CASE WHEN x = 0 THEN 1 ELSE 0 END)::HUGEINT FROM range(23) t(x) UNION ALL"
    " SELECT n + 1, m, (coalesce(lag(c) OVER (ORDER BY m), 0) + n * c)::HUGEINT FROM s WHERE n < 22),"
    " big AS (SELECT n, m, c::DOUBLE AS c FROM s)"
)

ORACLES: dict[str, str] = {
    "nn_1": f"WITH {PAIRS} SELECT qid, id, round(dist, 6) AS dist FROM ranked WHERE rank = 1",
    "knn_k3": f"WITH {PAIRS} SELECT qid, rank, id, round(dist, 6) AS dist FROM ranked WHERE rank <= 3",
    "range_search": f"WITH {PAIRS} SELECT qid, id, round(dist, 6) AS dist FROM pairs WHERE dist < {RADIUS}",
    "range_counts": f"WITH {PAIRS} SELECT qid, count(*) FILTER (WHERE dist < {RADIUS}) AS n FROM pairs GROUP BY qid",
    "furthest": f"WITH {WITH_SELF} SELECT qid, id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist DESC, id) AS r FROM ranked) WHERE r = 1",
    "knn_label_vote": f"WITH {PAIRS} SELECT qid, label FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, label) AS r FROM ranked WHERE rank <= 3 GROUP BY qid, label) WHERE r = 1",
    "returned_points": f"WITH {PAIRS} SELECT qid, unnest(range(len(v)))::INT AS pos, round(unnest(v), 6) AS x FROM ranked JOIN pts USING (id) WHERE rank = 1",
    "tree_knn_k3": f"WITH {WITH_SELF} SELECT qid, rank, id, round(dist, 6) AS dist FROM ranked WHERE rank <= 3",
    "tree_range_search": f"WITH {WITH_SELF} SELECT qid, id, round(dist, 6) AS dist FROM ranked WHERE dist < {RADIUS}",
    "tree_insert_remove": f"WITH {PTS} SELECT qid, arg_min(id, (d, id)) AS id, round(min(d), 6) AS dist FROM (SELECT qid, id, list_distance(qv, v) AS d FROM asked, pts WHERE id % 3 <> 0) GROUP BY qid",
    "forest_knn_k3": f"WITH {WITH_SELF} SELECT qid, rank, id, round(dist, 6) AS dist FROM ranked WHERE rank <= 3",
    "forest_range_search": f"WITH {WITH_SELF} SELECT qid, id, round(dist, 6) AS dist FROM ranked WHERE dist < {RADIUS}",
    "forest_insert_remove": f"WITH {PTS} SELECT qid, arg_min(id, (d, id)) AS id, round(min(d), 6) AS dist FROM (SELECT qid, id, list_distance(qv, v) AS d FROM asked, pts WHERE id % 3 <> 0) GROUP BY qid",
    "tree_root": (
        f"WITH {MOMENTS}, far AS (SELECT id, sum((x - mean) * (x - mean)) AS d FROM entries JOIN moments USING (pos) GROUP BY id), root AS (SELECT pts.id, v FROM pts JOIN far USING (id) ORDER BY d, id DESC LIMIT 1),"
        " top AS (SELECT max(list_distance(pts.v, root.v)) AS r FROM pts, root)"
        " SELECT id, round(r, 6) AS max_dist, ceil(ln(r) / ln(1.3))::BIGINT AS level FROM root, top"
    ),
    "tree_nodes_checked": "SELECT vec_id AS id, 1::BIGINT AS n, true AS near_parent, true AS levels_fall, true AS radius_holds FROM embeddings",
    "tree_level_total": "SELECT count(*) AS n FROM embeddings",
    "tree_covering": "SELECT true AS covering",
    "tree_spread_checked": f"SELECT {K}::BIGINT AS n, {K}::BIGINT AS distinct_rows, {K}::BIGINT AS members",
    "tree_merge_distinct": f"WITH {PTS} SELECT min(id) AS id FROM pts GROUP BY v",
    "mean_vector": f"WITH {MOMENTS} SELECT pos, round(mean, 6) AS mean FROM moments",
    "var_vector": f"WITH {MOMENTS} SELECT pos, round(var, 6) AS var FROM moments",
    "dist_to_mean_order": f"WITH {MOMENTS}, far AS (SELECT id, round(sqrt(sum((x - mean) * (x - mean))), 6) AS dist FROM entries JOIN moments USING (pos) GROUP BY id) SELECT id, dist, row_number() OVER (ORDER BY dist DESC, id) - 1 AS n FROM far",
    "point_count": "SELECT count(*) AS n FROM embeddings",
    "firstk_seeds": f"SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT {K}",
    "random_seeds": f"SELECT vec_id AS id FROM embeddings ORDER BY {uniform_sql(5, 0, 'vec_id', '1')}, vec_id LIMIT {K}",
    "kmeanspp_d2_weights": f"WITH {PTS} SELECT a.id, round(min(power(list_distance(a.v, b.v), 2)), 6) AS d2 FROM pts a, (SELECT v FROM pts ORDER BY id LIMIT 3) b GROUP BY a.id",
    "kmeanspp_seeds": "WITH " + ", ".join([ENTRIES, *plus_plus(K, 3)]) + " SELECT k, unnest(range(len(v)))::INT AS pos, round(unnest(v), 6) AS x FROM c0",
    "kmeans_fit_kmeanspp": f"{centers_after(10, plus_plus(10, 0))} SELECT id, k FROM near",
    "kmeans_assign": f"{centers_after(0)} SELECT id, k FROM near",
    "kmeans_iter1_centers": f"{centers_after(1)} SELECT k, unnest(range(len(v)))::INT AS pos, round(unnest(v), 6) AS x FROM c1",
    "kmeans_iter3_centers": f"{centers_after(3)} SELECT k, unnest(range(len(v)))::INT AS pos, round(unnest(v), 6) AS x FROM c3",
    "kmeans_sse": f"{centers_after(1)} SELECT round(-sum(d2), 6) AS score FROM near",
    "kmeans_cluster_sizes": f"{centers_after(1)} SELECT k, count(*) AS n FROM near GROUP BY k",
    "kmeans_label_purity": f"{centers_after(1)} SELECT k, max(n) AS most FROM (SELECT k, label, count(*) AS n FROM near JOIN pts USING (id) GROUP BY k, label) GROUP BY k",
    "kmeans_lineitem": (
        "WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS id, [l_quantity, l_discount * 100, l_tax * 100]::DOUBLE[] AS v FROM lineitem),"
        " c AS (SELECT unnest([0, 1, 2, 3])::INT AS k, unnest([[5.0, 1.0, 1.0], [20.0, 9.0, 3.0], [33.0, 2.0, 6.0], [47.0, 7.0, 5.0]]::DOUBLE[][]) AS v),"
        " a AS (SELECT p.v, (SELECT arg_min(k, (round(list_distance(p.v, c.v), 9), k)) FROM c) AS k FROM p)"
        f" SELECT k, pos, round(sum(x) / (count(*) + {KAPPA0}), 6) AS x FROM (SELECT k, unnest(range(3))::INT AS pos, unnest(v) AS x FROM a) GROUP BY k, pos"
    ),
    "gmm_logdens": f"{GMM} SELECT id, k, round(s, 6) AS s FROM dens",
    "gmm_map_assign": f"{GMM} SELECT id, k FROM best",
    "gmm_mstep": mstep("best"),
    "gmm_sampled_mstep": mstep("drawn"),
    "gmm_log_weights": f"{GMM} SELECT m0.k, round(ln(count(id) + 1.0) - ln((SELECT count(*) FROM pts) + {float(G)}), 6) AS log_pi FROM m0 LEFT JOIN best USING (k) GROUP BY m0.k",
    "gmm_score_max": f"{GMM} SELECT round(avg(top) - 0.5 * 64 * ln(pi()), 6) AS score FROM best",
    "gmm_score_lse": f"{GMM} SELECT round(avg(l) - 0.5 * 64 * ln(pi()), 6) AS score FROM (SELECT id, max(top) + ln(sum(exp(s - top))) AS l FROM dens JOIN (SELECT id, top FROM best) USING (id) GROUP BY id)",
    "gmm_fit_soft": f"{soft_em(5)} SELECT k, pos, round(mean, 6) AS mean, round(var, 6) AS var, round(log_pi, 6) AS log_pi FROM g5",
    "tokenize": f"{tokens()} SELECT doc_id, pos, word FROM tokens",
    "vocab_first_seen": f"{tokens()}, {vocab('tokens')} SELECT word_id, word FROM vocab",
    "vocab_extended": (
        f"{tokens('(SELECT item_id AS doc_id, text FROM benchmark)')}, {vocab('tokens')}, more AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, {LINES} AS ws FROM documents)),"
        " fresh AS (SELECT word, row_number() OVER (ORDER BY min(doc_id::HUGEINT * 1000000000 + pos)) - 1 AS n FROM more WHERE word NOT IN (SELECT word FROM vocab) GROUP BY word)"
        " SELECT word_id, word FROM vocab UNION ALL SELECT (n + (SELECT count(*) FROM vocab))::INT, word FROM fresh"
    ),
    "word_freq": f"{tokens()} SELECT word, count(*) AS n FROM tokens GROUP BY word",
    "min_count_filter": f"{tokens()} SELECT doc_id, pos, word FROM tokens WHERE word IN (SELECT word FROM tokens GROUP BY word HAVING count(*) > {TRUNC})",
    "stopword_filter": f"{tokens()} SELECT doc_id, pos, word FROM tokens WHERE word NOT IN ({', '.join(repr(w) for w in STOPWORDS)})",
    "train_test_split": "SELECT doc_id, CASE WHEN doc_id >= 100 THEN 'train' ELSE 'test' END AS side FROM documents",
    "encode_decode": f"{tokens()} SELECT doc_id, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM tokens GROUP BY doc_id",
    "preprocess_counts": (
        f"{tokens()}, {vocab('tokens')}, named AS (SELECT word, word_id, regexp_replace(word, '[^A-Za-z0-9]', '', 'g') AS plain FROM vocab WHERE word IN (SELECT word FROM tokens GROUP BY word HAVING count(*) > {TRUNC}))"
        " SELECT doc_id, md5(string_agg(plain, ' ' ORDER BY word_id)) AS digest FROM tokens JOIN named USING (word) WHERE plain <> '' GROUP BY doc_id"
    ),
    "packed_corpus": f"{tokens()} SELECT doc_id, CASE WHEN doc_id >= 100 THEN 'train' ELSE 'test' END AS side, count(*) AS n FROM tokens GROUP BY doc_id",
    "synthetic_points_checked": "SELECT 10000::BIGINT AS n, 10000::BIGINT AS ids, 16 AS dim, 10::BIGINT AS labels, true AS near_means",
    "lda_init_topics": f"{started(T)} SELECT doc_id, pos, topic FROM z",
    "lda_counts_nwk": f"{started(T)} SELECT word_id, topic AS k, count(*) AS n FROM z GROUP BY ALL",
    "lda_counts_nmk": f"{started(T)} SELECT doc_id, topic AS k, count(*) AS n FROM z GROUP BY ALL",
    "lda_phi": f"{PHI} SELECT word_id, k, round(p, 9) AS p FROM phi",
    "lda_sweep1_counts": f"{PHI}, {swept(T, 'phi', 50.0)} SELECT word_id, k, count(*) AS n FROM new_z GROUP BY ALL",
    "lda_top_words": f"{PHI} SELECT k, rank::INT AS rank, word FROM (SELECT k, word, row_number() OVER (PARTITION BY k ORDER BY p DESC, word_id) AS rank FROM phi) WHERE rank <= 15",
    "lda_heldout_given_z": (
        f"{PHI}, ks AS (SELECT unnest(range({T}))::INT AS k), nmk AS (SELECT doc_id, topic AS k, count(*) AS n FROM z GROUP BY ALL), sizes AS (SELECT doc_id, count(*) AS size FROM z GROUP BY doc_id),"
        f" each AS (SELECT z.doc_id, z.pos, ln(sum((coalesce(n, 0) + {50.0 / T}) * p)) AS l FROM z CROSS JOIN ks LEFT JOIN nmk ON nmk.doc_id = z.doc_id AND nmk.k = ks.k JOIN phi ON phi.word_id = z.word_id AND phi.k = ks.k GROUP BY z.doc_id, z.pos)"
        " SELECT round(sum(l - ln(size + 50.0)) / count(*), 6) AS score FROM each JOIN sizes USING (doc_id)"
    ),
    "lda_fit_counts": f"{lda_after(3)} SELECT word_id, topic AS k, count(*) AS n FROM z3 GROUP BY ALL",
    "lda_predict_sizes": f"{coded()} SELECT doc_id, count(*) AS n, true AS in_range FROM coded GROUP BY doc_id",
    "hdp_simple_totals": f"{coded()} SELECT count(*) AS n, true AS in_range FROM coded",
    "hdp_stc_totals": f"{coded(TALK)} SELECT count(*) AS n, true AS in_range FROM coded",
    "hdp_heldout_given_z": (
        f"{started(G, TALK)}, ks AS (SELECT unnest(range({G}))::INT AS k), nwk AS (SELECT word_id, topic AS k, count(*) AS n FROM z GROUP BY ALL), nk AS (SELECT k, sum(n) AS n FROM nwk GROUP BY k),"
        f" phi AS (SELECT v.word_id, ks.k, (coalesce(nwk.n, 0) + 0.1) / (coalesce(nk.n, 0) + (SELECT count(*) FROM vocab) * 0.1::DOUBLE) AS p FROM vocab v CROSS JOIN ks LEFT JOIN nwk ON nwk.word_id = v.word_id AND nwk.k = ks.k LEFT JOIN nk ON nk.k = ks.k),"
        " nmk AS (SELECT doc_id, topic AS k, count(*) AS n FROM z GROUP BY ALL), sizes AS (SELECT doc_id, count(*) AS size FROM z GROUP BY doc_id),"
        f" each AS (SELECT z.doc_id, z.pos, ln(50.0 / {G + 1} / (SELECT count(*) FROM vocab) + sum((coalesce(n, 0) + 50.0 / {G + 1}) * p)) AS l FROM z CROSS JOIN ks LEFT JOIN nmk ON nmk.doc_id = z.doc_id AND nmk.k = ks.k JOIN phi ON phi.word_id = z.word_id AND phi.k = ks.k GROUP BY z.doc_id, z.pos)"
        " SELECT round(sum(l - ln(size + 50.0)) / count(*), 6) AS score FROM each JOIN sizes USING (doc_id)"
    ),
    "glda_fit": f"{glda_after(3)} SELECT k, pos, round(mean, 6) AS mean, round(var, 6) AS var FROM g3",
    "glda_sweep1_counts": f"{GLDA} {swept(G, 'gw', 1.0)} SELECT word_id, k, count(*) AS n FROM new_z GROUP BY ALL",
    "stirling_ratios": (
        f"{STIRLING} SELECT a.n, a.m, round(ln(a.c), 6) AS log_s, round(b.c / a.c, 6) AS u, round(d.c / b.c, 6) AS v, round(CASE WHEN a.n <= a.m THEN 1 ELSE d.c / a.c END, 6) AS w"
        " FROM big a JOIN big b ON b.n = a.n + 1 AND b.m = a.m JOIN big d ON d.n = a.n + 1 AND d.m = a.m + 1 WHERE a.m BETWEEN 1 AND a.n AND a.n BETWEEN 1 AND 20"
    ),
    "log_sum_exp_pairs": "SELECT event_id, round(value + ln(1 + exp(-1.0)), 6) AS \"both\" FROM events",
    "level_powers": f"SELECT event_id, ceil(ln(value) / {math.log(1.3)!r})::BIGINT AS level, round(power(1.3::DOUBLE, ceil(ln(value) / {math.log(1.3)!r})), 6) AS cover FROM events WHERE value > 0",
    "uniform_draws": f"SELECT event_id, round({uniform_sql(3, 1, 'event_id', 'user_id')}, 6) AS u FROM events",
    "categorical_draws": (
        "WITH w AS (SELECT o_orderpriority AS p, sum(count(*)) OVER (ORDER BY o_orderpriority) AS cum FROM orders GROUP BY 1), d AS (SELECT list(p ORDER BY cum) AS ps, list(cum::DOUBLE ORDER BY cum) AS cs, max(cum)::DOUBLE AS total FROM w)"
        f" SELECT o_orderkey, ps[1 + len(list_filter(cs, lambda c: c < u * total))] AS drawn FROM (SELECT o_orderkey, {uniform_sql(9, 0, 'o_orderkey', '1')} AS u FROM orders), d"
    ),
    "stream_assign": f"{centers_after(0)} SELECT id, k FROM near",
}
