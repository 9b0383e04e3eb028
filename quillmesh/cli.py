"""Command line: python -m quillmesh.cli PROGRAM --dataset PATH --output-model PATH ...

Programs: cover_tree, k_means, gmm, lda, glda, hdp, preprocessing, datagen. Points are Parquet
tables with id and v, or binary files (a path that ends in .dat); corpora are text files with
one document per line. A second path, PATH.test, is scored if it is given with --test.
Master, memory and the shared folder (spark.checkpoint.dir) come from spark-submit or the
session's defaults.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import covertree, mixture, topics
from .sources import binary, corpus


def positive(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError(f"{text} is not above zero")
    return value


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("quillmesh", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("program", choices=["cover_tree", "k_means", "gmm", "lda", "glda", "hdp", "preprocessing", "datagen"])
    out.add_argument("--dataset", required=True)
    out.add_argument("--test", default=None)
    out.add_argument("--output-model", default="./model")
    out.add_argument("--method", default="simple")
    out.add_argument("--init-type", default="random")
    out.add_argument("--num-clusters", "--num-topics", dest="k", type=positive, default=100)
    out.add_argument("--num-iterations", type=positive, default=1000)
    out.add_argument("--num-top-words", type=positive, default=15)
    out.add_argument("--num-threads", type=positive, default=None, help="tasks at a time on a local master; a cluster has its own setting")
    out.add_argument("--output-state-interval", type=positive, default=200)
    out.add_argument("--vocabulary", default=None, help="preprocessing: file of words; glda: table word_id, v")
    out.add_argument("--num-test", type=int, default=0)
    out.add_argument("--min-count", type=int, default=0)
    out.add_argument("--shuffle", action="store_true")
    out.add_argument("--seed", type=int, default=0)
    return out


def points(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith(".dat"):
        return spark.read.parquet(path).select("id", "v")
    rows = binary.read_points(spark, path)
    files = corpus.with_ordinal(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")), ["file"], "n")
    return rows.join(files, "file").select((F.col("n") * F.lit(1 << 40) + F.col("id")).alias("id"), "v")


def fit(args: argparse.Namespace, spark: SparkSession) -> float | None:
    kept = {"snapshot": args.output_model, "every": args.output_state_interval}
    if args.program in ("k_means", "gmm"):
        data, test = points(spark, args.dataset), points(spark, args.test) if args.test else None
        kind = mixture.KMeans if args.program == "k_means" else mixture.GMM
        return kind(args.k, args.num_iterations, args.init_type, data, seed=args.seed).fit(data, test, **kept)
    docs, vocab = corpus.read_corpus(spark, args.dataset)
    test = corpus.encode(corpus.tokenize(corpus.read_lines(spark, args.test)), vocab) if args.test else None
    if args.program == "lda":
        model = topics.LDA(args.k, args.num_iterations, vocab, seed=args.seed, sampler="alias" if "alias" in args.method else "dense")
    elif args.program == "glda":
        model = topics.GLDA(args.k, args.num_iterations, vocab, spark.read.parquet(args.vocabulary), seed=args.seed, sampler="alias" if "alias" in args.method else "dense")
    else:
        model = topics.HDP(args.k, args.num_iterations, vocab, seed=args.seed, method=args.method)
    score = model.fit(docs, test, **kept)
    model.get_top_words(spark, args.num_top_words).write.mode("overwrite").parquet(f"{args.output_model}-words")
    return score


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> float | None:
    """Runs a program; returns the score over the test data, if there is one."""
    args = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder
        spark = (builder.master(f"local[{args.num_threads}]") if args.num_threads else builder).getOrCreate()
    if args.program == "datagen":
        binary.write_synthetic_packs(spark, args.output_model, 1000 * args.k, 100, args.k, packs=8, seed=args.seed)
        return None
    if args.program == "preprocessing":
        if args.method == "uci":
            counts, vocab = corpus.read_uci(spark, args.dataset, args.vocabulary)
        else:
            counts, vocab = corpus.read_ldac(spark, args.dataset), corpus.read_ldac_vocab(spark, args.vocabulary)
        for side, rows in zip(("train", "test"), corpus.preprocess(counts, vocab, args.num_test, args.min_count, args.shuffle, args.seed), strict=True):
            rows.write.mode("overwrite").parquet(f"{args.output_model}/{side}")
        return None
    if args.program == "cover_tree":
        tree = covertree.CoverTree.from_matrix(points(spark, args.dataset))
        tree.save(args.output_model)
        if args.test:
            asked = points(spark, args.test).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
            tree.k_nearest(asked, 3).write.mode("overwrite").parquet(f"{args.output_model}/nearest")
        return None
    return fit(args, spark)


if __name__ == "__main__":
    print(main())
