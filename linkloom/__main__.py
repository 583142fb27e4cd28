"""python -m linkloom dictionary|prepare|check|tune|train|predict|staged [STEP] --data DIR --work DIR --out DIR (see --help).

All folders may be on any file system that Spark reaches."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics, normalize, sampling
from .plans import lifecycle, workflows
from .sources import io


def dictionary(spark: SparkSession, a: argparse.Namespace) -> None:
    """Learns the words of other scripts from the true pairs of the raw files."""
    s1 = io.read_source(spark, io.source_path(a.data, "train", 1), 1).select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("n1"))
    s23 = io.read_source(spark, io.source_path(a.data, "train", 2), 2).unionByName(io.read_source(spark, io.source_path(a.data, "train", 3), 3))
    pairs = io.read_truth(spark, io.truth_path(a.data)).join(s1, "s1_id").join(s23.select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("n2")), "cand_id")
    normalize.learn_dictionary(pairs).write.mode("overwrite").parquet(f"{a.work}/dictionary.parquet")


def known_words(spark: SparkSession, work: str) -> DataFrame | None:
    """The learnt words, or None where nothing has been learnt."""
    path = f"{work}/dictionary.parquet"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm):
        return None
    return spark.read.parquet(path).select("native", "latin")


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    words = known_words(spark, a.work)
    for split in ("train", "test"):
        for n in (1, 2, 3):
            clean = normalize.normalize(io.read_source(spark, io.source_path(a.data, split, n), n), words)
            io.write_clean(clean, io.clean_path(a.work, split, n))
            io.read_clean(spark, io.clean_path(a.work, split, n)).groupBy("country").count().show()
    io.truth_pairs(io.read_truth(spark, io.truth_path(a.data)), *records(spark, a.work, "train")).write.mode("overwrite").parquet(io.pairs_path(a.work))


def records(spark: SparkSession, work: str, split: str) -> tuple[DataFrame, DataFrame]:
    s = [io.read_clean(spark, io.clean_path(work, split, n)) for n in (1, 2, 3)]
    return s[0], s[1].unionByName(s[2])


def _train(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    s1, s23 = records(spark, a.work, "train")
    truth = spark.read.parquet(io.pairs_path(a.work))
    s1, s23 = sampling.universe(s1, s23, truth, a.universe)
    return s1, s23, truth.join(s1.select(F.col("rid").alias("s1_rid")), "s1_rid", "left_semi")


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    s1, s23 = records(spark, a.work, "train")
    metrics.clean_report(spark.read.parquet(io.pairs_path(a.work)), s1, s23).show()
    sample = sampling.exact_sample(records(spark, a.work, "test")[0], 5, "rid", by="country")
    sample.select("country", "business_name", "name_core", "legal_form", "addr_clean").orderBy("country").show(100, False)


def tune(spark: SparkSession, a: argparse.Namespace) -> None:
    s1, s23, truth = _train(spark, a)
    for found in (workflows.tune(s1, s23, truth, workflows.simple_pairs, workflows.SIMPLE_GRID, a.sample), workflows.tune(s1, s23, truth, workflows.rule_pairs, workflows.RULE_GRID, a.sample, "country")):
        for df in found:
            df.show()


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    model, config = workflows.train_threshold(*_train(spark, a), rounds=a.rounds, depth=a.depth, min_rows=a.min_rows)
    io.save_model(model, f"{a.work}/model")
    io.write_json(spark, f"{a.work}/model_config.json", config)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    """By the one-model learner or, with --scores, by simple or full keys and a fixed threshold."""
    s1, s23 = records(spark, a.work, "test")
    if a.scores:
        score, usual = (workflows.simple_pairs, 80.0) if a.scores == "simple" else (workflows.rule_pairs, 80.0)
        done = workflows.predict_by_score(s1, s23, score, usual if a.threshold is None else a.threshold)
    else:
        limit = io.read_json(spark, f"{a.work}/model_config.json")["threshold"] if a.threshold is None else a.threshold
        done = workflows.match_threshold(io.load_model(f"{a.work}/model"), limit, s1, s23)
    workflows.write_results(*done, s1, s23, a.out)


def staged(spark: SparkSession, a: argparse.Namespace) -> None:
    """The two-stage learner, step by step: cands (of --split), dump, ce, train, eval, predict."""
    shelf = lifecycle.Shelf(spark, f"{a.work}/staged")
    settings = lifecycle.SMALL if a.small else lifecycle.SETTINGS
    s1, s23, truth = _train(spark, a)
    t1, t23 = records(spark, a.work, "test") if a.step == "predict" or a.split == "test" else (None, None)
    t1 = lifecycle.first_of_each(t1, a.test_limit) if t1 is not None else None
    if a.step == "cands":
        lifecycle.candidates(shelf, a.split, *((t1, t23) if a.split == "test" else (s1, s23)), again=True)
    elif a.step == "dump":
        lifecycle.dump(shelf, a.split, *((t1, t23, None) if a.split == "test" else (s1, s23, truth)), settings)
    elif a.step == "ce":
        lifecycle.score_texts(shelf)
    elif a.step == "train":
        print(lifecycle.train(shelf, s1, s23, truth, a.sample, settings, again=a.again))
    elif a.step == "eval":
        lifecycle.evaluate(shelf, s1, s23, truth).show(200, False)
    else:
        workflows.write_results(*lifecycle.match(shelf, "test", t1, t23), t1, t23, a.out)


COMMANDS = {f.__name__: f for f in (dictionary, prepare, check, tune, train, predict, staged)}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="linkloom")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("step", nargs="?", choices=["cands", "dump", "ce", "train", "eval", "predict"], help="of staged")
    p.add_argument("--split", choices=["train", "test"], default="train", help="of staged cands and dump")
    p.add_argument("--data", default="data", help="raw tab-separated files")
    p.add_argument("--work", default="work", help="clean records, dictionary and model")
    p.add_argument("--out", default="output", help="the results' files")
    p.add_argument("--universe", type=int, default=800_000, help="records of source 1 that training takes of each country")
    p.add_argument("--sample", type=int, default=50_000, help="records of source 1 that tuning takes, and staged train of each country")
    p.add_argument("--rounds", type=int, default=600)
    p.add_argument("--depth", type=int, default=6)
    p.add_argument("--min-rows", type=int, default=100)
    p.add_argument("--threshold", type=float, help="instead of the learnt one")
    p.add_argument("--scores", choices=["simple", "rule"], help="predict without a learner")
    p.add_argument("--test-limit", type=int, default=0, help="first records of source 1 of each country that staged takes of the test split")
    p.add_argument("--small", action="store_true", help="learners for small tables")
    p.add_argument("--again", action="store_true", help="staged train learns anew what is already saved")
    a = p.parse_args(argv)
    if (a.command == "staged") != (a.step is not None):
        p.error("staged takes a step, the others none")
    COMMANDS[a.command](SparkSession.builder.appName("linkloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
