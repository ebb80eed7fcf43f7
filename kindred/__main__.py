"""Command lines: ``python -m kindred train | predict | profile | validate``, on folders of tab-separated files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import assignment as A
from kindred.operators import blocking as B
from kindred.operators import inspection as I
from kindred.plans import pipeline
from kindred.sources import tsv

#: Names of input and output files.
SOURCES = ("source1.tsv", "source2.tsv", "source3.tsv")
TRUTH, MATCHES, CANDIDATES = "ground_truth.tsv", "matching_results.tsv", "candidate_pairs.tsv"


def records(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """``pos, eid, source, name, address, country`` of a folder's three sources; ``pos`` follows the ids."""
    out = None
    for i, name in enumerate(SOURCES, 1):
        one = tsv.read_tsv(spark, f"{folder}/{part}_{name}").select(
            F.xxhash64("entity_id").alias("pos"), F.col("entity_id").alias("eid"), F.lit(f"S{i}").alias("source"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country"
        )
        out = one if out is None else out.unionByName(one)
    return out


def sides(spark: SparkSession, folder: str, part: str) -> tuple[DataFrame, DataFrame]:
    every = records(spark, folder, part)
    return every.where("source = 'S1'").drop("source"), every.where("source <> 'S1'").drop("source")


def truth_lists(spark: SparkSession, folder: str) -> DataFrame:
    return tsv.parse_truth(tsv.read_tsv(spark, f"{folder}/train_{TRUTH}", ("source1_entity_id", "matched_entity_ids")))


def train(spark: SparkSession, args: argparse.Namespace) -> bool:
    config = pipeline.FULL if args.features == "full" else pipeline.COMPACT
    s1, targets = sides(spark, args.data_dir, "train")
    truth = truth_lists(spark, args.data_dir).select("s1_id", F.explode("target_ids").alias("target_id"))
    linkage = pipeline.train(s1, targets, truth, config)
    linkage.save(args.artifact_dir)
    recall = B.blocking_recall(truth, pipeline.candidates(s1, targets, config, prune=False)).first()
    matches, _ = pipeline.predict(linkage, s1, targets)
    pairs = matches.select("s1_id", F.explode("target_ids").alias("target_id"))
    score = A.macro_f05(s1.select(F.col("eid").alias("s1_id")), truth, pairs).first()
    print(f"threshold {linkage.threshold:.2f}, pair recall of candidates {recall['pair_recall']:.4f}, macro F0.5 over all records {score['macro_f05']:.4f}, model in {args.artifact_dir}")
    return True


def predict(spark: SparkSession, args: argparse.Namespace) -> bool:
    config = pipeline.FULL if args.features == "full" else pipeline.COMPACT
    s1, targets = sides(spark, args.test_dir, "test")
    matches, candidates = pipeline.predict(pipeline.Linkage.load(args.artifact_dir, config), s1, targets)
    tsv.write_submission(candidates, f"{args.output_dir}/{CANDIDATES}", "candidate_entity_ids")
    tsv.write_submission(matches, f"{args.output_dir}/{MATCHES}")
    found = matches.agg(F.count("*").alias("n"), F.sum(F.size("target_ids")).alias("pairs"), F.count_if(F.size("target_ids") == 0).alias("single")).first()
    print(f"{found['n']} records, {found['pairs']} matched pairs, {found['single']} without a match, in {args.output_dir}")
    return True


def profile(spark: SparkSession, args: argparse.Namespace) -> bool:
    every, lists = records(spark, args.data_dir, "train"), truth_lists(spark, args.data_dir)
    pairs = lists.select("s1_id", F.explode("target_ids").alias("target_id"))
    s1, targets = every.where("source = 'S1'"), every.where("source <> 'S1'")
    for title, table in (
        ("rows", I.source_counts(every)),
        ("countries", I.country_distribution(every)),
        ("missing fields", I.missing_rates(every)),
        ("matches per record", I.match_sizes(lists)),
        ("targets of several records", I.shared_targets(pairs)),
        ("matches across countries", I.cross_country_matches(pairs, s1, targets)),
    ):
        print(title)
        table.show(50, truncate=False)
    return True


def validate(spark: SparkSession, args: argparse.Namespace) -> bool:
    s1, targets = sides(spark, args.test_dir, "test")
    passed = I.valid_files(spark, args.matching, args.candidate, s1, targets)
    print("PASS" if passed else "FAIL")
    return passed


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kindred", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for run, options in (
        (train, {"--data-dir": "dataset/train", "--artifact-dir": "artifacts"}),
        (predict, {"--test-dir": "dataset/test", "--artifact-dir": "artifacts", "--output-dir": "output"}),
        (profile, {"--data-dir": "dataset/train"}),
        (validate, {"--matching": f"output/{MATCHES}", "--candidate": f"output/{CANDIDATES}", "--test-dir": "dataset/test"}),
    ):
        command = commands.add_parser(run.__name__)
        command.set_defaults(run=run)
        for name, default in options.items():
            command.add_argument(name, default=default)
        if run in (train, predict):
            command.add_argument("--features", choices=("compact", "full"), default="compact")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"kindred {args.run.__name__}").getOrCreate()
    return 0 if args.run(spark, args) else 1


if __name__ == "__main__":
    sys.exit(main())
