"""Train, save, load and predict on small records, and the streaming wrapper."""

import random

from pyspark.sql import functions as F

from kindred.plans import pipeline
from kindred.streaming.scoring import link_stream

RECORDS = "pos long, eid string, name string, address string, country string"


def tables(spark, n=80):
    r = random.Random(1)
    words = ["w%02d" % i for i in range(60)]
    name = lambda: " ".join(r.sample(words, 4))
    s1 = [(i, f"S1-{i:03d}", name(), f"{i} Main St 100{i:02d}", "us") for i in range(n)]
    targets = [(i, f"S{2 + i % 2}-{i:03d}", s[2] + (" ltd" if i % 3 else ""), s[3], "us") for i, s in enumerate(s1)]
    truth = [(s[1], t[1]) for s, t in zip(s1, targets)]
    return spark.createDataFrame(s1, RECORDS), spark.createDataFrame(targets, RECORDS), spark.createDataFrame(truth, "s1_id string, target_id string")


def test_train_and_predict(spark, tmp_path):
    s1, targets, truth = tables(spark)
    config = pipeline.LinkageConfig(trees={"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 1})
    linkage = pipeline.train(s1, targets, truth, config)
    linkage.save(str(tmp_path))
    again = pipeline.Linkage.load(str(tmp_path), config)
    matches, candidates = pipeline.predict(again, s1, targets)
    right = matches.withColumn("target_id", F.explode("target_ids")).join(truth, ["s1_id", "target_id"]).count()
    assert matches.count() == candidates.count() == 80 and right >= 72


def test_stream(spark, tmp_path):
    s1, targets, _ = tables(spark, 12)
    s1.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s1.schema).parquet(str(tmp_path / "in"))
    link_stream(stream, targets, pipeline.COMPACT, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("s1_id").distinct().count() == 12
