"""Unique assignment of targets, threshold sweep, and F0.5.

Only targets are exclusive, so taking pairs greedily by probability equals taking each target's best pair. Nor
does the threshold change who wins a target, so a sweep computes the winners once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winners(scored: DataFrame, *ties: str) -> DataFrame:
    """Each target's best pair by ``p``, then the ``ties`` (``s1_id`` by default)."""
    best = Window.partitionBy("target_id").orderBy(F.desc("p"), *(ties or ("s1_id",)))
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def accepted(scored: DataFrame, threshold: float, targets: DataFrame | None = None) -> DataFrame:
    """Pairs with ``p >= threshold`` whose target exists."""
    kept = scored.where(F.col("p") >= threshold)
    return kept if targets is None else kept.join(targets.select(F.col("eid").alias("target_id")).distinct(), "target_id", "left_semi")


def match_lists(won: DataFrame) -> DataFrame:
    """``(s1_id, target_ids)`` with each record's targets by falling ``p``, then id."""
    return won.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("np"), "target_id"))), lambda x: x["target_id"]).alias("target_ids"))


def assign(s1: DataFrame, scored: DataFrame, *ties: str) -> DataFrame:
    """One row per S1 record with its targets; a winner that is no S1 record keeps its target from others."""
    return s1.select(F.col("eid").alias("s1_id")).join(match_lists(winners(scored, *ties)), "s1_id", "left").select("s1_id", F.coalesce("target_ids", F.array().cast("array<string>")).alias("target_ids"))


def subset_violations(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that are no candidates."""
    return matches.select("s1_id", "target_id").join(candidates.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")


def require_subset(matches: DataFrame, candidates: DataFrame) -> None:
    if bad := subset_violations(matches, candidates).limit(1).collect():
        raise ValueError(f"a match is no candidate: {bad[0]}")


def f05(predicted: Column, true: Column, hits: Column) -> Column:
    """F0.5 of one record from its counts; a record without true matches scores 1 if nothing was predicted."""
    precision, recall = hits / predicted, hits / true
    return (
        F.when(true == 0, F.when(predicted == 0, 1.0).otherwise(0.0))
        .when((predicted == 0) | (hits == 0), 0.0)
        .otherwise(1.25 * precision * recall / (0.25 * precision + recall))
    )


def entity_f05(ids: DataFrame, truth: DataFrame, predictions: DataFrame, *more: str) -> DataFrame:
    """``(s1_id, n_predicted, n_true, n_hits, f05)`` for every ``s1_id`` of ``ids``, for each value of ``more`` columns in it."""
    keys = ["s1_id", *more]
    t = truth.where("target_id <> ''").select("s1_id", "target_id").distinct()
    p = predictions.where("target_id <> ''").select(*keys, "target_id").distinct()
    n_true = t.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    n_pred = p.join(t.withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left").groupBy(*keys).agg(F.count("*").alias("n_predicted"), F.count("hit").alias("n_hits"))
    out = ids.select(*keys).join(n_true, "s1_id", "left").join(n_pred, keys, "left").na.fill(0, ["n_true", "n_predicted", "n_hits"])
    return out.withColumn("f05", f05(F.col("n_predicted"), F.col("n_true"), F.col("n_hits")))


def macro_f05(ids: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return entity_f05(ids, truth, predictions).agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.count("*").alias("entities"))


def require_truth(ids: DataFrame) -> None:
    if not ids.limit(1).count():
        raise ValueError("ground truth is empty")


def grid(start: float = 0.20, stop: float = 0.84, step: float = 0.02) -> list[float]:
    return [round(start + step * i, 2) for i in range(int(round((stop - start) / step)) + 1)]


def threshold_sweep(ids: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``(tau, macro_f05)`` for each threshold in one job; the grid is a short list of constants."""
    taus = F.array(*map(F.lit, thresholds))
    won = winners(scored).withColumn("tau", F.explode(F.filter(taus, lambda t: F.col("p") >= t)))
    everyone = ids.withColumn("tau", F.explode(taus))
    return entity_f05(everyone, truth, won, "tau").groupBy("tau").agg(F.round(F.avg("f05"), 6).alias("macro_f05"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the highest score."""
    return sweep.agg(F.max_by("tau", F.struct("macro_f05", -F.col("tau"))).alias("best_tau"), F.max("macro_f05").alias("best_f05"))
