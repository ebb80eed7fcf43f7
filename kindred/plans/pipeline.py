"""End-to-end plans: train on labelled records, then predict, for the compact and the full feature set.

Records are ``pos, eid, name, address, country``; truth is ``(s1_id, target_id)``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import entities as E
from kindred.functions import tokens as T
from kindred.operators import assignment as A
from kindred.operators import blocking as B
from kindred.operators import features as P
from kindred.operators import models as M


@dataclass(frozen=True)
class LinkageConfig:
    """Which blocking, features, model and thresholds a run uses."""

    features: str = "compact"
    top_k: int = B.TOP_K
    max_posting: int = B.MAX_POSTING
    alpha: float = B.ALPHA
    least_score: float = 0.05
    thresholds: tuple[float, ...] = tuple(A.grid())
    trees: dict = field(default_factory=lambda: dict(M.COMPACT_TREES))
    calibrate: bool = True


COMPACT = LinkageConfig()
FULL = LinkageConfig(features="full", top_k=40, thresholds=tuple(round(0.2 + 0.05 * i, 2) for i in range(14)), trees={}, calibrate=False)


@dataclass
class Linkage:
    """A fitted run: the model, the points of its calibration, and the threshold."""

    config: LinkageConfig
    model: M.Trees
    points: list[tuple[float, float]] | None
    threshold: float

    def save(self, path: str) -> None:
        Path(path).mkdir(parents=True, exist_ok=True)
        exported = M.export_ensemble(self.model, self.model.features, self.threshold) | {"features": self.model.features}
        Path(path, "model_parameters.json").write_text(json.dumps(exported), encoding="utf-8")
        side = {"threshold": self.threshold, "points": self.points, "features": self.config.features, "top_k": self.config.top_k}
        Path(path, "metadata.json").write_text(json.dumps(side), encoding="utf-8")

    @classmethod
    def load(cls, path: str, config: LinkageConfig) -> Linkage:
        if not Path(path, "metadata.json").exists():
            raise FileNotFoundError(f"no model in {path}")
        side = json.loads(Path(path, "metadata.json").read_text(encoding="utf-8"))
        ensemble = M.load_ensemble(Path(path, "model_parameters.json"))
        return cls(config, M.Trees(ensemble["features"], ensemble), side["points"], side["threshold"])


def candidates(s1: DataFrame, targets: DataFrame, config: LinkageConfig, prune: bool = True) -> DataFrame:
    """Candidate pairs; pruning by the best score is for prediction only."""
    if config.features == "compact":
        tokens = lambda d: d.withColumn("tokens", T.block_tokens(F.col("name"), F.col("address")))
        return B.idf_candidates(tokens(s1), tokens(targets), config.top_k, config.max_posting, config.alpha if prune else None)
    texts = lambda d: d.select("eid", E.normalize_country(F.col("country")).alias("country"), "name", "address").select(
        "eid", "country", E.parse_name(F.col("name"), F.col("country"))["core_name"].alias("core"), F.trim(F.concat_ws(" ", "name", "address")).alias("full_text")
    )
    return B.tfidf_candidates(texts(s1), texts(targets), "core", "full_text", config.top_k, config.least_score)


def features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, config: LinkageConfig) -> DataFrame:
    return P.compact_features(pairs, s1, targets) if config.features == "compact" else P.full_features(pairs, s1, targets)


def with_label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    known = truth.select("s1_id", "target_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(known, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def train(s1: DataFrame, targets: DataFrame, truth: DataFrame, config: LinkageConfig = COMPACT) -> Linkage:
    """Fit on 70 % of the S1 records, calibrate on 15 %, and choose the threshold on 15 %, dealt by a hash of their ids."""
    dealt = M.hash_percent(F.col("s1_id"))
    made = with_label(features(candidates(s1, targets, config, prune=False), s1, targets, config), truth).withColumn("deal", dealt)
    columns = list(P.COMPACT if config.features == "compact" else P.FULL)
    model = M.fit_trees(made.where("deal < 70"), columns, **config.trees)
    held = M.probabilities(model, made.where("deal >= 70"))
    points = M.isotonic_points(M.fit_isotonic(held.where("deal < 85"))) if config.calibrate else None
    tuned = held.where("deal >= 85")
    if points:
        tuned = tuned.withColumn("p", M.calibrated(F.col("p"), points))
    ids = s1.select(F.col("eid").alias("s1_id")).where(M.hash_percent(F.col("s1_id")) >= 85)
    A.require_truth(ids)
    best = A.best_threshold(A.threshold_sweep(ids, truth, tuned, list(config.thresholds))).first()
    return Linkage(config, model, points, best["best_tau"])


def predict(linkage: Linkage, s1: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(matches, candidates)``: a list of targets for every S1 record, a subset of its candidates by construction."""
    config = linkage.config
    pairs = candidates(s1, targets, config)
    scored = M.probabilities(linkage.model, features(pairs, s1, targets, config))
    if linkage.points:
        scored = scored.withColumn("p", M.calibrated(F.col("p"), linkage.points))
    kept = A.accepted(scored, linkage.threshold)
    everyone = s1.select(F.col("eid").alias("s1_id"))
    ranked = pairs.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_rank", "target_id"))), lambda x: x["target_id"]).alias("target_ids"))
    lists = everyone.join(ranked, "s1_id", "left").select("s1_id", F.coalesce("target_ids", F.array().cast("array<string>")).alias("target_ids"))
    return A.assign(s1, kept), lists
