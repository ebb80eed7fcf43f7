"""Sources, blocking, features, decisions, metrics, models and validation on small tables."""

import math
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import dictionaries as D
from kindred.functions import tokens as T
from kindred.operators import assignment as A
from kindred.operators import blocking as B
from kindred.operators import features as P
from kindred.operators import inspection as I
from kindred.operators import models as M
from kindred.sources import tsv


def test_read_and_write(spark, tmp_path):
    path = tmp_path / "source.tsv"
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t\tNULL\n", encoding="utf-8")
    assert [tuple(r) for r in tsv.read_tsv(spark, str(path)).collect()] == [("S1-1", "NA", "", "NULL")]
    with pytest.raises(Exception):
        tsv.read_tsv(spark, str(tmp_path / "none.tsv")).collect()
    truth = tsv.parse_truth(spark.createDataFrame([("S1-1", "S2-47, S3-812,"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string"))
    assert {r["s1_id"]: r["target_ids"] for r in truth.collect()} == {"S1-1": ["S2-47", "S3-812"], "S1-2": []}
    with pytest.raises(ValueError):
        tsv.parse_truth(spark.createDataFrame([("x",)], "a string"))
    tsv.write_submission(truth, str(tmp_path / "out"))
    lines = sorted(x for f in (tmp_path / "out").glob("part*") for x in f.read_text().splitlines())
    assert "S1-1\tS2-47,S3-812" in lines and "S1-2\t" in lines


def test_tolerant_lines(spark):
    lines = spark.createDataFrame([("a\tb\tc\td",), ("a\tb",), ("a\t\t\t\te",), ("",)], "value string")
    assert sorted(tuple(r) for r in tsv.split_tolerant(lines).collect()) == [("a", "", "", ""), ("a", "b", "c", "d")]
    assert tuple(tsv.count_malformed(lines).first()) == (2, 4)


def test_suffix_order():
    assert D.suffixes_for("in")[:6] == ["private limited", "pvt ltd", "limited", "pvt", "ltd", "llp"]
    assert "no" not in D.ABBREVIATIONS["global"]


def test_dictionaries_from_files(tmp_path):
    (tmp_path / "xx.yaml").write_text("address_abbreviations:\n  st: street\n  no: number\n")
    (tmp_path / "bad.yaml").write_text(":\n  - [")
    found = D.load_dictionaries(str(tmp_path))
    assert found["xx"]["st"] == "street" and "no" not in found["xx"] and "global" in found and "bad" not in found


RECORDS = "pos long, eid string, country string, name string, address string"


def test_blocking_against_loop(spark):
    names = ["blue moon cafe", "blue river bank", "moon river cafe", "green bank", "blue blue moon", ""]
    s1 = [(i, f"S1-{i}", "x", n, "") for i, n in enumerate(names)]
    targets = [(i, f"S2-{i}", "x" if i < 5 else "y", n, "") for i, n in enumerate(names[::-1])]
    side = lambda rows: spark.createDataFrame(rows, RECORDS).withColumn("tokens", T.block_tokens(F.col("name"), F.col("address")))
    got = {(r["s1_id"], r["target_id"]): (r["score"], r["cand_rank"]) for r in B.idf_candidates(side(s1), side(targets), k=2, most=3, alpha=0.3).collect()}
    toks = lambda n: [w for w in n.split() if len(w) >= 3]
    mine = [t for t in targets if t[2] == "x"]
    index = defaultdict(list)
    for t in mine:
        for w in set(toks(t[3])):
            index[w].append(t)
    want = {}
    for s in s1:
        score = defaultdict(float)
        for w in toks(s[3]):
            if w in index and len(index[w]) <= 3:
                for t in index[w]:
                    score[t[0], t[1]] += math.log(len(mine) / (len(index[w]) + 1))
        top = sorted(((round(v, 9), k) for k, v in score.items()), key=lambda x: (-x[0], x[1]))[:2]
        for rank, (v, (_, tid)) in enumerate(top):
            if v >= 0.3 * top[0][0]:
                want[s[1], tid] = (v, rank)
    assert got == want


def test_one_target_has_no_vocabulary(spark):
    s1 = spark.createDataFrame([(0, "S1-0", "x", "blue moon", "")], RECORDS)
    one = spark.createDataFrame([(0, "S2-0", "x", "blue moon", "")], RECORDS)
    assert B.tfidf_candidates(s1, one, "name", "address").count() == 0
    assert B.blocking_recall(one.select("eid", F.col("eid").alias("target_id")).where("false").withColumnRenamed("eid", "s1_id"), spark.createDataFrame([], "s1_id string, target_id string")).first()["pair_recall"] == 1.0


def test_compact_goldens(spark):
    s1 = spark.createDataFrame([("a", "Acme Supplies Pvt Ltd", "Plot 42, MG Road 560001"), ("b", "A", "")], "eid string, name string, address string")
    t = spark.createDataFrame([("c", "ACME Supply", "42 M.G. Road, Bengaluru 560001"), ("d", "A", "x 4B")], "eid string, name string, address string")
    pairs = spark.createDataFrame([("a", "c", 0.5, math.e - 1), ("b", "d", 0.0, math.e - 1)], "s1_id string, target_id string, score double, n_targets double")
    got = {r["s1_id"]: [r[c] for c in P.COMPACT] for r in P.compact_features(pairs, s1, t).collect()}
    assert got["a"] == pytest.approx([0.2, 0.428571, 0.4, 0.909091, 0.545455, 0.25, 0.375, 0.324324, 0.195122, 1, 0, 0.307692, 0.262295, 0.5], abs=1e-6)
    assert got["b"] == pytest.approx([1, 0, 0, 1, 1, 1, 0, 0, 0, 0, 1, 0.333333, 0, 0], abs=1e-6)


SCORED = "s1_id string, target_id string, p double"


def test_assignment(spark):
    s1 = spark.createDataFrame([("S1-001",), ("S1-002",), ("S1-003",)], "eid string")
    scored = spark.createDataFrame([("S1-001", "S2-999", 0.9), ("S1-002", "S2-999", 0.7), ("S1-002", "S3-111", 0.6)], SCORED)
    assert {r["s1_id"]: r["target_ids"] for r in A.assign(s1, scored).collect()} == {"S1-001": ["S2-999"], "S1-002": ["S3-111"], "S1-003": []}
    with pytest.raises(ValueError):
        A.require_subset(scored, scored.where("p > 0.6"))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.sampled_from([0.2, 0.5, 0.6, 0.9])), min_size=1, max_size=40, unique_by=lambda x: x[:2]))
def test_greedy_and_sweep_against_loops(spark, rows):
    rows = [(f"S1-{a}", f"S2-{b}", p) for a, b, p in rows]
    scored = spark.createDataFrame(rows, SCORED)
    ids = spark.createDataFrame([(f"S1-{a}",) for a in range(5)], "s1_id string")
    truth = spark.createDataFrame([(f"S1-{b % 4}", f"S2-{b}") for b in range(5)], "s1_id string, target_id string")
    true = defaultdict(set)
    for b in range(5):
        true[f"S1-{b % 4}"].add(f"S2-{b}")

    def greedy(tau):
        taken, out = set(), defaultdict(set)
        for s, t, p in sorted((r for r in rows if r[2] >= tau), key=lambda r: (-r[2], r[0], r[1])):
            if t not in taken:
                taken.add(t)
                out[s].add(t)
        return out

    def f05(pred, want):
        if not want:
            return float(not pred)
        hits = len(pred & want)
        if not hits:
            return 0.0
        p, r = hits / len(pred), hits / len(want)
        return 1.25 * p * r / (0.25 * p + r)

    got = defaultdict(set)
    for r in A.winners(scored).collect():
        got[r["s1_id"]].add(r["target_id"])
    assert got == greedy(0)
    sweep = {r["tau"]: r["macro_f05"] for r in A.threshold_sweep(ids, truth, scored, [0.3, 0.55, 0.7]).collect()}
    for tau, value in sweep.items():
        out = greedy(tau)
        assert value == pytest.approx(sum(f05(out[f"S1-{a}"], true[f"S1-{a}"]) for a in range(5)) / 5, abs=1e-6)


def test_metric(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    truth = spark.createDataFrame([("a", "S2-00047"), ("a", "S3-00812"), ("c", "S2-1")], "s1_id string, target_id string")
    pred = spark.createDataFrame([("a", "S2-00047"), ("a", "S2-00193"), ("a", "S3-00812")], "s1_id string, target_id string")
    assert A.macro_f05(ids, truth, pred).first()["macro_f05"] == pytest.approx((5 / 7 + 1 + 0) / 3, abs=1e-6)
    with pytest.raises(ValueError):
        A.require_truth(ids.where("false"))


def test_submission(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "eid string")
    targets = spark.createDataFrame([("S2-1",), ("S3-1",)], "eid string")
    rows = lambda *x: spark.createDataFrame(list(x), "s1_id string, target_ids string")
    candidates = rows(("S1-1", "S2-1,S3-1"), ("S1-2", ""))
    assert I.verdict(I.submission_issues(rows(("S1-1", "S2-1"), ("S1-2", "")), candidates, s1, targets))
    bad = I.submission_issues(rows(("S1-1", "S2-1,S2-1,S1-2,S2-9"), ("S1-1", ""), ("", "x"), ("S1-7", "")), candidates, s1, targets)
    assert {r["rule"] for r in bad.collect()} == {"duplicate_target", "self_match", "unknown_target", "not_a_candidate", "duplicate_row", "empty_id", "unknown_s1", "missing_s1"}
    assert I.header_issue("x", "matches") and not I.header_issue(I.EXPECTED["matches"], "matches")


ENSEMBLE = {
    "baseline_prediction": 0.1,
    "trees": [
        {
            "iter": 0,
            "nodes": [
                {"id": 0, "is_leaf": False, "val": 0, "feat": 0, "th": 0.5, "left": 1, "right": 2, "miss_left": True},
                {"id": 1, "is_leaf": True, "val": -1.0},
                {"id": 2, "is_leaf": False, "val": 0, "feat": 1, "th": 0.25, "left": 3, "right": 4, "miss_left": False},
                {"id": 3, "is_leaf": True, "val": 0.4},
                {"id": 4, "is_leaf": True, "val": 1.5},
            ],
        }
    ],
}


def test_trees(spark):
    nan = float("nan")
    rows = spark.createDataFrame([([0.4, 0.1],), ([0.6, 0.25],), ([0.6, 0.3],), ([nan, 0.9],), ([0.9, nan],)], "x array<double>")
    got = rows.select(M.raw_score(ENSEMBLE, F.col("x")).alias("a"), M.score_batches(ENSEMBLE)(F.col("x")).alias("b"))
    assert [r["a"] for r in got.collect()] == pytest.approx([-0.9, 0.5, 1.6, -0.9, 1.6])
    M.require_parity(got, "a", "b")


def test_export_matches_model(spark):
    rows = [(float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(200)]
    data = spark.createDataFrame(rows, "f0 double, f1 double, label int")
    model = M.fit_trees(data, ["f0", "f1"], maxIter=3, maxDepth=2)
    ensemble = M.export_ensemble(model, ["f0", "f1"], 0.5)
    both = M.probabilities(model, data).withColumn("q", M.sigmoid(M.raw_score(ensemble, F.array("f0", "f1"))))
    M.require_parity(both, "p", "q")
    assert both.where("label = 1").agg(F.min("p")).first()[0] > 0.5
    with pytest.raises(RuntimeError):
        M.probabilities(None, data)


def test_isotonic(spark):
    data = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.5, 1), (0.9, 1)], "p double, label int")
    model = M.fit_isotonic(data)
    points = M.isotonic_points(model)
    asked = spark.createDataFrame([(0.0,), (0.15,), (0.4,), (2.0,)], "p double")
    assert [r[0] for r in asked.select(M.calibrated(F.col("p"), points)).collect()] == pytest.approx([0, 0.25, 0.75, 1])
    assert [r["prediction"] for r in model.transform(asked).collect()] == pytest.approx([0, 0.25, 0.75, 1])


def test_boosting_fits_and_bounds(spark):
    """Trees of the full parameters separate two moons' worth of rows, mind missing values, and keep leaves large enough."""
    import numpy as np

    from kindred.operators import boosting

    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    x[r.random(x.shape) < 0.1] = np.nan
    y = ((np.nan_to_num(x[:, 0]) ** 2 + np.nan_to_num(x[:, 1]) > 1) ^ np.isnan(x[:, 2])).astype(float)
    for params, least in ((M.FULL_TREES, 0.93), (M.FULL_TREES | M.COMPACT_TREES, 0.93)):
        s = boosting.Settings(params["maxIter"] // 2, params["stepSize"], params["maxDepth"], params["maxLeaves"], params["minInstancesPerNode"], params["l2"], params["maxBins"])
        ensemble = boosting.fit(x[:2000], y[:2000], s)
        nodes = [n for t in ensemble["trees"] for n in t["nodes"]]
        leaves = [n for n in nodes if n["is_leaf"]]
        assert min(n["cnt"] for n in leaves) >= 20 and max(sum(n["is_leaf"] for n in t["nodes"]) for t in ensemble["trees"]) <= 31
        held = spark.createDataFrame([(row.tolist(), float(label)) for row, label in zip(x[2000:], y[2000:])], "x array<double>, y double")
        p = [(r["p"], r["y"]) for r in held.select(M.sigmoid(M.score_batches(ensemble)(F.col("x"))).alias("p"), "y").collect()]
        assert np.mean([(a >= 0.5) == (b == 1) for a, b in p]) >= least


def test_parsing_with_own_dictionaries(spark, tmp_path):
    from kindred.functions import entities as E

    (tmp_path / "xx.yaml").write_text("address_abbreviations:\n  zz: zigzag\nlegal_suffixes:\n  - oyj\n")
    row = spark.range(1)
    ask = lambda: row.select(E.parse_name(F.lit("Acme Oyj"), F.lit("xx"))["legal_suffix"].alias("s"), E.parse_address(F.lit("1 zz st"), F.lit("xx"))["expanded_address"].alias("a"))
    before = dict(D.ABBREVIATIONS)
    with D.using(str(tmp_path)):
        inside = ask()
    assert tuple(inside.first()) == ("oyj", "1 zigzag street") and tuple(ask().first()) == ("", "1 zz street") and before == D.ABBREVIATIONS
