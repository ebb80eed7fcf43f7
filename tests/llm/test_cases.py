"""Nulls, ties, repeats, empty tables, odd columns and large inputs in small, for every operator and pipeline stage."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from kindred.llm import bpe, embed_dedup, frames, html_extract, jaccard, lines, oracles, packing, pii, substrings, topk, toxicity  # noqa: E402

from test_corpus import corpus, rows_of, same_as_sql, text_rows  # noqa: E402

#: Columns whose names clash with those the operators use, or need quoting.
ODD = "doc_id int, text string, lang string, source string, n_chars long, score double, predicted int, batch_id string, payload string, key int, hashes binary, label int, group int, `a.b` string"


def odd_docs(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, 0.5, 1, "x", None, 3, b"h", None, None, "dot") for d, t in rows], ODD)


REPEATED = [(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (7, None), (7, None), (8, ""), (None, None)]
OPERATORS = {
    "pack": lambda d: packing.pack_documents(d, P.path("byte_bpe_50k.json"), P.PATTERN),
    "round_trip": lambda d: bpe.round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "jaccard": jaccard.near_duplicates,
    "pii": pii.find,
    "substrings": substrings.drop_repeats,
    "lines": lines.drop_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_nulls_and_odd_columns(spark, name):
    got = OPERATORS[name](odd_docs(spark, REPEATED)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in REPEATED)
    if name == "jaccard":
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(5, 2, 5), (None, 2, None), (7, 0, 7), (8, 0, 8), (None, 0, None)}
    assert OPERATORS[name](odd_docs(spark, []).where("false")).count() == 0


KEPT = {"reject": lambda d, labels: toxicity.reject(d, labels), "lines": lambda d, _: lines.drop_repeats(d, keep_columns=True), "jaccard": lambda d, _: jaccard.keep_first(d), "pii": lambda d, _: pii.sanitise(d), "substrings": lambda d, _: substrings.drop_repeats(d, keep_columns=True)}


@pytest.mark.parametrize("name", KEPT)
def test_odd_columns_come_back(spark, name):
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark, [(i, f"text number {i} has w{i} and v{i * 7}") for i in range(20)] + [(90, None), (None, "x")])
    got = KEPT[name](docs, labels)
    assert got.columns == docs.columns and got.schema == docs.schema
    rows = got.collect()
    assert len(rows) == 22 and all(r["score"] == 0.5 and r["a.b"] == "dot" and r["batch_id"] == "x" for r in rows)


# 1


def test_added_tokens_and_special_places(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["hello " + end + " world", end, end + "a", "a" + end, end + end, "x " + end + " " + end + "\n", "<|endof" + end + "text|>", "long word " * 3000 + end]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN).toPandas()
    for i, text in enumerate(texts):
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 1], 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert (p.start, p.ids_crc32) == (at, zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            at += p.length
        assert at == len(ids)


def test_repeated_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 2000, "doc_id long, text string").repartition(2)
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, group_docs=100)
    assert got.count() == 2000 and got.select((F.col("sequence_id") / F.lit(1 << 32)).cast("int")).distinct().count() > 10


# 2


def test_best_run_is_the_best_of_all_runs():
    r = random.Random(3)
    for _ in range(300):
        scores = [r.choice((-3, -1, -0.5, 0, 1, 2.5)) for _ in range(r.randint(0, 25))]
        a, b = html_extract.best_run(scores)
        every = [(sum(scores[i:j]), -i) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)]
        assert sum(scores[a:b]) == pytest.approx(max([0, *(s for s, _ in every)]))


LONG = "They went down to the shore before the sun rose and stayed until it was dark. " * 4


@pytest.mark.parametrize("box", ["div", "section", "table"])
def test_pages_without_content_elements(box):
    inner = f"<h1>Title of it</h1><p>{LONG}</p><p>{LONG}<b>Bold.</b></p>"
    page = f"<nav><a href='/'>Home</a></nav><div class='ad'>buy now</div><{box}>{inner}</{box}><div><ul><li><a href='/x'>Next page</a></li><li><a>Sport</a></li></ul></div><footer>All rights reserved</footer>"
    weights = html_extract.fit_weights()
    assert html_extract.main_text(page, weights) == f"Title of it\n{LONG.strip()}\n{LONG}Bold."
    flat = {k: 1.0 if k.startswith("@") else 0.0 for k in weights}
    assert "Home" in html_extract.main_text(page, flat)


def test_html_empty_table_and_long_page(spark):
    schema = "page_id long, url string, html string"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    page = "<article>" + f"<p>{LONG}</p>" * 3000 + "<div class='comments'>" + "<p>no</p>" * 3000 + "</div><p>End.</p></article>"
    got = html_extract.extract(spark.createDataFrame([(1, "u", page), (1, "u", page)], schema)).collect()
    assert [r["text"] for r in got] == ["\n".join([LONG.strip()] * 3000 + ["End."])] * 2


# 4 to 7: the exchange of hashes


@pytest.fixture
def tiny_parts(monkeypatch):
    """An exchange in several steps already for a small table."""
    monkeypatch.setattr(frames, "FAN_BITS", 2)
    monkeypatch.setattr(frames, "BATCH_BYTES", 1 << 11)
    monkeypatch.setattr(frames.pack, "__defaults__", (1 << 11, None))
    for module in (jaccard, lines, pii, substrings):
        monkeypatch.setattr(module, "part_bits", lambda df: 7)


def test_exchange_in_several_steps(spark, tiny_parts):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, batch_id string").repartition(3)
    same_as_sql(substrings.drop_repeats(docs), oracles.SUBSTRING_DEDUP, documents=text_rows())
    same_as_sql(lines.drop_repeats(docs), oracles.LINE_DEDUP, documents=text_rows())
    assert rows_of(pii.find(docs.select("doc_id", "text"))) == rows_of(pii.find(docs.select("doc_id", "text").coalesce(1)))


def test_rows_sent_grow_with_the_input(spark, monkeypatch):
    """Rows of the first step: a batch sends one for each part that it has hashes of, and there are few parts."""
    hashes = np.sort(frames.mixed(np.arange(1, 200_001, dtype=np.uint64)))
    sent = {bits: sum(1 for _ in frames.send(1, bits, hashes)) for bits in (8, 12, 20)}
    assert sent == {8: 256, 12: 256, 20: 256}


def test_answers_for_other_rows_are_refused():
    with pytest.raises(RuntimeError):
        frames.received(None, bool, 3)
    assert len(frames.received(None, bool, 0)) == 0


def test_clean_documents_are_not_packed(spark):
    docs = spark.createDataFrame([(i, f"only here number {i}\nand a line of {i * i + 1000}") for i in range(50)] + [(100, "a line that is twice"), (101, "a line that is twice")], "doc_id long, text string")
    got = rows_of(lines.drop_repeats(docs))
    assert got[101][2] == 1 and sum(r[2] for r in got.values()) == 1 and len(got) == 52


# 8


@pytest.mark.parametrize("decay, most", [(1.0, 0.25), (0.8, 0.05)])
def test_share_of_scored_pairs(decay, most):
    """Evenly spread vectors, and ones whose spread falls from axis to axis."""
    r = np.random.default_rng(5)
    turn = np.linalg.qr(r.normal(size=(32, 32)))[0]
    v = np.floor(256 * (r.normal(size=(4000, 32)) * decay ** np.arange(32)) @ turn).astype(np.int64)
    block = topk.Block(np.arange(4000), v, int(np.abs(v).max()))
    for q in range(0, 4000, 100):
        ids, scores = block.search(q, v[q], 5)
        want = sorted((-int(v[q] @ v[c]), c) for c in range(4000) if c != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want
    assert block.scored < most * 40 * 4000


def test_top_k_with_large_integers():
    r = np.random.default_rng(6)
    v = r.integers(-(1 << 29), 1 << 29, (200, 6))
    block = topk.Block(np.arange(200), v, int(np.abs(v).max()))
    assert block.kind is np.int64
    ids, scores = block.search(3, v[3], 4)
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == sorted((-int(v[3] @ v[c]), c) for c in range(200) if c != 3)[:4]


# 9


def test_label_model_recovers_planted_rates():
    """Voters of known rates, two of which repeat a third; the given start is wrong in a tenth of the rows."""
    r = np.random.default_rng(7)
    n, y = 20000, None
    y = r.random(n) < 0.3
    yes, no = np.linspace(0.5, 0.9, 8), np.linspace(0.02, 0.2, 8)
    votes = (r.random((n, 8)) < np.where(y[:, None], yes, no)).astype(float)
    copies = np.where(r.random((n, 2)) < 0.95, votes[:, [0]], 1 - votes[:, [0]])
    votes = np.column_stack((votes, copies))
    start = np.where(y ^ (r.random(n) < 0.1), 0.95, 0.05)
    start[5000:] = np.nan
    model = toxicity.LabelModel.fit(votes, start)
    p = model.posterior(votes)
    assert model.prior == pytest.approx(0.3, abs=0.02) and ((p > 0.5) == y).mean() > 0.97
    for i in range(8):
        assert (p @ votes[:, i]) / p.sum() == pytest.approx(yes[i], abs=0.03) and ((1 - p) @ votes[:, i]) / (1 - p).sum() == pytest.approx(no[i], abs=0.03)
    # the repeating voters form one branch of the tree
    family = {0, 8, 9}
    assert sum(int(model.parent[i]) in family for i in family) == 2


def test_toxicity_empty_and_repeated(spark):
    docs = odd_docs(spark, REPEATED)
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, 0), (None, 1, 1), (9, None, 5)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(REPEATED) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(docs.where("false"), labels).count() == 0 and toxicity.classify(docs, labels.where("false")).count() == len(REPEATED)


# 10


def test_ties_at_the_threshold(spark):
    """Cosines a little above and below 0.98 and, with whole numbers, at it."""
    def at(c):
        return [c, math.sqrt(1 - c * c), 0.0]

    rows = [(0, [1.0, 0.0, 0.0]), (1, at(0.980001)), (2, at(0.979999)), (3, [49.0, 0.0, math.sqrt(99)])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    u = np.array([v for _, v in rows])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df).collect()}
    exact = (u @ u.T >= 0.98).sum(1) - 1
    assert got == {i: int(n) for i, n in enumerate(exact)} and got[0] >= 1


# the pipeline


def sf_folder(spark, path, rows):
    r = random.Random(1)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "more") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{path}/documents.parquet")
    known = [(d, r.randint(0, 5), int("vermin" in (t or "") or "scumbag" in (t or ""))) for d, t in rows if d is not None]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def made_documents():
    r = random.Random(11)
    words = ["".join(r.choices(["the", "an", "er", "ou", "in"], k=3)) for _ in range(300)]
    text = lambda k: " ".join(r.choices(words, k=k))
    rows = [(i, text(60)) for i in range(400)]
    toxic = set(range(0, 400, 8))
    rows = [(i, t + " you scumbag vermin" if i in toxic else t) for i, t in rows]
    line = "this very line stands in several documents"
    rows += [(500, "first\n" + line + "\n" + text(30)), (501, text(30) + "\n" + line), (502, rows[1][1]), (503, rows[1][1].rsplit(" ", 1)[0] + " changed"), (504, None), (505, ""), (506, "write to a.b@mail.example now " + text(20)), (506, "write to a.b@mail.example now " + text(20)), (None, text(20))]
    return rows, toxic, line


def test_stages_one_by_one(spark, tmp_path):
    rows, toxic, line = made_documents()
    sf = sf_folder(spark, tmp_path / "in", rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        was, columns = docs.collect(), docs.columns
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        got = out.collect()
        ids = {r["doc_id"] for r in got}
        if name != "packing":
            assert out.columns == columns and all(r["n_chars"] == len(r["text"] or "") for r in got)
        if name == "toxicity":
            assert not any("scumbag" in (r["text"] or "") for r in got) and len(got) == len(was) - len(toxic)
        if name == "line_dedup":
            assert sum(line in (r["text"] or "") for r in got) == 1 and len(got) == len(was)
        if name == "jaccard_join":
            assert 503 not in ids and {1, 502, 504, 505, 506, None} <= ids  # all of 502 went as a repeated line
        if name == "pii":
            assert not any("a.b@mail" in (r["text"] or "") for r in got) and len(got) == len(was) and any(r["text"] is None for r in got)
        if name == "packing":
            assert sum(r["start"] == 0 for r in got) == len(was) and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
        docs = out


def test_whole_pipeline_and_empty_table(spark, tmp_path):
    rows, toxic, _ = made_documents()
    got = corpus_pipeline.run(spark, sf_folder(spark, tmp_path / "a", rows)).collect()
    assert sum(r["start"] == 0 for r in got) == len(rows) - len(toxic) - 1
    assert corpus_pipeline.run(spark, sf_folder(spark, tmp_path / "b", [])).count() == 0


# 5: terms


def test_terms_by_plain_counts(spark):
    """The disclosing terms against document counts by plain loops."""
    import re

    r = random.Random(21)
    names = ["Anna", "Bo", "李雷", "X12", "kim", "of", "street", "river", "hill", "green"]
    mails = ["a@x.example", "b@y.example", "+1 234 567 8901", "10.0.0.1"]
    rows = []
    for i in range(120):
        parts = r.choices(names[4:], k=r.randint(2, 6)) + ["common"]
        if r.random() < 0.5:
            k = r.randrange(4)
            parts += [mails[k]] + ([names[k]] if r.random() < 0.8 else [])
        r.shuffle(parts)
        rows.append((i, " ".join(parts)))
    words = lambda t: {w.lower() for w in re.findall(r"[^\W_]+", t)}
    base = {i: pii.base_spans(t) for i, t in rows}
    value = {i: {t[a:b] for _, a, b in base[i]} for i, t in rows}
    df_term, df_value, both = Counter(), Counter(), Counter()
    free = {}
    for i, t in rows:
        rest = t
        for _, a, b in base[i]:
            rest = rest[:a] + " " * (b - a) + rest[b:]
        free[i] = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+", rest) if len(m[0]) >= 3 or not (m[0].isascii() and m[0].islower())]
        df_term.update(words(t))
        df_value.update(value[i])
        both.update({(w.lower(), v) for w, _, _ in free[i] for v in value[i]})
    n = len(rows)
    told = {(w, v) for (w, v), c in both.items() if c >= 3 and df_value[v] >= 3 and math.log(c * n / (df_term[w] * df_value[v])) >= math.log(n / df_value[v]) / 1.25 - 1e-12}
    want = {i: pii.listed(sorted([*base[i], *(("term", a, b) for w, a, b in free[i] if any((w.lower(), v) in told for v in value[i]))], key=lambda s: (s[1], pii.KINDS.index(s[0])))) for i, _ in rows}
    got = {x["doc_id"]: x["spans"] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and sum("term" in s for s in got.values()) > 20
