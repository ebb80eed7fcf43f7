"""Cases in which the corpus operators once did less than the whole job."""

import numpy as np
import pytest

from kindred.llm import embed_dedup, html_extract, pii, toxicity


# 2

LONG = "They went down to the shore before the sun rose and stayed until it was dark. " * 4


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>See <a href='/hidden-gems'>hidden gems</a> here.</p><p class='overflow-hidden'>Second part.</p></article>", "See hidden gems here.\nSecond part."),
        ("<article><section id='discussion'><p>We discuss it.</p></section><h2 id='related-work'>Related work</h2><p id='share-prices'>Prices rose.</p></article>", "We discuss it.\nRelated work\nPrices rose."),
        (f"<div class='content no-sidebar'><p>{LONG}</p></div>", LONG.strip()),
        (f"<div class='has-banner'><p>{LONG}</p></div>", LONG.strip()),
        (f"<div class='banner'><p>{LONG}</p></div><p>Short end.</p>", LONG.strip()),
        ("<article><p>Kept.</p><p hidden>Not seen.</p><div style='color:red; display: none'>Nor this.</div><p>End.</p></article>", "Kept.\nEnd."),
        ("<article><p title='display:none' data-x='hidden'>Kept.</p></article>", "Kept."),
    ],
)
def test_names_that_only_look_like_boilerplate(page, text):
    assert html_extract.main_text(page, html_extract.fit_weights()) == text


# 5


@pytest.mark.parametrize("name", ["Lee", "Li", "王伟", "O’Brien", "AC12345"])
@pytest.mark.parametrize("between", [1, 40])
def test_terms_of_any_kind_and_place_disclose(spark, name, between):
    filler = " ".join(["plain today text call"] * between)
    rows = [(i, f"{name} {filler} zed@mail.example") for i in range(6)] + [(i, "plain today text call") for i in range(6, 40)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert clean[0] == f"{'’' if '’' in name else ''} {filler} <EMAIL>" and clean[10] == rows[10][1]


# 9


def test_only_copies_are_left_out():
    shared = b"aa bb cc dd"
    rows = [(shared, b"0", 0), (shared, b"0", 0), (shared, b"0", 1), (shared + b" zz", b"0", 1), *((shared + b" w%d" % i, b"0", 0) for i in range(50))]
    assert toxicity.one_of_each(rows) == rows[:1] + rows[2:]


def test_shouting_counts_over_the_whole_text():
    assert toxicity.pattern_votes("a " * 2500 + "B " * 5000)[0]


# 10


@pytest.mark.parametrize("d, spread", [(32, 1.0), (32, 0.3)])
def test_large_labels_lose_no_link(spark, monkeypatch, d, spread):
    """Pairs a little above the threshold, in groups around centres; the labels are far above ``CELL``."""
    monkeypatch.setattr(embed_dedup, "CELL", 64)
    monkeypatch.setattr(embed_dedup, "BLOCK", 512)
    r = np.random.default_rng(11)
    base = r.normal(size=(20, d))[r.integers(0, 20, 2000)] + spread * r.normal(size=(2000, d))
    side = r.normal(size=base.shape)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    v = np.concatenate((base, 0.9801 * base + np.sqrt(1 - 0.9801**2) * side))
    df = spark.createDataFrame([(i, [float(x) for x in e], 0) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    got = {x["vec_id"]: x["n_links"] for x in embed_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(v))] == want.tolist()
