"""Golden values of text, names, addresses, sounds and similarities, and native expressions against plain Python."""

import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import entities as E
from kindred.functions import text as X
from kindred.functions import tokens as T


def values(spark, rows, *columns, schema="a string, b string"):
    return [tuple(r) for r in spark.createDataFrame([(*r, None)[:2] if len(r) < 2 else r for r in rows], schema).select(*columns).collect()]


def test_clean_text(spark):
    cases = {
        "U.S.A. Inc.": "usa inc", "J.P. Morgan + Co": "jp morgan and co", "info@acme": "info at acme", "a_b-c": "a_b c",
        "Café & Bistrot de l'Étoile": "cafe and bistrot de l etoile", "": "", None: "", "Ünïted   ½": "united 1 2",
    }
    assert [x for (x,) in values(spark, [(k,) for k in cases], X.clean_text(F.col("a")))] == list(cases.values())


def test_country(spark):
    names = ["USA", "United States", "India", "France", "Germany", None]
    assert [x for (x,) in values(spark, [(n,) for n in names], E.normalize_country(F.col("a")))] == ["us", "us", "in", "fr", "germany", ""]


def test_names(spark):
    rows = [("Acme Corp Ltd", "us"), ("Pvt Ltd", "in"), ("LLC", "us"), ("Foo Private Limited", ""), ("Foo Pvt Ltd", "us"), ("Bar GmbH", "de"), ("Acme Supplies Pvt Ltd", "in"), ("Dupont Consulting SARL", "fr")]
    parsed = E.parse_name(F.col("a"), F.col("b"))
    got = values(spark, rows, parsed["core_name"], parsed["legal_suffix"])
    assert got == [("acme corp", "ltd"), ("pvt", "ltd"), ("llc", ""), ("foo private", "limited"), ("foo pvt", "ltd"), ("bar gmbh", ""), ("acme supplies", "pvt ltd"), ("dupont consulting", "sarl")]
    (variants,) = values(spark, [("Acme Corporation d/b/a Fast Delivery Services",)], E.dba_variants(F.col("a")))[0]
    assert variants == ["acme corporation", "fast delivery services"]


def test_addresses(spark):
    rows = [("123 Main St., Apt 4B, New York, NY 10001", "us"), ("Plot 42, Opp SBI Bank, Near Bus Stand, Bengaluru 560001", "in"), ("rue x 75001", "in"), ("012345 x", "in"), ("x 75001 560001", "de"), ("", "us")]
    a = E.parse_address(F.col("a"), F.col("b"))
    got = values(spark, rows, a["postal_code"], a["expanded_address"], a["landmarks"])
    assert [g[0] for g in got] == ["10001", "560001", "75001", "", "560001", ""]
    assert "street" in got[0][1] and "apartment" in got[0][1]
    assert got[1][2] == ["opp sbi bank near bus stand bengaluru 560001"]


def test_sound(spark):
    words = ["Robert", "Rupert", "Ashcraft", "", "4Tech", None]
    got = [x for (x,) in values(spark, [(w,) for w in words], E.sound(F.col("a")))]
    assert got == ["R163", "R163", "A226", "", "T200", ""]


@pytest.mark.parametrize(
    "a, b, ratio, in_order, as_set",
    [
        ("acme supplies", "acme supply", 0.833333, 0.833333, 0.833333),
        ("state bank of india", "sbi", 0.272727, 0.181818, 0.181818),
        ("blue moon cafe", "cafe blue moon", 0.642857, 1, 1),
        ("", "", 1, 1, 0),
    ],
)
def test_ratios(spark, a, b, ratio, in_order, as_set):
    x, y = F.col("a"), F.col("b")
    got = values(spark, [(a, b)], T.matching_ratio(x, y), T.token_sort_ratio(x, y), T.token_set_ratio(x, y))[0]
    assert got == pytest.approx((ratio, in_order, as_set), abs=1e-6)


def plain_clean(text):
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    t = re.sub(r"[&+]|\band\b", " and ", t).replace("@", " at ")
    t = re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", t)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t)).strip()


def plain_grams(t, n):
    t = t.lower()
    return {t[i : i + n] for i in range(len(t) - n + 1)}


texts = st.lists(st.text(st.sampled_from("aAbBzé ïÖ.&+@-_'1x9 \t"), max_size=18), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts, texts)
def test_against_python(spark, left, right):
    rows = [(a, b) for a, b in zip(left, right)]
    x, y = F.col("a"), F.col("b")
    got = values(spark, rows, x, y, X.clean_text(x), F.array_sort(T.grams(x, 2)), T.jaccard(T.grams(x, 3), T.grams(y, 3)), T.common_prefix_ratio(x, y), T.length_ratio(x, y), T.matching_ratio(x, y))
    for a, b, clean, grams2, jac, prefix, length, ratio in got:
        assert clean == plain_clean(a)
        assert grams2 == sorted(plain_grams(a, 2))
        p, q = plain_grams(a, 3), plain_grams(b, 3)
        assert jac == pytest.approx(len(p & q) / len(p | q) if p and q else 0)
        short = min(len(a), len(b))
        same = next((i for i in range(short) if a[i] != b[i]), short)
        assert prefix == pytest.approx(same / short if short else 0)
        assert length == pytest.approx(short / max(len(a), len(b)) if a or b else 1)
        assert ratio == pytest.approx(SequenceMatcher(None, a, b).ratio())
