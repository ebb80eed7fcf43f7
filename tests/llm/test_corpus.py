"""The corpus operators against brute force on small tables with nulls, repeats, empty and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from kindred.llm import bpe, embed_dedup, html_extract, jaccard, lines, oracles, packing, pii, substrings, topk, toxicity  # noqa: E402
from kindred.llm.components import components  # noqa: E402
from kindred.llm.frames import squeeze, unsqueeze  # noqa: E402

DOCS = "doc_id long, text string, lang string, batch_id string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random words with copies, near copies, shared passages and lines, and awkward rows."""
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["Été,", "ß.", "don't"]
    text = lambda k: " ".join(r.choices(words, k=k))
    passage, line = text(30), text(6)
    docs = [text(r.randint(20, 120)).replace("w7 ", "w7\n") for _ in range(n)]
    for i in range(0, n, 5):
        docs[i] = docs[i] + " " + passage + "\n" + line
    for i in range(3, n, 6):
        near = docs[i - 1].split(" ")
        near[r.randrange(len(near))] = "changed"
        docs[i] = " ".join(near)
    docs[10] = docs[4]
    docs += ["", None, " \n\t ", "one two", "one two", line.upper() + "\n" + line, "word " * 3000, "a@b.example 12.34.56.78 +1 (234) 567-8901"]
    return [(i, t, "en", "x") for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def rows_of(df, key="doc_id"):
    return {r[key]: tuple(r) for r in df.collect()}


def by_sql(sql, **tables):
    c = duckdb.connect()
    for name, (columns, rows) in tables.items():
        c.register(name, pd.DataFrame(rows, columns=columns))
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def same_as_sql(df, sql, **tables):
    key = lambda d: sorted((k, str(v)) for k, v in d.items())
    assert sorted(key(r.asDict()) for r in df.collect()) == sorted(key(d) for d in by_sql(sql, **tables))


def text_rows():
    return ["doc_id", "text"], [(d, t) for d, t, *_ in corpus()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_hash_codec():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (unsqueeze(squeeze(values)) == values).all() and len(unsqueeze(squeeze(values[:0]))) == 0


# 1


def test_first_fit_decreasing():
    r = random.Random(2)
    sizes = sorted((r.randint(1, 100) for _ in range(300)), reverse=True)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    open_bins = []
    for s, b, o in zip(sizes, bins, offsets):
        at = next((i for i, used in enumerate(open_bins) if used + s <= 100), len(open_bins))
        if at == len(open_bins):
            open_bins.append(0)
        assert (b, o) == (at, open_bins[at])
        open_bins[at] += s


def test_packing(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.length.cumsum() - s.length == s.offset).all()
    for d, text, *_ in corpus():
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in got[got.doc_id == d].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            at += p.length
        assert at == len(ids)
    assert packing.pack_documents(empty(spark), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


# 2


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("a < b <p>x &amp; y&nbsp;z</p>", "a < b\nx & y z"),
        ("<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>One  two<br>three<p>Of.</article><footer>(c) me</footer>", "T\nOne two\nthree\nOf."),
        ("<article><p>Kept text here.</p><div class='ad'>buy now</div><section id=comments><p>me too</p></section><p>End.</p></article>", "Kept text here.\nEnd."),
        ("<div class='cookie-notice'>we use cookies<div>x</div></div><main>All of it<script>var a='</p>'</script></main><aside>more</aside>", "All of it"),
        ("<form>name <input></form><article>never closed", "never closed"),
    ],
)
def test_html(page, text):
    assert html_extract.main_text(page or "", html_extract.fit_weights()) == text


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article>é ü</article>", "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_extract.extract(pages).collect()), key=str) == [(1, "u", "é ü", 3), (None, None, "", 0)]
    assert html_extract.best_run([-1, 2, 3, -9, 4]) == (1, 3) and html_extract.best_run([-1.0]) == (0, 0)


# 3


def test_prefix_tables():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = bpe.PrefixEncoder(ranks)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    for _ in range(300):
        piece = "".join(r.choices("abctheing é日", k=r.randint(1, 30))).encode()
        assert own.encode(piece) == other._core_bpe.encode_single_piece(piece)
    table = bpe.PrefixTable(own, b"understand")
    table.append(b"ably")
    table.replace(2, 5, b"xyz")
    assert table.data == b"unxyzstandably" and table.ids() == own.walk(own.extend(table.data, []))
    assert own.decode(table.ids()) == table.data


def test_round_trip(spark, docs):
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = rows_of(bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    for d, text, *_ in corpus():
        ids = other.encode_ordinary(text or "")
        assert got[d] == (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).where("size(ids) > 0").count() == sum(bool(t) for _, t, *_ in corpus())


# 4, 6, 7


def test_jaccard(spark, docs):
    same_as_sql(jaccard.near_duplicates(docs), oracles.JACCARD_JOIN, documents=text_rows())
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (10, 64)").count() == 0 and kept.where("doc_id in (4, 60, 61, 63)").count() == 4


def test_connect_finds_every_link():
    r = np.random.default_rng(4)
    base = [np.unique(r.integers(0, 2**62, 40).astype(np.uint64)) for _ in range(5)]
    sets = [np.unique(np.concatenate((b[r.random(len(b)) > 0.08], r.integers(0, 2**62, r.integers(0, 4)).astype(np.uint64)))) for b in base for _ in range(12)]
    label = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.linked(sets[i], sets[j], 80):
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    assert (jaccard.connect(sets, np.arange(len(sets)), 80) == label).all()
    for s in sets:
        assert len(jaccard.sketched(jaccard.sketch(s))) == len(s)


def test_components(spark):
    """A path in random order, a star, and repeated and circular links."""
    order = list(range(100, 160))
    random.Random(3).shuffle(order)
    links = [*zip(order, order[1:]), *((9, k) for k in range(20, 40)), (1, 2), (2, 1), (2, 3), (3, 1), (5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), len(links)).collect()))
    assert found == {k: 100 for k in order} | {k: 9 for k in [9, *range(20, 40)]} | {1: 1, 2: 1, 3: 1}
    assert components(spark.createDataFrame([], "a long, b long"), 0).count() == 0


def test_large_keys_go_through_tiles(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE_KEY", 1)
    monkeypatch.setattr(jaccard, "CELL", 100)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    same_as_sql(jaccard.near_duplicates(docs), oracles.JACCARD_JOIN, documents=text_rows())


def test_substrings(spark, docs):
    same_as_sql(substrings.drop_repeats(docs), oracles.SUBSTRING_DEDUP, documents=text_rows())
    kept = substrings.drop_repeats(docs, keep_columns=True)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert substrings.drop_repeats(empty(spark)).count() == 0


def test_lines(spark, docs):
    same_as_sql(lines.drop_repeats(docs), oracles.LINE_DEDUP, documents=text_rows())
    kept = rows_of(lines.drop_repeats(docs, keep_columns=True))
    assert len(kept[0]) == 4 and kept[61][1] is None
    twice = spark.createDataFrame([(5, "the same line here\nx", "", ""), (5, "the same line here", "", ""), (None, "the same line here", "", "")], DOCS)
    assert sum(r["n_dropped"] for r in lines.drop_repeats(twice).collect()) == 0
    assert lines.drop_repeats(empty(spark)).count() == 0


# 5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    return sorted(((k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m[0])), key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_patterns():
    r = random.Random(5)
    parts = ["a.b@c-d.e", "@", "x@y", ".", "4111 1111 1111 1111", "1.2.3.4.5", "300.1.1.1", "+1 (234) 567-8901", "+", "12", " ", "é", "49927398716", "%+-_", "00.1.2.3", "-", "@q.w.", "4111111111111111"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 100_000) == [] and pii.base_spans("a" * 100_000) == []


def test_pii_terms(spark):
    rows = [(i, f"call Zyxomat at zed@mail.example today {i}", "", "") for i in range(6)] + [(i, f"plain today text call {i}", "", "") for i in range(6, 40)] + [(40, None, "", ""), (41, "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = rows_of(pii.find(docs))
    assert got[0][1:5] == (1, 0, 0, 0) and got[0][6] == "term:5:12,email:16:32"
    assert got[10][6] == "" and got[40][5] == hashlib.sha256(b"").hexdigest()
    clean = rows_of(pii.sanitise(docs))
    assert clean[0][1] == "call  at <EMAIL> today 0" and clean[10][1] == rows[10][1] and clean[40][1] is None
    assert pii.find(empty(spark)).count() == 0


# 8


def test_top_k(spark):
    r = np.random.default_rng(6)
    v = r.integers(-3, 4, (300, 5)) / 4
    v[100:150] = v[50]
    rows = [(int(i), [float(x) for x in v[i]], 0) for i in range(300)] + [(350, None, 0), (400, [1.0, None, 0.0, 0.0, 0.0], 0), (450, [float("nan")] * 5, 0), (500, [], 0), (None, [1.0] * 5, 0), (550, [0.0] * 5, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = {i: np.floor(256 * np.array(e)).astype(int) for i, e, _ in rows if i is not None and e and None not in e and not np.isnan(e).any()}
    got = Counter()
    found = {(q["query_id"], q["rank"]): (q["vec_id"], q["score"]) for q in topk.top_k(df, lambda i: i % 50 == 0).collect()}
    for q in (i for i in x if i % 50 == 0):
        best = sorted(((-int(x[q] @ x[c]), c) for c in x if c != q))[:5]
        for k, (s, c) in enumerate(best):
            assert found[q, k + 1] == (c, -s)
            got[q] += 1
    assert len(found) == sum(got.values())
    assert topk.top_k(df.where("false"), lambda i: i % 50 == 0).count() == 0


# 9


def test_toxicity(spark):
    r = random.Random(7)
    words = ["".join(r.choices(["the", "an", "er", "ou"], k=3)) for _ in range(60)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, " ".join(r.choices(words, k=40) + (r.choices(["scumbag", "vermin", "filth"], k=2) if bad else [])), "", ""))
        labels.append((i, 1, int(bad)))
    rows += [(600, None, "", ""), (601, "", "", "")]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (700, 1, None)], "doc_id long, quality int, toxic int")
    got = rows_of(toxicity.classify(docs, known))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i][1] for i in held) and sum(got[i][1] for i in range(600)) == len(held)
    assert sum(got[i][3] == int(i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert got[600][3] == got[601][3] == 0
    assert toxicity.reject(docs, known).columns == docs.columns
    assert all(r["score"] == 0 for r in toxicity.classify(docs, known.where("false")).collect())


# 10


def test_embeddings(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(120, 16))
    v[40:60] = v[3] + 0.03 * r.normal(size=(20, 16))
    v[60:70] = v[4]
    rows = [(int(i), [float(np.float32(x)) for x in v[i]], int(i % 2) if not 40 <= i < 70 else 1) for i in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("inf")] * 16, 1), (203, rows[5][1], None), (204, [None] * 16, 1), (205, [3e38] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    columns = ["vec_id", "embedding", "label"]
    good = [x for x in rows if x[0] != 205]
    same_as_sql(embed_dedup.near_duplicates(df.where("vec_id <> 205")), oracles.EMBEDDING_DEDUP.replace("from embeddings", "from (select vec_id::bigint as vec_id, embedding::double[] as embedding, label::int as label from raw_embeddings) embeddings"), raw_embeddings=(columns, [(i, e, lab) for i, e, lab in good]))
    assert rows_of(embed_dedup.near_duplicates(df), "vec_id")[205][1:] == (0, 205, True)
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_embedding_cuts_keep_recall(spark, monkeypatch):
    """With cells far below the table's size, at least nine of ten links are found and none is wrong."""
    monkeypatch.setattr(embed_dedup, "CELL", 64)
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    r = np.random.default_rng(9)
    base = r.normal(size=(300, 32))
    v = np.concatenate((base, base + 0.14 * r.normal(size=base.shape)))
    df = spark.createDataFrame([(i, [float(x) for x in e], 0) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.98
    want = link.sum() - len(v)
    got = sum(x["n_links"] for x in embed_dedup.near_duplicates(df).collect())
    assert 0.9 * want <= got <= want and want > 100
