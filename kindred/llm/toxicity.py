"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior.

Voters are words and word beginnings that the labelled rows propose, and patterns of spelling. The label model sees
their votes only, over labelled and as many unlabelled rows. By expectation-maximisation it estimates each voter's
rates under both classes, and for each voter the one other voter that it depends on most within the classes (a
tree of largest conditional mutual information) with the rates given that one's vote; so voters that repeat each
other count once. The labels only say where the classes start. A logistic model over words and word beginnings
learns the posterior of the labelled rows and scores every text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.llm.frames import arrow_schema, column, map_rows, record, renamed, tidy

#: Labelled rows to learn from, at most, the ones with the smallest hash of their id; and as many unlabelled ones.
SAMPLE = 12_000
#: What a false alarm's share weighs against that of caught rows when the score's cut is chosen.
ALARM = 20
#: How far a labelled row is held to its label while the label model is estimated.
HELD = 0.5
#: Bits of mutual information (in nats) from which on a voter depends on another.
DEPENDENT = 2e-4
LEXICON = 256
#: Standard errors of the bound on the share of toxic rows among those with a feature.
Z = 2.5
#: Lengths of word beginnings that are features next to whole words.
STEMS = (3, 4, 5, 6, 7)
_apart = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_apart).split())


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings; a beginning is marked so that it differs from the word of that spelling."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) >= k)]


def pattern_votes(text: str) -> list[bool]:
    """Patterns of spelling that may go with abuse: shouting, strings of marks, stretched letters, addressing someone."""
    letters = sum(c.isalpha() for c in text)
    upper = sum(c.isupper() for c in text)
    low = text.lower()
    return [letters > 20 and upper > 0.3 * letters, "!!" in text, "??" in text, any(c * 4 in low for c in "aeious"), "you " in low and "!" in text, len(text) < 40]


@dataclass
class LabelModel:
    """A prior, and the rate of each binary voter under both classes, given the vote of the voter it depends on.

    ``parent`` is that voter, -1 for none; ``rates[y, w, i]`` is the share of votes of voter i in class y where its
    parent votes w (0 without a parent).
    """

    prior: float
    parent: np.ndarray
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.rates), np.log1p(-self.rates)
        # what a vote adds to the log odds, what it adds more with its parent's, and the parent's without it
        own, both = ((yes - no)[1] - (yes - no)[0])[0], ((yes - no)[1] - (yes - no)[0])[1]
        base, lone = (no[1] - no[0])[0], (no[1] - no[0])[1] - (no[1] - no[0])[0]
        z = np.empty(len(votes))
        for at, x, given in self.runs(votes, self.parent):
            z[at : at + len(x)] = x @ own + (x * given) @ (both - own) + given @ lone
        z += math.log(self.prior / (1 - self.prior)) + base.sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def runs(votes: np.ndarray, parent: np.ndarray, rows: int = 2048) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Some rows at a time: where they begin, their votes, and the votes of each voter's parent."""
        for at in range(0, len(votes), rows):
            x = votes[at : at + rows].astype(float)
            yield at, x, np.where(parent >= 0, x[:, parent], 0)

    @classmethod
    def estimate(cls, votes: np.ndarray, p: np.ndarray, parent: np.ndarray) -> LabelModel:
        """The model of largest likelihood if ``p`` is each row's share of class 1, smoothed by half a row."""
        rates = np.empty((2, 2, votes.shape[1]))
        sums = np.zeros((2, 3, votes.shape[1]))
        for at, x, given in cls.runs(votes, parent):
            for y, q in enumerate((1 - p[at : at + len(x)], p[at : at + len(x)])):
                sums[y] += q @ x, q @ (x * given), q @ given
        for y, q in enumerate((1 - p, p)):
            total, both, of_parent = sums[y]
            overall = (total + 0.5) / (q.sum() + 1)
            rates[y, 1] = (both + overall) / (of_parent + 1)
            rates[y, 0] = (total - both + overall) / (q.sum() - of_parent + 1)
        return cls(float(np.clip(p.mean(), 1e-4, 1 - 1e-4)), parent, np.clip(rates, 1e-5, 1 - 1e-5))

    @staticmethod
    def dependences(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Each voter's parent in the forest of largest mutual information within the classes."""
        m, n = votes.shape[1], len(votes)
        shared = np.zeros((m, m))
        for q in (1 - p, p):
            size = q.sum() + 1
            both = sum(((x * q[at : at + len(x), None]).T @ x for at, x, _ in LabelModel.runs(votes, np.full(m, -1))), np.zeros((m, m))) + 0.25
            one = q @ votes + 0.5
            for cell, i, j in ((both, one, one), (one[:, None] - both + 0.5, one, size - one), (one[None, :] - both + 0.5, size - one, one), (size - one[:, None] - one[None, :] + both, size - one, size - one)):
                cell = np.maximum(cell, 1e-3)
                shared += cell / n * np.log(cell * size / np.outer(i, j))
        np.fill_diagonal(shared, 0)
        parent, inside, best, at = np.full(m, -1), np.zeros(m, bool), np.full(m, -np.inf), np.full(m, -1)
        for _ in range(m):
            k = int(np.where(inside, -np.inf, best).argmax())
            k = k if best[k] > -np.inf and not inside[k] else int(np.flatnonzero(~inside)[0])
            inside[k] = True
            parent[k] = at[k] if best[k] >= DEPENDENT else -1
            closer = ~inside & (shared[k] > best)
            best[closer], at[closer] = shared[k][closer], k
        return parent

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> LabelModel:
        """Expectation-maximisation from the shares ``start`` of class 1; NaN for rows of which nothing is known.

        Between its rounds a row of known start is held ``HELD`` of the way to it, so that the classes stay where the
        labels are; what the model then says of a row comes from its votes alone.
        """
        known = ~np.isnan(start)
        alone = np.full(votes.shape[1], -1)
        model = cls.estimate(votes[known], start[known], alone)
        p = model.posterior(votes)
        for parent in (alone, None):
            parent = cls.dependences(votes, p) if parent is None else parent
            for _ in range(rounds):
                model = cls.estimate(votes, np.where(known, HELD * np.nan_to_num(start) + (1 - HELD) * p, p), parent)
                new = model.posterior(votes)
                moved = np.abs(new - p).max()
                p = new
                if moved < 1e-4:
                    break
        return model


@dataclass
class Classifier:
    weights: dict[bytes, float]
    bias: float

    def word_weight(self, word: bytes) -> float:
        get = self.weights.get
        return get(word, 0.0) + sum(get(word[:k] + b"*", 0.0) for k in STEMS if len(word) >= k)


def fit_logistic(rows: list[np.ndarray], n: int, target: np.ndarray, rounds: int = 150, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on counts of features by Adam over all rows at once."""
    lengths = np.array([len(r) for r in rows])
    columns = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    w, b = np.zeros(n), math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    # rare classes weigh as much as common ones
    share = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    mw, vw, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(owner, w[columns], len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * share / len(rows)
        gw = np.bincount(columns, error[owner], n) + ridge * w
        gb = error.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 * (1 - t / (rounds + 1))
        w -= rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def one_of_each(rows: list[tuple[bytes, bytes, int]]) -> list[tuple[bytes, bytes, int]]:
    """Rows without those whose whole word set and label equal an earlier one's: copies would vote as many.

    A row's words are distinct and sorted, so equal sets have equal bytes.
    """
    import xxhash

    seen: set[tuple[bytes, int]] = set()
    kept = []
    for row in rows:
        key = xxhash.xxh3_128_digest(row[0]), row[2]
        if key not in seen:
            seen.add(key)
            kept.append(row)
    return kept


def least_share(a: int, b: int) -> float:
    """Wilson's lower bound on a / (a + b)."""
    n, z2 = a + b, Z * Z
    return (a + z2 / 2 - Z * math.sqrt(a * b / n + z2 / 4)) / (n + z2)


def voters(kept: list[tuple[bytes, bytes, int]]) -> dict[bytes, float]:
    """Features, each with a lower bound over one half of the share of toxic rows among those that have it.

    Features are counted text by text, first over the toxic rows and then, for those that can still become voters,
    over the others; memory follows the packed texts.
    """
    # fewer than this many toxic rows can't bring the bound above one half
    least = next(a for a in range(1, 1000) if least_share(a, 0) > 0.5)
    toxic: dict[bytes, int] = {}
    # one kind of feature at a time: most occur once or twice and needn't be held together
    for size in (None, *STEMS):
        counts: Counter[bytes] = Counter()
        for words, _, label in kept:
            if label:
                counts.update({w if size is None else w[:size] + b"*" for w in words.split() if size is None or len(w) >= size})
        toxic |= {f: n for f, n in counts.items() if n >= least}
    clean: Counter[bytes] = Counter()
    for words, _, label in kept:
        if not label:
            clean.update({f for w in words.split() for f in features_of(w) if f in toxic})
    sure = {f: least_share(toxic[f], clean[f]) for f in sorted(toxic)}
    return {f: s for f, s in sure.items() if s > 0.5}


def vote_matrix(own: list[Iterable[bytes]], patterns: list[bytes], lexicon: list[bytes]) -> np.ndarray:
    """A row of votes for each text: its words of the lexicon, whether it has one and three of them, its patterns."""
    chosen = {f: j for j, f in enumerate(lexicon)}
    votes = np.zeros((len(own), len(lexicon)), np.float32)
    for r, fs in enumerate(own):
        votes[r, [chosen[f] for f in fs if f in chosen]] = 1
    hits = votes.sum(1)
    spelling = np.array([[v == 49 for v in p] for p in patterns], np.float32).reshape(len(own), -1)
    return np.column_stack((votes, spelling, hits >= 1, hits >= 3)).astype(np.float32)


def learn(rows: list[tuple[bytes, bytes, int]], unlabelled: Callable[[list[bytes]], list[tuple[list[bytes], bytes]]] | None = None) -> Classifier | None:
    """From ``(distinct words, pattern votes, label)`` of each row; None without rows of both labels.

    ``unlabelled`` gets the lexicon and returns what each of the unlabelled texts has of it, and its pattern votes.
    """
    kept = one_of_each(rows)
    y = np.array([label for *_, label in kept])
    if not len(y) or y.min() == y.max():
        return None
    sure = voters(kept)
    known = {f: i for i, f in enumerate(sure)}
    lexicon = sorted(known, key=lambda f: (-sure[f], f))[:LEXICON]
    own = [Counter(f for w in words.split() for f in features_of(w) if f in known) for words, _, _ in kept]
    more = unlabelled(lexicon) if unlabelled and lexicon else []
    votes = vote_matrix([*own, *(fs for fs, _ in more)], [*(p for _, p, _ in kept), *(p for _, p in more)], lexicon)
    start = np.concatenate((np.where(y == 1, 0.95, 0.05), np.full(len(more), np.nan)))
    # a word and its beginnings often vote as one
    votes = np.unique(votes, axis=1)
    posterior = LabelModel.fit(votes, start).posterior(votes[: len(y)])
    if not known:
        return Classifier({}, math.log(y.mean() / (1 - y.mean())))
    columns = [np.array([known[f] for f, n in fs.items() for _ in range(min(n, 3))], np.int64) for fs in own]
    w, bias = fit_logistic(columns, len(known), posterior)
    model = Classifier({f: float(w[i]) for f, i in known.items() if abs(w[i]) > 1e-3}, float(bias))
    weight = {x: v for x in {x for words, _, _ in kept for x in words.split()} if (v := model.word_weight(x))}
    model.bias -= cut_off(np.array([model.bias + math.fsum(weight.get(x, 0.0) for x in words.split()) for words, _, _ in kept]), y)
    return model


def cut_off(z: np.ndarray, y: np.ndarray) -> float:
    """Where to cut the log odds ``z``: the most of the share of caught rows less ``ALARM`` times that of false alarms."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    gain = np.concatenate(([0.0], np.cumsum(np.where(y == 1, 1 / max((y == 1).sum(), 1), -ALARM / max((y == 0).sum(), 1)))))
    # between equal values there is no cut
    allowed = np.concatenate(([True], z[1:] < z[:-1], [True]))
    k = int(np.where(allowed, gain, -np.inf).argmax())
    if k == 0:
        return float(z[0]) + 1
    return float(z[k - 1]) - 1 if k == len(z) else float(z[k - 1] + z[k]) / 2


def held_out(doc_id: int | None) -> bool:
    """The fold that is never learned from; a null id counts as the text of a null, an empty string."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def spelled(text: str | None) -> str:
    return "".join("01"[v] for v in pattern_votes(text or ""))


def learnable(ids: Column) -> Column:
    return ids.isNotNull() & (F.crc32(ids.cast("string").cast("binary")) % 5 != 0)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[bytes, bytes, int]]:
    """Words, pattern votes and labels of at most ``sample`` rows outside the held-out fold.

    The ids go out by broadcast: they are bounded.
    """
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    schema = "packed string, label int"
    target = arrow_schema(docs.sparkSession, schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            packed = [" ".join(sorted(w.decode("utf-8", "replace") for w in words_of(t or ""))) + "\0" + spelled(t) for t in texts]
            yield record({"packed": packed, "label": column(batch, "label")}, target)

    got = map_rows(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"), rows, schema)
    # copies of a document can share an id; the bound holds for rows as well
    first = got.orderBy(F.xxhash64("packed"), "packed", "label").limit(sample)
    return [(*r["packed"].encode().split(b"\0"), r["label"]) for r in first.collect()]


def unlabelled_votes(docs: DataFrame, labels: DataFrame, sample: int, lexicon: list[bytes]) -> list[tuple[list[bytes], bytes]]:
    """What at most ``sample`` texts without a label, outside the held-out fold, have of the lexicon, and their patterns."""
    ids = docs.select("doc_id").where(learnable(F.col("doc_id"))).distinct().join(labels.select("doc_id"), "doc_id", "left_anti")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = "hits array<int>, patterns string"
    target = arrow_schema(docs.sparkSession, schema)
    place = {f: j for j, f in enumerate(lexicon)}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            hits = [sorted({place[f] for w in words_of(t or "") for f in features_of(w) if f in place}) for t in texts]
            yield record({"hits": hits, "patterns": list(map(spelled, texts))}, target)

    got = map_rows(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text"), rows, schema)
    first = got.orderBy(F.xxhash64("hits", "patterns"), "hits", "patterns").limit(sample)
    return [([lexicon[j] for j in r["hits"]], r["patterns"].encode()) for r in first.collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Learn from ``sample`` labelled and as many unlabelled rows, at most."""
    model = learn(training_rows(docs, labels, sample), lambda lexicon: unlabelled_votes(docs, labels, sample, lexicon))
    tidy()
    return model


#: Words whose weights a task keeps.
MOST_WORDS = 1 << 17


def scored(docs: DataFrame, model: Classifier | None, finish: Callable[[pa.RecordBatch, list[float]], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """Score the texts of each batch and let ``finish`` make rows of it. Without a model every score is 0.

    Null and empty texts get the score of a text without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    class Weights(dict):
        def __missing__(self, word: bytes) -> float:
            got = shared.value.word_weight(word)
            if len(self) < MOST_WORDS:
                self[word] = got
            return got

    def score(text: str | None, weights: Weights) -> float:
        z = math.fsum(map(weights.__getitem__, words_of(text or ""))) + shared.value.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights()
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            yield finish(batch, [0.0 if shared.value is None else score(t, weights) for t in texts])

    return map_rows(docs, rows, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every whole text of ``docs``; learns outside the held-out fold.

    Labels that are null or neither 0 nor 1 teach nothing; of repeated labels of a document the larger holds.
    Without rows of both labels every score is 0. Null and empty texts get the score of a text without words.
    Rows keep their number; a null ``doc_id`` counts as an empty one for the fold. Other columns are not read.
    """
    schema = "doc_id long, held_out boolean, score double, predicted int"
    target = arrow_schema(docs.sparkSession, schema)

    def finish(batch: pa.RecordBatch, scores: list[float]) -> pa.RecordBatch:
        ids = column(batch, "doc_id")
        return record({"doc_id": ids, "held_out": list(map(held_out, ids.to_pylist())), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}, target)

    return scored(docs.select("doc_id", "text"), fit(docs, labels, sample), finish, schema)


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns whatever their names; see ``classify``."""
    names, docs = docs.columns, renamed(docs)
    target = arrow_schema(docs.sparkSession, docs.schema)

    def finish(batch: pa.RecordBatch, scores: list[float]) -> pa.RecordBatch:
        kept = batch.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))
        return record({n: column(kept, n) for n in kept.schema.names}, target)

    return scored(docs, fit(docs, labels, sample), finish, docs.schema).toDF(*names)
