"""Near-duplicate embeddings: randomised-rotation binary codes with correction factors.

A unit vector o is rotated at random and kept as the signs of its coordinates, with the correction ``<code, o>``.
For another unit vector q, ``<q, code> / <code, o>`` estimates ``<q, o>`` without bias, within
``EPS * sqrt((1 - c * c) / (c * c * (D - 1)))`` with high confidence. Only pairs whose upper bound reaches the
threshold are computed again, exactly and in double precision.

Pairs come from tiles. Vectors of one label and dimension lie in one cell while there are at most ``CELL`` of them;
of a larger group about every ``CELL``-th is a pivot, and each vector's home is the cell of its nearest pivot. By the
triangle inequality, a vector within angle ``t`` of one whose home is another cell is at most ``2 * t`` farther from
that cell's pivot than from its own; it is a guest in every such cell after its own, so each pair meets in one cell.
Homes and guests are dealt into blocks, and a tile is a pair of blocks, one of homes at least.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.frames import arrow_schema, column, cut, map_rows, record
from kindred.llm.topk import usable

COSINE = 0.98
#: Standard errors of an estimate that count as certain.
EPS = 4.0
CELL = 8192
BLOCK = 4096
#: Pivots of a group at most; beyond that cells grow.
PIVOTS = 256
SEED = 20


@lru_cache(8)
def rotation(d: int, turn: int) -> np.ndarray:
    """A random rotation that every executor derives alike."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, turn]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def cell_members(units: np.ndarray, pivots: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their cells, and whether they are guests there."""
    n = len(units)
    if pivots is None:
        return np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    angle = np.arccos(np.clip(units @ pivots.T, -1, 1))
    home = angle.argmin(1)
    near = angle <= angle.min(1, keepdims=True) + 2 * math.acos(max(-1.0, min(1.0, cosine))) + 1e-6
    near &= np.arange(len(pivots)) >= home[:, None]
    row, cell = np.nonzero(near)
    return row, cell, cell != home[row]


def unit_rows(v: np.ndarray) -> np.ndarray:
    # a first division keeps squares in range
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Codes:
    """Rotated unit vectors with their binary codes and corrections."""

    def __init__(self, units: np.ndarray):
        d = units.shape[1]
        self.d = d
        self.rotated = (units @ rotation(d, 0).T).astype(np.float32)
        self.code = np.where(self.rotated >= 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(d))
        self.correction = np.maximum((self.rotated * self.code).sum(1), 1e-6)
        c2 = self.correction.astype(float) ** 2
        self.error = (EPS * np.sqrt(np.maximum(1 - c2, 0) / (c2 * max(d - 1, 1))) + 1e-5).astype(np.float32)

    def upper(self, other: Codes) -> np.ndarray:
        """Upper bounds of the inner products of own rows with the other's."""
        return (self.rotated @ other.code.T) / other.correction + other.error


def tile_links(a: np.ndarray, b: np.ndarray, cosine: float, same: bool, rows: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """Yields ``(first row, link matrix)`` for runs of rows of ``a`` against all of ``b``."""
    codes_b = Codes(b)
    for at in range(0, len(a), rows):
        part = a[at : at + rows]
        may = Codes(part).upper(codes_b) >= cosine
        if same:
            may &= np.arange(at, at + len(part))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(may)
        link = np.zeros(may.shape, bool)
        if len(i) > 0.02 * may.size:
            link = may & (part @ b.T >= cosine)
        elif len(i):
            link[i, j] = np.einsum("ij,ij->i", part[i], b[j]) >= cosine
        yield at, link


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels after joining nodes i with nodes j; a label is the index of a component's first node."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row.

    Rows link if their labels are equal and not null, and the cosine is at least ``cosine``. A vector that is null,
    empty, zero, or holds null or non-finite components, a row without a label, and one without a ``vec_id`` link
    with nothing; vectors of different dimension don't link. Equal vectors of a label link with each other, so
    rows that repeat each other do, too.
    """
    e = F.col("embedding")
    nonzero = F.exists(e, lambda x: x != 0)
    good = usable(e) & F.coalesce(nonzero, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "label", F.when(good, e).alias("v"))
    classes = cut(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("c"), F.count("*").alias("size")))
    of_group = Window.partitionBy("label", "d").orderBy(F.xxhash64("c"), "c")
    prepared = classes.withColumn("d", F.size("v"))
    sizes = prepared.groupBy("label", "d").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / CELL))
    chosen = prepared.join(F.broadcast(sizes), ["label", "d"]).withColumn("r", F.row_number().over(of_group)).where(F.col("r") <= wanted)
    pivots: dict[tuple, list] = {}
    for r in chosen.select("label", "d", "v").collect():
        pivots.setdefault((r["label"], r["d"]), []).append(r["v"])
    shared = vectors.sparkSession.sparkContext.broadcast({k: unit_rows(np.array(v, float)) for k, v in pivots.items()})

    kind = dict(vectors.dtypes)["label"]
    schema = f"label {kind}, d int, cell long, guest boolean, c long, size long, unit array<double>"
    target = arrow_schema(vectors.sparkSession, schema)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = list(zip(column(batch, "label").to_pylist(), column(batch, "d").to_pylist()))
            # groups without pivots go together by dimension
            keys = [g if g in shared.value else (None, g[1]) for g in groups]
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                at.setdefault(k, []).append(i)
            for (_, d), rows_ in sorted(at.items(), key=lambda x: x[1]):
                part = batch.take(pa.array(rows_))
                units = unit_rows(column(part, "v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))
                row, cell, guest = cell_members(units, shared.value.get(keys[rows_[0]]), cosine)
                for first in range(0, len(row), len(units)):
                    some = slice(first, first + len(units))
                    part_ = part.take(pa.array(row[some]))
                    yield record({"label": column(part_, "label"), "d": [d] * part_.num_rows, "cell": cell[some], "guest": guest[some], "c": column(part_, "c"), "size": column(part_, "size"), "unit": list(units[row[some]])}, target)

    dealt = map_rows(prepared.select("label", "d", "c", "size", "v"), spread, schema)
    cell = ["label", "d", "cell"]
    counted = dealt.groupBy(*cell).agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests")).where("homes > 0 and homes + guests > 1")
    blocks = counted.select(*cell, F.ceil(F.col("homes") / BLOCK).cast("int").alias("home_blocks"), F.ceil(F.col("guests") / BLOCK).cast("int").alias("guest_blocks"))
    own = F.when(F.col("guest"), F.col("home_blocks") + F.pmod(F.xxhash64("c"), F.col("guest_blocks"))).otherwise(F.pmod(F.xxhash64("c"), F.col("home_blocks"))).cast("int")
    dealt = dealt.join(blocks, cell).withColumn("block", own)
    # guests meet homes only: they meet each other at home
    last = F.when(F.col("guest"), F.col("home_blocks")).otherwise(F.col("home_blocks") + F.col("guest_blocks")) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(x, "block").alias("b1"), F.greatest(x, "block").alias("b2")))
    tiles = dealt.withColumn("t", F.explode(pairs)).select(*cell, "t.b1", "t.b2", "block", "c", "size", "unit")

    def links(key: tuple, table: pa.Table) -> pa.Table:
        d, b1, b2 = (key[k].as_py() for k in (1, 3, 4))
        block = table.column("block").to_numpy()
        matrix = lambda t: column(t, "unit").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        left = table.filter(pa.array(block == b1))
        right = left if b1 == b2 else table.filter(pa.array(block == b2))
        n, m = left.num_rows, right.num_rows
        size_l, size_r = column(left, "size").to_numpy(), column(right, "size").to_numpy()
        add_l, add_r = np.zeros(n, np.int64), np.zeros(m, np.int64)
        shift = 0 if b1 == b2 else n
        label = np.arange(n + m - (m if b1 == b2 else 0))
        for at, link in tile_links(matrix(left), matrix(right), cosine, b1 == b2) if n and m else []:
            add_l[at : at + len(link)] += link @ size_r
            add_r += size_l[at : at + len(link)] @ link
            i, j = np.nonzero(link)
            if len(i):
                label = joined(label, i + at, j + shift)
        if b1 == b2:
            add_l += add_r
            ids, adds = column(left, "c").to_numpy(), add_l
        else:
            ids, adds = np.concatenate((column(left, "c").to_numpy(), column(right, "c").to_numpy())), np.concatenate((add_l, add_r))
        some = np.flatnonzero(adds)
        return pa.table({"a": ids[some], "b": ids[label[some]], "links": adds[some]})

    found = cut(tiles.groupBy(*cell, "b1", "b2").applyInArrow(links, "a long, b long, links long"))
    whole = components(found.where("a <> b"), found.count())
    more = found.groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    ends = classes.select("label", "v", "c", "size").join(more, "c", "left").join(whole.withColumnRenamed("node", "c").withColumnRenamed("label", "component"), "c", "left")
    ends = ends.select("label", "v", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component"))
    known = rows.where("v is not null").join(ends, ["label", "v"]).select("vec_id", "n_links", "component")
    other = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return known.unionByName(other).select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
