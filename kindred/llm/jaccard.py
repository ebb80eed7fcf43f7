"""Near-duplicate documents: an exact Jaccard join over word shingles.

1. *Suspects.* Documents meet on the smallest hashes of their shingle sets, an extended prefix. Two documents that
   link share at least so many of them, so a document with fewer repeated ones links with nothing and leaves.
2. *Classes.* Documents with equal sets are one class from here on.
3. *Rounds.* Classes that share a minimum hash are dealt by size into bands, and large bands over cells of bounded
   size. In a cell, bit counts of hashed bitmaps bound the overlap of two sets from above, and sorted arrays are
   intersected only where the bound allows a link. Pairs already connected are passed over, as only the components
   are asked for. Each round has other keys, bands and cells and starts from the components so far, so a group of
   near copies of any size is sent once a round and soon is one component, which is sent no more.
4. *Last round.* Every prefix hash is a key for classes not yet connected, which finds the rest: no link between
   different components is lost. There the bitmaps alone travel; the sets of the few pairs that they let pass are
   fetched for the exact test. A key with very many classes is dealt over tiles: a pair of cells of the same or of
   neighbouring bands, so that each pair of classes whose sizes can link meets in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.frames import Stored, arrow_schema, column, cut, gram_hashes, grouped, in_few, in_large, map_batches, map_rows, mixed, multipliers, pack, part_bits, plan_bytes, quoted, raw_texts, received, record, resolve, send, stored, tidied, word_hashes

WORDS = 5
#: Links need 100 * overlap >= PERCENT * union.
PERCENT = 80
#: Shingles in a cell, on average at most.
CELL = 1 << 20
#: Rounds with minimum hashes as keys.
ROUNDS = 2
#: Classes with a key in the last round, beyond which the key is dealt over tiles.
LARGE_KEY = 4096
#: Bits of the bitmaps that travel in the last round.
SIGNATURE = 2048
#: Width, as a power of two, of the sparse bitmaps that pairs are tested with next.
SPARSE_BITS = 20


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one shingle, one without words none."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    n = min(words, len(found))
    return np.unique(gram_hashes(word_hashes(found), n, seed=16 + n))


def least_overlap(n: int, percent: int) -> int:
    """What a set of n shingles shares with any partner, at least."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """How many of a pair's common shingles the extended prefix of a set of n holds."""
    return max(1, n // 5)


def prefix(n: int, percent: int, extended: bool) -> int:
    return n - least_overlap(n, percent) + (spare(n) if extended else 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    overlap = int((a[at] == b).sum())
    return overlap * (100 + percent) >= percent * (len(a) + len(b))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set: its shingles hashed to bits."""
    sizes = np.array([len(s) for s in sets])
    bits = min(4096, max(64, 1 << int(2 * sizes.max() - 1).bit_length()))
    flat = np.repeat(np.arange(len(sets), dtype=np.int64) * bits, sizes) + (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros(len(sets) * bits, bool)
    out[flat] = True
    return np.packbits(out).view(np.uint64).reshape(len(sets), -1)


def connect(sets: list[np.ndarray], label: np.ndarray, percent: int, across: np.ndarray | None = None) -> np.ndarray:
    """Labels after joining all linked sets of different labels; ``across``: compare only sets of different cells."""
    label = label.copy()
    if len(np.unique(label)) < 2:
        return label
    sizes = np.array([len(s) for s in sets], np.int64)
    signs = bitmaps(sets)
    grams = np.concatenate(sets)
    _, where, often = np.unique(grams, return_inverse=True, return_counts=True)
    central = np.add.reduceat(often[where], np.concatenate(([0], np.cumsum(sizes)[:-1]))) / sizes
    done = np.zeros(len(sets), bool)
    # the set that shares most comes first: it connects a group of copies at once
    for i in np.argsort(-central, kind="stable"):
        done[i] = True
        open_ = (label != label[i]) & ~done & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if across is not None:
            open_ &= across != across[i]
        near = np.flatnonzero(open_)
        if not len(near):
            continue
        both = signs[near]
        missing = np.bitwise_count(signs[i] & ~both).sum(1, dtype=np.int64)
        surplus = np.bitwise_count(both & ~signs[i]).sum(1, dtype=np.int64)
        bound = np.minimum(sizes[i] - missing, sizes[near] - surplus)
        may = bound * (100 + percent) >= percent * (sizes[near] + sizes[i])
        near, bound = near[may], bound[may]
        for j in near[np.argsort(-bound, kind="stable")]:
            if label[j] != label[i] and linked(sets[i], sets[j], percent):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label[label == old] = new
        if not (label != label[i]).any():
            break
    return label


def found_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, key, grams)``: key only for suspects, grams once per key and batch."""
    bits = part_bits(docs)
    packed = pack(docs.select("doc_id", "text"))

    def sets_of(table: pa.Table) -> tuple[list, list[np.ndarray]]:
        return column(table, "doc_id").to_pylist(), [shingles(t, words) for t in raw_texts(table)]

    def prefixes(ids: list, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # the smallest hashes, made uniform again
        heads = [mixed(~s[: prefix(len(s), percent, True)]) if d is not None and len(s) else s[:0] for d, s in zip(ids, sets)]
        distinct, which, n = np.unique(np.concatenate([np.empty(0, np.uint64), *heads]), return_inverse=True, return_counts=True)
        return distinct, n > 1, np.split(which, np.cumsum([len(h) for h in heads])[:-1]) if heads else []

    def ask(batch_id: int, table: pa.Table, _: dict) -> Iterator[dict]:
        distinct, shared, _w = prefixes(*sets_of(table))
        yield from send(batch_id, bits, distinct, shared=shared)

    def repeated(hashes: np.ndarray, owner: np.ndarray, shared: np.ndarray) -> np.ndarray:
        order, starts = grouped(hashes)
        sizes = np.diff(np.append(starts, len(order)))
        out = np.zeros(len(order), bool)
        out[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(shared[order], starts), sizes)
        return out

    def suspect(_: int, table: pa.Table, row: dict) -> Iterator[dict]:
        import xxhash

        ids, sets = sets_of(table)
        distinct, _s, which = prefixes(ids, sets)
        again = received(row["answers"], bool, len(distinct))
        keys, grams, seen = [], [], set()
        for s, w in zip(sets, which):
            n = len(s)
            key = None
            if len(w) and int(again[w].sum()) >= spare(least_overlap(n, percent)):
                key = xxhash.xxh3_128_digest(s.tobytes())
            keys.append(key)
            grams.append(s.tobytes() if key is not None and key not in seen else None)
            seen.add(key)
        yield {"doc_id": ids, "n_shingles": [len(s) for s in sets], "key": keys, "grams": grams}

    answers = resolve(map_batches(packed, ask, "part long, batch_id long, hashes binary, shared binary"), repeated, bits, bool, shared=bool)
    return map_batches(packed.join(answers, "batch_id", "left"), suspect, "doc_id long, n_shingles long, key binary, grams binary")


def keyed(classes: DataFrame, keys: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(key, c, n, turn)``: a row for each of ``keys(grams)``, numbered by ``turn``."""
    schema = "key long, c long, n int, turn int"
    target = arrow_schema(classes.sparkSession, schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(g, np.uint64) for g in column(batch, "grams").to_pylist()]
            ks = [keys(g) for g in found]
            times = [len(k) for k in ks]
            if ks:
                yield record({"key": np.concatenate(ks).view(np.int64), "c": np.repeat(column(batch, "c").to_numpy(), times), "n": np.repeat([len(g) for g in found], times).astype(np.int32), "turn": np.concatenate([np.arange(t, dtype=np.int32) for t in times])}, target)

    return map_rows(classes.select("c", "grams"), rows, schema)


def signatures(classes: DataFrame) -> DataFrame:
    """``(c, sign)``: bitmaps of one width for all classes."""
    target = arrow_schema(classes.sparkSession, "c long, sign binary")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = []
            for grams in column(batch, "grams").to_pylist():
                bit = np.zeros(SIGNATURE, bool)
                bit[(np.frombuffer(grams, np.uint64) & np.uint64(SIGNATURE - 1)).astype(np.int64)] = True
                signs.append(np.packbits(bit).tobytes())
            yield record({"c": column(batch, "c"), "sign": signs}, target)

    return map_rows(classes.select("c", "grams"), rows, "c long, sign binary")


def sketch(grams: np.ndarray) -> bytes:
    """The shingles' leading bits in order, as differences: a sparse bitmap of 2**SPARSE_BITS bits with repeats."""
    steps = np.diff((grams >> np.uint64(64 - SPARSE_BITS)).astype(np.int64), prepend=0)
    wide = bool(len(steps)) and steps.max() > 0xFFFF
    return (b"\1" if wide else b"\0") + steps.astype(np.uint32 if wide else np.uint16).tobytes()


def sketched(data: bytes) -> np.ndarray:
    """Distinct numbers for a sketch's bits, the k-th repeat of a bit having its own."""
    bits = np.cumsum(np.frombuffer(data[1:], np.uint32 if data[0] else np.uint16), dtype=np.int64)
    at = np.arange(len(bits))
    first = np.maximum.accumulate(np.where(np.diff(bits, prepend=-1) > 0, at, 0))
    return (bits << 24) + at - first


def sketches(classes: DataFrame, name: str) -> DataFrame:
    target = arrow_schema(classes.sparkSession, f"c long, {name} binary")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record({"c": column(batch, "c"), name: [sketch(np.frombuffer(g, np.uint64)) for g in column(batch, "grams").to_pylist()]}, target)

    return map_rows(classes.select("c", "grams"), rows, f"c long, {name} binary")


def passing(pairs: DataFrame, left: DataFrame, right: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs ``(a, b)`` whose values, the second columns of ``left`` and ``right``, pass a test."""
    one, two = left.columns[1], right.columns[1]
    both = pairs.join(left.withColumnRenamed("c", "a"), "a").join(right.withColumnRenamed("c", "b"), "b").select("a", "b", one, two)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [test(x, y) for x, y in zip(column(batch, one).to_pylist(), column(batch, two).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return map_rows(both, rows, "a long, b long")


def bounded_pairs(key: np.ndarray, at: np.ndarray, n: np.ndarray, comp: np.ndarray, signs: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of indices into ``signs`` that share a key, lie in different components and may link by their bitmaps."""
    order = np.lexsort((n, key))
    key, at, n, comp = key[order], at[order], n[order].astype(np.int64), comp[order]
    found: list[np.ndarray] = []
    left, step = np.arange(len(key)), 0
    while len(left):
        step += 1
        left = left[left + step < len(key)]
        right = left + step
        # within a key sizes ascend, so a pair too far apart ends its row
        left = left[(key[left] == key[right]) & (100 * n[left] >= percent * n[right])]
        right = left + step
        i, j = left[comp[left] != comp[right]], right[comp[left] != comp[right]]
        if len(i):
            code = (np.minimum(at[i], at[j]).astype(np.int64) << 32) | np.maximum(at[i], at[j])
            code, first = np.unique(code, return_index=True)
            i, j = i[first], j[first]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                sa, sb = signs[at[a]], signs[at[b]]
                bound = np.minimum(n[a] - np.bitwise_count(sa & ~sb).sum(1, dtype=np.int64), n[b] - np.bitwise_count(sb & ~sa).sum(1, dtype=np.int64))
                found.append(code[k : k + (1 << 16)][bound * (100 + percent) >= percent * (n[a] + n[b])])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def last_links(classes: DataFrame, labels: DataFrame, percent: int, buckets: int, size: int) -> tuple[DataFrame, Stored]:
    """``(a, b)``: every link between different components of ``classes`` with ``c`` and ``grams``; ``labels``: ``(c, comp)``.

    The second result is a table that the links are computed from.
    """
    rows = keyed(classes, lambda grams: grams[: prefix(len(grams), percent, False)]).drop("turn").join(labels, "c")
    shared = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("often")).where("low < high").select("key", "often")
    table = stored(rows.hint("merge").join(shared, "key").select("key", "c", "n", "comp", "often"), size)
    open_rows = in_few(table.df, table.df.count())
    small = open_rows.where(F.col("often") <= LARGE_KEY).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    signs = small.select(F.col("bucket").alias("at"), F.col("c").alias("of")).distinct().join(signatures(classes).withColumnRenamed("c", "of"), "of")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("of").to_numpy()
        order = np.argsort(ids)
        signs_ = np.frombuffer(b"".join(right.column("sign").to_pylist()), np.uint64).reshape(len(ids), -1)[order] if len(ids) else np.empty((0, SIGNATURE // 64), np.uint64)
        ids = ids[order]
        at = np.searchsorted(ids, left.column("c").to_numpy())
        code = bounded_pairs(left.column("key").to_numpy(), at, left.column("n").to_numpy(), left.column("comp").to_numpy(), signs_, percent)
        return pa.table({"a": ids[code >> 32], "b": ids[code & 0xFFFFFFFF]}) if len(code) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    pairs = small.select("bucket", "key", "c", "n", "comp").groupBy("bucket").cogroup(signs.groupBy("at")).applyInArrow(compare, "a long, b long").distinct()
    # a finer bitmap thins the pairs out before whole sets are fetched
    thin = passing(pairs, sketches(classes, "sketch_a"), sketches(classes, "sketch_b"), lambda x, y: linked(sketched(x), sketched(y), percent))
    sets = classes.select("c", "grams")
    exact = passing(thin, sets.withColumnRenamed("grams", "grams_a"), sets.withColumnRenamed("grams", "grams_b"), lambda x, y: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
    large = open_rows.where(F.col("often") > LARGE_KEY).select("key", "c", "n", "comp")
    return exact.unionByName(tile_links(classes, large, percent)), table


def compared(sent: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links that connect the components in each tile of ``(tile, c, comp, grams, side, two)``."""

    def compare(table: pa.Table) -> pa.Table:
        comp = table.column("comp").to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        side = table.column("side").to_numpy() if table.column("two")[0].as_py() else None
        new = connect(sets, comp, percent, side)
        moved = np.flatnonzero(new != comp)
        return pa.table({"a": comp[moved], "b": new[moved]})

    return sent.groupBy("tile").applyInArrow(tidied(compare), "a long, b long").distinct()


def cell_links(classes: DataFrame, rows: DataFrame, percent: int, turn: int, n: int) -> DataFrame:
    """``(a, b)``: links found in cells: classes that share a key, are of a size band, and fall into one of its cells.

    ``rows`` has ``key``, ``c``, ``n`` and ``comp``. Keys and bands of a single component are left alone. ``turn``
    moves the bands' bounds and deals the cells anew.
    """
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)) + 0.5 * turn + 1e-9)
    member = rows.select("c", "comp", F.xxhash64("key", band).alias("key"), "n")
    open_ = member.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.sum("n") / CELL).alias("cells")).where("low < high").select("key", "cells")
    dealt = member.hint("merge").join(open_, "key").select(F.xxhash64("key", F.pmod(F.xxhash64("c", F.lit(turn)), F.col("cells"))).alias("tile"), "c", "comp")
    sent = in_few(dealt, n).hint("merge").join(classes.select("c", "grams"), "c")
    return compared(sent.withColumn("side", F.lit(0).cast("long")).withColumn("two", F.lit(False)), percent)


def tile_links(classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links that connect the components of ``classes`` that share a key.

    Only keys that several components share matter. Their classes are dealt into cells by size band and hash; the
    number of cells of a band follows from its shingles, so a key that a third of all classes share gives many
    tiles of bounded size.
    """
    mixed_keys = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    ratio = float(np.log(100 / percent))
    member = rows.join(mixed_keys, "key").withColumn("band", F.floor(F.log(F.col("n")) / ratio + 1e-9).cast("int"))
    cells = member.groupBy("key", "band").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("cells"))
    above = cells.select("key", (F.col("band") - 1).alias("band"), F.col("cells").alias("above"))
    below = cells.select("key", (F.col("band") + 1).alias("band"), F.col("cells").alias("below"))
    dealt = (
        member.join(cells, ["key", "band"])
        .join(above, ["key", "band"], "left")
        .join(below, ["key", "band"], "left")
        .withColumn("cell", F.pmod(F.xxhash64("c"), F.col("cells")).cast("int"))
    )
    # a tile is (key, lower band and cell, upper band and cell); a class goes to all tiles that its cell is part of
    own = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda x: F.struct(F.col("band").alias("b1"), F.least(x, "cell").alias("c1"), F.col("band").alias("b2"), F.greatest(x, "cell").alias("c2")))
    up = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda x: F.struct(F.col("band").alias("b1"), F.col("cell").alias("c1"), (F.col("band") + 1).alias("b2"), x.alias("c2"))))
    down = F.when(F.col("below").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda x: F.struct((F.col("band") - 1).alias("b1"), x.alias("c1"), F.col("band").alias("b2"), F.col("cell").alias("c2"))))
    nothing = F.array().cast("array<struct<b1:int,c1:int,b2:int,c2:int>>")
    tiles = dealt.select("key", "c", "comp", "band", "cell", F.explode(F.concat(own, F.coalesce(up, nothing), F.coalesce(down, nothing))).alias("t")).select(F.xxhash64("key", "t.b1", "t.c1", "t.b2", "t.c2").alias("tile"), "c", "comp", (F.xxhash64("band", "cell")).alias("side"), (F.expr("t.b1 <> t.b2 or t.c1 <> t.c2")).alias("two"))
    # tiles of a single component need no sets
    open_tiles = tiles.groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("tile")
    sent = tiles.join(open_tiles, "tile").join(classes.select("c", "grams"), "c")

    return compared(sent, percent)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row.

    A document without words, or with a null text, has no shingles and is its own component. Rows without a
    ``doc_id`` get no component and link with nothing. Rows that share an id count as documents of their own.
    """
    size = plan_bytes(docs)
    found = stored(found_sets(docs, words, percent), 2 * size)
    classes = stored(found.df.where("key is not null").groupBy("key").agg(F.min("doc_id").cast("long").alias("c"), F.first("grams", ignorenulls=True).alias("grams")), 2 * size)
    ends = cut(found.df.select("doc_id", "n_shingles", "key"), size // 8)
    found.drop()
    turns = multipliers(ROUNDS, 7)
    n = classes.df.count()
    keys = stored(keyed(classes.df, lambda grams: mixed(grams[None, :] * turns[:, None]).min(1)), size)
    labels = in_few(classes.df.select("c", F.col("c").alias("comp")), n)
    for turn in range(ROUNDS):
        rows = in_few(keys.df.where(F.col("turn") == turn).join(labels, "c"), n)
        labels = relabelled(labels, cell_links(classes.df, rows, percent, turn, n), n)
    keys.drop()
    links, table = last_links(classes.df, labels, percent, 1 << max(4, part_bits(docs) - 2), size)
    labels = relabelled(labels, links, n)
    table.drop()
    members = cut(in_few(classes.df.select("key", "c").join(labels, "c").select("key", F.col("comp").alias("label")), n))
    classes.drop()
    return in_large(ends.join(members, "key", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")), size)


def relabelled(labels: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """``(c, comp)`` after joining the components at the ends of ``links``."""
    whole = components(links, n).select(F.col("node").alias("comp"), "label")
    return cut(in_few(labels.hint("merge").join(whole, "comp", "left").select("c", F.coalesce("label", "comp").alias("comp")), n))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its component, and rows without an id."""
    gone = near_duplicates(docs, words, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*map(quoted, docs.columns))
