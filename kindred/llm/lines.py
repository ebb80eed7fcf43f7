"""Line deduplication: two Bloom filters find suspects, and only suspects are shuffled.

The first pass puts the hash of every line into a filter of hashes seen once and, when it is there already, into
one of hashes seen twice. Filters of tasks are merged slice by slice. A line whose hash is not in the second
filter occurs in one document only, and a document without suspected lines is finished where it is read. The other
documents are packed, and the digests of their suspected lines go to the owner of their part of the hash space,
which confirms exact repeats and names the smallest document that holds each. False positives of the filters cost
a shuffle and change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.frames import arrow_schema, column, grouped, grow, map_batches, map_rows, pack, part_bits, plan_bytes, raw_texts, received, record, renamed, resolve, send, shrink

#: Shorter lines stay wherever they are.
LEAST_CHARS = 10
#: Filter bits for each estimated line, and the bound of a filter: a filter of 2**26 bits has 8 MB. Past that
#: bound more lines are suspects; results stay the same.
BITS_PER_LINE = 8
BYTES_PER_LINE = 100
MOST_BITS = 26
PROBES = 3
SLICES = 16


def line_key(line: bytes) -> bytes | None:
    """A line without white space at its ends, A-Z in lower case; None if it is too short to be judged."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < LEAST_CHARS or not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < LEAST_CHARS:
        return None
    return key


def digests(texts: list[bytes], docs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit digests of all judged lines of a batch as two halves, and the row of each."""
    import xxhash

    data, rows = [], []
    for row, (text, doc) in enumerate(zip(texts, docs)):
        if doc is not None:
            keys = [xxhash.xxh3_128_digest(k) for x in text.split(b"\n") if (k := line_key(x)) is not None]
            data += keys
            rows += [row] * len(keys)
    both = np.frombuffer(b"".join(data), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1], np.array(rows, np.int64)


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = np.uint64(64 // PROBES)
    return [((hashes >> (step * np.uint64(i))) ^ (hashes << np.uint64(i))) & np.uint64((1 << bits) - 1) for i in range(PROBES)]


def filters(docs: DataFrame, bits: int) -> np.ndarray:
    """The filter of hashes seen in two documents or more, as a packed bit array."""
    schema = "slice int, once binary, twice binary"
    target = arrow_schema(docs.sparkSession, schema)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the lower bit: seen once, the other: twice
        seen = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            high, _, rows = digests(raw_texts(batch), ids)
            owner = np.array([-1 if x is None else x for x in ids], np.int64)[rows] if len(rows) else rows
            order, starts = grouped(high, owner)
            per_doc = high[order[starts]]  # sorted; a hash once for each document
            new = np.ones(len(per_doc), bool)
            new[1:] = per_doc[1:] != per_doc[:-1]
            again = ~new
            first = per_doc[new]
            known = np.logical_and.reduce([seen[p] & 1 == 1 for p in probes(first, bits)]) if len(first) else np.zeros(0, bool)
            for p in probes(np.concatenate((first[known], per_doc[again])), bits):
                seen[p] |= 2
            for p in probes(first, bits):
                seen[p] |= 1
        for k, part in enumerate(np.split(seen, SLICES)):
            yield record({"slice": [k], "once": [shrink(np.packbits(part & 1))], "twice": [shrink(np.packbits(part >> 1))]}, target)

    def merge(table: pa.Table) -> pa.Table:
        once = twice = np.zeros((1 << bits) // 8 // SLICES, np.uint8)
        for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist()):
            a, b = grow(a, np.uint8), grow(b, np.uint8)
            once, twice = once | a, twice | b | (once & a)
        return pa.table({"slice": table.column("slice").slice(0, 1), "twice": pa.array([shrink(twice)], pa.binary())})

    got = map_rows(docs.select("doc_id", "text"), build, schema).groupBy("slice").applyInArrow(merge, "slice int, twice binary").collect()
    found = {r["slice"]: grow(bytes(r["twice"]), np.uint8) for r in got}
    empty = np.zeros((1 << bits) // 8 // SLICES, np.uint8)
    return np.concatenate([found.get(k, empty) for k in range(SLICES)])


def suspected(high: np.ndarray, twice: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the filter holds."""
    keep = np.ones(len(high), bool)
    for p in probes(high, bits):
        keep &= (twice[(p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return keep


def suspects(docs: list, texts: list[bytes], twice: np.ndarray, bits: int):
    """Distinct suspected digests of a batch, sorted; for each its smallest document and whether others have it."""
    high, low, rows = digests(texts, docs)
    keep = suspected(high, twice, bits)
    high, low, rows = high[keep], low[keep], rows[keep]
    owner = np.array([-1 if x is None else x for x in docs], np.int64)[rows] if len(rows) else rows
    order, starts = grouped(high, low)
    if not len(starts):
        return high, low, owner, np.zeros(0, bool)
    smallest = np.minimum.reduceat(owner[order], starts)
    largest = np.maximum.reduceat(owner[order], starts)
    first = order[starts]
    return high[first], low[first], smallest, smallest < largest


def drop_repeats(docs: DataFrame, keep_columns: bool = False) -> DataFrame:
    """Drop each line that a document with a smaller id holds as well; see ``line_key`` for what counts as the same.

    With ``keep_columns`` the columns of ``docs`` come back with the lines gone from ``text``; otherwise a digest
    per row. A null text is one empty line (it stays null among kept columns). Rows without a ``doc_id`` keep all
    their lines and are no one's first occurrence; rows that share a ``doc_id`` are one document.
    """
    names, docs = docs.columns, renamed(docs)
    bits = max(16, min(MOST_BITS, int(plan_bytes(docs) * BITS_PER_LINE / BYTES_PER_LINE).bit_length()))
    pbits = max(4, part_bits(docs) - 3)
    twice = docs.sparkSession.sparkContext.broadcast(filters(docs, bits))
    schema = docs.schema if keep_columns else "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    source = docs if keep_columns else docs.select("doc_id", "text")
    of_result = arrow_schema(docs.sparkSession, schema)

    def has_suspects(batch: pa.RecordBatch, texts: list[bytes]) -> np.ndarray:
        high, _, rows = digests(texts, column(batch, "doc_id").to_pylist())
        return np.bincount(rows[suspected(high, twice.value, bits)], minlength=batch.num_rows) > 0

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch)
            clean = np.flatnonzero(~has_suspects(batch, texts))
            part = batch.take(pa.array(clean))
            if keep_columns:
                yield record({n: column(part, n) for n in part.schema.names}, of_result)
            else:
                whole = [texts[i] for i in clean]
                yield record({"doc_id": column(part, "doc_id"), "n_lines": [t.count(b"\n") + 1 for t in whole], "n_dropped": [0] * len(whole), "kept_sha256": [hashlib.sha256(t).hexdigest() for t in whole]}, of_result)

    packed = pack(source, keep=lambda batch: has_suspects(batch, raw_texts(batch)))

    def ask(batch_id: int, table: pa.Table, _: dict) -> Iterator[dict]:
        high, low, smallest, several = suspects(column(table, "doc_id").to_pylist(), raw_texts(table), twice.value, bits)
        yield from send(batch_id, pbits, high, low=low, doc=smallest, several=several)

    def answer(high: np.ndarray, owner: np.ndarray, low: np.ndarray, doc: np.ndarray, several: np.ndarray) -> np.ndarray:
        order, starts = grouped(high, low)
        smallest, largest = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
        repeated = (smallest < largest) | np.logical_or.reduceat(several[order], starts)
        which = np.zeros(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        # the document that keeps the line; without repeats nobody loses it
        return np.where(repeated, smallest, np.iinfo(np.int64).max)[which]

    asked = map_batches(packed, ask, "part long, batch_id long, hashes binary, low binary, doc binary, several binary")
    answers = resolve(asked, answer, pbits, np.int64, low=np.uint64, doc=np.int64, several=bool)

    def finish(_: int, table: pa.Table, row: dict) -> Iterator[dict]:
        import xxhash

        ids, texts = column(table, "doc_id").to_pylist(), raw_texts(table)
        high, low, _s, _m = suspects(ids, texts, twice.value, bits)
        keeper = dict(zip(zip(high.tolist(), low.tolist()), received(row["answers"], np.int64, len(high)).tolist()))
        keeper = {k: v for k, v in keeper.items() if v != np.iinfo(np.int64).max}
        lines_n, dropped_n, kept = [], [], []
        for doc, text in zip(ids, texts):
            lines = text.split(b"\n")
            stay = lines
            if keeper and doc is not None:
                stay = []
                for line in lines:
                    key = line_key(line)
                    if key is not None:
                        x = xxhash.xxh3_128_intdigest(key)
                        if keeper.get((x >> 64, x & 0xFFFFFFFFFFFFFFFF), doc) != doc:
                            continue
                    stay.append(line)
            lines_n.append(len(lines))
            dropped_n.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        if keep_columns:
            was = column(table, "text").to_pylist()
            new = [w if not d else k.decode("utf-8", "surrogatepass") for w, d, k in zip(was, dropped_n, kept)]
            yield {n: column(table, n) for n in table.column_names} | {"text": new}
        else:
            yield {"doc_id": ids, "n_lines": lines_n, "n_dropped": dropped_n, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

    out = map_rows(source, finished, schema).union(map_batches(packed.join(answers, "batch_id", "left"), finish, schema))
    return out.toDF(*names) if keep_columns else out
