"""Substring deduplication by seed and extend.

A match of ``length`` words between two documents holds the same winnowed anchor in both: the smallest hash among
the short word runs inside it. Anchors are the seeds. In a first exchange, documents meet on their anchors; one that
occurs in a single document is no seed. In a second exchange, each place of a repeated seed meets the others with the
words to its left and right, as many as the longest match around it can reach without holding another anchor. There
matches are extended both ways, word by word: places that agree on ``l`` words to the left and ``r`` to the right
share a repeat, and the smallest document among them keeps it. Repeats that reach the threshold come back to each
place; repeats of neighbouring anchors join to maximal ones, and all words in them go, except in the smallest
document. Places of a batch with the same surroundings are sent as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from kindred.llm.frames import column, gram_hashes, grouped, map_batches, mixed, multipliers, pack, part_bits, raw_texts, received, renamed, resolve, send, word_hashes

#: Words in the shortest repeat, and in an anchor.
LENGTH = 13
ANCHOR = 5


class Places:
    """Where a batch's documents have their anchors.

    The word hashes of all documents lie in one array, with room between documents for the reach of an extension.
    """

    def __init__(self, texts: list[bytes], docs: list, length: int, anchor: int):
        self.words = [t.split() for t in texts]
        self.length, self.anchor, self.reach = length, anchor, length - anchor
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = self.reach + np.cumsum(sizes + self.reach) - (sizes + self.reach)
        self.hashes = np.zeros(int(sizes.sum()) + self.reach * (len(sizes) + 1) + length, np.uint64)
        of_word = np.repeat(self.starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        self.hashes[of_word] = word_hashes([w for words in self.words for w in words])
        self.sizes = sizes
        grams = gram_hashes(self.hashes, anchor)
        windows = np.where([d is not None for d in docs], np.maximum(0, sizes - length + 1), 0).astype(np.int64)
        first = np.repeat(self.starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        #: Places of anchors, the row of each, its document, its hash made uniform again, and the words around it.
        self.at = np.unique(first + sliding_window_view(grams, self.reach + 1).argmin(1)[first])
        self.row = np.searchsorted(self.starts, self.at, "right") - 1
        self.doc = np.array([0 if d is None else d for d in docs], np.int64)[self.row] if len(self.at) else np.empty(0, np.int64)
        self.keys = mixed(~grams[self.at])
        self.left = np.minimum(self.at - self.starts[self.row], self.reach)
        self.right = np.minimum((self.starts + sizes)[self.row] - self.at - anchor, self.reach)

    def around(self, some: np.ndarray) -> np.ndarray:
        """The hashes of the words to the left of some places, nearest first, and of those to the right."""
        steps = np.concatenate((-1 - np.arange(self.reach), self.anchor + np.arange(self.reach)))
        return self.hashes[self.at[some][:, None] + steps[None, :]]


def seeds(p: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct anchors of a batch, whether documents of the batch share each, and each place's index in them."""
    distinct, which = np.unique(p.keys, return_inverse=True)
    smallest, largest = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(smallest, which, p.doc)
    np.maximum.at(largest, which, p.doc)
    return distinct, smallest < largest, which


def surroundings(p: Places, seeded: np.ndarray):
    """Places of repeated seeds by what is around them: the places, their order, each group's start, first and smallest document."""
    some = np.flatnonzero(seeded)
    words = p.around(some)
    high, low = ((words * multipliers(words.shape[1], seed)[None, :]).sum(1, dtype=np.uint64) for seed in (4, 5))
    # what lies beyond a document's end is no word
    order, starts = grouped(p.keys[some], mixed(high), mixed(low), p.left[some], p.right[some])
    smallest = np.minimum.reduceat(p.doc[some][order], starts) if len(starts) else p.doc[:0]
    return some, order, starts, order[starts], words, smallest


def repeats(keys: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bits for each place of an anchor: bit l, if a smaller document agrees on l words to the left and the rest to the right."""
    reach = words.shape[1] // 2
    chains = []
    for side in (words[:, :reach], words[:, reach:]):
        # the hash of the anchor and of ever more words on one side
        chain = [mixed(keys)]
        for k in range(reach):
            chain.append(mixed(chain[-1] * np.uint64(0x9E3779B97F4A7C15) + side[:, k]))
        chains.append(chain)
    out = np.zeros(len(keys), np.uint16)
    for l in range(reach + 1):  # noqa: E741
        some = np.flatnonzero((left >= l) & (right >= reach - l))
        if len(some):
            order, starts = grouped(chains[0][l][some], chains[1][reach - l][some])
            least = np.repeat(np.minimum.reduceat(doc[some][order], starts), np.diff(np.append(starts, len(order))))
            out[some[order]] |= (least < doc[some][order]).astype(np.uint16) << np.uint16(l)
    return out


def removed_words(p: Places, some: np.ndarray, bits: np.ndarray) -> list[np.ndarray | None]:
    """For each document a mask of the words in its maximal repeats; None without any."""
    depth = np.zeros(len(p.hashes) + 1, np.int32)
    for l in range(p.reach + 1):  # noqa: E741
        begin = p.at[some[(bits >> np.uint16(l)) & np.uint16(1) == 1]] - l
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + p.length, -1)
    gone = np.cumsum(depth) > 0
    return [part if part.any() else None for part in (gone[s : s + n] for s, n in zip(p.starts.tolist(), p.sizes.tolist()))]


def drop_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep_columns: bool = False) -> DataFrame:
    """Remove each word in a run of ``length`` words that also starts in a document with a smaller id.

    Returns a digest per row or, with ``keep_columns``, the columns of ``docs`` with the kept words joined by one
    space as ``text`` (untouched where nothing goes). Null and empty texts have no words. A row without a
    ``doc_id`` keeps its words and is no one's first occurrence; rows that share an id don't remove each other's.
    """
    names, docs = docs.columns, renamed(docs)
    bits = part_bits(docs)
    packed = pack(docs if keep_columns else docs.select("doc_id", "text"))
    reach = length - anchor
    #: The words around a place, as one value.
    around = np.dtype((np.void, 16 * reach))

    def places(table: pa.Table) -> Places:
        return Places(raw_texts(table), column(table, "doc_id").to_pylist(), length, anchor)

    def ask_seeds(batch_id: int, table: pa.Table, _: dict) -> Iterator[dict]:
        distinct, shared, _which = seeds(places(table))
        yield from send(batch_id, bits, distinct, shared=shared)

    def repeated_seeds(hashes: np.ndarray, owner: np.ndarray, shared: np.ndarray) -> np.ndarray:
        order, starts = grouped(hashes)
        sizes = np.diff(np.append(starts, len(order)))
        out = np.zeros(len(order), bool)
        out[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(shared[order], starts), sizes)
        return out

    def seeded(p: Places, row: dict) -> np.ndarray:
        distinct, _, which = seeds(p)
        return received(row["seeds"], bool, len(distinct))[which]

    def ask_places(batch_id: int, table: pa.Table, row: dict) -> Iterator[dict]:
        p = places(table)
        some, _order, _starts, first, words, smallest = surroundings(p, seeded(p, row))
        room = (p.left[some][first] | p.right[some][first] << 8).astype(np.uint16)
        yield from send(batch_id, bits, p.keys[some][first], around=np.ascontiguousarray(words[first]).view(around).ravel(), room=room, doc=smallest)

    def extended(keys: np.ndarray, owner: np.ndarray, around: np.ndarray, room: np.ndarray, doc: np.ndarray) -> np.ndarray:
        words = np.frombuffer(around.tobytes(), np.uint64).reshape(len(keys), -1)
        return repeats(keys, words, room & np.uint16(0xFF), room >> np.uint16(8), doc)

    answers = resolve(map_batches(packed, ask_seeds, "part long, batch_id long, hashes binary, shared binary"), repeated_seeds, bits, bool, shared=bool).withColumnRenamed("answers", "seeds")
    asked = map_batches(packed.join(answers, "batch_id", "left"), ask_places, "part long, batch_id long, hashes binary, around binary, room binary, doc binary")
    found = resolve(asked, extended, bits, np.uint16, around=around, room=np.uint16, doc=np.int64)
    schema = docs.schema if keep_columns else "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def finish(_: int, table: pa.Table, row: dict) -> Iterator[dict]:
        p = places(table)
        some, order, starts, _first, _words, smallest = surroundings(p, seeded(p, row))
        sizes = np.diff(np.append(starts, len(order)))
        mine = np.zeros(len(order), np.uint16)
        mine[order] = np.repeat(received(row["answers"], np.uint16, len(starts)), sizes)
        # a smaller document of the batch with the same surroundings shares whatever they hold
        least = np.zeros(len(order), np.int64)
        least[order] = np.repeat(smallest, sizes)
        for l in range(reach + 1):  # noqa: E741
            whole = (least < p.doc[some]) & (p.left[some] >= l) & (p.right[some] >= reach - l)
            mine |= whole.astype(np.uint16) << np.uint16(l)
        gone = removed_words(p, some, mine)
        if keep_columns:
            was = column(table, "text").to_pylist()
            new = [t if g is None else b" ".join([x for x, r in zip(words, g.tolist()) if not r]).decode("utf-8", "surrogatepass") for t, words, g in zip(was, p.words, gone)]
            yield {n: column(table, n) for n in table.column_names} | {"text": new}
        else:
            kept = [words if g is None else [x for x, r in zip(words, g.tolist()) if not r] for words, g in zip(p.words, gone)]
            yield {
                "doc_id": column(table, "doc_id"),
                "n_words": [len(x) for x in p.words],
                "n_removed": [0 if g is None else int(g.sum()) for g in gone],
                "kept_sha256": [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept],
            }

    joined = packed.join(answers, "batch_id", "left").join(found, "batch_id", "left")
    out = map_batches(joined, finish, schema)
    return out.toDF(*names) if keep_columns else out
