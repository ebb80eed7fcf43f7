"""Pack documents into training sequences: first-fit decreasing over a tournament tree, in randomised groups.

Documents are tokenised where they are read. A document longer than a sequence fills whole sequences and leaves
one rest; a rest is never cut. Only the numbers of a piece are shuffled, never its text or ids. The groups come
from a hash of the document, so each is a random sample of the lengths and is packed on its own.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.bpe import TextEncoder
from kindred.llm.frames import TABLES, arrow_schema, column, map_rows, record

CAPACITY = 2048
#: Documents in a group, on average.
GROUP_DOCS = 4096
#: A group with more pieces is packed in runs of this many.
MOST_PIECES = 1 << 16


class Bins:
    """Open bins in order, below a tournament tree of what each can still hold."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and the room that it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        bin_number = at - self.leaves
        room[at] = had - size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return bin_number, had


def first_fit_decreasing(sizes: Iterable[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the sizes, which must be in descending order and at most the capacity."""
    sizes = list(sizes)
    bins = Bins(max(1, len(sizes)), capacity)
    placed = [bins.place(s) for s in sizes]
    return np.array([b for b, _ in placed], np.int64), np.array([capacity - room for _, room in placed], np.int64)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary of a byte-level tokenizer file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class AddedTokens:
    """An encoder that gives the added tokens inside a text their own ids, as the tokenizers library does."""

    def __init__(self, encoder: TextEncoder, added: dict[str, int]):
        self.encoder, self.added = encoder, added
        self._split = re.compile("|".join(f"({re.escape(x)})" for x in sorted(added, key=len, reverse=True)) or r"(?!)").split

    def ids(self, text: str) -> bytes:
        if not any(x in text for x in self.added):
            return self.encoder.ids(text)
        return b"".join(struct.pack("<I", self.added[x]) if x in self.added else self.encoder.ids(x) for x in self._split(text) if x)


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> AddedTokens:
    """The byte-level vocabulary of a tokenizers file as an encoder of whole texts."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if any(x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take white space or need word boundaries aren't supported")
    alphabet = byte_alphabet()
    ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
    plain = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return AddedTokens(TextEncoder(pattern, lambda piece: plain._core_bpe.encode_single_piece(piece)), special)


TABLES.append(tokenizer.cache_clear)


def pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int | None, capacity: int) -> DataFrame:
    """Every document's pieces with their lengths and checksums, and 63 random bits that follow from the document.

    The k-th of equal rows in a partition has bits of its own, in whatever order they come, so that repeated rows
    spread over the groups.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, dice long"
    target = arrow_schema(docs.sparkSession, schema)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids_of = encoder()
        often: Counter[int] = Counter()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                ids = ids_of(text or "") + end
                n = len(ids) // 4
                row = xxhash.xxh3_64_intdigest(f"{doc_id}:{n}:{zlib.crc32(ids)}".encode())
                dice = xxhash.xxh3_64_intdigest(struct.pack("<QQ", row, often[row])) >> 1
                often[row] += 1
                out += [(doc_id, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)]), n, dice) for a in range(0, n, capacity)]
            yield record(dict(zip(target.names, map(list, zip(*out)) if out else [[] for _ in target.names])), target)

    return map_rows(docs.select("doc_id", "text"), rows, schema, keeps_tables=True)


def pack_pieces(cut: DataFrame, groups: int, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; ``cut`` has ``length`` and ``dice``."""
    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes if n != "dice") + ", sequence_id long, offset long"
    names = [n for n in cut.columns if n != "dice"]

    def group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("dice", "ascending"), ("start", "ascending")])
        first, done = 0, []
        for at in range(0, table.num_rows, MOST_PIECES):
            run = table.slice(at, MOST_PIECES)
            bins, offsets = first_fit_decreasing(run.column("length").to_pylist(), capacity)
            bins += first
            first = int(bins.max()) + 1
            done.append(run.select(names).append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets)))
        return pa.concat_tables(done)

    return cut.withColumn("group", F.pmod(F.col("dice"), F.lit(groups))).groupBy("group").applyInArrow(lambda k, t: group(k, t), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int | None = 1, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Sequences of at most ``capacity`` tokens from all documents, a row per piece.

    A null or empty text is a document of the end token alone (without an end token it has no piece). A null
    ``doc_id`` stays null; repeated rows are packed as often as they occur. An empty table gives no rows. Columns
    other than ``doc_id`` and ``text`` are not read.
    """
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, lambda: tokenizer(tokenizer_path, pattern).ids, end_id, capacity)
    return pack_pieces(cut, groups, capacity)
