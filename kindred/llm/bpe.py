"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding. ``PrefixEncoder`` stores that
token for each prefix: the last token of a longer prefix is the one vocabulary entry that ends there and forms a
valid pair with the last token stored where it starts. An encoding is read off by walking back from the end. As
the table of a prefix never depends on what follows, bytes can be appended, and after an edit only the part
behind it is computed again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.frames import TABLES, arrow_schema, column, map_rows, record

#: Estimated bytes of each table of pairs, prefixes or chunks that a worker keeps.
MEMO_BYTES = 128 << 20
#: Bytes of an entry next to its key's and value's content, about.
ENTRY = 160


class Memo(dict):
    """A table of at most ``MEMO_BYTES``: when half of that is new, the new entries become the old ones, which go.

    Entries in use are found among the old ones and become new again.
    """

    def __init__(self):
        super().__init__()
        self.spent, self.old = 0, {}

    def keep(self, key, value, size: int) -> None:
        self.spent += ENTRY + size
        if self.spent > MEMO_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.spent = ENTRY + size
        self[key] = value


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes pieces of bytes by the ranks of a byte-level vocabulary."""

    #: Prefixes of these lengths keep their tables, so that words with a common beginning share them.
    KEPT = (12, 9, 6, 3)

    def __init__(self, ranks: dict[bytes, int]):
        self._prefixes = Memo()
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Every ending of a token, with the rank of the token that it is itself, or -1.
        self.endings = {token[k:]: ranks.get(token[k:], -1) for token in ranks for k in range(len(token))}
        self._pairs = Memo()

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none can be merged."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    at, best = i, rank
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _valid(self, before: int, token: int) -> bool:
        """Whether the two tokens encode their joined bytes; before -1: whether the token encodes its own."""
        got = self._pairs.old.get((before, token))
        if got is None:
            data = self.tokens[token] if before < 0 else self.tokens[before] + self.tokens[token]
            got = self.merged(data) == ([token] if before < 0 else [before, token])
        self._pairs.keep((before, token), got, 64)
        return got

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last``, which holds the last token of each prefix so far, up to the end of ``data``."""
        ending, known = self.endings.get, self._pairs.get
        for end in range(len(last) + 1, len(data) + 1):
            # the tokens that end here, from the shortest to the longest
            found, start = [], end - 1
            while start >= 0 and (token := ending(data[start:end])) is not None:
                if token >= 0:
                    found.append((start, token))
                start -= 1
            for start, token in reversed(found):
                before = last[start - 1] if start else -1
                good = known((before, token))
                if self._valid(before, token) if good is None else good:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        for k in self.KEPT:
            if len(piece) > k and (got := self._prefixes.get(piece[:k]) or self._prefixes.old.get(piece[:k])):
                last = list(got)
                break
        known = len(last)
        self.extend(piece, last)
        for k in self.KEPT:
            if known < k < len(piece):
                self._prefixes.keep(piece[:k], tuple(last[:k]), 9 * k)
        return self.walk(last)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """A piece whose encoding follows appends and edits."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.encoder.extend(self.data, self.last)

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put ``data`` in place of the bytes from start to end; prefixes before start keep their entries."""
        self.data = self.data[:start] + data + self.data[end:]
        del self.last[start:]
        self.encoder.extend(self.data, self.last)

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last)


def compiled(pattern: str):
    """The splitting pattern needs categories of characters, which the standard library lacks."""
    import regex

    return regex.compile(pattern)


class TextEncoder:
    """Texts to token ids as little-endian bytes; keeps the ids of chunks between single spaces.

    A single space between two characters that are no white space always begins a match of the pattern, so a text
    can be cut there and the chunks be encoded apart.
    """

    def __init__(self, pattern: str, encode_piece: Callable[[bytes], list[int]]):
        pieces = compiled(pattern).findall

        class Table(Memo):
            def __init__(self, before: str):
                super().__init__()
                self.before = before

            def __missing__(self, chunk: str) -> bytes:
                got = self.old.get(chunk)
                if got is not None:
                    self.keep(chunk, got, 2 * len(chunk) + len(got))
                    return got
                found = pieces(self.before + chunk)
                if len(found) > 1 and found[0] != chunk:
                    # a word followed by a comma shares the word's entry
                    got = self[found[0][len(self.before) :]] + b"".join(map(own.__getitem__, found[1:]))
                else:
                    ids = [i for x in found for i in encode_piece(x.encode("utf-8", "surrogatepass"))]
                    got = struct.pack(f"<{len(ids)}I", *ids)
                if len(chunk) < 100:
                    self.keep(chunk, got, 2 * len(chunk) + len(got))
                return got

        #: Chunks at the start of a text, and those after a space.
        own = self.own = Table("")
        self.spaced = Table(" ")

    _odd = re.compile(r"[^\S \n]")
    _single = re.compile(r"(?<=\S) (?=\S)")

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        plain = not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or self._odd.search(text))
        head, *rest = text.split(" ") if plain else self._single.split(text)
        return self.own[head] + b"".join(map(self.spaced.__getitem__, rest))


@lru_cache(2)
def text_encoder(path: str, pattern: str) -> tuple[TextEncoder, list[bytes]]:
    encoder = PrefixEncoder(read_ranks(path))
    table = [encoder.tokens.get(i, b"") for i in range(max(encoder.tokens) + 1)]
    return TextEncoder(pattern, encoder.encode), table


TABLES.extend((read_ranks.cache_clear, text_encoder.cache_clear))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` for each row; a null text has no ids. The vocabulary file must lie on every executor."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>"
    target = arrow_schema(docs.sparkSession, schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = text_encoder(ranks_path, pattern)
        for batch in batches:
            ids = [np.frombuffer(encoder.ids(x or ""), "<u4").astype(np.int32) for x in column(batch, text_col).to_pylist()]
            yield record({id_col: column(batch, id_col), "ids": ids}, target)

    return map_rows(docs.select(id_col, text_col), rows, schema, keeps_tables=True)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode it again; digests of both. A null or empty text has no ids.

    Rows keep their number: repeated rows give repeated results, a null ``doc_id`` stays null.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    target = arrow_schema(docs.sparkSession, schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = text_encoder(ranks_path, pattern)
        token = table.__getitem__
        for batch in batches:
            counts, ids_sums, text_sums = [], [], []
            for text in column(batch, "text").to_pylist():
                ids = encoder.ids(text or "")
                counts.append(len(ids) // 4)
                ids_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(hashlib.sha256(b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))).hexdigest())
            yield record({"doc_id": column(batch, "doc_id"), "n_tokens": counts, "ids_sha256": ids_sums, "decoded_sha256": text_sums}, target)

    return map_rows(docs.select("doc_id", "text"), rows, schema, keeps_tables=True)
