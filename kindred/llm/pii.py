"""Personal data: patterns, and terms that reveal it by how they occur in the corpus.

The patterns find the protected values. A term discloses a value when it occurs in the value's documents so much more
often than by chance that it gives away most of what naming the value would: with document counts,
``PMI(term; value) >= IC(value) / alpha``, where ``PMI = ln(co * N / (df(term) * df(value)))`` and
``IC = -ln(df(value) / N)``. All terms of a document count with each of its values; those with a value in at least
``support`` documents are judged, so values in fewer documents send no terms. All counts are over all documents;
they meet in two hash exchanges, first the values and then the terms.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.frames import column, grouped, map_batches, pack, part_bits, received, renamed, resolve, send, word_hashes

#: Kinds in the order in which spans at one place are listed; ``term`` is what the statistics add.
KINDS = ("email", "ip", "card", "phone", "term")
#: Share of a value's information that a term may give away: 1 / ALPHA.
ALPHA = 1.25
#: Documents in which a term must stand with a value.
SUPPORT = 3
#: Shorter terms are judged unless they are lower-case ASCII letters (at, to, of).
LEAST_TERM = 3

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]+((?:\.[0-9]+){3})")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
#: Punctuation, symbols, spaces and controls beyond ASCII.
_separators = "".join(c for c in map(chr, range(128, 65536)) if unicodedata.category(c)[0] in "PSZ" or unicodedata.category(c) == "Cc")
_mark = re.compile(f"[{_separators}]")
_term = re.compile(rf"[^\x00-/:-@\[-`{{-\x7f{_separators}]+")
#: Bytes that separate terms: all of ASCII but letters and digits.
_apart = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, found from each @: the run before it, then the domain. Linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all pattern matches that pass, by start and then kind."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms of some documents, and in how many of them each occurs."""
    each = [np.unique(word_hashes(_mark.sub(" ", t.decode("utf-8", "surrogatepass").lower()).encode("utf-8", "surrogatepass").translate(_apart).split())) for t in texts]
    return np.unique(np.concatenate(each), return_counts=True) if each else (np.empty(0, np.uint64), np.empty(0, np.int64))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def value_of(text: str, span: tuple[str, int, int]) -> int:
    """A value's hash: its kind and its letters and digits."""
    return hash_of(span[0] + ":" + "".join(c for c in text[span[1] : span[2]].lower() if c.isalnum() or c == "."))


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """``(term hash, start, end)`` of the terms that can be judged; a part of a value is no term."""
    covered = np.zeros(len(text) + 1, np.int64)
    for _, a, b in spans:
        covered[a + 1 : b + 1] = 1
    covered = np.cumsum(covered)
    for m in _term.finditer(text):
        s, e = m.span()
        word = m[0]
        if (len(word) >= LEAST_TERM or not (word.isascii() and word.islower())) and covered[s] == covered[e]:
            yield hash_of(word.lower()), s, e


def values_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch: sorted distinct values, and in how many documents each occurs."""
    values: dict[int, int] = {}
    for raw in texts:
        text = raw.decode("utf-8", "surrogatepass")
        for v in {value_of(text, s) for s in base_spans(text)}:
            values[v] = values.get(v, 0) + 1
    keys = sorted(values)
    return np.array(keys, np.uint64), np.array([values[k] for k in keys], np.int64)


def pairs_of(texts: list[bytes], enough: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: sorted distinct (term, value) pairs of the values in ``enough``, and in how many documents each occurs."""
    terms, values = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for raw in texts if enough else []:
        text = raw.decode("utf-8", "surrogatepass")
        spans = base_spans(text)
        own = np.array(sorted({value_of(text, s) for s in spans} & enough), np.uint64)
        if len(own):
            found = np.array(sorted({t for t, _, _ in terms_of(text, spans)}), np.uint64)
            terms.append(np.repeat(found, len(own)))
            values.append(np.tile(own, len(found)))
    term, value = np.concatenate(terms), np.concatenate(values)
    order, starts = grouped(term, value)
    first = order[starts]
    return term[first], value[first], np.diff(np.append(starts, len(order)))


def disclosing(docs_n: int, alpha: float, support: int):
    def answer(hashes: np.ndarray, owner: np.ndarray, value: np.ndarray, of_value: np.ndarray, n: np.ndarray) -> np.ndarray:
        order, starts = grouped(hashes, value)
        sizes = np.diff(np.append(starts, len(order)))
        term, is_pair = hashes[order[starts]], value[order[starts]] != 0
        count = np.add.reduceat(n[order], starts) if len(starts) else n[:0]
        # rows without a value come first within their term and hold its documents
        df_at = np.searchsorted(term, term, "left")
        co, df_term, df_value = count.astype(float), np.maximum(count[df_at], 1).astype(float), of_value[order[starts]].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            told = np.log(co * docs_n / (df_term * df_value)) >= np.log(docs_n / df_value) / alpha
        told &= is_pair & (count >= support)
        out = np.zeros(len(order), np.uint8)
        out[order] = np.repeat(told, sizes)
        return out

    return answer


def with_disclosures(docs: DataFrame, finish, schema, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """Run ``finish(table, texts, told)`` over batches; ``told``: the terms that disclose each value."""
    packed = pack(docs)
    bits, total = part_bits(docs), docs.count()
    few = max(4, bits - 4)
    payload = {"value": np.uint64, "of_value": np.int64, "n": np.int64}
    columns = "part long, batch_id long, hashes binary"

    def ask_values(batch_id: int, table: pa.Table, _: dict) -> Iterator[dict]:
        keys, n = values_of(raw(table))
        yield from send(batch_id, few, keys, n=n)

    def sums(hashes: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
        order, starts = grouped(hashes)
        out = np.zeros(len(order), np.int64)
        out[order] = np.repeat(np.add.reduceat(n[order], starts), np.diff(np.append(starts, len(order))))
        return out

    of_values = resolve(map_batches(packed, ask_values, columns + ", n binary"), sums, few, np.int64, n=np.int64)

    def asked(texts: list[bytes], row: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        terms, n = term_counts(texts)
        values = values_of(texts)[0]
        df = received(row["of_values"], np.int64, len(values))
        pair_term, pair_value, co = pairs_of(texts, set(values[df >= support].tolist()))
        hashes, value = np.concatenate((terms, pair_term)), np.concatenate((np.zeros(len(terms), np.uint64), pair_value))
        of_value = np.concatenate((np.zeros(len(terms), np.int64), df[np.searchsorted(values, pair_value)]))
        order = np.lexsort((value, hashes))
        return hashes[order], {"value": value[order], "of_value": of_value[order], "n": np.concatenate((n, co))[order]}

    def ask_terms(batch_id: int, table: pa.Table, row: dict) -> Iterator[dict]:
        hashes, more = asked(raw(table), row)
        yield from send(batch_id, bits, hashes, **more)

    packed = packed.join(of_values.withColumnRenamed("answers", "of_values"), "batch_id", "left")
    told = resolve(map_batches(packed, ask_terms, columns + ", value binary, of_value binary, n binary"), disclosing(total, alpha, support), bits, np.uint8, **payload)

    def last(_: int, table: pa.Table, row: dict) -> Iterator[dict]:
        texts = raw(table)
        pairs: dict[int, set[int]] = {}
        if row["of_values"]:
            hashes, more = asked(texts, row)
            for i in np.flatnonzero((received(row["answers"], np.uint8, len(hashes)) == 1) & (more["value"] != 0)):
                pairs.setdefault(int(more["value"][i]), set()).add(int(hashes[i]))
        yield finish(table, texts, pairs)

    return map_batches(packed.join(told, "batch_id", "left"), last, schema)


def raw(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in column(table, "text", pa.binary()).to_pylist()]


def all_spans(text: str, told: dict[int, set[int]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Pattern spans, and these with the disclosing terms of this document."""
    base = base_spans(text)
    own = set().union(*(told.get(value_of(text, s), ()) for s in base)) if base and told else set()
    terms = [("term", s, e) for t, s, e in terms_of(text, base) if t in own] if own else []
    return base, sorted([*base, *terms], key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """Spans of personal data in every whole text, as counts, a digest of the pattern spans, and a list of all.

    A null or empty text has none. Rows keep their number; ``doc_id`` may be null or repeat, and repeated rows
    count as documents of their own. Offsets are code points, ends exclusive.
    """

    def finish(table: pa.Table, texts: list[bytes], told: dict[int, set[int]]) -> dict:
        out = {f"n_{k}": [] for k in KINDS[:4]} | {"base_sha256": [], "spans": []}
        for t in texts:
            base, every = all_spans(t.decode("utf-8", "surrogatepass"), told)
            for k in KINDS[:4]:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(every))
        return {"doc_id": column(table, "doc_id")} | out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return with_disclosures(docs.select("doc_id", "text"), finish, schema, alpha, support)


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of spans that overlap, gives way to the name of its first kind; terms are removed."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], "" if kind == "term" else f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``docs`` with personal data generalised to its kind and disclosing terms removed from ``text``; a null stays null."""

    def finish(table: pa.Table, texts: list[bytes], told: dict[int, set[int]]) -> dict:
        new = []
        for was, t in zip(column(table, "text").to_pylist(), texts):
            spans = all_spans(was or "", told)[1]
            new.append(sanitised(was, spans) if spans else was)
        return {n: column(table, n) for n in table.column_names} | {"text": new}

    names, docs = docs.columns, renamed(docs)
    return with_disclosures(docs, finish, docs.schema, alpha, support).toDF(*names)
