"""Names, addresses, countries and sounds as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import dictionaries as D
from kindred.functions.text import WORD, clean_text, words


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: lambdas would compute a captured expression for every element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def normalize_country(label: Column) -> Column:
    """A known country's label; any other label, cleaned."""
    return let(clean_text(label), lambda c: F.coalesce(F.element_at(mapping(D.COUNTRIES), c), c))


def by_country(country: Column, tables: dict[str, Column], default: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    chosen = default
    for name, value in tables.items():
        chosen = F.when(key == name, value).otherwise(chosen)
    return chosen


def dba_variants(name: Column, distinct: bool = True) -> Column:
    """Cleaned parts of a name: around aliases such as "dba", and inside parentheses; the cleaned name if nothing is left.

    Repeated parts go unless ``distinct`` is false. Parentheses hold any character but a line feed, aliases match in any case of Unicode.
    """
    name = F.coalesce(name, F.lit(""))
    inside = F.filter(F.regexp_extract_all(name, F.lit(r"(?d)\((.*?)\)"), 1), lambda x: F.trim(x) != "")
    whole = F.concat(F.array(F.regexp_replace(name, r"(?d)\(.*?\)", " ")), inside)
    alias = rf"(?iu)(?<![{WORD}])(?:{'|'.join(D.ALIASES)})(?![{WORD}])"
    parts = F.flatten(F.transform(whole, lambda x: F.split(x, alias)))
    clean = F.filter(F.transform(parts, clean_text), lambda x: x != "")
    fallback = F.when(name == "", F.array().cast("array<string>")).otherwise(F.array(clean_text(name)))
    return let(F.array_distinct(clean) if distinct else clean, lambda c: F.when(F.size(c) > 0, c).otherwise(fallback))


def legal_suffix(clean: Column, country: Column) -> Column:
    """The first suffix of the country's list that a cleaned name ends with after some other word; '' if none."""
    lists = {c: F.array(*map(F.lit, D.suffixes_for(c))) for c in D.LEGAL_SUFFIXES if c != "global"}
    candidates = by_country(country, lists, F.array(*map(F.lit, D.suffixes_for("global"))))
    hits = let(clean, lambda c: F.filter(candidates, lambda s: F.endswith(c, F.concat(F.lit(" "), s))))
    return F.coalesce(F.get(hits, 0), F.lit(""))


def core_name(clean: Column, suffix: Column) -> Column:
    return F.when(suffix == "", clean).otherwise(F.substring(clean, F.lit(1), F.length(clean) - F.length(suffix) - 1))


def parse_name(name: Column, country: Column) -> Column:
    """``struct(raw_name, clean_name, core_name, legal_suffix, name_variants)``."""

    def parts(clean: Column, variants: Column, label: Column) -> Column:
        first = F.coalesce(F.get(variants, 0), clean)
        cores = F.array_distinct(F.filter(F.transform(variants, lambda v: let(legal_suffix(v, label), lambda s: core_name(v, s))), lambda x: x != ""))

        def whole(first: Column, suffix: Column, cores: Column) -> Column:
            core = core_name(first, suffix)
            core = F.when(core == "", clean).otherwise(core)
            return F.struct(
                F.coalesce(name, F.lit("")).alias("raw_name"),
                clean.alias("clean_name"),
                core.alias("core_name"),
                suffix.alias("legal_suffix"),
                F.when(F.size(cores) > 0, cores).otherwise(F.array(core)).alias("name_variants"),
            )

        return let(first, lambda f: let(legal_suffix(f, label), lambda s: let(cores, lambda c: whole(f, s, c))))

    return let(clean_text(name), lambda c: let(dba_variants(name), lambda v: let(F.coalesce(country, F.lit("")), lambda k: parts(c, v, k))))


def plain_sigma(text: Column) -> Column:
    """Capital sigmas as small ones: Java's lower case would give a final sigma at a word's end, DuckDB's doesn't."""
    return F.replace(text, F.lit("Σ"), F.lit("σ"))


def parse_whole_name(name: Column, country: Column) -> Column:
    """``struct(core_name, legal_suffix)`` of the whole cleaned name: what stands in parentheses or around an alias isn't cut off.

    A capital sigma at a word's end becomes a plain small one, as in SQL.
    """

    def parts(clean: Column, suffix: Column) -> Column:
        return F.struct(core_name(clean, suffix).alias("core_name"), suffix.alias("legal_suffix"))

    return let(clean_text(plain_sigma(name)), lambda c: let(legal_suffix(c, country), lambda s: parts(c, s)))


def digits(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?<![{WORD}])({pattern})(?![{WORD}])", 1), F.lit(""))


def postal_code(clean: Column, country: Column) -> Column:
    """The country's form first, then six digits, then five; '' if none."""
    six, five = digits(clean, "[1-9][0-9]{5}"), digits(clean, "[0-9]{5}")
    own = by_country(country, {"in": six, "us": five, "fr": five}, F.lit(None).cast("string"))
    return F.coalesce(own, six, five, F.lit(""))


def landmarks(clean: Column) -> Column:
    """Phrases that begin with a landmark word; in cleaned text one runs to the end."""
    found = F.regexp_extract_all(clean, F.lit(rf"(?<![{WORD}])((?:{'|'.join(D.LANDMARKS)})\s+[^,;]+)"), 1)
    return F.filter(F.transform(found, clean_text), lambda x: x != "")


def expand_address(clean: Column, country: Column) -> Column:
    """Replace abbreviations word by word; the country's meaning goes before the global one."""
    maps = {c: mapping(D.ABBREVIATIONS["global"] | own) for c, own in D.ABBREVIATIONS.items() if c != "global"}
    table = by_country(country, maps, mapping(D.ABBREVIATIONS["global"]))
    return let(table, lambda t: F.array_join(F.transform(F.split(clean, " "), lambda w: F.coalesce(F.element_at(t, w), w)), " "))


def numbers(clean: Column) -> Column:
    """Tokens of digits only; "4B" isn't one."""
    return F.filter(F.split(clean, " "), lambda x: x.rlike("^[0-9]+$"))


def parse_address(address: Column, country: Column) -> Column:
    """``struct(raw_address, clean_address, expanded_address, postal_code, landmarks, numbers, tokens)``."""

    def parts(clean: Column, expanded: Column, label: Column) -> Column:
        return F.struct(
            F.coalesce(address, F.lit("")).alias("raw_address"),
            clean.alias("clean_address"),
            expanded.alias("expanded_address"),
            postal_code(clean, label).alias("postal_code"),
            landmarks(clean).alias("landmarks"),
            numbers(clean).alias("numbers"),
            words(expanded).alias("tokens"),
        )

    return let(clean_text(address), lambda c: let(F.coalesce(country, F.lit("")), lambda k: let(expand_address(c, k), lambda e: parts(c, e, k))))


def sound(token: Column) -> Column:
    """Four-character sound code in which every letter without a code separates equal codes."""
    letters = F.regexp_replace(F.lower(F.coalesce(token, F.lit(""))), "[^a-z]", "")
    others = "".join(c for c in map(chr, range(97, 123)) if not any(c in x for x in D.SOUND_CODES.values()))
    coded = F.translate(letters, "".join(D.SOUND_CODES.values()) + others, "".join(k * len(v) for k, v in D.SOUND_CODES.items()) + "0" * len(others))
    for code in D.SOUND_CODES:
        coded = F.regexp_replace(coded, f"{code}+", code)
    tail = F.replace(F.substring(coded, 2, 1 << 30), F.lit("0"), F.lit(""))
    return F.when(letters == "", "").otherwise(F.substring(F.concat(F.upper(F.substring(letters, 1, 1)), tail, F.lit("000")), 1, 4))


def sound_key(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(words(clean_text(text)), sound), lambda x: x != ""), " ")
