"""Text normalisation as native column expressions.

``\\w`` stands for letters, numbers and the underscore of all scripts, which Java's own ``\\w`` doesn't; hence WORD.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"\p{L}\p{N}_"


@lru_cache
def latin_folds() -> tuple[str, str, str, dict[str, str]]:
    """How NFKD without combining marks changes U+0080 to U+036F: characters, their single replacements, deletions, and longer replacements."""
    single, gone, longer = {}, [], {}
    for code in range(0x80, 0x370):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char:
            continue
        if not plain:
            gone.append(char)
        elif len(plain) == 1:
            single[char] = plain
        else:
            longer[char] = plain
    return "".join(single), "".join(single.values()), "".join(gone), longer


def strip_accents(text: Column) -> Column:
    """Decompose and drop combining marks, for characters below U+0370 (Latin and its marks); null gives ''."""
    chars, plain, gone, longer = latin_folds()
    text = F.coalesce(text, F.lit(""))
    short = out = F.translate(text, chars + gone, plain)
    for char, to in longer.items():
        out = F.replace(out, F.lit(char), F.lit(to))
    # few texts have characters that become several
    return F.when(F.rlike(text, F.lit(f"[{''.join(longer)}]")), out).otherwise(short)


@F.pandas_udf(StringType())
def strip_accents_full(texts):
    """As ``strip_accents`` for all of Unicode, by the standard library."""
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) if t else "")


def clean_text(text: Column) -> Column:
    """Lower case without accents; "&" and "+" as "and", "@" as "at", dotted initials joined, other marks to single spaces."""
    t = F.lower(strip_accents(text))
    t = F.regexp_replace(t, "[&+]", " and ")
    t = F.replace(t, F.lit("@"), F.lit(" at "))
    t = F.regexp_replace(t, rf"(?<=(?<![{WORD}])[a-z])\.(?=[a-z](?![{WORD}]))", "")
    return F.trim(F.regexp_replace(t, rf"[^{WORD}]+", " "))


def words(clean: Column) -> Column:
    """The non-empty tokens of a cleaned text."""
    return F.filter(F.split(clean, " "), lambda x: x != "")


def tokenize(text: Column) -> Column:
    return words(clean_text(text))
