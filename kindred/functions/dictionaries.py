"""Fixed values that results depend on: word lists and lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

#: Words that compact tokens leave out.
STOPWORDS = (
    "inc corp corporation llc ltd limited pvt private co company and the of in at road rd street st avenue ave lane ln drive dr nagar colony floor near opp opposite "
    "block sector phase house plot door no null sarl sas sci france de la le du des les en rue bd boulevard av impasse new old east west north south main cross"
).split()

#: Country names and their labels.
COUNTRIES = {
    "us": "us",
    "usa": "us",
    "united states": "us",
    "united states of america": "us",
    "in": "in",
    "ind": "in",
    "india": "in",
    "bharat": "in",
    "fr": "fr",
    "fra": "fr",
    "france": "fr",
    "republique francaise": "fr",
}

#: Legal suffixes by country.
LEGAL_SUFFIXES = {
    "global": ["corporation", "corp", "incorporated", "inc", "company", "co", "limited", "ltd", "llc", "llp"],
    "us": ["llc", "inc", "incorporated", "corp", "corporation", "co", "company", "llp", "lp", "pc", "pllc"],
    "in": ["private limited", "pvt ltd", "pvt", "limited", "ltd", "llp"],
    "fr": ["societe a responsabilite limitee", "sarl", "societe par actions simplifiee", "sas", "sasu", "societe anonyme", "sa", "eurl", "snc", "sci", "scp", "gie"],
}

#: Address abbreviations by country. A bare "no" isn't among them, as YAML 1.1 reads it as false.
ABBREVIATIONS = {
    "global": {
        "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "ste": "suite",
        "apt": "apartment", "fl": "floor", "flr": "floor", "bldg": "building", "hwy": "highway", "pkwy": "parkway",
    },
    "us": {
        "st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "ste": "suite", "apt": "apartment",
        "fl": "floor", "bldg": "building", "hwy": "highway", "pkwy": "parkway", "fwy": "freeway", "n": "north", "s": "south", "e": "east", "w": "west",
        "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    },
    "in": {
        "opp": "opposite", "nr": "near", "rd": "road", "st": "street", "flr": "floor", "fl": "floor", "dist": "district", "sec": "sector", "apt": "apartment",
        "soc": "society", "bldg": "building",
    },
    "fr": {
        "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "all": "allee", "che": "chemin", "imp": "impasse", "pl": "place",
        "rte": "route", "ctre": "centre", "bat": "batiment", "res": "residence", "sq": "square", "qu": "quai", "cedex": "cedex", "bp": "boite postale",
    },
}

#: Consonants by sound code; every other letter has none.
SOUND_CODES = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}

#: What splits a trading name from a legal name.
ALIASES = ["d/?b/?a", "t/?a", "trading as", "formerly known as", "f/?k/?a", "formerly", "aka"]

#: Words that begin a landmark.
LANDMARKS = ["near", "opp", "opposite", "behind", "beside", "adjacent to", "next to"]


def suffixes_for(country: str) -> list[str]:
    """A country's suffixes, longest first, then the global ones that it lacks, longest first."""
    by_length = lambda xs: sorted(xs, key=len, reverse=True)
    own = by_length(LEGAL_SUFFIXES.get(country, LEGAL_SUFFIXES["global"]))
    return list(dict.fromkeys([*own, *by_length(LEGAL_SUFFIXES["global"])]))


def load_dictionaries(path: str, defaults: dict = ABBREVIATIONS, section: str = "address_abbreviations") -> dict:
    """Dictionaries from ``<country>.yaml`` files of a folder; unreadable files are passed over, the global default fills a gap."""
    from pathlib import Path

    import yaml

    found = {}
    for file in sorted(Path(path).glob("*.yaml")):
        try:
            data = yaml.safe_load(file.read_text(encoding="utf-8"))
        except (OSError, UnicodeDecodeError, yaml.YAMLError):
            continue
        if isinstance(data, dict) and section in data:
            found[file.stem] = data[section]
    return {"global": defaults["global"]} | found


@contextmanager
def using(path: str) -> Iterator[None]:
    """Names and addresses parsed by expressions made inside take suffixes and abbreviations from a folder's files."""
    was = dict(ABBREVIATIONS), dict(LEGAL_SUFFIXES)
    now = load_dictionaries(path), load_dictionaries(path, LEGAL_SUFFIXES, "legal_suffixes")
    try:
        for table, values in zip((ABBREVIATIONS, LEGAL_SUFFIXES), now):
            table.clear()
            table.update(values)
        yield
    finally:
        for table, values in zip((ABBREVIATIONS, LEGAL_SUFFIXES), was):
            table.clear()
            table.update(values)
