"""DuckDB text for the same expressions, to check results against."""

from __future__ import annotations

from kindred.functions import dictionaries as D
from kindred.functions.text import latin_folds

W = r"\p{L}\p{N}_"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def lookup(pairs: dict[str, str]) -> str:
    return f"map({strings(pairs)}, {strings(pairs.values())})"


def strip_accents(x: str) -> str:
    chars, plain, gone, longer = latin_folds()
    out = f"translate(coalesce({x}, ''), {quoted(chars + gone)}, {quoted(plain)})"
    for char, to in longer.items():
        out = f"replace({out}, {quoted(char)}, {quoted(to)})"
    return out


def clean(x: str) -> str:
    out = rf"replace(regexp_replace(lower({strip_accents(x)}), '[&+]', ' and ', 'g'), '@', ' at ')"
    # RE2 has no lookaround: mark the dot of one pair of initials after the other
    for _ in range(6):
        out = rf"regexp_replace({out}, '(^|[^{W}])([a-z])\.([a-z])($|[^{W}])', '\1\2' || chr(57344) || '\3\4', 'g')"
    return rf"trim(regexp_replace(replace({out}, chr(57344), ''), '[^{W}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def all_words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[{W}]+')"


def country(x: str) -> str:
    return f"coalesce({lookup(D.COUNTRIES)}[{x}], {x})"


def by_country(c: str, tables: dict[str, str], default: str) -> str:
    return f"case lower(trim({c})) " + " ".join(f"when {quoted(k)} then {v}" for k, v in tables.items()) + f" else {default} end"


def suffix(name: str, c: str) -> str:
    lists = by_country(c, {k: strings(D.suffixes_for(k)) for k in D.LEGAL_SUFFIXES if k != "global"}, strings(D.suffixes_for("global")))
    return f"coalesce(list_filter({lists}, lambda s: ends_with({name}, ' ' || s))[1], '')"


def core(name: str, suf: str) -> str:
    return f"case when {suf} = '' then {name} else substr({name}, 1, length({name}) - length({suf}) - 1) end"


def token_digits(x: str, pattern: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: regexp_full_match(w, '{pattern}'))[1]"


def postal(x: str, c: str) -> str:
    six, five = token_digits(x, "[1-9][0-9]{5}"), token_digits(x, "[0-9]{5}")
    return f"coalesce({by_country(c, {'in': six, 'us': five, 'fr': five}, 'null')}, {six}, {five}, '')"


def expand(x: str, c: str) -> str:
    maps = {k: lookup(D.ABBREVIATIONS["global"] | own) for k, own in D.ABBREVIATIONS.items() if k != "global"}
    table = by_country(c, maps, lookup(D.ABBREVIATIONS["global"]))
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: coalesce(({table})[w], w)), ' ')"


def landmark(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '(?:^|[^{W}])((?:{'|'.join(D.LANDMARKS)})\s+[^,;]+)', 1), lambda p: trim(p))"


def sound(x: str) -> str:
    letters = f"regexp_replace(lower(coalesce({x}, '')), '[^a-z]', '', 'g')"
    others = "".join(c for c in map(chr, range(97, 123)) if not any(c in v for v in D.SOUND_CODES.values()))
    coded = f"translate({letters}, {quoted(''.join(D.SOUND_CODES.values()) + others)}, {quoted(''.join(k * len(v) for k, v in D.SOUND_CODES.items()) + '0' * len(others))})"
    for k in D.SOUND_CODES:
        coded = f"regexp_replace({coded}, '{k}+', '{k}', 'g')"
    return f"case when {letters} = '' then '' else substr(upper(substr({letters}, 1, 1)) || replace(substr({coded}, 2), '0', '') || '000', 1, 4) end"


def block_tokens(name: str, address: str) -> str:
    return f"list_filter({all_words(f'{name} || chr(32) || {address}')}, lambda w: length(w) >= 3 and not list_contains({strings(D.STOPWORDS)}, w))"


def runs(c: str, n: int, between: str = "''") -> str:
    parts = ", ".join(f"{c}[{k}:{k - n - 1 if k < n else '-1'}]" for k in range(1, n + 1))
    return f"list_transform(list_zip({parts}), lambda z: {f' || {between} || '.join(f'z[{k}]' for k in range(1, n + 1))})"


def grams(x: str, n: int) -> str:
    return f"list_distinct({runs(f"string_split(lower(coalesce({x}, '')), '')", n)})"


def flat(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^{W}\s]', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def jaccard(a: str, b: str, empty: str = "0") -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then {empty} when len({a}) = 0 or len({b}) = 0 then 0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end"


def gram_jaccard(a: str, b: str, n: int = 3) -> str:
    return f"case when length({a}) < {n} or length({b}) < {n} then ({a} = {b})::int else {jaccard(grams(a, n), grams(b, n))} end"


def prefix_ratio(a: str, b: str) -> str:
    short = f"least(length({a}), length({b}))"
    return f"case when {short} = 0 then 0 else coalesce(list_filter(range(1, {short} + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1))[1] - 1, {short}) / {short} end"


def length_ratio(a: str, b: str) -> str:
    return f"case when greatest(length({a}), length({b})) = 0 then 1 else least(length({a}), length({b})) / greatest(length({a}), length({b})) end"


#: Pages as linkage records: source by id, title as name, url as address, language as country.
RECORDS = r"""pg as (select page_id, replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&') as name,
  url as address, regexp_extract(html, '<html lang="([^"]*)"', 1) as country from pages),
rec as (select page_id as pos, ['S1-', 'S2-', 'S3-'][page_id % 3 + 1] || lpad(page_id::varchar, 12, '0') as eid, 'S' || (page_id % 3 + 1) as source, name, address, country from pg)"""

#: Candidates by inverted index with a posting cutoff of ``most``; scores before ranking are rounded.
INDEX = """tok as (select pos, eid, source, country, {tokens} as t from rec),
each as (select country, eid as target_id, pos, unnest(list_distinct(t)) as token from tok where source <> 'S1'),
size as (select country, count(*) as n_targets from tok where source <> 'S1' group by country),
df as (select country, token, count(*) as df from each group by all having count(*) <= {most}),
wgt as (select country, token, n_targets, ln(n_targets / (df + 1)) as idf from df join size using (country)),
ask as (select country, s1_id, token, count(*) as times from (select country, eid as s1_id, unnest(t) as token from tok where source = 'S1') group by all),
scr as (select s1_id, target_id, any_value(pos) as pos, any_value(n_targets) as n_targets, round(sum(times * idf), 9) as score
  from ask join wgt using (country, token) join each using (country, token) group by s1_id, target_id),
top as (select * exclude (r), (r - 1)::int as cand_rank from (select *, row_number() over (partition by s1_id order by score desc, pos) as r from scr) where r <= {k}),
cand as (select * exclude (best) from (select *, max(score) over (partition by s1_id) as best from top) where score >= {alpha} * best)"""


def index(most: int, k: int = 35, alpha: float = 0.3) -> str:
    return INDEX.format(tokens=block_tokens("name", "address"), most=most, k=k, alpha=alpha)


#: Each target with its first S1 record of the same title and language.
TRUTH = """tru as (select b.eid as target_id, min(a.eid) as s1_id from rec a join rec b on a.source = 'S1' and b.source <> 'S1' and lower(a.name) = lower(b.name) and a.country = b.country group by b.eid)"""

SCORED = """sco as (select s1_id, target_id, cand_rank, round(1 / (1 + exp(4 - score)), 6) as p from cand)"""
WON = """won as (select s1_id, target_id, p from (select *, row_number() over (partition by target_id order by p desc, s1_id) as r from sco) where r = 1)"""
F05 = "case when n_true = 0 then case when n_predicted = 0 then 1 else 0 end when n_predicted = 0 or n_hits = 0 then 0 else 1.25 * (n_hits / n_predicted) * (n_hits / n_true) / (0.25 * (n_hits / n_predicted) + n_hits / n_true) end"
