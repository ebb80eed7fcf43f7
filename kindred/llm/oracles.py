"""DuckDB statements for the queries that SQL can express."""

#: White space of the contracts: \x20 and \x09 to \x0D.
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, unnest(l) as line, unnest(range(len(l))) as i from d),
k as (select *, {ASCII_LOWER.format(f"trim(line, {SPACE})")} as key from x),
g as (select key, min(doc_id) as keeper from k where length(key) >= 10 and doc_id is not null group by key having min(doc_id) < max(doc_id)),
j as (select k.doc_id, k.i, k.line, g.keeper is not null and k.doc_id <> g.keeper as gone from k left join g on k.key = g.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""

SUBSTRING_DEDUP = """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 11)) as i, w from d where len(w) >= 13),
h as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as run from g),
m as (select run, min(doc_id) as first from h where doc_id is not null group by run),
r as (select h.doc_id, unnest(range(h.i, h.i + 13)) as spot from h join m on h.run = m.run where h.doc_id > m.first),
gone as (select doc_id, list_distinct(list(spot)) as spots from r group by doc_id),
k as (select d.doc_id, d.w, list_filter(d.w, lambda x, i: not coalesce(list_contains(gone.spots, i), false)) as kept from d left join gone on d.doc_id = gone.doc_id)
select doc_id, len(w) as n_words, len(w) - len(kept) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""

EXACT_TOP_K = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(embedding) > 0 and vec_id is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
      from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

EMBEDDING_DEDUP = """
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
           where embedding is not null and label is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.v, b.v) >= 0.98),
w(id, r) as (select vec_id, vec_id from embeddings union select w.id, l.b from w join l on w.r = l.a),
c as (select id, min(r) as component_id from w group by id),
n as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings left join n on vec_id = a join c on vec_id = id
"""

#: Words in lower case by the contract's definition, of documents.
WORDS = f"list_filter(regexp_split_to_array({ASCII_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

JACCARD_JOIN = f"""
with recursive d as (select doc_id, {WORDS} as w from documents),
g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from d),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
r(id, r) as (select doc_id, doc_id from documents union select r.id, l.b from r join l on r.r = l.a),
c as (select id, min(r) as component_id from r group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id from d left join n on n.doc_id = d.doc_id join c on c.id = d.doc_id
"""
