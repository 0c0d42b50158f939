"""DuckDB twins of the registered queries whose results SQL can express, over the same tables."""

from __future__ import annotations

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE_WORDS}') as words from documents),
win as (select doc_id, i, array_to_string(words[i:i + 49], ' ') as k from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from d)),
first as (select k, min(doc_id) as least from win group by k),
gone as (select distinct doc_id, i + o as j from (select doc_id, i, unnest(range(0, 50)) as o from win join first using (k) where doc_id > least)),
word as (select doc_id, unnest(words) as w, unnest(range(1, len(words) + 1)) as j from d),
left_over as (
  select doc_id, count(*) as n_words, count(gone.j) as n_removed, string_agg(w, ' ' order by word.j) filter (where gone.j is null) as kept
  from word left join gone using (doc_id, j) group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_over using (doc_id)
"""

OP6 = rf"""
with d as (select doc_id, regexp_extract_all({LOWER_SQL}, '{ALNUM_WORDS}') as words from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({LOWER_SQL}, '{ALNUM_WORDS}') as words from benchmark where item_id is not null),
item_win as (
  select distinct item, least(len(words), 10) as n, array_to_string(words[i:i + 9], ' ') as k
  from (select item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from b where len(words) > 0)),
widths as (select distinct n from item_win),
doc_win as (select doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') as k
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from d, widths)),
hit as (select doc_id, n, i, item from doc_win join item_win using (n, k)),
words_hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hit) group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words_hit using (doc_id) left join items using (doc_id)
"""

OP9 = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER_SQL}, '{SPACE_WORDS}') as words from documents),
shingle as (
  select distinct doc_id, array_to_string(words[i:i + 3], ' ') as s
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as i from d where len(words) > 0)),
sets as (select doc_id, count(*) as n, list(s order by s) as members from shingle group by doc_id),
class as (select doc_id, n, min(doc_id) over (partition by members) as c from sets),
least as (select c, n from class where doc_id = c),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as n_common from shingle x join shingle y on x.s = y.s and x.doc_id < y.doc_id
  where x.doc_id in (select c from least) and y.doc_id in (select c from least) group by all),
pair as (
  select a, b from common join least u on u.c = a join least v on v.c = b where 100 * n_common >= 85 * (u.n + v.n - n_common)),
edge as (select a, b from pair union all select b, a from pair),
reach as (select c as node, c as r from least union select reach.node, edge.b from reach join edge on edge.a = reach.r),
root as (select node, min(r) as component_id from reach group by node)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id
from d left join class using (doc_id) left join root on root.node = class.c
"""

OP10 = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select *, payload_bytes >= 1000 and page_id < max(page_id) over (partition by payload_digest) as again, max(page_id) over (partition by payload_digest) as keeper from p)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then keeper end as refers_to from k
"""

OP11 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as c from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (select q.vec_id as query_id, x.vec_id, list_inner_product(q.c, x.c)::bigint as score from v q join v x on q.vec_id % 50 = 0 and x.vec_id <> q.vec_id),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pair)
select query_id, rank, vec_id, score from placed where rank <= 5
"""

OP12 = rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{SPACE_WORDS}') as words from documents),
failed as (select doc_id, part, (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
  + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as bits from d),
label as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
cell as (select part, bits, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from failed left join label using (doc_id) group by part, bits),
letter as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(l, bit)),
perm as (select a.l || b.l || c.l || d.l || e.l as o from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
step as (select o, s::int as s, bit, coalesce(sum(bit) over (partition by o order by s rows between unbounded preceding and 1 preceding), 0)::int as before
  from perm, range(1, 6) r(s), letter where substr(o, s::int, 1) = l),
counted as (
  select part, o as filter_order, s as step, bit, coalesce(sum(n) filter (where bits & (before | bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where bits & bit <> 0 and bits & before = 0), 0)::bigint as removed, coalesce(sum(n) filter (where bits & bit <> 0 and bits & before <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where bits = bit), 0)::bigint as unique_fails, coalesce(sum(good) filter (where bits & bit <> 0 and bits & before = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where bits & bit <> 0 and bits & before = 0), 0)::bigint as toxic_lost
  from cell, step group by all)
select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from counted
"""

LETTER_WORDS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = rf"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r, regexp_extract_all({LOWER_SQL}, '{LETTER_WORDS}') as words from documents),
c as (select lang, source, term, count(*) as n, count(distinct r) as docs from (select lang, source, r, unnest(words) as term from d) group by all),
kept as (select lang, term, sum(n) as n_lang from c group by lang, term having sum(docs) >= 30),
size as (select lang, count(*) as v, sum(n_lang) as total_lang from kept group by lang),
total as (select lang, source, sum(n) as total from c join kept using (lang, term) group by lang, source),
g as (select lang, source, coalesce(v, 0) as v, coalesce(total_lang, 0) as total_lang, coalesce(total, 0) as total
  from (select distinct lang, source from d) left join size using (lang) left join total using (lang, source)),
grid as (select g.lang, g.source, term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (total + 5 * v) as p, 1 + (1000000000::hugeint * (n_lang + 5)) // (total_lang + 5 * v) as q
  from g join kept using (lang) left join c using (lang, source, term)),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join grid x on x.lang = a.lang and x.source = a.source
  left join grid y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
term as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from grid where n > 0 and p > q),
placed as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
select * from placed where part = 'pair' or rank <= 50
"""

ORACLES = {
    "op4_substring_dedup": OP4,
    "op6_decontamination": OP6,
    "op9_jaccard_join": OP9,
    "op10_warc": OP10,
    "op11_threshold_search": OP11,
    "op12_filter_audit": OP12,
    "op13_source_divergence": OP13,
}
