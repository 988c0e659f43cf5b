"""DuckDB SQL of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
line as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n from line where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
gram as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from gram) where n > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
m as (
    select doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(dup.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters, length(regexp_replace(text, '[^!?]', '', 'g')) as marks,
        len(list_filter(w, lambda x: not regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) as wordless, len(string_split(text, chr(10))) as lines
    from d left join dup using (doc_id) left join covered using (doc_id)
),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, greatest(n_words, 1) as n from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and n_symbols::double / n <= 0.2 and wordless::double / n <= 0.3 and upper::double / greatest(letters, 1) <= 0.5 and marks::double / n <= 0.2
        and word_chars::double / n between 2 and 20 and n_dup_lines::double / lines <= 0.5 as kept
from b
"""

NEAR = (
    r"""
with recursive d as (select doc_id, regexp_extract_all("""
    + _LOWER
    + r""", '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (
    select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
edge as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 85 * (x.n + y.n - m)),
reach as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
least as (select a as doc_id, min(b) as c from reach group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least(doc_id, c), doc_id) as component_id, coalesce(least(doc_id, c), doc_id) = doc_id as kept
from d left join n using (doc_id) left join least using (doc_id)
"""
)

LEAKS = (
    r"""
with d as (select doc_id, regexp_extract_all("""
    + _LOWER
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t as (select item_id, regexp_extract_all("""
    + _LOWER
    + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select item_id, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i, w from t where len(w) > 0),
item as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from p),
size as (select distinct n from item),
win as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, size where len(w) >= n)),
hit as (select doc_id, i, win.n, item_id from win join item on win.n = item.n and win.g = item.g),
word as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
who as (select doc_id, list_sort(list(distinct item_id::varchar)) as items from hit group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (doc_id) left join who using (doc_id)
"""
)
