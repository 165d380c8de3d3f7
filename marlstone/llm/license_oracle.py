"""DuckDB SQL of the license scan, with the templates of its default parameters written in."""

import math

from marlstone.llm.licenses import SPREAD, TEMPLATES, THETA, template_words


def sql() -> str:
    sets = [(label, template_words(text)) for label, text in TEMPLATES]
    rows = ", ".join(f"({t}, '{label}', {len(set(ws))}, {math.ceil(THETA * len(set(ws)) - 1e-9)}, {SPREAD * len(ws)}, {sorted(set(ws))})" for t, (label, ws) in enumerate(sets))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    ascii_lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with t as (select doc_id, row_number() over () as rid, {ascii_lower} as text from documents),
w as materialized (select doc_id, rid, text, regexp_extract_all(text, '{word}') as words from t),
p as (select rid, i, case when words[i] = 'mit' and words[i + 1] = 'license' then 'mit' when words[i] = 'apache' and words[i + 1] = 'license' then 'apache'
  when words[i] = 'general' and words[i + 1] = 'public' and words[i + 2] = 'license' then 'gpl' end as label
  from (select rid, words, unnest(generate_series(1, len(words))) as i from w where contains(text, 'license'))),
b as (select rid, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, list(distinct label) as bl from p where label is not null group by rid),
templates(t, label, size, need, span, ws) as (values {rows}),
may as (select rid, words, t, label, size, need, span, ws from w, templates where len(list_intersect(list_distinct(words), ws)) >= need),
h as materialized (select rid, t, label, size, need, span, i, words[i] as w from (select *, unnest(generate_series(1, len(words))) as i from may) where list_contains(ws, words[i])),
m as (select a.rid, a.label, count(distinct b.w) / a.size as c from h a join h b on a.rid = b.rid and a.t = b.t and b.i >= a.i and b.i < a.i + a.span
  group by a.rid, a.t, a.label, a.size, a.need, a.i having count(distinct b.w) >= a.need),
l as (select rid, list(distinct label) as ml, max(c) as c from m group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(bl), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(c, 0)::double end as score
from w left join b using (rid) left join l using (rid)
"""
