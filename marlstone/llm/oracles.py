"""DuckDB SQL of the queries that SQL can express."""

from marlstone.llm import license_oracle

SQL: dict[str, str] = {}

SQL["op9_quality_rules"] = r"""
with t as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
w as (select doc_id, rid, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from t),
win as (select rid, i, list_aggregate(list_slice(words, i, i + 7), 'string_agg', chr(10)) as g
  from (select rid, words, unnest(generate_series(1, len(words) - 7)) as i from w where len(words) >= 8)),
rep as (select rid, i from win qualify count(*) over (partition by rid, g) > 1),
cov as (select rid, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words
  from (select rid, i, lead(i) over (partition by rid order by i) as nxt from rep) group by rid),
m as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  length(regexp_replace(text, '[^!]+', '', 'g'))::bigint as n_exclaim,
  length(regexp_replace(text, '[^\p{Lu}]+', '', 'g'))::bigint as n_upper,
  length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::bigint as n_letters,
  len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join cov using (rid)),
b as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or (n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words))
    or 10 * n_symbols > 3 * n_words or (n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines)
    or (n_letters >= 50 and 100 * n_upper > 60 * n_letters) or (n_words >= 20 and 100 * n_exclaim > 40 * n_words)) as kept
from b
"""

SQL["op1_source_mix"] = r"""
with d as (select doc_id, source, row_number() over () as rid, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
  md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as i from d group by source),
w as (select *, [5, 2, 1][((i - 1) % 3 + 1)::int]::bigint as w, 3 * source_size as cap from s),
o as (select *, sum(source_size) over () as total, sum(w) over () as all_w,
  coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as cap_b,
  coalesce(sum(w) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as w_b from w),
c as (select *, (total - cap_b) * w > cap * (all_w - w_b) as capped from o),
t as (select i, source, source_size, case when capped then cap::double
  else ((total - coalesce(sum(case when capped then cap end) over (), 0)) * w)::double / (sum(case when not capped then w end) over ())::double end as target from c),
q as materialized (select *, floor(target)::bigint as quota, ((floor(target)::bigint + 4095) // 4096)::bigint as need from t),
g as (select i, need, sum(target) over (order by i) as hi from q where need > 0),
b as (select i, need, hi / max(hi) over () as hi from g),
r as (select i, need, coalesce(lag(hi) over (order by i), 0.0) as lo, case when i = max(i) over () then 2.0 else hi end as hi from b),
n as (select sum(need)::bigint as n from q),
points as (select x as slot, ((x + 0.5) * 0.6180339887498949::double) % 1.0::double as u from (select unnest(range(n)) as x from n)),
drawn as (select i, need, slot, row_number() over (partition by i order by slot) - 1 as block from points join r on u >= lo and u < hi),
late as (select i, unnest(range(had, need)) as block from (select q.i, q.need, coalesce(max(block) + 1, 0) as had from q left join drawn using (i) group by q.i, q.need)),
slots as materialized (select i, block, slot from drawn where block < need
  union all select i, block, n + row_number() over (order by i, block) - 1 from late, n),
p as materialized (select rid, doc_id, size, source_size::bigint as source_size, target, quota, i,
  coalesce(sum(size) over (partition by d.source order by h, doc_id, rid rows between unbounded preceding and 1 preceding), 0)::bigint as pos
  from d join q on d.source is not distinct from q.source),
e as (select rid, i, k * source_size + pos as lo, least(k * source_size + pos + size, quota) as hi from p, range(3) as k(k)),
x as (select rid, i, lo, hi, unnest(generate_series(lo // 4096, (hi - 1) // 4096)) as block from e where lo < hi),
y as (select rid, sum(least(hi, (block + 1) * 4096) - greatest(lo, block * 4096))::bigint as taken, min(slot)::bigint as first_slot, count(*) as n_slots
  from x join slots using (i, block) group by rid)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot, coalesce(n_slots, 0)::bigint as n_slots from p left join y using (rid)
"""

SQL["op4_secret_scan"] = r"""
with t as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
kinds(k, kind, pat) as (values (0, 'assign', '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]{16,}'), (2, 'hex', '[0-9a-f]{24,}'), (3, 'key', '[A-Za-z0-9+/]{40,}=*'), (4, 'endpoint', 'https?://[A-Za-z0-9.-]+(?::[0-9]+)?')),
m as (select rid, k, kind, regexp_extract_all(text, pat) as ms, string_split_regex(text, pat) as gaps from t, kinds where regexp_matches(text, pat)),
u as (select rid, k, kind, unnest(ms) as m, unnest(list_slice(gaps, 1, len(ms))) as gap, unnest(generate_series(1, len(ms))) as i from m),
pos as (select *, (sum(length(gap) + length(m)) over (partition by rid, k order by i rows unbounded preceding))::int as stop from u),
ok as (select rid, k, kind, stop - length(m) as start, stop from pos where case k
  when 0 then length(regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6
  when 3 then length(m) = 40 and regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]') and not suffix(m, '=') else true end),
near as materialized (select *, k < 3 or exists (select 1 from ok b where b.rid = a.rid and b.k = 1 and b.stop >= a.start - 500 and b.start <= a.stop + 500) as linked from ok a),
f as (select * from near a where linked and (k < 4 or exists (select 1 from near b where b.rid = a.rid and b.k in (0, 2, 3) and b.linked and b.stop >= a.start - 500 and b.start <= a.stop + 500)))
select t.doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k, stop) filter (k < 3), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k, stop), '') as spans
from t left join f using (rid) group by t.rid, t.doc_id
"""

SQL["op5_license_scan"] = license_oracle.sql()

SQL["op8_ngram_jaccard"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as materialized (select distinct doc_id, array_to_string(list_slice(words, i, i + 4), ' ') as g
  from (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) as i from w where len(words) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
common as (select g from s group by g having count(*) > 1),
c as materialized (select doc_id, g from s join common using (g)),
l as materialized (select a.doc_id as a, b.doc_id as b from c a join c b using (g) join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r as (select doc_id as node, doc_id as id from n union select l.b as node, r.id from r join l on l.a = r.node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, d.doc_id)::bigint as component_id
from documents d left join n using (doc_id) left join (select node, min(id) as c from r group by node) m on m.node = d.doc_id
"""
