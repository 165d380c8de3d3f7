"""DuckDB SQL of ``marlstone.queries``, by name; queries that SQL cannot express have none and are tested by golden values."""

from __future__ import annotations

from marlstone.functions import code as C
from marlstone.functions import similarity as S
from marlstone.functions import text as T
from marlstone.operators import pairing
from marlstone.queries import PROGRAMS

SQL: dict[str, str] = {}


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _any(x: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, {_str(p)})" for p in patterns) + ")"


_SPLIT = "string_split(text, chr(10))"
_LINES = f"lines as (select doc_id, pos, {_strip('raw')} as line from (select doc_id, unnest(generate_series(0, len({_SPLIT}) - 1)) as pos, unnest({_SPLIT}) as raw from documents)), full_lines as (select * from lines where line <> '')"
_RUN = "len(list_filter(generate_series(1, length({0}) - 3), lambda i: {0}[i] = {0}[i + 1] and {0}[i] = {0}[i + 2] and {0}[i] = {0}[i + 3])) > 0"


def _placeholder(x: str) -> str:
    plain = [p for p in T.PLACEHOLDERS if not p.startswith(("(?U)", "(.)"))]
    return f"({_any(x, plain)} or regexp_matches({x}, '^[^\\p{{L}}\\p{{M}}]+$') or {_RUN.format(x)})"


def _quality(x: str) -> str:
    alnum, special = rf"length(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')) / length({x})", rf"length(regexp_replace({x}, {_str('[^' + T.SPECIAL + ']')}, '', 'g')) / length({x})"
    return f"(case when {_strip(x)} = '' then 1.0::double else ({alnum} * 0.7::double + (1.0::double - {special}) * 0.3::double) * case when regexp_matches({x}, {_str(T.SYMBOL_RUN)}) then 0.3::double else 1.0::double end end)"


def _list(values) -> str:
    return "(" + ", ".join(map(_str, values)) + ")"




def _url(x: str) -> str:
    return f"regexp_matches({x}, {_str('(?i)^(?:' + '|'.join(T.URLS) + ')')})"


_DENIED = "{0} in " + _list([*T.LANGUAGES, *T.SECTION_NAMES])
_SEQUENCE = "(" + " or ".join(f"contains({{0}}, '{s}')" for s in T.SEQUENCES) + ")"

SQL["sanitize_lines"] = f"""
with {_LINES},
c as (select doc_id, line, min(pos) as pos, {_url('line')} as is_url, {_any('line', T.PATHS)} as is_path from full_lines
  where not ({_DENIED.format('line')}) and not {_placeholder('line')} and not {_SEQUENCE.format('line')} group by doc_id, line),
k as (select *, case when is_url then 2 when is_path then 0 else 1 end as part from c where is_url or {_quality('line')} >= {T.GIBBERISH}),
n as (select *, count(*) filter (part < 2) over (partition by doc_id) as kept from k),
o as (select doc_id, count(*) as n_lines, string_agg(line, chr(10) order by part, case when part <> 1 then line end, pos) as strings_out from n where part < 2 or kept < 100 group by doc_id)
select doc_id, coalesce(n_lines, 0)::int as n_lines, coalesce(strings_out, '') as strings_out from documents left join o using (doc_id)
"""
SQL["text_quality_score"] = f"with {_LINES} select doc_id, pos::int as pos, round({_quality('line')}, 6) as score, {_quality('line')} < {T.GIBBERISH} as gibberish from full_lines"
SQL["ordered_line_dedup"] = f"""
with {_LINES}, f as (select doc_id, line, min(pos) as pos from full_lines group by doc_id, line),
o as (select doc_id, count(*) as n, string_agg(line, chr(10) order by pos) as s from f group by doc_id)
select doc_id, coalesce(n, 0)::int as n_lines, coalesce(s, '') as lines from documents left join o using (doc_id)
"""
SQL["placeholder_filter"] = f"with {_LINES} select doc_id, pos::int as pos, {_placeholder('line')} as is_placeholder from full_lines"
SQL["literal_deny_filter"] = f"""
with w as (select p_partkey, unnest(string_split(p_name, ' ')) as word from part
  union all select n_nationkey::bigint, [{', '.join(map(_str, T.LANGUAGES[:20]))}][n_nationkey % 20 + 1] from nation)
select p_partkey, word, {_DENIED.format('word')} as denied from w
"""
SQL["sequence_filter"] = f"with w as (select doc_id, text || case when doc_id % 3 = 0 then 'x0123456789y' else '0123' end as line from documents) select doc_id, {_SEQUENCE.format('line')} as has_sequence from w"
SQL["url_predicate"] = f"select page_id, {_url(_strip('url'))} as is_url, {_url(_strip('html'))} as html_is_url from pages"
_PATH = "regexp_replace(url, '^[a-z]+://[^/]+|[?#].*$', '', 'g')"
SQL["path_predicate"] = f"with p as (select page_id, {_PATH} as p from pages) select page_id, {_any('p', T.PATHS)} as is_path, {_any(chr(39) + 'src' + chr(39) + ' || p || ' + chr(39) + '.c' + chr(39), T.PATHS)} as file_is_path from p"
SQL["binary_name"] = "select page_id, replace(regexp_extract(regexp_replace(url, '[?#].*$', '') || '.json', '([^/]+/[^/]+)/?$', 1), '.json', '') as bin_name from pages"
SQL["head_tail_sample"] = """
with w as (select doc_id, string_split(text, ' ') as w from documents), s as (select doc_id, case when len(w) > 100 then list_concat(w[1:50], w[-50:]) else w end as w from w)
select doc_id, len(w)::int as n, array_to_string(w, ' ') as sample from s
"""
SQL["strip_line_comments"] = r"""
with l as (select page_id, list_filter(string_split(regexp_replace(replace(html, '>', '>' || chr(10)), '(?m)//.*$', '', 'g'), chr(10)), lambda x: regexp_matches(x, '\S')) as ls from pages)
select page_id, md5(array_to_string(ls, chr(10))) as code_md5 from l
"""
SQL["strip_all_comments"] = r"""
with c as (select page_id, 'int f() { /* a' || chr(10) || 'b */ return g("x // y"); } // z' || chr(10) || replace(html, ';', '; /* c */') as code from pages)
select page_id, md5(regexp_replace(code, '("(?:\\(?s:.)|[^"\\])*")|/\*(?s:.*?)\*/|//[^\n]*', '\1', 'g')) as code_md5 from c
"""
_STRCMP = r"""nullif(lower(regexp_extract({0}, '(?i)strcmp\([^,]+,\s*"([^"]+)"\)', 1)), '')"""
SQL["strcmp_keyword"] = f"""
with c as (select page_id, html, 'if (!StrCmp(argv[1], "' || regexp_extract(url, '//([a-zA-Z.]+)', 1) || '")) run();' as code from pages)
select page_id, {_STRCMP.format('code')} as keyword, {_STRCMP.format('html')} as html_keyword from c
"""
SQL["min_nonblank_lines"] = rf"""
with n as (select doc_id, len(list_filter({_SPLIT}, lambda x: regexp_matches(x, '\S')))::int as n, len({_SPLIT}) as k from documents)
select doc_id, n as n_lines, n > 3 as is_name_sample, n > 5 as is_summary_sample, k >= {C.LEAST_LINES} as has_blocks from n
"""
SQL["line_slice"] = f"select doc_id, array_to_string(({_SPLIT})[2:3], chr(10)) as part from documents"
SQL["mask_and_unmask"] = """
with n as (select doc_id, text, split_part(text, ' ', 2) as name from documents),
m as (select doc_id, name, case when name <> '' and instr(text, name) > 0 then substring(text, 1, instr(text, name) - 1) || '[MASK]' || substring(text, instr(text, name) + length(name)) else text end as masked from n)
select doc_id, md5(masked) as masked_md5, md5(replace(masked, '[MASK]', name)) as unmasked_md5 from m
"""
SQL["file_report"] = rf"""
with t as (select doc_id, '/bin/x: ELF 64-bit, x86-64, ' || text as text from documents),
l as (select doc_id, text, list_filter(list_transform({_SPLIT}, lambda x: {_strip('x')}), lambda x: x <> '') as ls, string_split(text, ',') as f from t)
select doc_id, md5(array_to_string(list_transform(ls, lambda x: regexp_replace(x, '^[^:]+:\s*', '')), chr(10))) as report_md5, md5(array_to_string(f[1:len(f) - 1], ',')) as short_md5 from l
"""
SQL["import_labels"] = "select s_suppkey, split_part(s_name || '@@GLIBC_2.2', '@', 1) as name, 'EXT_' || printf('%08x', s_suppkey) as label from supplier"

SQL["first_wins_name_dedup"] = "select source, min(doc_id) as doc_id from documents group by source"
SQL["first_wins_body_dedup"] = "select min(doc_id) as doc_id from documents group by text"
SQL["two_stage_dedup"] = """
with n as (select *, source || '_' || substring(text, 1, 3) as name from documents), a as (select * from n qualify row_number() over (partition by name order by doc_id) = 1),
b as (select * from a where length(text) > 0 qualify row_number() over (partition by text order by doc_id) = 1)
select name, doc_id from b
"""
SQL["last_wins_merge"] = "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1"
_SPLITS = "select doc_id, case when r < floor(0.8::double * n) then 'train' when r < floor((0.8::double + 0.1::double) * n) then 'test' else 'validation' end as split from (select doc_id, row_number() over (order by md5('split:' || doc_id), doc_id) - 1 as r, count(*) over () as n from documents)"
SQL["deterministic_split"] = _SPLITS
SQL["split_audit_counts"] = f"select split, count(*) as n from ({_SPLITS}) group by split"
SQL["skip_existing"] = "select doc_id from documents where doc_id not in (select doc_id from labels)"
SQL["union_corpora"] = "select case lang when 'en' then 0 when 'de' then 1 when 'fr' then 2 when 'es' then 3 else 4 end as part, doc_id, lang from documents"

SQL["sibling_semi_join"] = "select o_orderkey, o_custkey as c_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0) and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')"
_FUNCTIONS = """
f as (select o_orderstatus as opt, o_custkey::varchar as "binary", 'fn_' || o_orderkey as func_name, o_orderkey as k, o_orderkey % 11 = 0 as invalid, o_orderkey % 9 as n,
  o_orderpriority <> '5-LOW' as called, o_totalprice > 100000 as s_called, 'int fn_' || o_orderkey || '(void) { return ' || o_custkey || '; }' as code from orders)
"""
SQL["function_pairs"] = f"""
with {_FUNCTIONS}
select opt, "binary", func_name, code, 'fn_' || (k + 1) as caller, case when opt <> 'P' then replace(code, 'fn_', 'FUN_') end as stripped_code,
  case when opt <> 'P' and s_called then '_puts' end as stripped_external, case when opt <> 'P' and s_called then 'fn_' || (k + 2) end as stripped_internal,
  case when opt <> 'P' then 'FUN_' || k end as stripped_function_name
from f where not invalid and n >= 5 and called
"""
SQL["prediction_pairs"] = f"with {_FUNCTIONS} select func_name, case when called then k::varchar end as caller, (k % 20)::int as n_assembly from f where k % 20 >= 10"
SQL["context_attach"] = "select o_custkey as bin_name, o_orderkey, c_name as bin_info from orders join customer on o_custkey = c_custkey where c_acctbal > 0"
SQL["context_missing_audit"] = "select o_custkey as bin_name, o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)"
SQL["constant_context"] = "select n_nationkey, n_name, r_regionkey, r_name from nation cross join (select * from region order by r_regionkey limit 1)"
SQL["skip_list_anti"] = f"""
with p as (select p_partkey, case p_partkey % 10 when 0 then 'main' when 1 then 'FUN_0010' else p_name end as func_name from part)
select p_partkey, func_name from p where func_name not in {_list(pairing.SKIP_SPLIT)} and not contains(func_name, 'FUN_')
"""
SQL["assembly_window"] = "select l_orderkey, l_linenumber, l_quantity from lineitem where l_linenumber <> 7 and l_quantity::int * 30 between 5 and 1024"

_E = "e as (select distinct l_linestatus as \"binary\", 'p' || l_partkey as caller, 's' || l_suppkey as callee, l_partkey as k from lineitem)"
SQL["edge_extract_unique"] = f'with {_E} select "binary", caller as func, string_agg(callee, chr(44) order by callee) as callees from e group by all'
SQL["ordered_adjacency"] = """
with x as (select l_linestatus as "binary", l_suppkey::varchar as func, l_returnflag as callee, min(l_orderkey * 10 + l_linenumber) as pos from lineitem group by all)
select "binary", func, string_agg(callee, ',' order by pos, callee) as callees from x group by "binary", func
"""
_CLOSED = """
, back as (select * from forward union select * from backward),
o as (select "binary", caller as func, string_agg(callee, ',' order by callee) as callees from ahead group by all),
i as (select "binary", callee as func, string_agg(caller, ',' order by caller) as callers from back group by all)
select "binary", func, coalesce(callees, '') as callees, coalesce(callers, '') as callers from o full join i using ("binary", func)
"""
_HALVES = """with forward as (select distinct l_linestatus as "binary", 'p' || l_partkey as caller, 's' || l_suppkey as callee from lineitem where l_returnflag <> 'R'),
backward as (select distinct l_linestatus as "binary", 'p' || l_partkey as caller, 's' || l_suppkey as callee from lineitem where l_returnflag = 'R')"""
_SYMBOLS = "select 's' || s_suppkey from supplier where s_acctbal < 0"
SQL["edge_closure"] = f"{_HALVES}, ahead as (select * from forward union select * from backward where callee not in ({_SYMBOLS})){_CLOSED}"
SQL["forward_closure"] = f"{_HALVES}, ahead as (select * from forward){_CLOSED}"
SQL["external_classify"] = f"with {_E} select \"binary\", caller, callee, case when callee in ({_SYMBOLS}) then 'external' else 'internal' end as kind from e"
_INLINE = """
with n as (select p_brand, p_partkey, unnest([1, 3, 7, 11, 13, 17, 19]) as f, unnest(generate_series(0, 6)) as pos from part),
a as (select p_brand, p_partkey, pos, (p_partkey * f + f) % 400 as m from n),
h as (select a.p_brand, a.p_partkey, a.pos, a.m, p.p_name from a join part p on p.p_brand = a.p_brand and p.p_partkey = a.m where a.m not in (0, 8)),
"""
SQL["neighbor_inline"] = f"""{_INLINE}
g as (select p_brand, p_partkey, string_agg('code:' || m || ':' || p_name, ',' order by pos) as s from h group by all), r as (select p_brand, p_partkey, string_agg('name:' || m, ',' order by pos) as s from a group by all)
select r.p_brand, r.p_partkey::varchar as func_name, coalesce(g.s, r.s) as callees from r left join g using (p_brand, p_partkey)
"""
SQL["first_n_neighbors"] = f"""{_INLINE}
k as (select *, row_number() over (partition by p_brand, p_partkey order by pos) as i from h),
g as (select p_brand, p_partkey, string_agg('callee ' || m || ': ' || p_name, chr(10) order by i) as a, string_agg('caller ' || i || ': ' || p_name, chr(10) order by i) as b from k where i <= 5 group by all)
select p_brand, p_partkey::varchar as func_name, coalesce(a, '') as callees, coalesce(b, '') as callers from part left join g using (p_brand, p_partkey)
"""

SQL["jaccard_tokens"] = r"""
with x as (select doc_id, list_distinct(string_split_regex(text, '\s+')) as w from documents), w as (select x.doc_id, x.w, y.w as b from x join x y on y.doc_id = x.doc_id + 1)
select doc_id, round(len(list_intersect(w, b)) / (len(w) + len(b) - len(list_intersect(w, b))), 9) as jaccard from w
"""
_SCORED = """
with b as (select vec_id // 20 as func, 't' || (label % 3) as type, vec_id as id, ['a' || (vec_id % 3), 'b' || (vec_id % 5), 'c'] as paths, embedding::double[] as v, vec_id % 40 < 2 as open from embeddings),
s as (select l.func, l.type, l.id as left_id, r.id as right_id, l.open and r.open as same, len(list_intersect(l.paths, r.paths)) / (6 - len(list_intersect(l.paths, r.paths))) as st, list_cosine_similarity(l.v, r.v) as se
  from b l join b r on l.func = r.func and l.type = r.type and l.id % 2 = 0 and r.id % 2 = 1),
x as (select func, type, left_id, right_id, round(st, 6) as structure_score, round(se, 6) as semantic_score, round(case when same then 0.9 else 0.8 * st + (1 - 0.8::double) * se end, 6)::double as final_score from s)
"""
SQL["blended_scores"] = f"{_SCORED} select * from x"
SQL["argmax_candidate"] = f"{_SCORED} select left_id, right_id, final_score from x qualify row_number() over (partition by left_id order by final_score desc, right_id) = 1"
SQL["cosine_pairs"] = "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"

_STRICT = "'{\"code_description\": \"does ' || json_extract_string(props, '$.k') || '\"}'"
_REPLIES = f"""
r as (select event_id, case event_id % 5 when 0 then {_STRICT} when 1 then '```json' || chr(10) || {_STRICT} || chr(10) || '```' when 2 then 'Sure: ' || {_STRICT} || ' ok'
  when 3 then '{{"code_description": "cut ' || json_extract_string(props, '$.k') || '}}' else 'plain ' || json_extract_string(props, '$.k') end as reply from events)
"""
_FENCE = _strip("regexp_replace(regexp_replace(" + _strip("{0}") + ", '^[`json]+|[`json]+$', '', 'g'), '^`+|`+$', '', 'g')")


def _reply(x: str, braced: str, key: str, close_quote: bool = True, drop_key: bool = True) -> str:
    text = _strip(f"regexp_replace({_strip(f'regexp_replace({braced}, {_str(chr(94) + chr(92) + chr(123) + chr(43))}, {chr(39) * 2})')}, '\\}}+$', '')")
    if drop_key:
        text = f"replace({text}, '\"{key}\":', '')"
    text = f"case when suffix({text}, '\"') then {text} else {text} || '\"' end" if close_quote else _strip(text)
    bare = f"replace({x}, '{{' || chr(10) || '    \"{key}\":', '')"
    get = lambda v: f"case when json_valid({v}) then json_extract_string({v}, '$.{key}') end"
    return f"coalesce({get(x)}, case when {braced} <> '' then {get(braced)} end, case when {braced} <> '' then {text} end, {_strip(bare) if close_quote else bare})"


_BRACED = r"regexp_extract({0}, '(?s)\{{.*\}}', 0)"
SQL["json_reply_extract"] = f"""
with {_REPLIES}, f as (select event_id, reply, {_FENCE.format('reply')} as x from r), b as (select *, {_BRACED.format('x')} as xb, {_BRACED.format('reply')} as rb from f)
select event_id, {_reply('x', 'xb', 'code_description')} as description, {_reply('reply', 'rb', 'code_description', drop_key=False)} as with_key from b
"""
SQL["json_name_extract"] = f"""
with {_REPLIES}, f as (select event_id, {_FENCE.format("replace(reply, 'code_description', 'new_name')")} as x from r), b as (select *, {_BRACED.format('x')} as xb from f),
g as (select event_id, {_reply('x', 'xb', 'new_name', close_quote=False)} as got from b)
select event_id, case when got is null or length(got) > 12 then 'orig' else got end as new_name from g
"""
_ANSWERS = r"""
w as (select conv_id, turn, regexp_replace(substring(text, 1, length(text) // 2), '[^\p{L}]', '', 'g') as w, regexp_replace(substring(text, length(text) // 2 + 1), '[^\p{L}]', '', 'g') as v from conversations),
a as (select conv_id, turn, case (conv_id + turn) % 6 when 0 then 'The function name is: ' || w || '_' || v || '.' || chr(10) || 'because' when 1 then 'Name: "' || w || '" I think' when 2 then 'It is `ns::' || w || '`'
  when 3 then w || '::' || v when 4 then 'call ' || w || ' ' || v else '' end as answer from w)
"""
SQL["prediction_parse"] = f"""
with {_ANSWERS}, p1 as (select conv_id, turn, split_part(split_part(split_part(answer, chr(10), 1), '.', 1), ':', -1) as x from a),
p2 as (select conv_id, turn, case when contains(x, '"') then split_part(x, '"', 2) else x end as x from p1), p3 as (select conv_id, turn, case when contains(x, '`') then split_part(x, '`', 2) else x end as x from p2)
select conv_id, turn, {_strip("split_part(" + _strip("split_part(x, '.', -1)") + ", ' ', -1)")} as predicted from p3
"""
SQL["truth_parse"] = f"with {_ANSWERS} select conv_id, turn, {_strip('replace(split_part(' + _strip('answer') + ', ' + chr(39) + ':' + chr(39) + ', -1), ' + chr(39) + '.' + chr(39) + ', ' + chr(39) * 2 + ')')} as truth, replace({_strip(chr(39) + 'assistant: ' + chr(39) + ' || answer')}, 'assistant: ', '') as reply from a"
SQL["name_tokens"] = r"select p_partkey, trim(regexp_replace(lower(p_name || '_' || p_brand || ' ' || p_type), '[^\p{L}]+', ' ', 'g')) as tokens, len(string_split(lower(p_name), ' '))::int as n_words from part"
SQL["canonicalize_name"] = "select p_partkey, regexp_replace('__' || replace(lower(p_name), ' ', '___') || '_', '^_+|_+$|_{2,}', '_', 'g') as name from part"
SQL["edit_similarity"] = "with p as (select a.p_partkey, a.p_name as a, b.p_name as b from part a join part b on b.p_partkey = a.p_partkey + 1) select p_partkey, round(1.0::double - damerau_levenshtein(a, b) / greatest(length(a), length(b)), 9) as similarity from p"
SQL["prefix_match"] = "with p as (select p_partkey, p_name as a, substring(p_name, 1, 3) as b from part union all select a.p_partkey, a.p_name, b.p_name from part a join part b on b.p_partkey = a.p_partkey + 1) select p_partkey, (starts_with(a, b) or starts_with(b, a)) and length(a) > 1 and length(b) > 1 as is_prefix from p"
_COUNTS = """
l as (select a.p_partkey, string_split(lower(a.p_name), ' ') as r, string_split(lower(b.p_name), ' ') as g from part a join part b on b.p_partkey = a.p_partkey + 1),
c as (select p_partkey, case when r = g then len(r) else len(list_intersect(r, g)) end::bigint as tp,
  case when r = g then 0 else len(list_distinct(g)) - len(list_intersect(r, g)) end::bigint as fp, case when r = g then 0 else len(list_distinct(r)) - len(list_intersect(r, g)) end::bigint as fn from l)
"""
SQL["token_counts"] = f"with {_COUNTS} select * from c"
SQL["micro_prf1"] = f"""
with {_COUNTS}, s as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c), p as (select *, tp / (tp + fp) as p, tp / (tp + fn) as r from s)
select tp, fp, fn, round(p, 9) as precision, round(r, 9) as recall, round(2 * p * r / (p + r), 9) as f1 from p
"""
SQL["judge_agreement"] = """
with a as (select doc_id // 7 as k, arg_max(quality = 1, doc_id) as a from labels where quality = 1 or toxic = 0 group by k), b as (select doc_id // 7 as k, arg_max(toxic = 1, doc_id) as b from labels where quality = 0 or toxic = 0 group by k),
x as (select * from a full join b using (k))
select count(*) filter (a is not null and b is not null) as n_common, count(*) filter (a and b) as n_both_true, count(*) filter (b is null) as n_only_first, count(*) filter (a is null) as n_only_second,
  round(count(*) filter (a and b) / count(*) filter (a is not null and b is not null), 9) as ratio from x
"""
SQL["similar_rate"] = "select count(*) filter (quality = 1) as n_similar, count(*) as n_total, round(count(*) filter (quality = 1) / count(*), 9) as rate from labels"
SQL["vector_verdicts"] = "with c as (select vec_id, greatest(0.0, least(1.0, round(list_sum(list_transform(embedding, lambda x: x::double * x::double * 0.8::double)) + embedding[1]::double, 6))) as c from embeddings) select vec_id, c >= 0.7 as similarity, round_even(c, 4)::double as similarity_score from c"

SQL["chat_records"] = r"""
with x as (select u.conv_id || '_' || u.turn as func_name, u.text as input, a.text as output from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'),
k as (select *, regexp_replace(input, '("(?:\\(?s:.)|[^"\\])*")|/\*(?s:.*?)\*/|//[^\n]*', '\1', 'g') as code from x), l as (select * from k where len(list_filter(string_split(code, chr(10)), lambda s: regexp_matches(s, '\S'))) > 1),
m as (select *, case when instr(input, func_name) > 0 then substring(input, 1, instr(input, func_name) - 1) || '[MASK]' || substring(input, instr(input, func_name) + length(func_name)) else input end as masked from l)
select 0 as part, func_name, 'user:Code:' || chr(10) || masked || chr(10) || chr(10) || 'assistant:' || output as record from m
union all select 2, func_name, 'user:info|puts, free|callee g: adds||' || code || chr(10) || 'assistant:The function name is: ' || lower(func_name) || '.' from l
"""
SQL["context_prompts"] = """
with w as (select doc_id, lang, string_split(text, ' ') as w from documents)
select doc_id as bin_name, md5(array_to_string(case when len(w) > 100 then list_concat(w[1:50], w[-50:]) else w end, chr(10)) || '|libc|ELF, ' || lang) as prompt_md5 from w
"""
SQL["checkpoint_counts"] = "select event_id // 1000 as batch, count(*) as n, count(distinct user_id) as n_users from events group by event_id // 1000"
SQL["completion_order"] = "select event_id, row_number() over (partition by user_id order by ts, event_id)::int as arrived, user_id from events"
SQL["model_replies"] = "select item_id as id, substring(sha256(text), 1, 16) as description from benchmark"


def _program(name: str, called: str, last: str) -> str:
    """The text of each page's program, with other names."""
    texts = ", ".join(_str(p.replace("run_@K", name).replace("FUN_00@K", called).replace("FUN_9", last)) for p in PROGRAMS)
    return f"replace(replace([{texts}][length(html) % 4 + 1], '@K', page_id::varchar), '@H', md5(html))"


SQL["mask_names"] = f"select page_id, md5({_program('[MASK]', 'FUN_00@K', 'FUN_9')}) as masked_md5, md5({_program('[MASK]', 'FUN_00@K', 'FUN_9')}) as first_md5 from pages"


def _renamed() -> str:
    """Called names in order of appearance: in the fourth program FUN_7 comes first and the page's own last."""
    texts = [p.replace("FUN_00@K", "FUN_0").replace("FUN_9", "FUN_1") for p in PROGRAMS[:3]]
    texts.append(PROGRAMS[3].replace("FUN_7", "FUN_0").replace("FUN_9", "FUN_1").replace("FUN_00@K", "FUN_2"))
    return f"replace(replace([{', '.join(map(_str, texts))}][length(html) % 4 + 1], '@K', page_id::varchar), '@H', md5(html))"


SQL["rename_calls"] = f"select page_id, md5({_renamed()}) as renamed_md5 from pages"
#: Block records of the four programs: number, type, first line, line after the last, children.
BLOCKS = (
    (0, "run", "full_function", "null", "null", ""),
    (1, "2", "for_statement", 2, 10, ""), (1, "1", "for_statement", 10, 18, ""), (1, "run", "function_definition", "null", "null", "2,1"),
    (2, "2", "while_statement", 2, 12, ""), (2, "1", "for_statement", 12, 20, ""), (2, "run", "function_definition", "null", "null", "2,1"),
    (3, "2", "while_statement", 2, 20, "1"), (3, "1", "if_statement", 12, 19, ""), (3, "run", "function_definition", "null", "null", "2"),
)
_BLOCKS = "b(v, block_id, type, line_start, line_end, relation) as (values " + ", ".join(f"({v}, '{i}', '{t}', {a}::int, {z}::int, '{r}')" for v, i, t, a, z, r in BLOCKS) + ")"
SQL["code_blocks"] = f"with {_BLOCKS} select page_id, block_id, type, line_start, line_end, relation from pages join b on v = length(html) % 4"
_TOP = "translation_unit>function_definition>compound_statement>"
_FOR = ["for_statement>compound_statement>expression_statement"] * 4
_IN_IF = ["while_statement>compound_statement>if_statement>compound_statement>expression_statement"] * 4
PATHS = (_FOR, _FOR * 2, _IN_IF + _FOR, ["while_statement>compound_statement>expression_statement"] * 8 + _IN_IF)
_PATHS = ", ".join(_str("\n".join(_TOP + p for p in [*ps, "expression_statement", "expression_statement"])) for ps in PATHS)
SQL["structure_paths"] = f"select page_id, [{_PATHS}][length(html) % 4 + 1] as paths from pages"
_GREEDY = _SCORED.replace("'t' || (label % 3) as type", "case when vec_id % 20 >= 18 then 'full_function' else 't' || (label % 3) end as type").replace("\nwith b", "\nwith recursive b").replace("on l.func", "on l.type <> 'full_function' and l.func")
SQL["blended_alignment"] = f"""{_GREEDY},
c as (select func, left_id, list({{'r': right_id, 's': final_score}} order by final_score desc, right_id) as cs, row_number() over (partition by func order by left_id) as k from x where final_score >= 0.3 group by func, left_id),
g as (select func, 0::bigint as k, []::bigint[] as used, null::bigint as left_id, null::bigint as right_id, null::double as final_score from (select distinct func from c)
  union all select func, k, case when pick is null then used else list_append(used, pick.r) end, left_id, pick.r, pick.s
  from (select g.func, c.k, g.used, c.left_id, list_filter(c.cs, lambda p: not list_contains(g.used, p.r))[1] as pick from g join c on c.func = g.func and c.k = g.k + 1))
select func, left_id, right_id, final_score from g where right_id is not null
"""
# Local alignment of an abbreviation, a cell at a time: score and matched places of the row above and of this one.
_ALIGN = """
z(a, b, i, j, above, row, top, n) as (
  select a, b, 1, 0, list_transform(range(length(b) + 1), lambda q: {{'s': 0.0::double, 'n': 0}}), [{{'s': 0.0::double, 'n': 0}}], 0.0::double, 0 from {0}
  union all
  select a, b, case when j = length(b) then i + 1 else i end, case when j = length(b) then 0 else j + 1 end,
    case when j = length(b) then row else above end, case when j = length(b) then [{{'s': 0.0::double, 'n': 0}}] else list_append(row, cell) end,
    case when j < length(b) and cell.s > top then cell.s else top end, case when j < length(b) and cell.s > top then cell.n else n end
  from (select *, case when v = 0 or j = length(b) then {{'s': 0.0::double, 'n': 0}} when v = m then {{'s': v, 'n': above[j + 1].n + 1}} when v = f then {{'s': v, 'n': above[j + 2].n}} else {{'s': v, 'n': row[j + 1].n}} end as cell
    from (select *, greatest(0.0, m, f, h) as v from (select *, above[j + 1].s + case when a[i] = b[j + 1] then 2.0 else -2.0 end as m, above[j + 2].s - 1.0 as f, row[j + 1].s - 3.0 as h from z where i <= length(a)))))
"""
_ALIGNED = "select a, b, top as score, case when b = '' then 0.0 else least(1.0, top / (2 * length(b))) end::double as confidence, n::int as n_places from z where i = length(a) + 1"
SQL["abbreviation_match"] = f"""
with recursive p as (select p_partkey, p_name, replace(lower(p_name), ' ', '') as a, replace(lower(regexp_replace(p_name, '[aeiou ]', '', 'g')), ' ', '') as b from part),
d as (select distinct a, b from p), {_ALIGN.format('d')}, g as ({_ALIGNED})
select p_partkey, score::double as score, confidence, n_places from p join g using (a, b)
"""


def similar(pairs: str) -> str:
    """CTEs (after ``with recursive``) that end in v(r, g, alike): the cascade over the pairs of the CTE ``pairs`` (r, g)."""
    grams = "(select w, unnest(generate_series(1, greatest(length(w) - 2, 1))) as i from words)"
    side = lambda c: f"replace(replace(replace(lower({c}), '_', ''), '-', ''), ' ', '')"
    lemma = lambda c: f"case when regexp_matches({c}, '^[a-z]{{3,}}$') then regexp_replace({c}, '^([a-z]{{3,}}?)(?:ing|ed|es|s)$', '\\1') end"
    gate = f"least(length(r), length(g)) >= 3 and r not in {_list(sorted(S.PREPOSITIONS))} and g not in {_list(sorted(S.PREPOSITIONS))}"
    gate_p = gate.replace("(r)", "(p.r)").replace("(g)", "(p.g)").replace("and r not", "and p.r not").replace("and g not", "and p.g not")
    ok = f"x.confidence >= {S.CONFIDENCE} and x.n_places >= {S.PLACES}"
    return f"""
d as (select distinct {side('r')} as a, {side('g')} as b from {pairs} where {gate} union select distinct {side('g')}, {side('r')} from {pairs} where {gate}),
{_ALIGN.format('d')}, al as ({_ALIGNED}),
words as (select distinct w from (select r as w from {pairs} union all select g from {pairs})),
hashed as (select w, ('0x' || substring(md5(substring(w, i, 3)), 1, 15))::bigint as h from {grams}),
vec as (select w, h % 64 as k, sum(case when h // 64 % 2 = 1 then 1.0 else -1.0 end)::double as v from hashed group by all),
norm as (select w, sqrt(sum(v * v)) as n from vec group by w having n > 0),
cosine as (select p.r, p.g, sum(a.v * b.v) / (any_value(m.n) * any_value(o.n)) as c from {pairs} p join vec a on a.w = p.r join vec b on b.w = p.g and b.k = a.k join norm m on m.w = p.r join norm o on o.w = p.g group by p.r, p.g),
v as (select p.r, p.g, case when p.r = '' or p.g = '' then p.r = p.g else
  trim(p.r) = trim(p.g) or 1.0 - damerau_levenshtein(p.r, p.g) / greatest(length(p.r), length(p.g)) >= {S.EDIT}
  or coalesce({lemma('p.r')} = {lemma('p.g')}, false)
  or ({gate_p} and exists (select 1 from al x where {ok} and ((x.a = {side('p.r')} and x.b = {side('p.g')}) or (x.a = {side('p.g')} and x.b = {side('p.r')}))))
  or (least(length(p.r), length(p.g)) > 1 and (starts_with(p.r, p.g) or starts_with(p.g, p.r)))
  or (least(length(p.r), length(p.g)) >= 3 and coalesce(c, 0) >= {S.VECTORS}) end as alike
  from {pairs} p left join (select r as cr, g as cg, c from cosine) on cr = p.r and cg = p.g)
"""


SQL["similar_prf1"] = f"""
with recursive l as (select a.p_partkey as k, string_split(lower(a.p_name), ' ') as rs, string_split(lower(b.p_name), ' ') as gs from part a join part b on b.p_partkey = a.p_partkey + 1),
u as (select k, rs, gs, unnest(generate_series(1, len(gs))) as j from l), t as (select k, rs, gs, j, unnest(generate_series(1, len(rs))) as i from u),
q as (select distinct rs[i] as r, gs[j] as g from t), {similar('q')},
first as (select k, j, min(i) as i from t join v on v.r = rs[i] and v.g = gs[j] where alike and rs[i] <> gs[j] and rs[i] not in {_list(S.UNMATCHED)} and gs[j] not in {_list(S.UNMATCHED)} and not list_contains(rs, gs[j]) group by k, j),
o as (select u.k, any_value(u.rs) as rs, list(coalesce(u.rs[first.i], u.gs[u.j]) order by u.j) as os from u left join first on first.k = u.k and first.j = u.j group by u.k),
c as (select case when rs = os then len(rs) else len(list_intersect(list_distinct(rs), os)) end as tp, case when rs = os then 0 else len(list_distinct(os)) - len(list_intersect(list_distinct(rs), os)) end as fp,
  case when rs = os then 0 else len(list_distinct(rs)) - len(list_intersect(list_distinct(rs), os)) end as fn from o),
s as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c), p as (select *, tp / (tp + fp) as p, tp / (tp + fn) as r from s)
select tp, fp, fn, round(p, 9) as precision, round(r, 9) as recall, round(2 * p * r / (p + r), 9) as f1 from p
"""
