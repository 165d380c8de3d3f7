"""DuckDB SQL of ``marlstone.edge_queries``, by name."""

from __future__ import annotations

from marlstone.edge_queries import MANGLED
from marlstone.functions import code as C
from marlstone.oracles import _INLINE, _SPLITS, BLOCKS, SQL, _program, _str, similar

__all__ = ["SQL"]

_SUPPLIERS = "select s_nationkey as nation, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int as pos, s_name as key, s_suppkey as k, s_acctbal as balance from supplier"
SQL["json_dict_scan"] = _SUPPLIERS
SQL["json_array_scan"] = _SUPPLIERS
SQL["json_record_scan"] = f"select nation, pos, k, balance from ({_SUPPLIERS})"
SQL["tolerant_load"] = "select s_nationkey as nation, case when s_nationkey % 5 = 0 then 0 else count(*) end as n, s_nationkey % 5 = 0 as malformed from supplier group by s_nationkey"
SQL["relative_paths"] = "select distinct 'region=' || n_regionkey || '/nation=' || n_nationkey as folder from nation join supplier on s_nationkey = n_nationkey"
_WORDS = r"trim(regexp_replace(lower({0}), '[^\p{{L}}]+', ' ', 'g'))"
SQL["score_lines"] = f"select {_WORDS.format('p_name')} as truth, ' ' || {_WORDS.format('p_type')} as prediction from part"
SQL["prompt_template"] = "select n_nationkey, 'Name: ' || n_name || chr(10) || 'Key: ' || n_nationkey || chr(10) as prompt from nation"
SQL["process_outputs"] = "select r_name as path, r_name as said, '[Timeout] Command took too long.' as late, '[Errno 2] No such file or directory: ' || chr(39) || '/absent/tool' || chr(39) as absent, '' as failed from region"

_DUMPED = """f as (select o_orderstatus as opt, 'p/' || (o_custkey % 10) as bin_name, o_orderkey as k, 'fn_' || o_orderkey as func_name, o_custkey,
  case when o_orderkey % 11 = 0 then 1 else o_orderkey % 9 end::int as n_assembly, 'int fn_' || o_orderkey || '(void) { return ' || o_custkey || '; }' as decomp_code from orders)"""
SQL["function_dump"] = f"with {_DUMPED} select opt, 'p' as project, bin_name, func_name, k as start, k + 9 as \"end\", n_assembly, decomp_code from f"
SQL["variable_dump"] = f"""
with {_DUMPED}, v as (select *, 'local' as kind, 'v' as name, k % 4 as t from f union all select *, 'argument', 'a', (k + 1) % 4 from f)
select opt, bin_name, func_name, kind, name, ['unsigned int *', 'char *', 'int', 'pair_t'][t + 1] as type, case when kind = 'local' then k % 4 = 2 end as is_enum, case when kind = 'local' then k % 4 = 3 end as is_struct,
  case when kind = 'argument' then 'RDI' end as register, case when kind = 'argument' then 1 end::int as count from v
"""
SQL["call_graph_dump"] = f"with {_DUMPED} select opt, bin_name, func_name, case when k % 5 <> 0 then k::varchar else 'unknown' end as address, k % 3 = 0 as is_external, 'fn_' || (k + 1) as callees from f"
SQL["call_graph_edges"] = f"""
with {_DUMPED} select opt, bin_name, func_name as caller, 'fn_' || (k + 1) as callee, 'internal' as kind from f union select opt, bin_name, func_name, 'puts', 'external' from f
union select opt, bin_name, 'fn_' || (k - 1), func_name, case when k % 3 = 0 then 'external' else 'internal' end from f
"""
SQL["symbol_sets"] = f"with {_DUMPED} select opt, bin_name, func_name as symbol, case when k % 3 = 0 then 'external' else 'defined' end as kind from f"
SQL["display_ids"] = f"""
with {_DUMPED}, i as (select opt, bin_name, func_name, case when k % 3 = 0 then func_name when k % 5 = 0 then 'EXT_' || func_name else k::varchar end as id from f)
select f.opt, f.bin_name, a.id as caller, coalesce(b.id, 'fn_' || (k + 1)) as callee from f join i a using (opt, bin_name, func_name) left join i b on b.opt = f.opt and b.bin_name = f.bin_name and b.func_name = 'fn_' || (k + 1)
"""
SQL["segment_filter"] = "with s as (select o_orderkey, ['LOAD', '.text', '.plt', 'COMMON', '.data', '', '.plt.got'][o_orderkey % 7 + 1] as s from orders) select o_orderkey, s in ('LOAD', '.text', 'COMMON') as is_code, starts_with(s, '.plt') as is_linkage from s"
SQL["file_type_filter"] = "select page_id, page_id % 6 not in (2, 3, 4) as is_binary from pages"
SQL["aggregate_types"] = "select p_partkey, p_partkey % 4 = 2 as is_enum, p_partkey % 4 = 0 as is_struct, p_partkey % 4 = 1 as is_union from part"
SQL["modes"] = "select * from (values (false, false, 'set exactly one of dataset, prediction'), (false, true, 'prediction'), (true, false, 'dataset'), (true, true, 'set exactly one of dataset, prediction')) t(dataset, prediction, mode)"

SQL["places_roundtrip"] = "select 'x' as arch, o_orderstatus as opt, 'p' as project, (o_custkey % 8)::varchar as \"binary\", 'fn_' || o_orderkey as func_name, 'int fn_' || o_orderkey || '(void) { return ' || o_custkey || '; }' as decomp_code from orders"
SQL["splits_roundtrip"] = _SPLITS
SQL["records_roundtrip"] = "select n_name, r_regionkey, r_name from nation join region on n_regionkey = r_regionkey"
SQL["append_new_rows"] = "select c_custkey, c_name from customer"
SQL["ordered_merge"] = "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1"
SQL["dataset_registration"] = """
select 'names' as dataset, * from (values ('', 'file_name', 'train.json'), ('', 'formatting', 'sharegpt'), ('columns', 'messages', 'messages'), ('tags', 'role_tag', 'role'),
  ('tags', 'content_tag', 'content'), ('tags', 'user_tag', 'user'), ('tags', 'assistant_tag', 'assistant')) t(section, name, value)
"""
SQL["stream_append"] = "select user_id, 1::bigint as n from events group by user_id"
SQL["stream_first_seen"] = "select distinct user_id from events"

SQL["judge_replies"] = """
with x as (select a.p_partkey as id, a.p_name as t, case when b.p_partkey % 7 <> 0 then b.p_name else '' end as g from part a join part b on b.p_partkey = a.p_partkey + 1),
y as (select *, g <> '' and substring(t, 1, 3) = substring(g, 1, 3) as similarity from x)
select id, similarity, similarity::int::double as similarity_score, case when g = '' then 'no name' end as error from y
"""
SQL["verdict_parse"] = "select p_partkey, p_partkey % 5 < 2 as similar from part"
SQL["predicted_names"] = """
with c as (select conv_id, turn, role, case when conv_id % 6 <> 0 then text else '' end as text from conversations),
x as (select conv_id as id, arg_min(text, turn) as first, arg_max(text, turn) as ground_truth from c group by conv_id)
select id, ground_truth, case when first = '' then '' else substring(md5(first), 1, 8) end as predicted_name from x
"""
SQL["error_filter"] = "select false as keep_empty, item_id as id, substring(md5(text), 1, 8) as reply from benchmark where item_id % 4 <> 0 union all select true, item_id, case when item_id % 4 <> 0 then substring(md5(text), 1, 8) else '' end from benchmark"
SQL["filled_records"] = "select doc_id from documents join labels using (doc_id) where coalesce(quality, toxic) is not null"
SQL["embedded_texts"] = """
with g as (select item_id, text, unnest(generate_series(1, greatest(length(text) - 2, 1))) as i from benchmark), h as (select item_id, ('0x' || substring(md5(substring(text, i, 3)), 1, 15))::bigint as h from g),
v as (select item_id, h % 64 as k, sum(case when h // 64 % 2 = 1 then 1 else -1 end) as v from h group by all), n as (select item_id, sqrt(sum(v * v)) as n from v group by item_id)
select item_id, k::int as component, round(v / n, 6)::double as value from v join n using (item_id) where v <> 0
"""

SQL["neighbor_inline_always"] = f"""{_INLINE}
g as (select p_brand, p_partkey, string_agg('code:' || m || ':' || p_name, ',' order by pos) as s from h group by all)
select p.p_brand, p.p_partkey::varchar as func_name, coalesce(g.s, '') as callees from part p left join g using (p_brand, p_partkey)
"""
SQL["snippet_alignment"] = """
with li as (select l_orderkey as func, l_linenumber as pos, min(l_partkey) as part from lineitem group by all),
h as (select func, pos // 2 as block, max(pos) as pos, arg_max(part, pos) as part from li where part % 3 <> 0 group by func, pos // 2),
s as (select func, string_agg(block || '|code ' || part || '|does ' || part, ';' order by pos) as history from h group by func)
select o_orderkey as func, 'f' || o_custkey as input, o_orderpriority as output, coalesce(history, '') as history from orders left join s on func = o_orderkey where o_totalprice > 50000
"""
SQL["call_renamed_dedup"] = r"""
with c as (select o_orderkey, case when o_orderkey % 7 = o_orderkey % 3 then 'FUN_0(n) + FUN_0(n) + ' else 'FUN_0(n) + FUN_1(n) + ' end || (o_orderkey % 5) as body from orders),
m as (select body, min(o_orderkey) as o_orderkey from c group by body)
select o_orderkey, 'int f(int n)' || chr(10) || '{' || chr(10) || '  return ' || body || ';' || chr(10) || '}' || chr(10) as code from m
"""
SQL["split_replay"] = """
with n as (select doc_id, row_number() over (order by md5('split:' || doc_id), doc_id) - 1 as r, count(*) over () as n from documents where doc_id % 3 <> 0)
select doc_id, 'test' as split from documents where doc_id % 3 = 0
union all select doc_id, case when r < floor(0.8::double * n) then 'train' when r < floor((0.8::double + 0.1::double) * n) then 'test' else 'validation' end from n
"""
SQL["throughput"] = "with s as (select count(*) as n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as s from events) select n, round(s, 3)::double as seconds, round(n / s, 6)::double as per_second from s"
SQL["sample_sentences"] = "select p_partkey, 'The predicted function name is: ' || p_name || '. ' as output, 'The function name is: ' || lower(p_name) || '.' as answer from part"

_COUNTED = "[" + ", ".join(str(sum(v == k and a != "null" for v, _, _, a, _, _ in BLOCKS)) for k in range(4)) + "]"
SQL["block_count"] = f"select sum({_COUNTED}[length(html) % 4 + 1])::bigint as n_blocks, count(*) as n_functions from pages"


def _marked() -> str:
    """Each program's lines with markers before and after its blocks' lines."""
    from marlstone.queries import PROGRAMS

    out = []
    for v, program in enumerate(PROGRAMS):
        lines, before = program.split("\n"), {}
        for k, i, _, a, z, _ in BLOCKS:
            if k == v and a != "null":
                before.setdefault(a, []).append(C._marker(i, "start"))
                before.setdefault(z, []).insert(0, C._marker(i, "end"))
        out.append("\n".join(x for n in range(len(lines)) for x in [*before.get(n, []), lines[n]]))
    texts = ", ".join(map(_str, out))
    return f"replace(replace([{texts}][length(html) % 4 + 1], '@K', page_id::varchar), '@H', md5(html))"


SQL["block_markers"] = f"select page_id, md5({_marked()}) as marked_md5 from pages"
_NAMES = "[" + ", ".join(_str(n if n is not None else f"call {m}!") for m, n in MANGLED.items()) + "]"
SQL["demangled_names"] = f"select p_partkey, {_NAMES}[p_partkey % {len(MANGLED)} + 1] as name from part"
SQL["similar_words"] = f"""
with recursive l as (select a.p_partkey, string_split(lower(a.p_name), ' ') as rs, string_split(lower(b.p_name), ' ') as gs from part a join part b on b.p_partkey = a.p_partkey + 1),
u as (select *, unnest(generate_series(1, greatest(len(rs), len(gs)))) as i from l), w as (select p_partkey, rs[i] as r, gs[i] as g, ['', 's', 'ing', '_of', 'er'][p_partkey % 5 + 1] as e from u),
q as (select distinct r, g from (select r, g || e as g from w union all select r, r || e from w where p_partkey % 2 = 0 union all select r, regexp_replace(r, '[aeiou]', '', 'g') from w) where r is not null and g is not null),
{similar('q')}
select r as "right", g as guess, alike from v
"""
SQL["edges_by_binary"] = """
with e as (select distinct l_returnflag as "binary", l_linestatus as b from lineitem)
select "binary", 'main' as func, string_agg(b, ',' order by b) as callees, '' as callers from e group by "binary" union all select "binary", b, '', 'main' from e
"""
