"""DuckDB SQL of the operators' queries that SQL can express."""

from __future__ import annotations

from tessera.llm.quality import BIT, MEASURES, POLICIES, RULES

SPACED = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FAILED = " + ".join(f"case when {rule} then {BIT[name]} else 0 end" for name, rule in RULES.items())
_V1 = " or ".join(f"({RULES[r]})" for r in POLICIES["v1"])

OP1 = f"""with d as (select doc_id, coalesce(text,'') as t, regexp_extract_all(coalesce(text,''), '{SPACED}') as ws from documents),
 l as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '{SPACED}') group by 1),
 w as (select doc_id, generate_subscripts(ws,1) as i, unnest(ws) as w from d),
 g as (select doc_id, i, w, case when lead(w,4) over o is not null then concat_ws(' ', w, lead(w,1) over o, lead(w,2) over o, lead(w,3) over o, lead(w,4) over o) end as win from w window o as (partition by doc_id order by i)),
 r as (select doc_id, i, w, win is not null and count(*) over (partition by doc_id, win) > 1 as again from g),
 c as (select doc_id, w, max(case when again then 1 else 0 end) over (partition by doc_id order by i rows between 4 preceding and current row) as hit from r),
 a as (select doc_id, count(*) as n_words, cast(sum(length(w)) as bigint) as word_chars, cast(sum(hit) as bigint) as n_repeat_words from c group by 1),
 m as (select d.doc_id, coalesce(n_words,0) as n_words, coalesce(word_chars,0) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(n_dup_lines,0) as n_dup_lines, coalesce(n_repeat_words,0) as n_repeat_words, coalesce(n_lines,0) as n_lines
  from d left join a on a.doc_id=d.doc_id left join l on l.doc_id=d.doc_id)
 select doc_id, {", ".join(m for m in MEASURES if m != "n_lines")}, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, not ({_V1}) as kept, cast({_FAILED} as bigint) as failed from m"""

OP3 = f"""with d as (select doc_id, regexp_extract_all(coalesce(text,''), '{SPACED}') as ws from documents),
 w as (select doc_id, ws, generate_subscripts(ws,1) as i, unnest(ws) as w from d),
 g as (select doc_id, i, w, case when i + 34 <= len(ws) then array_to_string(ws[i:i+34], ' ') end as win from w),
 r as (select doc_id, i, w, win is not null and count(*) over (partition by win) > 1 as again from g),
 c as (select doc_id, i, w, max(case when again then 1 else 0 end) over (partition by doc_id order by i rows between 34 preceding and current row) as hit from r),
 a as (select doc_id, count(*) as n_words, cast(sum(hit) as bigint) as n_removed, string_agg(w, ' ' order by i) filter (where hit=0) as kept from c group by 1)
 select d.doc_id, coalesce(n_words,0) as n_words, coalesce(n_removed,0) as n_removed, sha256(coalesce(kept,'')) as kept_sha256 from d left join a on a.doc_id=d.doc_id"""

OP5 = f"""with recursive d as (select doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text,'')")}, '{SPACED}') as ws from documents),
 s as (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws,' ') else array_to_string(ws[i:i+2],' ') end as s from (select doc_id, ws, unnest(range(1, greatest(len(ws)-1, 2))) as i from d where len(ws)>0)),
 n as (select doc_id, count(*) as n from s group by 1),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s=b.s and a.doc_id<b.doc_id group by 1,2),
 e as (select a, b from p join n na on na.doc_id=a join n nb on nb.doc_id=b where 100*k >= 85*(na.n+nb.n-k)),
 u as (select a, b from e union all select b, a from e),
 reach(a, b) as (select a, b from u union select r.a, u.b from reach r join u on u.a=r.b),
 c as (select a, min(b) as low from reach group by 1)
 select d.doc_id, coalesce(n.n,0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) as kept from d left join n on n.doc_id=d.doc_id left join c on c.a=d.doc_id"""

OP7 = f"""with d as (select doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text,'')")}, '{ALNUM}') as ws from documents),
 b as (select item_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text,'')")}, '{ALNUM}') as ws from benchmark),
 bw as (select distinct item_id, least(len(ws),13) as n, array_to_string(ws[i:i+least(len(ws),13)-1],' ') as win from (select item_id, ws, unnest(range(1, greatest(len(ws)-11, 2))) as i from b where len(ws)>0)),
 dw as (select doc_id, n, i, array_to_string(ws[i:i+n-1],' ') as win from (select doc_id, ws, n, unnest(range(1, len(ws)-n+2)) as i from d, (select distinct n from bw) where len(ws)>=n)),
 h as (select dw.doc_id, dw.n, dw.i, item_id from dw join bw on bw.win=dw.win and bw.n=dw.n),
 k as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(i, i+n)) as w from h) group by 1),
 q as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from h) group by 1)
 select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit,0) as n_hit, coalesce(n_items,0) as n_items, sha256(coalesce(ids,'')) as items_sha256, coalesce(n_hit,0)>0 and 20*coalesce(n_hit,0)>=len(ws) as contaminated from d left join k on k.doc_id=d.doc_id left join q on q.doc_id=d.doc_id"""

OP8 = """with d as (select doc_id, hex(encode(coalesce(text,''))) as h, octet_length(encode(coalesce(text,''))) as n from documents),
 w as (select doc_id, h, n, unnest(range(0, n)) as i from d),
 g as (select doc_id, i, substr(h, 2*i+1, 2) as b, case when i + 50 <= n then substr(h, 2*i+1, 100) end as win from w),
 r as (select doc_id, i, b, win is not null and min(doc_id) over (partition by win) < doc_id as again from g),
 c as (select doc_id, i, b, max(case when again then 1 else 0 end) over (partition by doc_id order by i rows between 49 preceding and current row) as hit from r),
 s as (select *, hit=1 and coalesce(lag(hit) over (partition by doc_id order by i),0)=0 as new from c),
 a as (select doc_id, cast(sum(hit) as bigint) as n_removed, count(*) filter (where new) as n_spans, string_agg(b, '' order by i) filter (where hit=0) as kept from s group by 1)
 select d.doc_id, cast(n as bigint) as n_bytes, coalesce(n_removed,0) as n_removed, coalesce(n_spans,0) as n_spans, sha256(unhex(coalesce(kept,''))) as kept_sha256 from d left join a on a.doc_id=d.doc_id"""

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [("assign", ASSIGN.replace("'", "''"), 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
_MATCHES = " union all ".join(f"select doc_id, '{kind}' as kind, {k} as k, string_split_regex(t, '{rule}') as gaps, regexp_extract_all(t, '{rule}') as found, regexp_extract_all(t, '{rule}', {group}) as value, {least} as least from d" for k, (kind, rule, group, least) in enumerate(_KINDS))
#: The base spans alone: layers are beyond SQL.
OP6_BASE = f"""with d as (select doc_id, coalesce(text,'') as t from documents), m as ({_MATCHES}),
 s as (select doc_id, kind, k, gaps, found, unnest(range(1, len(found)+1)) as i from m where len(found)>0),
 p as (select s.doc_id, s.kind, s.k, list_sum(list_transform(s.gaps[1:s.i], lambda x: length(x))) + coalesce(list_sum(list_transform(s.found[1:s.i-1], lambda x: length(x))),0) as a, length(s.found[s.i]) as n, length(m.value[s.i]) as size, least from s join m on m.doc_id=s.doc_id and m.k=s.k),
 g as (select doc_id, count(*) filter (where k=0) as n_assign, count(*) filter (where k=1) as n_access, count(*) filter (where k=2) as n_hex, string_agg(kind || ':' || cast(a as bigint) || ':' || cast(a+n as bigint), ',' order by a, k) as spans from p where size>=least group by 1)
 select d.doc_id, coalesce(n_assign,0) as n_assign, coalesce(n_access,0) as n_access, coalesce(n_hex,0) as n_hex, sha256(coalesce(spans,'')) as base_sha256 from d left join g on g.doc_id=d.doc_id"""

ORACLES = {"op1_quality_rules": OP1, "op3_substring_dedup": OP3, "op5_near_dedup": OP5, "op6_base_spans": OP6_BASE, "op7_decontamination": OP7, "op8_suffix_dedup": OP8}
