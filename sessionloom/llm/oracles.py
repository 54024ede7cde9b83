"""Checking SQL of the queries on training text that SQL can express."""

_TRUE = "coalesce(lower(raw->>'$.{k}')='true', false)"

#: Walks down from the one message without a parent, and up from the newest leaf.
P4 = f"""with recursive o as materialized (select line_id, raw from transcript_lines where raw is not null and json_valid(raw) and json_type(raw)='OBJECT'),
m as materialized (select line_id, s, u, nullif(p, '') p, role, raw, c, case when json_type(raw,'$.timestamp')='VARCHAR' then epoch_us(try_cast(raw->>'$.timestamp' as timestamp)) // 1000 when json_type(raw,'$.timestamp') in ('BIGINT','UBIGINT') then (raw->>'$.timestamp')::bigint end ts
  from (select *, row_number() over (partition by s, u order by line_id) rn from (select line_id, raw, raw->>'$.sessionId' s, raw->>'$.uuid' u, raw->>'$.parentUuid' p, coalesce(raw->>'$.type', raw->>'$.recordType') role, json_extract(raw,'$.message.content') c
    from o where not {_TRUE.format(k='isSidechain')} and raw->>'$.sessionId' is not null and raw->>'$.uuid' is not null)) where rn=1),
down(s, u, d) as (select s, u, 0 from m where p is null union all select m.s, m.u, down.d+1 from m join down on m.s=down.s and m.p=down.u),
sound as materialized (select s from m group by s having count(*) filter (where p is null)=1 and count(*)=(select count(*) from down where down.s=m.s)),
leaf as materialized (select s, u from (select m.s, m.u, row_number() over (partition by m.s order by coalesce(ts, -(1::bigint<<61)) desc, line_id) rn from m join sound using (s) where not exists (select 1 from m k where k.s=m.s and k.p=m.u)) where rn=1),
up(s, u, k) as (select s, u, 0 from leaf union all select up.s, m.p, k+1 from up join m on m.s=up.s and m.u=up.u where m.p is not null),
path as materialized (select m.*, -k place from up join m on m.s=up.s and m.u=up.u where role in ('user','assistant') and not {_TRUE.format(k='isMeta')} and not {_TRUE.format(k='isApiErrorMessage')}),
b as (select s, u, unnest(case when json_type(c)='ARRAY' then json_extract(c,'$[*]') when json_type(c)='OBJECT' then [c] else [] end) b from path),
f as (select s, u, bool_or(coalesce(b->>'$.type', b->>'$.kind')='tool_result') is_result, bool_or(json_type(b,'$.text')='VARCHAR' and trim(b->>'$.text', ' ' || chr(9) || chr(10) || chr(13))<>'') said from b group by 1, 2),
n as (select path.s, path.u, role, place, row_number() over (partition by path.s order by place) turn_no, role='user' and not coalesce(is_result, false) asks, coalesce(said, false) or (json_type(c)='VARCHAR' and trim(c->>'$', ' ' || chr(9) || chr(10) || chr(13))<>'') spoken from path left join f on path.s=f.s and path.u=f.u),
w as (select *, count(*) filter (where role='assistant') over (partition by s order by place) answers from n),
q as (select s, answers, count(*) n, bool_or(spoken) spoken from w where asks group by 1, 2),
kept as (select s from q group by s having max(n)=1 and bool_or(spoken) intersect select s from (select s, role, row_number() over (partition by s order by place desc) rn from n) where rn=1 and role='assistant')
select s session_id, turn_no::integer turn_no, u uuid from n where s in (select s from kept)"""

SQL = {"p4_found": P4}
