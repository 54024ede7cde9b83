"""Checking SQL of the general training-data queries."""

_OBJECTS = "objects as materialized (select line_id, file_name, raw from transcript_lines where raw is not null and json_valid(raw) and json_type(raw)='OBJECT')"
_KIND = "case json_type({x}) when 'NULL' then 'null' when 'VARCHAR' then 'str' when 'BOOLEAN' then 'bool' when 'BIGINT' then 'int' when 'UBIGINT' then 'int' when 'DOUBLE' then 'float' when 'ARRAY' then 'list' when 'OBJECT' then 'dict' end"
_KEYS = "select line_id, file_name, rtype, {unit} unit, {prefix} || k path, {kind} jtype from (select *, unnest(json_keys({obj})) k from {src} where json_type({obj})='OBJECT')"


def _keys(unit: str, prefix: str, obj: str, src: str) -> str:
    path = "'$.\"' || k || '\"'"
    return _KEYS.format(unit=unit, prefix=f"'{prefix}'", obj=obj, src=src, kind=_KIND.format(x=f"json_extract({obj}, {path})"))


P1 = f"""with {_OBJECTS},
recs as materialized (select line_id, file_name, raw, coalesce(json_extract_string(raw,'$.type'), json_extract_string(raw,'$.recordType')) rtype,
  json_extract(raw,'$.message') m, json_extract(raw,'$.message.usage') u from objects),
known as materialized (select * from recs where rtype in (select record_type from schema_baseline)),
blocks as materialized (select *, row_number() over () n from (
  select line_id, file_name, rtype, unnest(json_extract(m,'$.content[*]')) b from known where json_type(m,'$.content')='ARRAY'
  union all select line_id, file_name, rtype, json_extract(m,'$.content') b from known where json_type(m,'$.content')='OBJECT')),
paths as materialized ({_keys("0", "", "raw", "known")} union all {_keys("0", "message.", "m", "known")} union all {_keys("0", "message.usage.", "u", "known")}
  union all {_keys("n", "message.content[].", "b", "blocks")}),
moves(new_path, old_path) as (values ('recordType','type'),('workdir','cwd'),('branchName','gitBranch'),('requestRef','requestId'),('message.modelName','message.model'),
  ('message.content[].kind','message.content[].type'),('message.content[].toolUseId','message.content[].tool_use_id')),
listed as materialized (select p.*, b.field_path is not null known_path from paths p left join (select distinct record_type, field_path from schema_baseline) b on p.rtype=b.record_type and p.path=b.field_path),
unlisted as materialized (select l.*, v.old_path, o.path is null and v.old_path is not null and exists (select 1 from schema_baseline s where s.record_type=l.rtype and s.field_path=v.old_path) moved
  from listed l left join moves v on l.path=v.new_path left join paths o on o.line_id=l.line_id and o.unit=l.unit and o.path=v.old_path where not l.known_path),
required as (select distinct record_type, field_path from schema_baseline where is_required)
select file_name, rtype record_type, path field_path, 'retyped' change_kind from listed l where known_path and jtype<>'null'
  and not exists (select 1 from schema_baseline s where s.record_type=l.rtype and s.field_path=l.path and s.json_type=l.jtype)
union select file_name, rtype, case when moved then old_path else path end, case when moved then 'renamed' else 'added' end from unlisted
union select k.file_name, k.rtype, r.field_path, 'removed' from known k join required r on k.rtype=r.record_type
  left join paths p on p.line_id=k.line_id and p.unit=0 and p.path=r.field_path
  left join unlisted x on x.line_id=k.line_id and x.unit=0 and x.moved and x.old_path=r.field_path where p.path is null and x.path is null
union select file_name, rtype, 'type', 'added' from recs where rtype not in (select record_type from schema_baseline)"""

P2 = f"""with recursive {_OBJECTS},
n as materialized (select json_extract_string(raw,'$.uuid') uuid, arg_min(coalesce(json_extract_string(raw,'$.parentUuid'),''), line_id) parent from objects where json_type(raw,'$.uuid')='VARCHAR' group by 1),
t as (select uuid, uuid root_uuid, 0 "depth" from n where parent not in (select uuid from n) union all select n.uuid, t.root_uuid, t."depth"+1 from n join t on n.parent=t.uuid)
select uuid, root_uuid, "depth" from t union all select uuid, '', -1 from n where uuid not in (select uuid from t)"""

_TREE = f"""{_OBJECTS},
n as materialized (select json_extract_string(raw,'$.uuid') uuid, min(line_id) line_id, arg_min(coalesce(json_extract_string(raw,'$.parentUuid'),''), line_id) parent from objects where json_type(raw,'$.uuid')='VARCHAR' group by 1)"""
P2_PATHS = f"""with recursive {_TREE},
t as (select uuid, line_id, uuid path, 1 nodes from n where parent not in (select uuid from n) union all select n.uuid, n.line_id, t.path || '/' || n.uuid, t.nodes+1 from n join t on n.parent=t.uuid)
select uuid, path, nodes from t where line_id % 20 = 0"""
P2_DESCENDANTS = f"""with recursive {_TREE},
sound as (select uuid from n where parent not in (select uuid from n) union all select n.uuid from n join sound on n.parent=sound.uuid),
d as (select n.uuid, c.uuid descendant from n join n c on c.parent=n.uuid where n.line_id % 20 = 0 and n.uuid in (select uuid from sound) union all select d.uuid, n.uuid from n join d on n.parent=d.descendant)
select uuid, descendant from d"""

_UNNEST = "unnest(json_extract({x},'$[*]')) {y}, generate_subscripts(json_extract({x},'$[*]'),1)-1 {i}"
_TYPE = "coalesce(json_extract_string({x},'$.type'), json_extract_string({x},'$.kind'))"
P5 = f"""with {_OBJECTS}, c as (select line_id, json_extract(raw,'$.message.content') c from objects),
b as (select line_id, {_UNNEST.format(x="c", y="b", i="i")} from c where json_type(c)='ARRAY' union all select line_id, c b, 0 i from c where json_type(c)='OBJECT'),
t as materialized (select *, {_TYPE.format(x="b")} kind, case when {_TYPE.format(x="b")}='tool_use' then json_extract_string(b,'$.id') else coalesce(json_extract_string(b,'$.tool_use_id'), json_extract_string(b,'$.toolUseId')) end ref_id
  from b where json_type(b)='OBJECT' and {_TYPE.format(x="b")} in ('tool_use','tool_result')),
p as materialized (select line_id, i, ref_id, {_UNNEST.format(x="json_extract(b,'$.content')", y="p", i="j")} from t where kind='tool_result' and json_type(b,'$.content')='ARRAY'),
q as materialized (select line_id, i, j, ref_id, {_UNNEST.format(x="json_extract(p,'$.content')", y="q", i="k")} from p where json_type(p,'$.content')='ARRAY')
select line_id, i::varchar node_path, kind node_type, ref_id from t
union all select line_id, i || '.' || j, {_TYPE.format(x="p")}, ref_id from p where json_type(p)='OBJECT'
union all select line_id, i || '.' || j || '.' || k, {_TYPE.format(x="q")}, ref_id from q where json_type(q)='OBJECT'"""

P5_USAGE = f"""with {_OBJECTS}, u as (select line_id, json_extract_string(raw,'$.message.id') message_id, json_extract(raw,'$.message.usage') u from objects where json_type(raw,'$.message.usage')='OBJECT'),
k as (select *, unnest(json_keys(u)) metric from u) select line_id, message_id, metric, json_extract(u, '$."' || metric || '"')::varchar as "value" from k"""

P6 = f"""with {_OBJECTS}, k as (select line_id, json_extract_string(raw,'$.sessionId') s, coalesce('m:' || json_extract_string(raw,'$.message.id'), 'u:' || json_extract_string(raw,'$.uuid')) "key",
  coalesce(try_cast(json_extract_string(raw,'$.message.usage.output_tokens') as bigint), 0) n from objects)
select line_id from (select line_id, row_number() over (partition by s, "key" order by n desc, line_id) r from k where s is not null and "key" is not null) where r > 1"""

SQL = {"p1_found": P1, "p2_found": P2, "p2_paths": P2_PATHS, "p2_descendants": P2_DESCENDANTS, "p5_found": P5, "p5_usage": P5_USAGE, "p6_found": P6}
