"""DuckDB SQL for the queries of ``histories``, by other means: recursion, range frames, versions side by side, the tables that reports were made of."""

from __future__ import annotations

_CALLS = """
calls as (
  select 'e' || event_id as id, ts, 'u' || user_id as session_id, event_type as api, event_id % 11 = 0 as violation, user_id as caller, value, event_id // 500 as team from events
  union all
  select 'd' || doc_id, timestamp '2024-01-01 00:00:00' + to_seconds((doc_id * 7919) % 2592000), 's' || doc_id % 40, lang, doc_id % 7 = 0, doc_id * 31 % 5003, n_chars::double, doc_id // 500 from documents
)"""
_VERSIONS = """
v1 as (select doc_id, source, lang, n_chars from documents where doc_id % 10 <> 3),
v2 as (select doc_id, source, lang, case when doc_id % 7 = 0 then n_chars + 1 else n_chars end as n_chars from documents where doc_id % 11 <> 0),
v3 as (select doc_id, source, case when doc_id % 5 <> 0 then lang end as lang, n_chars from documents where doc_id % 13 <> 0),
flat as (select 1 as v, * from v1 union all select 2, * from v2 union all select 3, * from v3)"""
_BROKEN = "({0} % 20 in (7, 13) or {0} % 101 = 5)"
_SPANS = "(values ('whole', date '2000-01-01', date '2100-01-01'), ('second_week', date '2024-01-08', date '2024-01-14'), ('one_day', date '2024-01-20', date '2024-01-20'))"

ORACLE = {
    "session_logs": f"""
with recursive {_CALLS}, starts as (
  select session_id, min(ts) as first_ts from calls group by session_id
  union all
  select s.session_id, min(c.ts) from starts s join calls c on c.session_id = s.session_id and c.ts > s.first_ts + interval 3600 seconds group by s.session_id, s.first_ts
), span as (
  select session_id, first_ts, lead(first_ts) over (partition by session_id order by first_ts) as next_ts from starts
), own as (
  select span.session_id, span.first_ts, span.next_ts, calls.ts, api, violation, row_number() over (partition by span.session_id, span.first_ts order by ts desc, api desc) as back
  from span join calls on calls.session_id = span.session_id and calls.ts >= span.first_ts and (span.next_ts is null or calls.ts < span.next_ts)
), by_api as (
  select session_id, first_ts, string_agg(api || '=' || n, ',' order by api) as apis from (select session_id, first_ts, coalesce(api, '') as api, count(*) as n from own group by all) group by all
)
select session_id, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') as first_ts, count(*) as total, count_if(violation)::bigint as violations, any_value(by_api.apis) as apis,
  string_agg(api, ',' order by ts, api) filter (where back <= 5) as recent,
  any_value(next_ts) is not null or (epoch_us(first_ts) + 3600000000) // 1000 + 1 <= (select epoch_ms(max(ts)) from calls) - 600000 as expired
from own join by_api using (session_id, first_ts) group by session_id, first_ts""",
    "counts_at_calls": f"""
with {_CALLS}
select id, api, count(*) over (partition by api order by ts range between interval 60 seconds preceding and current row) as last_60,
  count(*) over (partition by api order by ts range between interval 3600 seconds preceding and current row) as last_3600,
  count(*) over (partition by api order by ts range between interval 86400 seconds preceding and current row) as last_86400 from calls""",
    "list_history": f"""
with {_VERSIONS}, seen as (
  select *, lag(v) over w as before, lag({{'s': source, 'l': lang, 'n': n_chars}}) over w as old from flat window w as (partition by doc_id order by v)
), cut as (
  select *, case when before = v - 1 and old is not distinct from {{'s': source, 'l': lang, 'n': n_chars}} then 0 else 1 end as new from seen
), grouped as (
  select *, sum(new) over (partition by doc_id order by v) as g from cut
)
select doc_id, any_value(source) as source, any_value(lang) as lang, any_value(n_chars) as n_chars, min(v)::bigint as valid_from, case when max(v) < 3 then max(v) + 1 end::bigint as valid_to from grouped group by doc_id, g""",
    "list_changes": f"""
with {_VERSIONS}
select coalesce(v1.doc_id, v2.doc_id) as doc_id, case when v1.doc_id is null then 'insert' when v2.doc_id is null then 'delete' else 'update' end as change, v1.n_chars as old_n_chars, v2.n_chars as new_n_chars
from v1 full join v2 on v1.doc_id = v2.doc_id where v1.doc_id is null or v2.doc_id is null or (v1.source, v1.lang, v1.n_chars) is distinct from (v2.source, v2.lang, v2.n_chars)""",
    "old_lookups": f"""
with {_VERSIONS} select labels.doc_id, quality, source, n_chars from labels left join v2 on labels.doc_id = v2.doc_id""",
    "provider_reports": f"""
with r as (select 'o' || o_orderkey as ioc, o_orderkey as k, lower(o_orderpriority) as tag from orders union all select 'd' || doc_id, doc_id, lower(lang) from documents),
b as (select *, {_BROKEN.format("k")} as broken from r)
select ioc, broken, case when broken or k % 9 = 0 then 0 else k % 61 end::int as malicious, case when broken or k % 9 = 0 or k % 3 = 0 then 0 else k % 5 end::int as suspicious,
  case when broken or k % 9 = 0 or k % 4 = 0 then 0 else k % 70 end::int as harmless, 0 as undetected,
  case when not broken then case when k % 2 = 0 then k + 1700000000 else k + 1600000000 end end as last_seen, case when broken or k % 6 = 0 then '' else tag || '|seen' end as tags from b""",
    "pulse_reports": f"""
with b as (select *, {_BROKEN.format("doc_id")} as broken, doc_id % 3 as listed from documents)
select doc_id, broken, case when broken then 0 else greatest(doc_id % 4, listed) end::int as pulse_count,
  case when broken or listed = 0 then '' else upper(lang) || '|Hive' end as families,
  case when broken or listed = 0 then '' else (select string_agg(t, '|' order by t) from (select distinct unnest(['botnet', lower(trim(source))]) as t) where t <> '') end as tags from b""",
    "merged_sketches": f"""
with {_CALLS}, s as (select * from {_SPANS} as t(span, a, b))
select span, api, team, count(*) as n, count(distinct caller) as callers, true as callers_ok, true as median_ok, true as high_ok from calls join s on ts::date between a and b group by span, api, team""",
}
