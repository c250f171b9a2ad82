"""DuckDB SQL for the queries of ``joins``, by other means: every rule against every host, full comparisons, range joins, the engine's own as-of join, recursion."""

from __future__ import annotations

from .joins import HOPS, NETWORKS, PATTERNS, SUFFIX_RULES

_DOMAIN = "(?:[a-zA-Z0-9](?:[a-zA-Z0-9\\-]{0,61}[a-zA-Z0-9])?\\.)+[a-zA-Z]{2,}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

ORACLE = {
    "suffix_splits": f"""
with hosts as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host from pages),
rules as ({SUFFIX_RULES}),
rule as (select ltrim(regexp_replace(rule, '^[*][.]', ''), '!') as base, rule[1] = '!' as exception, len(string_split(rule, '.')) - (rule[1] = '!')::int as labels from rules),
rows as (
  select 'p' || page_id as key, host from hosts
  union all
  select distinct 'd' || doc_id, unnest(regexp_extract_all(text, '{_DOMAIN}')) from documents
), clean as (
  select key, host, regexp_replace(lower(host), '^www[.]', '') as h from rows
), each as (
  select h, string_split(h, '.') as p, coalesce(arg_max(labels, exception::int * 1000 + labels) filter (where base is not null), 1) as k
  from (select distinct h from clean) left join rule on (h = base or ends_with(h, '.' || base)) and labels <= len(string_split(h, '.')) group by h
), cut as (
  select h, p, len(p) as n, case when len(p) < 2 then 0 else k end as k from each
), done as (
  select h, case when k = 0 then h when n = k then '' else p[n - k] end as domain, case when k = 0 then '' else array_to_string(p[n - k + 1:], '.') end as suffix,
    case when k = 0 or n = k then h else array_to_string(p[n - k:], '.') end as registrable_domain, case when k = 0 or n <= k + 1 then '' else array_to_string(p[1:n - k - 1], '|') end as subdomain_labels from cut
)
select key, host, registrable_domain, subdomain_labels, domain, suffix from clean join done using (h)""",
    "nearest_names": """
with names as (
  select distinct unnest(regexp_extract_all(lower(x), '[a-z]+')) as name from (select p_name as x from part union all select p_type from part union all select text from benchmark)
), words as (
  select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents
), near as (
  select word, name, levenshtein(word, name) as distance, list_distinct(string_split(word, '')) as a, list_distinct(string_split(name, '')) as b from words, names
  where length(word) >= 5 and length(name) >= 4 and word <> name and abs(length(word) - length(name)) <= 2 and levenshtein(word, name) <= 2
)
select word, arg_min(name, {'d': distance, 'n': name}) as name, min(distance)::int as distance from near
where distance::double / greatest(length(word), length(name)) < 0.25 and len(list_intersect(a, b))::double / greatest(len(a), len(b)) >= 0.5 group by word""",
    "first_patterns": f"""
with p as ({PATTERNS}), least as (select pattern, min(priority) as priority, arg_min(label, {{'p': priority, 'l': label}}) as label from p group by pattern),
found as (select doc_id, pattern, priority, label from documents join least on position(pattern in text) > 0)
select doc_id, min(priority) as priority, arg_min(label, {{'p': priority, 't': pattern}}) as label, arg_min(pattern, {{'p': priority, 't': pattern}}) as pattern, count(pattern) as n_patterns
from documents left join found using (doc_id) group by doc_id""",
    "known_states": """
with e as (select event_id, case when event_id % 3 = 0 then 1 else user_id end as user_id, ts from events),
d as (select case when doc_id % 3 = 0 then 1 else doc_id % 1000 end as user_id, timestamp '2024-01-01 00:00:00' + to_seconds((doc_id * 7919) % 2592000) as known_from, n_chars, lang from documents),
one as (select user_id, known_from, max({'n': n_chars, 'l': lang}) as s from d group by all)
select event_id, e.user_id as user_id, s.n as n_chars, s.l as lang, strftime(known_from, '%Y-%m-%d %H:%M:%S') as known_at from e asof left join one on e.user_id = one.user_id and e.ts >= one.known_from""",
    "address_ranges": f"""
with n as ({NETWORKS}), r as (
  select id, string_split(string_split(cidr, '/')[1], '.') as o, string_split(cidr, '/')[2]::int as len from n
), span as (
  select id, len, (o[1]::bigint * 16777216 + o[2]::bigint * 65536) // (1::bigint << (32 - len)) * (1::bigint << (32 - len)) as low, (1::bigint << (32 - len)) as size from r
), a as (
  select distinct doc_id, unnest(regexp_extract_all(text, '\\b{_OCTET}(?:\\.{_OCTET}){{3}}\\b')) as address from documents
), num as (
  select doc_id, address, list_reduce(list_transform(string_split(address, '.'), lambda x: x::bigint), lambda s, x: s * 256 + x) as v from a
), met as (
  select doc_id, address, id, len from num left join span on v >= low and v < low + size
)
select doc_id, address, arg_max(id, {{'l': len, 'i': -id}}) as range_id, max(len) as prefix_length from met group by doc_id, address""",
    "followed_pages": f"""
with recursive h as ({HOPS}), step as (
  select url, arg_min(target, {{'o': ord, 't': target}}) as target from h where url <> target group by url
), walk as (
  select url, [url] as chain, target as ahead from step
  union all
  select walk.url, list_append(chain, ahead), step.target from walk left join step on step.url = walk.ahead
  where ahead is not null and not list_contains(chain, ahead) and len(chain) < 10
), longest as (
  select url, arg_max(chain, len(chain)) as chain, arg_max({{'a': ahead}}, len(chain)).a as ahead from walk group by url
)
select url, array_to_string(chain, ' ') as chain, chain[-1] as final_url, (len(chain) - 1)::int as n_hops, coalesce(list_contains(chain, ahead), false) as cyclic, ahead is not null and not list_contains(chain, ahead) as capped from longest""",
}
