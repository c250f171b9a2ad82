"""DuckDB SQL for the queries of ``queries``, written for itself: other means, same results.

Results that rest on fixed mails, wrapped urls and redirect records are given as
tables worked out by hand.
"""

from __future__ import annotations

from .. import fixtures as fx
from .. import lists
from ..operators import artifacts, mail
from . import drawn, histories_oracle, joins_oracle
from .factors import FACTORS


def _set(values) -> str:
    return "(" + ", ".join(map(fx.literal, values)) + ")"


def _brand_rows() -> str:
    return ", ".join(f"({k}, {fx.literal(b)})" for k, b in enumerate(lists.BRANDS))


HOSTS = f"""
raw as (select 'p' || page_id as key, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages union all select 'f' || host_id, host from ({fx.HOSTS})),
n1 as (select key, host, string_split(regexp_replace(lower(trim(host)), '^[a-z][a-z0-9+.-]*://', ''), '/')[1] as s from raw),
n2 as (select key, host, case when s[1] = '[' then string_split(ltrim(s, '['), ']')[1] when length(s) - length(replace(s, ':', '')) = 1 then string_split(s, ':')[1] else s end as s from n1),
n3 as (select key, host, case when starts_with(s, 'www.') then s[5:] else s end as h from n2),
n4 as (select key, host, h, string_split(h, '.') as p, regexp_full_match(h, '(\\d{{1,3}}\\.){{3}}\\d{{1,3}}|\\[?[0-9a-f:]+\\]?') as ip from n3),
n5 as (select *, case when ip or len(p) < 2 then 0 when len(p) >= 3 and p[-2] || '.' || p[-1] in {_set(lists.TWO_LABEL_SUFFIXES)} then 2 else 1 end as k from n4),
ctx as (select key, host, h as hostname, case when k = 0 then h else p[len(p) - k] end as domain, case when k = 0 then '' else array_to_string(p[len(p) - k + 1:], '.') end as suffix,
  case when k = 0 then h else array_to_string(p[len(p) - k:], '.') end as registrable_domain, case when k = 0 then []::varchar[] else list_filter(p[1:len(p) - k - 1], lambda x: x <> '') end as labels from n5)
"""

_DISTINCT = "list_filter({0}, lambda x, i: x <> '' and list_position({0}, x) = i)"
_TOKENS = _DISTINCT.format("string_split_regex(lower(hostname), '[._-]+')")
_ENTROPY = "round_even(case when length({0}) = 0 then 0.0 else -list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: (length({0}) - length(replace({0}, c, '')))::double / length({0}) * log2((length({0}) - length(replace({0}, c, '')))::double / length({0})))) end, 2)"

_TLD = f"""
t1 as (select key, host, lower(trim(host)) as d, string_split(lower(trim(host)), '.') as p from raw),
t2 as (select key, case when len(p) >= 3 and p[-2] || '.' || p[-1] in {_set(lists.TLD_TWO_LABEL_SUFFIXES)} then '.' || p[-2] || '.' || p[-1] when len(p) > 1 then '.' || p[-1] else '' end as tld from t1),
tld as (select key, tld, case when tld in {_set(lists.MEDIUM_TLDS)} then 'Medium' when tld in {_set(lists.SAFE_TLDS)} then 'Low' else 'High' end as risk_level from t2)
"""

_GLYPH = "replace(replace(replace(translate(lower({0}), 'oliseazbg', '011534286'), 'm', 'rn'), 'w', 'vv'), '@', 'a')"
_BRANDS = f"brand as (select o, b, {_GLYPH.format('b')} as f from (values {_brand_rows()}) as t(o, b))"

_SIMILAR = f"""
{_BRANDS},
tok as (select key, unnest(list_filter(string_split_regex(string_split(regexp_replace(lower(host), '^www\\.', ''), '.')[1], '[-_]+'), lambda x: x <> '')) as t, generate_subscripts(list_filter(string_split_regex(string_split(regexp_replace(lower(host), '^www\\.', ''), '.')[1], '[-_]+'), lambda x: x <> ''), 1) as i, len(list_filter(string_split_regex(string_split(regexp_replace(lower(host), '^www\\.', ''), '.')[1], '[-_]+'), lambda x: x <> '')) as n from raw),
exact as (select key, arg_min(b, i * 1000 + o) as b, arg_min(t = b, i * 1000 + o) as same from tok join brand on {_GLYPH.format('t')} = f where t <> b or n > 1 group by key),
near as (select key, i, o, b, levenshtein(t, b) as d from tok, brand where t not in {_set(lists.INFRA_TOKENS)} and length(t) >= 5 and length(b) >= 4 and t <> b
  and len(list_intersect(list_distinct(string_split(t, '')), list_distinct(string_split(b, ''))))::double / greatest(len(list_distinct(string_split(t, ''))), len(list_distinct(string_split(b, '')))) >= 0.5
  and levenshtein(t, b)::double / greatest(length(t), length(b)) < 0.25),
best as (select key, arg_min(b, d * 1000000 + i * 1000 + o) as b, min(d) as d from near group by key),
first as (select key, t from tok where i = 1),
fuzzy as (select key, b, d from best join first using (key) where d = 1 and length(t) >= greatest(3, length(b) - 1) or d = 2 and length(t) >= length(b) - 1)
"""

_HOSTNAME = f"""
{_BRANDS},
hp as (select key, string_split(regexp_replace(lower(trim(host)), '^www\\.', ''), '.') as p from raw),
lab as (select key, p, unnest(case when len(p) > 2 then p[:len(p) - 2] else []::varchar[] end) as label, generate_subscripts(case when len(p) > 2 then p[:len(p) - 2] else []::varchar[] end, 1) as li from hp),
pt as (select key, p, label, li, unnest(string_split_regex(label, '[-_]+')) as t, generate_subscripts(string_split_regex(label, '[-_]+'), 1) as ti from lab),
tk as (select key, p[-2] as owner, p[-2] || '.' || p[-1] as root, label, t, li * 100 + ti as spot from pt where length(t) >= 4 and t not in {_set(lists.INFRA_TOKENS)}),
hit as (select key, root, arg_min(b, spot * 1000 + o) as b, arg_min(label, spot * 1000 + o) as label, arg_min(t, spot * 1000 + o) as t, 0 as d from tk join brand on {_GLYPH.format('t')} = f where not (t = b and owner = b) group by key, root),
near as (select key, root, label, t, b, levenshtein(t, b) as d, levenshtein(t, b) * 10000000 + spot * 1000 + o as rank from tk, brand where {_GLYPH.format('t')} <> f and length(t) >= 5 and length(b) >= 5 and abs(length(t) - length(b)) <= 2 and length(t) >= length(b) - 1 and 1 - levenshtein(t, b)::double / greatest(length(t), length(b)) >= 0.8),
best as (select key, root, arg_min(b, rank) as b, arg_min(label, rank) as label, arg_min(t, rank) as t, min(d) as d from near group by key, root having min(d) <= 2),
one as (select * from hit union all select * from best where key not in (select key from hit))
"""

_URL = f"""
u0 as (select url_id, url from ({fx.URLS}) union all select page_id + 1000, url from pages),
u1 as (select url_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) as scheme, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*:', '') as rest from u0),
u2 as (select *, regexp_extract(rest, '^//([^/?#]*)', 1) as netloc, regexp_replace(rest, '^//[^/?#]*', '') as tail from u1),
u3 as (select *, regexp_replace(regexp_extract(tail, '^[^?#]*'), ';[^/]*$', '') as path, regexp_extract(tail, '\\?([^#]*)', 1) as query from u2),
u4 as (select *, lower(string_split(string_split(netloc, '@')[-1], ':')[1]) as hostname, lower(path) || ' ' || lower(query) as words from u3),
kw as (select url_id, list_sort(list(k)) as ks from u4, (values {', '.join(f'({fx.literal(k)})' for k in lists.PATH_KEYWORDS)}) as t(k) where regexp_matches(words, '(^|[^a-z])' || k || '($|[^a-z])') group by url_id),
sig as (select u4.*, coalesce(ks, []) as ks, [
  case when lower(scheme) in ('data', 'javascript', 'vbscript', 'ftp') then 'suspicious_scheme' end, case when regexp_full_match(hostname, '(\\d{{1,3}}\\.){{3}}\\d{{1,3}}') then 'ip_host' end,
  case when len(ks) >= 3 then 'path_keywords_high' end, case when len(ks) in (1, 2) then 'path_keywords_present' end, case when length(path) > 300 then 'very_long_path' end, case when length(path) between 121 and 300 then 'long_path' end,
  case when regexp_matches(path || query, '(%[0-9A-Fa-f]{{2}}){{4,}}') then 'encoded_params' end, case when regexp_matches(query, '[A-Za-z0-9+/]{{30,}}') then 'base64_in_query' end,
  case when len(list_filter(string_split(query, '&'), lambda x: lower(string_split(x, '=')[1]) in {_set(lists.REDIRECT_PARAMETERS)})) > 0 then 'open_redirect_param' end,
  case when regexp_matches(path, '//[a-z0-9-]+\\.[a-z]{{2,}}') then 'double_slash_path' end, case when regexp_matches(path, '(?i)/([a-z0-9-]+\\.(com|net|org|io|co|app|bank))/') then 'brand_in_path' end,
  case when regexp_matches(path, '(?i)[0-9a-f]{{24,}}') then 'random_token_in_path' end, case when regexp_matches(query, '(?i)[?&][a-z_-]+=https?://') then 'url_in_query' end] as s from u4 left join kw using (url_id))
"""
_POINTS = "list_sum(list_transform(s, lambda x: case x when 'suspicious_scheme' then 15 when 'ip_host' then 8 when 'path_keywords_high' then 10 when 'path_keywords_present' then 5 when 'very_long_path' then 5 when 'long_path' then 2 when 'encoded_params' then 5 when 'base64_in_query' then 3 when 'open_redirect_param' then 8 when 'double_slash_path' then 10 when 'brand_in_path' then 10 when 'random_token_in_path' then 3 when 'url_in_query' then 8 else 0 end))"

_CALLS = "calls as (select ts, user_id::varchar as session_id, event_type as api, case when event_id % 3 = 0 then 'POST' else 'GET' end as method, event_id % 11 = 0 as violation, event_id from events)"


def _pages_sql(select: str) -> str:
    return select


_NOISE_OK = (
    f"length(d) >= 4 and regexp_matches(regexp_extract(d, '[^.]*$'), '^[a-z]{{2,6}}$') and regexp_extract(d, '[^.]*$') not in {_set(artifacts.NOISE_TLDS)} and string_split(d, '.')[1] not in {_set(artifacts.HTML_TAGS)} "
    f"and not regexp_matches(string_split(d, '.')[1], '^[0-9a-f]{{2}}$') and not (" + " or ".join(f"ends_with(d, {fx.literal(n)})" for n in artifacts.NOISE_SUFFIXES) + ")"
)
_ART = f"""
txt as (select doc_id, coalesce(text, '') as t from documents),
url as (select doc_id, list_distinct(list_transform(regexp_extract_all(t, '(?i)https?://[^\\s"''<>)\\]]+'), lambda u: rtrim(u, '.,;)>"'''))) as urls from txt),
dom as (select doc_id, d from (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(t, '\\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,}}\\b'), lambda x: lower(x)))) as d from txt) where {_NOISE_OK}),
ip as (select doc_id, unnest(x) as ip, generate_subscripts(x, 1) as pos from (select doc_id, regexp_extract_all(t, '\\b(?:(?:25[0-5]|2[0-4]\\d|[01]?\\d\\d?)\\.){{3}}(?:25[0-5]|2[0-4]\\d|[01]?\\d\\d?)\\b') as x from txt)),
pub as (select doc_id, ip, min(pos) as pos from ip where not regexp_matches(ip, '^(10\\.|192\\.168\\.|169\\.254\\.|127\\.|172\\.(1[6-9]|2\\d|3[01])\\.)') and ip not in ('0.0.0.0', '255.255.255.255') group by doc_id, ip),
doms as (select doc_id, list_sort(list(distinct d))[:20] as ds from dom group by doc_id),
ips as (select doc_id, list(ip order by pos)[:20] as xs from pub group by doc_id)
"""


def _lines(*parts: str) -> str:
    return " + ".join(f"({p})" for p in parts)


def _band(value: str, *bands) -> str:
    return "case " + " ".join(f"when {value} between {a} and {b} then {p}" for a, b, p in bands) + " else 0 end"


_INF = 1 << 30
_HAS = lambda words, x: "(" + " or ".join(f"contains({x}, {fx.literal(w)})" for w in words) + ")"
#: Every factor of the general score as (name, points); names are needed where a rule looks at others.
_FACTORS = {
    "vt": "case when mal = 1 then 10 when input_type = 'ip' then " + _band("mal", (2, 3, 25), (4, 7, 40), (8, _INF, 45)) + " else " + _band("mal", (2, 4, 25), (5, 9, 35), (10, 19, 45), (20, _INF, 55)) + " end",
    "abuse": "case when not abuse_ok then 0 when input_type = 'ip' then " + _band("conf", (51, _INF, 30), (21, 50, 20), (5, 20, 10)) + " else " + _band("conf", (51, _INF, 20), (6, 50, 5)) + " end",
    "tor": "case when abuse_ok and is_tor then 15 else 0 end",
    "age": "case when age_days < 30 then 30 when age_days < 90 then 10 when age_days < 180 then 5 else 0 end",
    "tls": "case when tls_age_days < 7 then 10 when tls_age_days < 30 then 5 else 0 end",
    "rapid": "case when rapid_deploy or abused_platform is not null then 10 else 0 end",
    "asn": "case when provider in ('Vultr', 'Google Cloud') then 8 else 0 end",
    "otx": "case tier when 'Strong' then 20 when 'Suspicious' then 10 when 'Contextual' then 3 else 0 end",
    "ipmal": "case when ipotx and pulses > 0 and nf > 0 then case when nf = 1 then 15 when nf <= 3 then 20 else 30 end else 0 end",
    "ippulse": "case when ipotx and pulses > 5 then 10 else 0 end",
    "confirmed": "case when ipotx and mal >= 5 and nf >= 2 then 20 else 0 end",
    "ransom": f"case when ipotx and ({_HAS(lists.RANSOMWARE_WORDS, 'lower(families)')} or {_HAS(lists.RANSOMWARE_WORDS, 'tags')}) then 15 else 0 end",
    "subnet": "case when ipotx and mal >= 3 and pulses >= 2 and not (mal >= 5 and nf >= 2) then 12 else 0 end",
    "corr": "case when otx_ok and tier in ('Strong', 'Suspicious') and vt_ok and mal >= 2 then 10 else 0 end",
    "corrob": "case when input_type in ('url', 'domain') and mal >= 5 and tier in ('Strong', 'Suspicious') then 15 else 0 end",
    "cloud": "case when input_type = 'ip' and mal >= 2 and provider in ('Vultr', 'Google Cloud', 'IBM') then 10 else 0 end",
    "consensus": "case when input_type = 'ip' and mal >= 2 and conf > 5 and (tier in ('Strong', 'Suspicious') or (ipotx and pulses > 0 and nf > 0)) then 15 else 0 end",
    "entropy": "case entropy_level when 'High' then 5 when 'Moderate' then 2 else 0 end",
    "sub": "case when sub_level = 'High' then 10 when sub_level = 'Moderate' then 5 when sub_old_scored then 10 else 0 end",
    "depth": "case when labels = 'a,b,c' then 5 else 0 end",
    "tld": "case tld_level when 'High' then 15 when 'Medium' then 5 else 0 end",
    "tldcorr": "case when tld_level = 'High' and (nb > 0 or lure or coalesce(age_days < 30, false)) then 10 else 0 end",
    "similar_high": "case when similar_flag and similar_confidence = 'High' then 15 else 0 end",
    "similar_med": "case when similar_flag and similar_confidence = 'Medium' then 8 else 0 end",
    "hb": "case when not hostname_brand_match then 0 when hostname_brand_confidence = 'Medium' then 8 when hostname_brand_context = 'cdn_subdomain' then 20 else 12 end",
    "cdn": "case when hostname_brand_match and hostname_brand_context = 'cdn_subdomain' or mal >= 3 and registrable_domain = 'fastly.net' then 15 else 0 end",
    "ct": "case when not ct_ok then 0 when ct_level = 'High' then 10 when ct_level = 'Elevated' then 5 else 0 end",
    "triple": "case when triple then 30 else 0 end",
    "multi": "case when not triple and nb >= 2 then 20 else 0 end",
    "brandsub": "case when not triple and nb > 0 and brand_context <> 'root' then 10 else 0 end",
    "lure": "case when not triple and lure then 8 else 0 end",
    "abused": "case when not triple and abused_platform is not null and nb = 0 then 8 else 0 end",
    "abusedbrand": "case when nb > 0 and abused_platform is not null then 15 else 0 end",
    "brandtls": "case when high and (coalesce(tls_age_days < 30, false) or (coalesce(age_days < 30, false) and tls_age_days is null)) then 15 else 0 end",
    "brandent": "case when high and entropy_level <> 'Low' then 5 else 0 end",
    "brandotx": "case when high and tier in ('Strong', 'Suspicious') then 10 else 0 end",
}
_STRUCTURAL = _lines("f_similar_high", "f_hb", "f_tls", "case when f_age >= 10 then f_age else 0 end", "f_entropy", "f_sub", "f_rapid", "case when f_tld = 15 then 15 else 0 end", "f_tldcorr", "f_abused", "f_abusedbrand")
_URL_POINTS = "case signals when 'suspicious_scheme,ip_host' then 23 when 'path_keywords_high,very_long_path,encoded_params' then 20 when 'path_keywords_present,long_path,open_redirect_param,base64_in_query' then 18 when 'double_slash_path,brand_in_path,random_token_in_path,url_in_query' then 31 else 0 end"
_URL_COUNT = "case when signals = '' then 0 else len(string_split(signals, ',')) end"
_RISK = f"""
with a as ({drawn.RISK_INPUT}),
b as (select *, vt_ok and input_type = 'hash' as hash, case when vt_ok then vt_malicious else 0 end as mal, case when abuse_ok then abuse_confidence else 0 end as conf, otx_pulses as pulses,
  case when families = '' then 0 else len(string_split(families, ',')) end as nf, case when brand_list = '' then 0 else len(string_split(brand_list, ',')) end as nb, lure_list <> '' as lure,
  case when not otx_ok then 'None' when input_type = 'ip' and otx_tier = 'None' and tags <> '' then 'Suspicious' else otx_tier end as tier, input_type = 'ip' and otx_ok as ipotx,
  similar_flag and similar_confidence = 'High' or hostname_brand_match and hostname_brand_confidence = 'High' as high from a),
c as (select *, nb > 0 and cdn_provider is not null and lure as triple from b),
f as (select *, {', '.join(f'{v} as f_{k}' for k, v in _FACTORS.items())} from c),
g as (select *, {_STRUCTURAL} as structural, {_lines(*(f'f_{k}' for k in list(_FACTORS)[:8]))} as early,
  case when nf between 1 and 3 then case nf when 1 then 10 else 15 end when nf >= 4 then 20 else 0 end as h_fam, {_band('pulses', (1, 3, 5), (4, 10, 10), (11, _INF, 15))} as h_pulse, case when tags in ('botnet', 'lockbit,trojan') then 10 else 0 end as h_tag,
  case when otx_file_score < 1 then 0 when otx_file_score < 5 then 5 when otx_file_score < 10 then 10 when otx_file_score < 20 then 20 else 30 end as h_score, {_band('mal', (1, 2, 20), (3, 10, 40), (11, 25, 60), (26, 49, 80), (50, _INF, 95))} as h_vt from f),
h as (select id, hash, mal, conf, tags, otx_ok, pulses, nf,
  case when hash then h_vt + case when otx_ok then h_fam + h_pulse + h_tag + h_score else 0 end
    else {_lines(*(f'f_{k}' for k in _FACTORS))} + case when structural >= 20 then 10 else 0 end + case when input_type = 'url' then {_URL_POINTS} + case when redirect_suspicious then 10 else 0 end else 0 end end as points,
  case when hash then (h_vt > 0)::int + case when otx_ok then (h_fam > 0)::int + (h_pulse > 0)::int + (h_tag > 0)::int + (h_score > 0)::int else 0 end
    else {_lines(*(f'(f_{k} > 0)::int' for k in _FACTORS))} + (structural >= 20)::int + case when input_type = 'url' then {_URL_COUNT} + redirect_suspicious::int else 0 end end as n,
  case when hash then 0 else case when otx_ok and otx_reference_only and early > 3 then -7 else 0 end + case when nb > 0 and abused_platform is not null and not triple then 8 else 0 end end as adj from g),
i as (select *, case when hash then least(points, 100) else points + adj end as raw from h),
j as (select *, case when hash then case when raw >= 70 then 'HIGH' when raw >= 30 then 'MEDIUM' else 'LOW' end else case when raw <= 25 then 'LOW' when raw <= 60 then 'MEDIUM' else 'HIGH' end end as sev from i)
select id, n as n_factors, points as factor_points, raw as raw_score, least(raw, 100) as normalized_score, sev as severity,
  case sev when 'LOW' then 'LOW THREAT' when 'MEDIUM' then 'NEEDS REVIEW' else case when mal >= 1 or otx_ok and (pulses > 0 or nf > 0 or tags <> '') or not hash and conf > 0 then 'HIGHLY MALICIOUS' else 'LIKELY MALICIOUS' end end as verdict from j
"""

#: Points of an address by the two feeds on addresses: its last octet's confidence, and a twelfth's rest of the second one as verdicts.
_ADDRESS_POINTS = """(case when string_split(ip, '.')[4]::int > 50 then 30 when string_split(ip, '.')[4]::int > 20 then 20 when string_split(ip, '.')[4]::int >= 5 then 10 else 0 end
  + case when string_split(ip, '.')[2]::int % 12 = 0 then 0 when string_split(ip, '.')[2]::int % 12 = 1 then 10 when string_split(ip, '.')[2]::int % 12 <= 3 then 25 when string_split(ip, '.')[2]::int % 12 <= 7 then 40 else 45 end)"""
_TEXTS = ("origin", "from_domain", "mismatches", "sending_host", "receiving_host", "domain", "label", "hostname", "mailfrom_domain", "signing_domain")


def _own_mails(templates: str, columns: str) -> str:
    """Results of the mail templates for each order's mail, with the order's own domains."""
    shown = ", ".join(f"{drawn.renamed('t.' + c)} as {c}" if c in _TEXTS else f"t.{c} as {c}" for c in columns.split(", "))
    return f"select o_orderkey as msg_id, {shown} from orders join ({templates}) t on t.msg_id = o_orderkey % 6 + 1"


ORACLE: dict[str, str] = {
    "input_types": f"""
with r as (select row_id, raw from ({fx.INPUTS}) union all select page_id + 1000, url from pages), c as (select row_id, left(regexp_replace(trim(raw), '[\\x00-\\x1f\\x7f]', '', 'g'), 512) as clean from r)
select row_id, clean, case when regexp_matches(clean, '(?i)^(https?|ftp)://') then 'url'
  when regexp_full_match(clean, '((25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){{3}}(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)(/([0-9]|[12][0-9]|3[0-2]))?') or (contains(clean, '::') and regexp_full_match(clean, '[0-9a-fA-F:]+')) then 'ip'
  when length(clean) in (32, 40, 64) and regexp_full_match(clean, '[0-9a-fA-F]+') then 'hash' when regexp_full_match(clean, '([a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,}}') then 'domain' else 'unknown' end as input_type from c""",
    "host_context": f"with {HOSTS} select key, hostname, registrable_domain, array_to_string(labels, '|') as subdomain_labels, domain, suffix, array_to_string({_TOKENS}, '|') as tokens from ctx",
    "tld_risk": f"with {HOSTS}, {_TLD} select key, tld, risk_level, case risk_level when 'Low' then 0 when 'Medium' then 5 else 15 end as score_added from tld",
    "host_entropy": f"""with {HOSTS}, e as (select key, replace(domain, '-', '') as d, case when len(labels) > 0 then replace(labels[1], '-', '') end as l from ctx),
s as (select key, {_ENTROPY.format('d')} as es, case when length(l) > 6 then {_ENTROPY.format('l')} end as ss from e)
select key, es as entropy_score, case when es < 3.1 then 'Low' when es < 3.8 then 'Moderate' else 'High' end as entropy_level, ss as subdomain_entropy_score, case when ss >= 3.6 then 'High' when ss >= 2.8 then 'Moderate' when ss is not null then 'Low' end as subdomain_entropy_level, coalesce(ss >= 3.6, false) as old_scored from s""",
    "host_signals": f"""with {HOSTS}, deep as (select d, string_split(d, '.')[-2] as owner from (values {', '.join(f'({fx.literal(a)})' for a in sorted(lists.ABUSED_HOSTING) if a.count('.') >= 2)}) as t(d)),
under as (select key, min(d) as d, list(owner) as owners from ctx join deep on hostname = d or ends_with(hostname, '.' || d) group by key),
x as (select c.*, d, coalesce(owners, []) as owners, {_TOKENS} as toks, registrable_domain in {_set(lists.CDNS)} as cdn, string_split(registrable_domain, '.')[1] as root from ctx c left join under using (key)),
y as (select *, list_filter(toks, lambda t: t in {_set(lists.BRANDS)} and not (cdn and t = root) and not list_contains(owners, t)) as bs,
  list_filter(toks, lambda t: t in {_set(lists.LURES)} and t <> suffix and '.' || t not in {_set([t for t in (*lists.SAFE_TLDS, *lists.MEDIUM_TLDS)])}) as ls from x),
z as (select *, list_filter(labels, lambda l: list_contains(string_split_regex(l, '[._-]+'), bs[1])) as spot from y)
select key, array_to_string(bs, '|') as brands, case when len(bs) = 0 then null when len(spot) > 0 then case when cdn then 'cdn_subdomain' else 'subdomain' end when list_contains(string_split_regex(root, '[._-]+'), bs[1]) then 'root' else 'subdomain' end as brand_context,
  case when len(bs) = 0 then null when len(spot) > 0 then spot[1] when list_contains(string_split_regex(root, '[._-]+'), bs[1]) then root end as source_label, array_to_string(ls, '|') as lures, case when cdn then registrable_domain end as cdn_provider,
  case when registrable_domain in {_set(lists.ABUSED_HOSTING)} then registrable_domain else d end as platform from z""",
    "brand_similarity": f"""with {HOSTS}, {_SIMILAR} select h.key, e.b is not null or f.b is not null as brand_impersonation_flag, coalesce(e.b, f.b) as matched_brand, case when e.b is not null or f.d = 1 then 'High' when f.d = 2 then 'Medium' end as confidence,
case when e.same then 'Brand token in compound domain' when e.b is not null then 'Homoglyph substitution' when f.b is not null then 'Levenshtein distance' end as method from raw h left join exact e on h.key = e.key left join fuzzy f on h.key = f.key""",
    "hostname_brand": f"""with {HOSTS}, {_HOSTNAME} select h.key, o.b is not null as brand_match_hostname, o.b as matched_brand, o.label as matched_label, o.t as matched_token, case when o.b is null then null when root in {_set(lists.BRAND_CDNS)} then 'cdn_subdomain' else 'subdomain' end as context,
case when o.d <= 1 then 'High' when o.d = 2 then 'Medium' end as confidence from raw h left join one o on h.key = o.key""",
    "url_heuristics": f"with {_URL} select url_id, array_to_string(list_filter(s, lambda x: x is not null), '|') as signals, array_to_string(ks, '|') as path_keywords, length(path) as path_length, coalesce({_POINTS}, 0) as score from sig",
    # wrapped urls are unescaped as a whole before their parameters are read, so what follows an & or # of theirs is lost
    "gateway_unwrap": f"select page_id as url_id, case when page_id % 9 in (1, 2, 8) then url else regexp_replace(url, '[&#].*', '') end as destination, {drawn.pick('page_id', [g for _, g in drawn.WRAPS])} as gateway, false as is_wrapper from pages",
    "infrastructure": f"""with x as (select *, case when cname is not null then rtrim(lower(cname), '.') end as c, lower(coalesce(org, '')) as o from ({drawn.INFRA})),
direct as (select * from (values ('vercel.app', 'Vercel', 1), ('up.railway.app', 'Railway', 2), ('railway.app', 'Railway', 2), ('fastly.net', 'Fastly Edge Infrastructure', 3)) as t(s, p, k)),
d as (select host_id, any_value(p) as p, any_value(case p when 'Vercel' then 'Direct Vercel platform domain (*.vercel.app)' when 'Railway' then 'Direct Railway platform domain (*.railway.app)' else 'Direct Fastly infrastructure endpoint' end) as m from x join direct on not is_ip and (host = s or ends_with(host, '.' || s)) group by host_id),
y as (select x.*, d.p as dp, d.m as dm, case when is_ip or c is null then null when ends_with(c, 'vercel.app') then 'Vercel' when ends_with(c, 'netlify.app') then 'Netlify' when ends_with(c, 'akamai.net') then 'Akamai' when ends_with(c, 'cloudfront.net') then 'AWS CloudFront' end as cp,
  case when is_ip or tls_error <> '' then null when contains(lower(issuer), 'cloudflare') then 'Cloudflare' when contains(lower(issuer), 'amazon') then 'AWS CloudFront' end as tp,
  case when contains(o, 'render') then 'Render' when contains(o, 'github') then 'GitHub Pages' when contains(o, 'fastly') then 'Fastly' when contains(o, 'cloudflare') then 'Cloudflare' when contains(o, 'amazon') then 'AWS CloudFront' when contains(o, 'microsoft') then 'Azure' end as op from x left join d using (host_id)),
z as (select *, coalesce(dp, cp, tp, op) as p from y)
select host_id, coalesce(p, case when contains(o, 'digitalocean') then 'DigitalOcean' when contains(o, 'hetzner') then 'Hetzner' when o <> '' then org else 'Unresolved' end) as provider,
  case when dp is not null then 'Rapid Deploy CDN' when p in ('Vercel', 'Netlify', 'Render', 'GitHub Pages') then 'Rapid Deploy CDN' when p in ('Akamai', 'Fastly', 'Cloudflare') then 'Enterprise CDN' when p is not null then 'Enterprise Cloud' when contains(o, 'digitalocean') or contains(o, 'hetzner') then 'Cloud Hosting Provider' when o <> '' then 'Unclassified Hosting Provider' else 'Unresolved Infrastructure' end as category,
  dp is not null or coalesce(cp in ('Vercel', 'Netlify'), false) or coalesce(cp is null and tp is null and op = 'Render', false) as rapid_deploy,
  case when dp is not null then dm when cp is not null then 'CNAME record' when tp is not null then 'TLS certificate issuer' when op is not null then 'ASN/Organization' else 'ASN/Organization (unclassified)' end as method from z""",
    "pulse_tiers": f"""with p as ({drawn.PULSES}), d as ({drawn.DOMAINS}),
t as (select ioc, list_sort(list(distinct g)) as hs from (select ioc, lower(trim(unnest(string_split(tags, ',')))) as g from p) where g in ('malware','phishing','ransomware','trojan','c2','botnet','stealer','spyware','rat','backdoor','exploit','infostealer','dropper','keylogger','credential-theft','apt','campaign','loader') group by ioc),
a as (select ioc, greatest(max(pulse_count), count(*)) as told, max(pulse_count) as pc, list_sort(list(distinct family) filter (family <> '')) as fs, list_sort(list(distinct trim(adversary)) filter (trim(adversary) <> '')) as ads, max(try_cast(modified as timestamp)) as latest from p group by ioc),
b as (select a.*, coalesce(hs, []) as hs, floor((epoch(timestamp '2024-06-01') - epoch(latest)) / 86400)::int as days, d.* from a join d on a.ioc = d.domain left join t on a.ioc = t.ioc),
c as (select *, case when malware_count > 0 and days < 90 then 'Strong' when pc > 0 and (len(hs) > 0 or dns_count > 20 and ip_count > 5) then 'Suspicious' when pc > 0 then 'Contextual' else 'None' end as tier from b)
select domain as ioc, told::int as pulses_told, coalesce(array_to_string(fs, '|'), '') as families, array_to_string(hs, '|') as high_risk_tags, coalesce(array_to_string(ads, '|'), '') as adversaries, days, tier,
  case when coalesce(domain_age > 3650, false) and not coalesce(tls_age < 90, false) then case tier when 'Suspicious' then 'Contextual' when 'Contextual' then 'None' else tier end else tier end as dampened, malware_count > 0 and dns_count = 0 and len(hs) = 0 as reference_only from c""",
    "verdict_merge": f"""with v as (select *, case when url_gone then 0 else url_bad end as u, case when host_gone then 0 else host_bad end as h, url_bad + coalesce(suspicious, 0) + coalesce(harmless, 0) + coalesce(undetected, 0) as total from ({drawn.VERDICTS}))
select id, case when h >= u then host_bad else url_bad end as malicious, case when h >= u then coalesce(host_seen, url_seen) else url_seen end as last_seen, case when h >= u then 'domain' else 'url' end as source, total,
  coalesce(nullif(own_score, 0), case when total > 0 and url_bad > 0 then round_even(30.0::double * url_bad / total, 1) end)::double as file_score from v""",
    "ct_summary": f"""with n as (select domain, lower(trim(unnest(string_split(name_value, '|')))) as name from ({drawn.CT})), u as (select distinct domain, name from n where name <> '' and name <> domain and name[1] <> '*')
select domain, count(*) as subdomain_count, case when count(*) > 25 then 'High' when count(*) > 10 then 'Elevated' else 'None' end as explosion_level, array_to_string(list_sort(list(name))[:50], '|') as subdomains from u group by domain""",
    "dns_summary": f"""with d as ({drawn.DNS}) select domain, coalesce(string_agg(value, '|' order by pos) filter (rtype = 'A'), '') as a, coalesce(string_agg(value, '|' order by pos) filter (rtype = 'CNAME'), '') as cname, coalesce(string_agg(value, '|' order by pos) filter (rtype = 'MX'), '') as mx,
coalesce(arg_min(value, pos) filter (rtype = 'TXT' and regexp_matches(value, '(?i)^v=spf1\\b')), arg_min(value, pos) filter (rtype = 'TXT' and regexp_matches(value, '(?i)^[^a-z0-9]*v=spf1\\b'))) as spf, arg_min(value, pos) filter (rtype = 'DMARC') as dmarc, arg_min(value, pos) filter (rtype = 'DKIM') as dkim from d group by domain""",
    "passive_dns": f"""with p as (select ioc, nullif(trim(address), '') as a, nullif(trim(first), '') as f, nullif(trim(last), '') as l from ({drawn.PASSIVE}))
select ioc, count(*) as passive_dns_count, count(distinct a) as unique_ip_count, min(least(coalesce(f, l), coalesce(l, f))) as first_seen, max(greatest(coalesce(f, l), coalesce(l, f))) as last_seen from p group by ioc""",
    "risk_scores": _RISK,
    "text_artifacts": f"with {_ART} select doc_id, len(urls) as n_urls, coalesce(array_to_string(ds, '|'), '') as domains, coalesce(array_to_string(xs, '|'), '') as ips from url left join doms using (doc_id) left join ips using (doc_id)",
    "artifact_counts": f"""with {_ART}, n as (select doc_id, len(urls) as n_url, coalesce(len(ds), 0) as n_domain, coalesce(len(xs), 0) as n_ip from url left join doms using (doc_id) left join ips using (doc_id)),
s as (select doc_id, string_split(ip, '.')[-1]::int % 100 as score from (select doc_id, unnest(xs) as ip from ips)),
m as (select doc_id, count_if(score > 60) as high, count_if(score between 26 and 60) as medium, max(score) as top from s group by doc_id)
select doc_id, n_url, n_domain, n_ip, coalesce(high, 0)::bigint as total_high, coalesce(medium, 0)::bigint as total_medium, coalesce(top, 0)::int as max_score, (n_url + n_domain + n_ip)::bigint as total_artifacts from n left join m using (doc_id) where n_url + n_domain + n_ip > 0""",
    "artifact_scores": f"with {_ART}, s as (select doc_id, ip, {_ADDRESS_POINTS} as score from pub) select doc_id, ip as ioc, 'ip' as ioc_type, score, case when score <= 25 then 'LOW' when score <= 60 then 'MEDIUM' else 'HIGH' end as severity from s",
    "calls_by_api": f"""with {_CALLS}, m as (select session_id, api, method, count(*) as n from calls group by all), s as (select session_id, api, sum(n)::bigint as calls, string_agg(method || '=' || n, ',' order by method) as methods from m group by all)
select *, row_number() over (partition by session_id order by (api = 'violation')::int, calls desc, api) as ord from s""",
    "session_timeline": f"with {_CALLS} select event_id, session_id, round_even((epoch_us(ts) - epoch_us(min(ts) over (partition by session_id))) / 1e6, 2) as t from calls",
    "trailing_counts": f"""with {_CALLS} select coalesce(api, 'all') as api, {', '.join(f"count(*) filter (ts >= timestamp '2024-01-15' - interval {n} second and ts <= timestamp '2024-01-15') as last_{n}" for n in (60, 3600, 86400))} from calls group by rollup (api)""",
    "live_sessions": f"with {_CALLS} select session_id, count(*) as total from calls group by session_id having min(ts) >= timestamp '2024-01-01 01:00:00'",
    "call_windows": f"with {_CALLS} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, api, count(*) as calls, count(*) filter (violation) as violations from calls group by all",
    "call_classes": f"select o_orderkey as call_id, {drawn.pick('o_orderkey', [h for h, _ in drawn.CALL_KINDS])} as host, {drawn.pick('o_orderkey', [a for _, a in drawn.CALL_KINDS])} as api, o_orderkey % {len(drawn.CALL_KINDS)} in (8, 9) as violation from orders",
    "redirect_chains": f"select 'https://t.co/' || o_orderkey as url, {', '.join(f'{drawn.pick(drawn.K, [drawn.numbered(kind[1][i]) for kind in drawn.CHAIN_KINDS])} as {name}' for i, name in enumerate(('chain', 'hosts', 'final_url')))} from orders",
    "redirect_scores": """
with p as (select page_id as pos, url, (page_id % 70)::int as score, regexp_extract(url, '^[a-z]+://[^/?#]*') as origin from pages), canon as (select origin, arg_min(pos, pos) as pos from p where score > 25 group by origin),
j as (select p.*, c.pos % 5 as k, c.pos % 2 = 0 as redirects, p.score > 25 as live from p left join canon c using (origin)),
e as (select *, live and redirects and 20 * k > score as up from j)
select pos, case when up then (20 * k)::int else score end as score, case when (case when up then 20 * k else score end) <= 25 then 'LOW' when (case when up then 20 * k else score end) <= 60 then 'MEDIUM' else 'HIGH' end as severity, live and (20 * k >= 60 or k = 1) as chain_suspicious, up as elevated
from (select pos, score, k, live, coalesce(up, false) as up from e)""",
    "mail_verdicts": _own_mails(fx.MAIL_RESULTS, "origin, n_hops, spf, dkim, dmarc, source_type, chain_valid, trusted_instance, from_domain, bulk_sender, mismatches, n_anomalies"),
    "mail_hops": _own_mails(fx.values_sql("msg_id, ix, sending_host, receiving_host, ip, gateway, is_internal", [
        (1, 0, "a27.us-west-2.amazonses.com", "mx1.pphosted.com", "54.240.27.57", "amazon_ses", False), (1, 1, "mx1.pphosted.com", "z.protection.outlook.com", "143.55.149.216", "proofpoint", False), (1, 2, "inner.protection.outlook.com", "y.protection.outlook.com", "10.0.0.5", "microsoft", True),
        (1, 3, "relay.protection.outlook.com", "mx.corp.com", "40.1.1.1", "microsoft", False), (2, 0, "mail.sender.net", "mx1.example.org", "9.9.9.9", "", False),
    ]), "ix, sending_host, receiving_host, ip, gateway, is_internal"),
    "sender_domains": _own_mails(fx.values_sql("msg_id, domain, fields, mismatch", [(1, "shop.com", "from", True), (1, "evil.org", "reply_to", True), (1, "us-west-2.amazonses.com", "return_path", True), (2, "bank.com", "from", True), (2, "sender.net", "return_path", True), (3, "a.com", "from", False), (4, "spf.com", "from", False), (6, "b.c", "from", False)]), "domain, fields, mismatch"),
    "mail_flow": _own_mails(fx.values_sql("msg_id, pos, label, hostname", [
        (1, 0, "Internet", ""), (1, 1, "Amazon SES", "a27.us-west-2.amazonses.com"), (1, 2, "Proofpoint", "mx1.pphosted.com"), (1, 3, "Microsoft 365", "inner.protection.outlook.com"), (1, 4, "Microsoft 365", "relay.protection.outlook.com"), (1, 5, "Mailbox", ""),
        (2, 0, "Internet", ""), (2, 1, "mail.sender.net", "mail.sender.net"), (2, 2, "Mailbox", ""), *[(m, k, label, "") for m in (3, 4, 5, 6) for k, label in ((0, "Internet"), (1, "Mailbox"))],
    ]), "pos, label, hostname"),
    "auth_records": _own_mails(fx.values_sql("msg_id, ix, type, spf, dkim, dmarc, mailfrom_domain, signing_domain", [
        (1, 0, "AR", "fail", "pass", "pass", "us-west-2.amazonses.com", "shop.com"), (1, 1, "ARC", "fail", "pass", "pass", None, "shop.com"), (2, 0, "AR", "softfail", "fail", "fail", "sender.net", "other.net"),
        (3, 0, "AR-Original", "pass", "none", "none", "a.com", None), (3, 1, "AR", "fail", "pass", "pass", None, "a.com"), (6, 0, "AR", "pass", "none", "none", None, None), (6, 1, "ARC", "pass", "pass", "pass", None, None),
    ]), "ix, type, spf, dkim, dmarc, mailfrom_domain, signing_domain"),
}

#: The pages' hosts have neither brands nor risky suffixes; what they can score by is spelled out here.
ORACLE["url_risk"] = f"""
with {HOSTS}, {_URL},
e as (select key, {_ENTROPY.format("replace(domain, '-', '')")} as es, case when len(labels) > 0 and length(replace(labels[1], '-', '')) > 6 then {_ENTROPY.format("replace(labels[1], '-', '')")} end as ss, len(labels) as depth from ctx where key[1] = 'p'),
pts as (select url_id - 1000 as row_id, list_transform(list_filter(s, lambda x: x is not null), lambda x: case x when 'suspicious_scheme' then 'url_suspicious_scheme=15' when 'ip_host' then 'url_ip_host=8' when 'path_keywords_high' then 'url_path_keywords_high=10' when 'path_keywords_present' then 'url_path_keywords=5'
  when 'very_long_path' then 'url_very_long_path=5' when 'long_path' then 'url_long_path=2' when 'encoded_params' then 'url_encoded_params=5' when 'base64_in_query' then 'url_base64_query=3' when 'open_redirect_param' then 'url_open_redirect=8' when 'double_slash_path' then 'url_double_slash=10' when 'brand_in_path' then 'url_brand_in_path=10' when 'random_token_in_path' then 'url_random_token=3' else 'url_in_query_string=8' end) as u from sig where url_id >= 1000),
f as (select row_id, list_concat(list_filter([case when es >= 3.8 then 'high_entropy=5' when es >= 3.1 then 'moderate_entropy=2' end, case when ss >= 3.6 then 'subdomain_v2_high=10' when ss >= 2.8 then 'subdomain_v2_moderate=5' end, case when depth >= 3 then 'subdomain_depth_signal=5' end], lambda x: x is not null), u) as fs from pts join e on 'p' || row_id = key),
r as (select row_id, array_to_string(fs, '|') as factors, coalesce(list_sum(list_transform(fs, lambda x: string_split(x, '=')[2]::int)), 0)::int as raw_score from f)
select row_id, factors, raw_score, case when raw_score <= 25 then 'LOW' when raw_score <= 60 then 'MEDIUM' else 'HIGH' end as severity, case when raw_score <= 25 then 'LOW THREAT' when raw_score <= 60 then 'NEEDS REVIEW' else 'LIKELY MALICIOUS' end as verdict from r
"""
ORACLE["lookup_feeds"] = f"select o_orderkey as row_id, {', '.join(f'{drawn.pick(drawn.K, [r[i] for r in fx.FEED_ROWS])} as {name}' for i, name in enumerate(('raw_score', 'severity', 'verdict', 'n_factors', 'error'), 2))} from orders"
ORACLE["severity_histogram"] = f"""with r as (select row_id, raw_score, row_id % 30 as bad from ({ORACLE['url_risk']})), s as (select row_id, raw_score + case when bad = 0 then 0 when bad = 1 then 10 when bad <= 4 then 25 when bad <= 9 then 35 when bad <= 19 then 45 else 55 end as score from r)
select case when row_id % 50 = 49 then 'ERROR' when score <= 25 then 'LOW' when score <= 60 then 'MEDIUM' else 'HIGH' end as severity, count(*) as n from s group by 1"""
_KINDS = f"(select row_id, trim(raw) as clean, {drawn.pick('row_id', drawn.KINDS)} as input_type from ({drawn.INDICATORS}))"
ORACLE["checks"] = f"""
select row_id, case input_type when 'ip' then 'Infrastructure' when 'hash' then '' when 'url' then 'TLD|Entropy|URL Heuristics|Infrastructure' else 'TLD|Entropy|Infrastructure' end as passed,
case input_type when 'ip' then 'VT|OTX|AbuseIPDB' when 'hash' then 'VT|OTX' else 'VT|OTX|Age|TLS|Subdomains' end as failed, '' as skipped from {_KINDS} where input_type <> 'unknown'
"""
ORACLE["display_forms"] = f"""
select row_id, case when input_type = 'ip' then 'https://www.abuseipdb.com/check/' || replace(replace(clean, ':', '%3A'), '/', '%2F') else 'https://www.abuseipdb.com/' end as abuse_link, rtrim(translate(to_base64(encode(clean)), '+/', '-_'), '=') as url_key,
case when starts_with(clean, 'http') then 'url' when row_id % 9 = 0 then 'ip' else 'domain' end as guess, case when length(clean) <= 8 then repeat('•', length(clean)) else left(clean, 4) || repeat('•', length(clean) - 8) || right(clean, 4) end as masked,
case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KB', floor(b / 1024.0::double * 10 + 0.5) / 10) else printf('%.1f MB', floor(b / 1048576.0::double * 10 + 0.5) / 10) end as size from (select *, row_id % 3000 * 1000 as b from {_KINDS}) where input_type <> 'unknown'
"""

_LABEL = "case verdict when 'HIGHLY MALICIOUS' then 'Highly Malicious' when 'LIKELY MALICIOUS' then 'Likely Malicious' when 'NEEDS REVIEW' then 'Needs Review' when 'LOW THREAT' then 'Low Threat' else verdict end"
_SEVERITY = "case when {0} <= 25 then 'LOW' when {0} <= 60 then 'MEDIUM' else 'HIGH' end"
_GATEWAY_ROWS = ", ".join(f"({k}, {fx.literal(g)}, {fx.literal(n)})" for k, (g, n, _) in enumerate(mail.GATEWAYS))
_MAXIMA = "map {" + ", ".join(f"{fx.literal(k)}: {m}" for k, (m, _) in FACTORS.items()) + "}"
_CHAINED = """chained as (select page_id as pos, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, 'dest' || page_id % 5 || case when page_id % 5 < 2 then '.xyz' else '.com' end as last, page_id % 4 <> 0 as leads from pages)"""

#: Queries of ``artifact_queries``: their inputs are made from keys, and so are these results.
ORACLE |= {
    "mail_parts": """select doc_id as msg_id, 'doc-' || doc_id || '.txt' as filename, octet_length(encode(coalesce(text, '')))::bigint as size, sha256(coalesce(text, '')) as sha256, sha256(coalesce(text, '')) as body_sha256 from documents""",
    "mail_scores": f"""with {_ART}, p as (select doc_id, {_ADDRESS_POINTS} as score from (select doc_id, unnest(xs) as ip from ips) union all select doc_id, 0 from documents)
select doc_id as msg_id, max(score) as overall_score, {_SEVERITY.format("max(score)")} as severity, count_if(score > 60)::bigint as n_high, count_if(score between 26 and 60)::bigint as n_medium from p group by doc_id""",
    "mail_links": """select page_id as msg_id, 'www.other' || page_id % 7 || '.org now' as display, 'www.other' || page_id % 7 || '.org' as display_domain, 'site' || page_id % 50 || '.com' as href_domain,
case when page_id % 2 = 0 then '' else 'https://site' || page_id % 50 || '.com/p' end as unwrapped_href from pages where page_id % 3 = 1""",
    "received_addresses": """with x as (select o_orderkey, o_orderkey % 256 || '.7.1.' || o_orderkey % 3 as one, o_orderkey % 5 + 1 || '.7.1.' || o_orderkey % 3 as two from orders)
select o_orderkey, array_to_string(list_filter([case when not starts_with(one, '127.') then one end, case when two <> one then two end], lambda x: x is not null), '|') as ips from x""",
    "relay_contexts": """with x as (select c_custkey as msg_id, c_custkey % 3 as k, case when c_custkey % 2 = 0 then 'Microsoft 365' else 'Proofpoint' end as own, c_custkey % 2 = 0 as plain from customer)
select msg_id, k <> 0 as has_mismatch, case when k = 1 then 'Proofpoint' else own end as eval_gateway, case when k = 2 then 'Proofpoint' else '' end as relay_chain, case when plain then 'Microsoft 365 — Local Evaluation' else 'Trusted Gateway Policy Decision (Proofpoint)' end as context_label from x""",
    "gateway_keys": f"""with g as (select * from (values {_GATEWAY_ROWS}) as t(o, k, n)), s as (select r_regionkey, case r_regionkey % 3 when 0 then upper(n) when 1 then '  ' || k || ' gateway ' else left(n, 7) end as spelling from region, g),
c as (select distinct spelling, lower(trim(spelling)) as v from s), h as (select spelling, v, arg_min(k, o + case when contains(v, k) or contains(k, v) then 0 else 100 end) as k from c join g on contains(v, k) or contains(k, v) or contains(lower(n), v) or contains(v, lower(n)) group by all)
select r_regionkey, spelling, k as gateway from s join h using (spelling)""",
    "invitation_urls": "select page_id, 'https://u' || page_id || '.net/a|https://meet.io/' || page_id || '|https://alt.io/' || page_id % 9 as urls from pages",
    "source_priority": """with o as (select o_custkey as msg_id, o_orderkey, 'u' || o_orderkey % 10 as ioc, case when o_orderkey % 3 = 0 then 'u' || o_orderkey % 7 end as other from orders)
select msg_id, ioc, o_orderkey from o where not exists (select 1 from o as p where p.msg_id = o.msg_id and p.other = o.ioc)""",
    "url_overflow": """select c_custkey as doc_id, c_custkey % 16 as n_urls, least(10, c_custkey % 16) as n_displayed, (c_custkey % 16) // 2 as n_wrapped, 'https://h' || c_custkey % 16 || '.com/p' as last_url from customer where c_custkey % 16 > 0""",
    "code_types": """select page_id, case page_id % 5 when 0 then 'url' when 1 then 'domain' when 4 then case when contains(url, '.') then 'domain' end end as kind,
case page_id % 5 when 0 then 'url' when 4 then 'url' when 1 then 'domain' else 'unknown' end as typed from pages""",
    "file_reads": """with x as (select doc_id, doc_id % 3 as k, 'see https://s' || doc_id || '.org/a, and www.t' || doc_id || '.net/x but logo.png ' || case when doc_id % 3 = 0 then '<html><img src=''https://img' || doc_id || '.net/p''>' else '' end as said from documents)
select 'f' || doc_id || case k when 0 then '.html' when 1 then '.csv' else '.TXT' end as filename, case k when 0 then 'html' else 'text' end as extractor, length(said) as size, sha256(said) as sha256, 'https://s' || doc_id || '.org/a|' || case k when 0 then 'https://img' || doc_id || '.net/p|' else '' end || 'www.t' || doc_id || '.net/x' as urls from x""",
    "pasted_lines": "select page_id, 0 as pos, trim(url) as raw from pages where regexp_matches(trim(url), '(?i)^https?://') union all select page_id, 3, '1.2.3.4' from pages union all select page_id, 4, sha256(url) from pages where url is not null",
    "listed_names": "select n_nationkey, 0 as ord, lower(n_name) as item from nation where n_nationkey % 5 <> 4 union all select n_nationkey, 1, 'x' || n_nationkey from nation where n_nationkey % 5 <> 4",
    "json_rows": "select '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as value from nation",
    "hop_view": f"""with {_CHAINED}, h as (select pos as page_id, unnest(case when leads then [host, 'mid.net', last] else [host] end) as domain, unnest(case when leads then [0, 1, 2] else [0] end) as ix, leads from chained)
select page_id, ix, domain, ix = 0 as is_first, ix = case when leads then 2 else 0 end as is_final from h""",
    "final_hosts": f"""with {_CHAINED}, k as (select pos, last, last[5]::int as k from chained where leads),
s as (select pos, last, (case when ends_with(last, '.xyz') then 15 else 0 end + case k when 0 then 0 when 1 then 35 when 2 then 45 when 3 then 45 else 55 end + -- age; and of the youngest one, its risky suffix and the pattern that both make
  case k when 0 then 30 + 10 + 10 when 2 then 10 when 4 then 5 else 0 end)::int as final_score from k)
select pos, final_score, case when ends_with(last, '.xyz') then 'High' else 'Low' end as final_tld_level, final_score >= 60 or ends_with(last, '.xyz') as chain_suspicious from s""",
    "redirect_totals": """with p as (select page_id as pos, page_id % 70 > 25 as live, regexp_extract(url, '^[a-z]+://[^/?#]*') as origin from pages), c as (select origin, min(pos) % 5 as k from p where live group by origin)
select count(distinct case when live then origin end) as analysed, count_if(not live) as skipped, count(*) as total_url_results, count_if(live and (20 * k >= 60 or k = 1)) as suspicious_chains from p left join c using (origin)""",
    "source_badges": f"""with x as (select o_custkey % 100 as msg_id, case o_orderkey % 3 when 0 then 'QR Code' when 1 then 'Email Body' else 'Attachment' end as source, {_SEVERITY.format("o_orderkey * 37 % 101")} as s from orders)
select msg_id, source, count(*) as n, count_if(s = 'HIGH') as n_high, count_if(s = 'MEDIUM') as n_medium, case when bool_or(s = 'HIGH') then 'HIGH' when bool_or(s = 'MEDIUM') then 'MEDIUM' else 'LOW' end as worst from x group by all""",
    "signal_chips": f"""with h as (select url_id - 1000 as page_id, string_split(signals, '|') as s from ({ORACLE["url_heuristics"]}) where url_id >= 1000)
select page_id, array_to_string(list_filter([case page_id % 3 when 1 then 'entropy:Moderate' when 2 then 'entropy:High' end, case when page_id % 4 = 0 then 'resembles:paypal' end, case when page_id % 5 = 0 then 'rapid_deploy' end,
  case when list_has_any(s, ['path_keywords_high', 'path_keywords_present']) then 'path_keywords' end, case when list_contains(s, 'open_redirect_param') then 'open_redirect' end, case when list_has_any(s, ['encoded_params', 'base64_in_query']) then 'encoded_params' end,
  case when list_has_any(s, ['double_slash_path', 'brand_in_path']) then 'path_confusion' end, case when list_contains(s, 'ip_host') then 'ip_host' end, case when list_has_any(s, ['very_long_path', 'long_path']) then 'long_path' end], lambda x: x is not null), '|') as chips from h""",
    "factor_rows": f"""with r as (select row_id, factors from ({ORACLE["url_risk"]})), f as (select row_id, unnest(string_split(factors, '|')) as f, generate_subscripts(string_split(factors, '|'), 1) as i from r where factors <> ''),
p as (select row_id, i, string_split(f, '=')[1] as k, string_split(f, '=')[2]::int as n from f), t as (select *, least(100, floor(100.0 * n / {_MAXIMA}[k] + 0.5))::int as pct from p),
s as (select row_id, string_agg(k || ':' || n || ':' || pct || ':' || case when n >= 15 then 'high' when n >= 8 then 'medium' else 'low' end, '|' order by n desc, i) as shown, max(case when k = 'moderate_entropy' then n end) as entropy_points from t group by row_id)
select row_id, coalesce(shown, '') as shown, entropy_points from r left join s using (row_id)""",
    "verdict_labels": f"""with x as (select o_orderkey, o_orderkey * 37 % 101 as s from orders), v as (select o_orderkey, case when o_orderkey % 7 = 0 then 'OTHER' when s <= 25 then 'LOW THREAT' when s <= 60 then 'NEEDS REVIEW' when o_orderkey % 2 = 0 then 'HIGHLY MALICIOUS' else 'LIKELY MALICIOUS' end as verdict from x)
select o_orderkey, {_LABEL} as label from v""",
    "escaped_pages": """select page_id, sha256(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as escaped_sha256 from pages""",
    "shown_formats": """with x as (select o_orderkey, o_orderdate, o_orderkey * 997 as b, o_orderkey * 997 / 1024.0::double as kb from orders)
select o_orderkey, case o_orderkey % 3 when 0 then strftime(make_timestamp((o_orderkey * 1000 + 1600000000) * 1000000), '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%d') else 'n/a' end as shown_date,
case when b < 1024 then b || ' B' when kb < 1024 then printf('%.1f KB', floor(kb * 10 + 0.5) / 10) else printf('%.1f MB', floor(kb / 1024 * 10 + 0.5) / 10) end as shown_size from x""",
    "newest_reports": """with x as (select '9.9.9.' || o_custkey % 200 as ip, arg_max(o_orderkey % 101, o_orderkey)::int as confidence from orders group by all)
select ip, confidence, case when confidence > 50 then 30 when confidence > 20 then 20 when confidence >= 5 then 10 else 0 end as raw_score from x""",
}

ORACLE["session_views"] = f"""
with {_CALLS}, c as (select *, round_even((epoch_us(ts) - epoch_us(min(ts) over (partition by session_id))) / 1e6, 2) as t, row_number() over (partition by session_id order by ts, api, method) as ord from calls),
m as (select session_id, string_agg(method || '=' || n, ',' order by n desc, method) as methods, sum(n)::bigint as calls from (select session_id, method, count(*) as n from calls group by all) group by session_id),
l as (select session_id, string_agg(api || '@' || printf('%.2f', t), ',' order by ord) as timeline from c where ord <= 40 group by session_id)
select m.session_id, methods, sha256(timeline) as timeline_sha256, greatest(calls - 40, 0)::bigint as more from m join l using (session_id)
"""
ORACLE["relay_hops"] = f"""
with h as ({ORACLE["mail_hops"]})
select msg_id, (row_number() over (partition by msg_id order by ix) - 1)::int as ix, sending_host, case gateway when 'amazon_ses' then 'Amazon SES' when 'proofpoint' then 'Proofpoint' when 'microsoft' then 'Microsoft 365' end as gateway_name from h where gateway <> ''
"""
ORACLE["attachment_urls"] = "select page_id as msg_id, url || '&attached=1' as ioc from pages union all select page_id, url from pages where page_id % 3 = 0"
ORACLE["enriched_hosts"] = f"""
with a as (select row_id, raw, row_id % 3 as k, regexp_extract(raw, '^(?:https://)?([^/]*)', 1) as host from ({drawn.HOSTED})), dns as ({drawn.HOST_FEEDS['dns']}), asn as ({drawn.HOST_FEEDS['asn']}), ct as ({drawn.HOST_FEEDS['ct']}), red as ({drawn.HOST_FEEDS['redirects']})
select row_id, address, org, subdomain_count, explosion_level, suspicious as redirect, case when k = 2 then 'Unresolved' when cname is not null then 'Netlify' when org is not null then org else 'Unresolved' end as provider
from a left join dns on k < 2 and dns.domain = host left join asn on asn.ip = address left join ct on k < 2 and ct.domain = host left join red on k = 0 and red.url = raw
"""
ORACLE |= joins_oracle.ORACLE | histories_oracle.ORACLE
