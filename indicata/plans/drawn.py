"""Input tables of queries, drawn from the given ones: plain SQL that both engines read alike.

Each is a statement over one or two given tables, whose rows pick among kinds of values by their keys, so
inputs grow with the tables. ``read`` runs one in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx
from ..sources.tables import dealt, table


def pick(key: str, values) -> str:
    """A value by the remainder of a key."""
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {v if isinstance(v, _Sql) else fx.literal(v)}" for i, v in enumerate(values)) + " end"


class _Sql(str):
    """SQL text among plain values."""


def part(key: str, n: int) -> str:
    """Whole quotient."""
    return f"cast(floor({key} / {n}) as bigint)"


def text(key: str) -> str:
    return f"cast({key} as varchar(20))"


K, C = "o_orderkey", "o_custkey"
_T, _P = text(K), text(C)
#: (kind, indicator): of an indicator table; blank around it in one case.
KINDS = ("ip", "ip", "hash", "domain", "url", "url", "unknown", "domain", "unknown")
INDICATORS = f"""select {K} as row_id, {pick(K, [
    _Sql(f"'10.' || {text(K + ' % 256')} || '.' || {text(C + ' % 256')} || '.' || {text(K + ' % 7')}"), _Sql(f"'2001:db8::' || {text(K + ' % 9999')}"), _Sql(f"md5({_T})"), _Sql(f"'host' || {_P} || '.example.com'"),
    _Sql(f"'https://h' || {_P} || '.org/p' || {_T}"), _Sql(f"'ftp://c' || {_P} || '.net/f'"), _Sql(f"'plain' || {_T}"), _Sql(f"'  Sub' || {_P} || '.Test.co.uk '"), "",
])} as raw from orders"""

#: (host, api, violation) of called hosts.
CALL_KINDS = ((_Sql("'www.virustotal.com'"), "virustotal"), (_Sql(f"'a' || {_P} || '.virustotal.com'"), "virustotal"), ("otx.alienvault.com", "otx"), ("urlscan.io", "urlscan"), (_Sql(f"'sub' || {_P} || '.crt.sh'"), "other"), ("crt.sh", "crt_sh"), ("whois.team-cymru.com", "dns_whois"), ("RDAP.arin.net", "dns_whois"), (_Sql(f"'evil' || {_P} || '.com'"), "violation"), ("notvirustotal.com", "violation"), ("API.abuseipdb.com", "abuseipdb"))
CALLED = f"select {K} as call_id, {pick(K, [h for h, _ in CALL_KINDS])} as host from orders"

INFRA = f"""select {K} as host_id, {pick(K, [_Sql(f"'h' || {_P} || '.vercel.app'"), _Sql(f"'a' || {_P} || '.up.railway.app'"), _Sql(f"'shop' || {_P} || '.com'"), "global.ssl.fastly.net", "notvercel.app", "1.2.3.4", _Sql(f"'cdn' || {_P} || '.org'")])} as host,
{pick(part(K, 7), [None, "shop.netlify.app.", "d1.cloudfront.net", "x.akamai.net", "notvercel.app"])} as cname, {pick(part(K, 35), [None, "AMAZON-02, US", "CLOUDFLARENET, US", "RENDER, US", "GITHUB, US", "FASTLY, US", "DIGITALOCEAN-ASN", "SMALLHOST LLC", "MICROSOFT-CORP", "HETZNER-AS"])} as org,
{pick(C, [None, "Amazon", "Cloudflare Inc", "LE"])} as issuer, {pick(part(C, 4), [None, "timeout", ""])} as tls_error, {K} % 7 = 5 as is_ip from orders"""

PULSES = f"""select 'd' || {_P} as ioc, cast({C} % 4 as int) as pulse_count, {pick(K, [" Phishing ,c2", "news", "C2", "report", "apt,Loader", ""])} as tags, {pick(part(K, 6), ["Emotet", "Qakbot", None, "LockBit", ""])} as family,
{pick(part(K, 3), ["APT1", " ", None, "FIN7"])} as adversary, {pick(K, [None, "", _Sql(f"'2023-' || lpad({text('1 + ' + K + ' % 12')}, 2, '0') || '-' || lpad({text('1 + ' + C + ' % 28')}, 2, '0') || 'T00:00:00'"), "2024-05-30T23:00:00"])} as modified from orders"""
DOMAINS = f"""select distinct 'd' || {_P} as domain, cast({C} % 3 as int) as malware_count, cast({C} % 40 as int) as dns_count, cast({C} % 11 as int) as ip_count,
cast({pick(C, [4000, None, 9000, 30])} as int) as domain_age, cast({pick(part(C, 4), [200, 10, None])} as int) as tls_age from orders"""

VERDICTS = f"""select {K} as id, cast({K} % 13 as int) as url_bad, {K} % 5 = 0 as url_gone, cast({pick(K, [None, _Sql(C), 7])} as int) as url_seen, cast({C} % 11 as int) as host_bad, {C} % 7 = 0 as host_gone, cast({pick(C, [_Sql(K), None])} as int) as host_seen,
cast({pick(part(K, 5), [None, 0, 2, 1])} as int) as suspicious, cast({pick(C, [_Sql(C + " % 70"), 0, None])} as int) as harmless, cast({pick(K, [_Sql(K + " % 60"), None])} as int) as undetected, cast({pick(part(C, 3), [None, 0, _Sql(K + " % 31")])} as double) as own_score from orders"""

_ZONE = f"'z' || {text(part(C, 5))} || '.com'"
CT = f"""select {_ZONE} as domain, {pick(C, [_Sql(f"'h' || {text(K + ' % 60')} || '.' || {_ZONE} || '|*.' || {_ZONE} || '|' || {_ZONE}"), _Sql(f"' WWW' || {text(K + ' % 9')} || '.' || {_ZONE}"), _Sql(_ZONE)])} as name_value from orders"""

DNS = f"""select 'd' || {_P} as domain, {pick(K, ["A", "CNAME", "TXT", "MX", "TXT", "DMARC", "DKIM"])} as rtype, {pick(K, [_Sql(f"'1.0.0.' || {text(K + ' % 200')}"), "x.netlify.app.", _Sql(pick(part(K, 7), ["google-site=1", "V=SPF1 -all", "(v=spf1 ok)", "v=spf10 bad"])), _Sql(f"'mx.d' || {_P}"), "prefix v=spf1", " v=DMARC1; p=none", "v=DKIM1; p=AB"])} as value, {K} as pos from orders"""

PASSIVE = f"""select 'd' || {_P} as ioc, {pick(K, ["1.1.1.1", " 1.1.1.1 ", "", _Sql(f"'2.2.2.' || {text(K + ' % 200')}"), None])} as address, {pick(part(K, 5), ["", _Sql(f"'20' || lpad({text(K + ' % 24')}, 2, '0') || '-01-01T00:00:00'"), None])} as first, {pick(part(K, 3), [_Sql(f"'20' || lpad({text(C + ' % 24')}, 2, '0') || '-06-01T00:00:00'"), "", None])} as last from orders"""

#: Parts of urls escaped twice over for a redirector that uses - and _ instead of % and /.
_V2 = "replace(replace(replace(replace(url_encode(url), '-', '%2D'), '_', '%5F'), '%2F', '_'), '%', '-')"
WRAPS = (
    ("'https://nam12.safelinks.protection.outlook.com/?url=' || url_encode(url) || '&data=05'", "Microsoft SafeLinks"), ("'https://urldefense.com/v3/__' || url || '__;!!abc!def$'", "Proofpoint URLDefense"), (f"'https://urldefense.proofpoint.com/v2/url?u=' || {_V2} || '&d=x'", "Proofpoint URLDefense"),
    ("'https://linkprotect.cudasvc.com/url?a=' || url_encode(url) || '&c=1'", "Barracuda LinkProtect"), ("'https://protect.mimecast.com/s/x?p=' || url_encode(url)", "Mimecast Protect"), ("'https://l.facebook.com/l.php?u=' || url_encode(url) || '&h=1'", "Meta Redirect"), ("'https://click.mailer.net/?url=' || url_encode(url)", "Security Gateway"),
    ("'https://nam12.safelinks.protection.outlook.com/?url=' || url_encode('https://l.facebook.com/l.php?u=' || url_encode(url))", "Microsoft SafeLinks"), ("url", "Security Gateway"),
)
WRAPPED = f"select page_id as url_id, {pick('page_id', [_Sql(w) for w, _ in WRAPS])} as url from pages"

#: Redirect records of five kinds; {n} is the row's number.
CHAIN_KINDS = (
    (("https://a.com/x{n}", "https://b.com/y{n}", None, None, None, None), ("https://t.co/{n}|https://a.com/x{n}|https://b.com/y{n}", "t.co|a.com|b.com", "https://b.com/y{n}")),
    ((None, None, "https://c.com/z{n}", None, None, None), ("https://t.co/{n}|https://c.com/z{n}", "t.co|c.com", "https://c.com/z{n}")),
    (("https://v{n}.com/1", "https://end.com/", None, "/hop|https://d{n}.com/q", "https://end.com/", None), ("https://t.co/{n}|https://v{n}.com/1|https://t.co/hop|https://d{n}.com/q|https://end.com/", "t.co|v{n}.com|d{n}.com|end.com", "https://end.com/")),
    ((None, None, None, "", "https://t.co/{n}", "https://fonts.gstatic.com/f|https://dest{n}.io/favicon.ico"), ("https://t.co/{n}|https://dest{n}.io/", "t.co|dest{n}.io", "https://t.co/{n}")),
    ((None,) * 6, ("https://t.co/{n}", "t.co", "https://t.co/{n}")),
)


def numbered(value: str | None, number: str = _T) -> _Sql:
    """A text in which {n} stands for a number of the row, as SQL."""
    return _Sql("cast(null as varchar(20))" if value is None else f" || {number} || ".join(fx.literal(v) for v in value.split("{n}")))


CHAINS = f"select 'https://t.co/' || {_T} as url, " + ", ".join(f"{pick(K, [numbered(kind[0][i]) for kind in CHAIN_KINDS])} as {name}" for i, name in enumerate(("vt_redirects", "vt_final", "vt_url", "us_redirects", "us_page", "us_listed"))) + " from orders"


def renamed(value: str) -> str:
    """Domains of the mail templates, made the row's own."""
    for name, end in (("shop", "com"), ("bank", "com"), ("sender", "net")):
        value = f"replace({value}, '{name}.{end}', '{name}' || {_P} || '.{end}')"
    return value


#: Messages with their headers in order: those of a template with the order's own domains. Spark's SQL.
MESSAGES = f"""select /*+ broadcast(t) */ {K} as msg_id, transform(t.headers, h -> named_struct('name', h.name, 'value', {renamed('h.value')})) as headers
from orders join (select msg_id, array_sort(collect_list(named_struct('pos', pos, 'name', name, 'value', value))) as headers from ({fx.MAILS}) group by msg_id) t on t.msg_id = {K} % 6 + 1"""

#: Indicators of the feed templates, made the customer's own.
_OWN = {"bad.xyz": "bad{n}.xyz", "https://u.com/a": "https://u{n}.com/a", "u.com": "u{n}.com", "err.com": "err{n}.com", "old.com": "old{n}.com"}


def address(first: int, second: int, key: str) -> _Sql:
    """An address for each key: three octets are its digits to base 256, the second one counted from ``second``, so that it stays an address for any number of keys."""
    return _Sql(f"'{first}.' || {text(f'({second} + {part(key, 65536)}) % 256')} || '.' || {text(key + ' % 256')} || '.' || {text(part(key, 256) + ' % 256')}")


def _indicator(value: str, key: str) -> _Sql:
    if value in ("9.9.9.9", "8.8.4.4"):
        return address(int(value[0]), int(value[2]), key)
    if len(value) == 32:
        return _Sql(f"upper(md5({text(key)}))" if value.isupper() else f"md5({text(key)})")
    # a number in two digits, so that no number of customers makes a name look random
    return numbered(_OWN[value], f"bin({key})") if value in _OWN else _Sql(fx.literal(value))


def _feed(columns: str, rows, constant: tuple[str, ...] = ()) -> str:
    """A feed with a customer's own records for each of the template's; those of constant indicators once, whatever the customers' keys."""
    names = columns.split(", ")
    out = []
    for row in rows:
        others = ", ".join(f"{fx.literal(v)} as {n}" for n, v in zip(names[1:], row[1:]))
        once = "distinct " if row[0] in constant else ""
        out.append(f"select {once}{_indicator(row[0], 'c_custkey')} as {names[0]}, {others} from customer")
    return " union all ".join(out)


CONSTANT = ("paypal-verify.netlify.app",)
FEEDS = {name: _feed(columns, rows, CONSTANT) for name, (columns, rows) in fx.FEEDS.items()}
ASKED = f"select {K} as row_id, {pick(K, [_indicator(r[1], C) for r in fx.FEED_ROWS])} as raw from orders"


#: Feature rows for the score, drawn from order keys so that every rule meets many combinations. Plain SQL, for both engines.
RISK_INPUT = """
select o_orderkey as id,
  case o_orderkey % 5 when 0 then 'ip' when 1 then 'hash' when 2 then 'url' else 'domain' end as input_type,
  case when o_orderkey % 3 = 0 then 'a.b.evil.com' else '1.2.3.4' end as query,
  o_orderkey % 13 <> 0 as vt_ok,
  cast(case when (o_orderkey // 7) % 3 = 0 then 0 else (o_orderkey // 3) % 61 end as int) as vt_malicious,
  o_orderkey % 4 <> 1 as abuse_ok, cast((o_orderkey // 11) % 90 as int) as abuse_confidence, (o_orderkey // 2) % 17 = 0 as is_tor,
  cast(case when o_custkey % 3 = 0 then null else (o_custkey * 7) % 400 end as int) as age_days,
  cast(case when o_custkey % 4 = 0 then null else (o_custkey * 3) % 60 end as int) as tls_age_days,
  o_custkey % 9 = 0 as rapid_deploy,
  case o_custkey % 5 when 0 then 'Vultr' when 1 then 'Unresolved' when 2 then 'Google Cloud' when 3 then 'SmallHost' else 'IBM' end as provider,
  o_custkey % 6 <> 0 as otx_ok,
  case (o_orderkey // 5) % 4 when 0 then 'None' when 1 then 'Contextual' when 2 then 'Suspicious' else 'Strong' end as otx_tier,
  o_custkey % 5 = 0 as otx_reference_only,
  case (o_custkey // 3) % 4 when 0 then '' when 1 then 'botnet' when 2 then 'phishing' else 'lockbit,trojan' end as tags,
  case (o_custkey // 5) % 5 when 0 then '' when 1 then 'Emotet' when 2 then 'Hive,Qakbot' when 3 then 'A,B,C' else 'A,B,C,D' end as families,
  cast((o_orderkey // 13) % 15 as int) as otx_pulses, cast((o_custkey // 2) % 30 as double) as otx_file_score,
  case (o_orderkey // 17) % 3 when 0 then 'Low' when 1 then 'Moderate' else 'High' end as entropy_level,
  case (o_orderkey // 19) % 4 when 0 then null when 1 then 'Low' when 2 then 'Moderate' else 'High' end as sub_level,
  (o_orderkey // 23) % 2 = 0 as sub_old_scored,
  case (o_orderkey // 29) % 3 when 0 then '' when 1 then 'a' else 'a,b,c' end as labels,
  case (o_orderkey // 31) % 3 when 0 then 'fastly.net' when 1 then 'evil.com' else '' end as registrable_domain,
  case (o_orderkey // 37) % 3 when 0 then 'Low' when 1 then 'Medium' else 'High' end as tld_level,
  (o_orderkey // 41) % 2 = 0 as similar_flag, case (o_orderkey // 43) % 2 when 0 then 'High' else 'Medium' end as similar_confidence,
  (o_orderkey // 47) % 2 = 0 as hostname_brand_match, case (o_orderkey // 53) % 2 when 0 then 'High' else 'Medium' end as hostname_brand_confidence,
  case (o_orderkey // 59) % 2 when 0 then 'cdn_subdomain' else 'subdomain' end as hostname_brand_context,
  (o_orderkey // 61) % 3 <> 0 as ct_ok, case (o_orderkey // 67) % 3 when 0 then 'None' when 1 then 'Elevated' else 'High' end as ct_level,
  case (o_custkey // 7) % 4 when 0 then 'paypal' when 1 then 'paypal,okta' else '' end as brand_list,
  case (o_custkey // 11) % 3 when 0 then 'root' when 1 then 'subdomain' else 'cdn_subdomain' end as brand_context,
  case (o_custkey // 13) % 2 when 0 then 'login,verify' else '' end as lure_list,
  case (o_custkey // 17) % 3 when 0 then 'fastly.net' end as cdn_provider, case (o_custkey // 19) % 3 when 0 then 'netlify.app' end as abused_platform,
  case (o_custkey // 23) % 5 when 0 then 'suspicious_scheme,ip_host' when 1 then 'path_keywords_high,very_long_path,encoded_params' when 2 then 'path_keywords_present,long_path,open_redirect_param,base64_in_query' when 3 then 'double_slash_path,brand_in_path,random_token_in_path,url_in_query' else '' end as signals,
  (o_orderkey // 71) % 7 = 0 as redirect_suspicious
from orders
"""

#: Hosts of customers as urls, names and addresses, and what four more feeds say of them.
_HOME, _PLACE = "'h' || {0} || '.com'", "'1.2.' || {1} || '.' || {2}"


def _of(template: str, key: str) -> str:
    return template.format(text(key), text(key + " % 256"), text(part(key, 256)))


HOSTED = f"""select {K} as row_id, {pick(K, [_Sql(f"'https://' || {_of(_HOME, C)} || '/p'"), _Sql(_of(_HOME, C)), _Sql(_of(_PLACE, C))])} as raw from orders"""
#: The same with addresses for any number of customers, as places stop being addresses at the 65536th; its SQL tells the kinds apart by the rows' keys.
HOSTED_ANY = HOSTED.replace(_of(_PLACE, C), address(1, 2, C))
_N = "c_custkey"
HOST_FEEDS = {
    "dns": f"select {_of(_HOME, _N)} as domain, {_of(_PLACE, _N)} as address, case when {_N} % 6 = 0 then 'x.netlify.app' end as cname from customer where {_N} % 2 = 0",
    "asn": f"select {_of(_PLACE, _N)} as ip, 'ORG' || {text(_N + ' % 7')} as org from customer where {_N} % 4 = 0",
    "ct": f"select {_of(_HOME, _N)} as domain, cast({_N} % 40 as int) as subdomain_count, case when {_N} % 40 > 25 then 'High' when {_N} % 40 > 10 then 'Elevated' else 'None' end as explosion_level, cast(null as varchar(9)) as error from customer where {_N} % 3 = 0",
    "redirects": f"select 'https://' || {_of(_HOME, _N)} || '/p' as url, {_N} % 10 = 0 as suspicious from customer where {_N} % 5 = 0",
}


#: What the statements need of a table.
_KEYS = {"orders": (K, C), "customer": ("c_custkey",), "pages": ("page_id", "url")}


def read(spark: SparkSession, sf_dir: str, sql: str, *, dear: bool = False) -> DataFrame:
    """The rows of one of the statements, over the tables that it names; ``dear`` if costly work on each row follows."""
    for name, keys in _KEYS.items():
        if f"from {name}" in sql:
            rows = table(spark, sf_dir, name).select(*keys)
            (dealt(rows) if dear else rows).createOrReplaceTempView(f"_drawn_{name}")
            sql = sql.replace(f"from {name}", f"from _drawn_{name}")
    return spark.sql(sql)
