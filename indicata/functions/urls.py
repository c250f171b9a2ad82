"""URLs: splitting, structural signals and their points, gateway unwrapping, chains. Built-in functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lists
from .text import contains_any, ends_with_any, let, member, ordered_dedup, percent_decoded, present, strings, text_or_empty

_GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def url_parts(url: Column) -> Column:
    """Struct of scheme, netloc, hostname, path and query, by the generic syntax; parameters after ; leave the path."""
    return let(F.regexp_replace(F.trim(text_or_empty(url)), r"[\t\r\n]", ""), _parts)


def _parts(u: Column) -> Column:
    piece = lambda k: F.regexp_extract(u, "(?s)" + _GENERIC, k)
    scheme, netloc = F.lower(piece(1)), piece(2)
    last = F.substring_index(netloc, "@", -1)
    host = F.when(F.startswith(last, F.lit("[")), F.regexp_extract(last, r"^\[([^\]]*)", 1)).otherwise(F.substring_index(last, ":", 1))
    path = F.when(scheme.isin("", "http", "https", "ftp", "sftp", "hdl", "prospero", "rtsp", "sip", "sips", "mms", "shttp", "imap", "tel"), F.regexp_replace(piece(3), r";[^/]*$", "")).otherwise(piece(3))
    return F.struct(scheme.alias("scheme"), netloc.alias("netloc"), F.lower(host).alias("hostname"), path.alias("path"), piece(4).alias("query"))


def url_host(url: Column) -> Column:
    """Lower-case host, or the string itself if it has none."""
    host = url_parts(url)["hostname"]
    return F.when(host != "", host).otherwise(url)


def query_pairs(query: Column) -> Column:
    """Array of (name, value) of a query, decoded, plus as blank; pairs without = are kept with an empty value."""
    items = F.filter(F.split(query, "&"), lambda x: x != "")
    decode = lambda x: percent_decoded(F.translate(x, "+", " "))
    return F.transform(items, lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("name"), F.when(F.contains(x, F.lit("=")), decode(F.regexp_replace(x, "(?s)^[^=]*=", ""))).otherwise("").alias("value")))


def parameter(pairs: Column, name: str) -> Column:
    """The first value that isn't empty of a parameter, else null."""
    return F.get(F.filter(pairs, lambda p: (p["name"] == name) & (p["value"] != "")), F.lit(0))["value"]


#: Signal, factor and points, in the order in which they are told.
SIGNALS = (
    ("suspicious_scheme", "url_suspicious_scheme", 15),
    ("ip_host", "url_ip_host", 8),
    ("path_keywords_high", "url_path_keywords_high", 10),
    ("path_keywords_present", "url_path_keywords", 5),
    ("very_long_path", "url_very_long_path", 5),
    ("long_path", "url_long_path", 2),
    ("encoded_params", "url_encoded_params", 5),
    ("base64_in_query", "url_base64_query", 3),
    ("open_redirect_param", "url_open_redirect", 8),
    ("double_slash_path", "url_double_slash", 10),
    ("brand_in_path", "url_brand_in_path", 10),
    ("random_token_in_path", "url_random_token", 3),
    ("url_in_query", "url_in_query_string", 8),
)


def url_heuristics(url: Column, keywords=lists.PATH_KEYWORDS, redirects=lists.REDIRECT_PARAMETERS) -> Column:
    """Struct of signals, path_keywords, path_length and score; patterns are fixed values."""
    return let(F.struct(text_or_empty(url).alias("url"), url_parts(url).alias("p")), lambda s: _heuristics(s["url"], s["p"], keywords, redirects))


def _heuristics(url: Column, p: Column, keywords, redirects) -> Column:
    both = F.concat(F.lower(p["path"]), F.lit(" "), F.lower(p["query"]))
    word = lambda w: both.rlike(f"(^|[^a-z]){re.escape(w)}($|[^a-z])")
    # one pattern first: most urls hold no keyword at all
    some = both.rlike("(^|[^a-z])(" + "|".join(map(re.escape, sorted(keywords))) + ")($|[^a-z])")
    found = F.when(some & (url != ""), present(F.array(*[F.when(word(w), w) for w in sorted(keywords)]))).otherwise(strings([]))
    return let(F.struct(url.alias("url"), p.alias("p"), found.alias("found"), query_pairs(p["query"]).alias("pairs")), lambda x: _signals(x["url"], x["p"], x["found"], x["pairs"], redirects))


def _signals(url: Column, p: Column, found: Column, pairs: Column, redirects) -> Column:
    path, query = p["path"], p["query"]
    n, size = F.size(found), F.length(path)
    fired = {
        "suspicious_scheme": p["scheme"].isin("data", "javascript", "vbscript", "ftp"),
        "ip_host": p["hostname"].rlike(r"^(\d{1,3}\.){3}\d{1,3}$"),
        "path_keywords_high": n >= 3,
        "path_keywords_present": n.between(1, 2),
        "very_long_path": size > 300,
        "long_path": size.between(121, 300),
        "encoded_params": F.concat(path, query).rlike("(%[0-9A-Fa-f]{2}){4,}"),
        "base64_in_query": query.rlike("[A-Za-z0-9+/]{30,}={0,2}"),
        "open_redirect_param": F.exists(pairs, lambda x: member(F.lower(x["name"]), redirects)),
        "double_slash_path": path.rlike(r"//[a-z0-9-]+\.[a-z]{2,}"),
        "brand_in_path": path.rlike(r"(?i)/([a-z0-9-]+\.(com|net|org|io|co|app|bank))/"),
        "random_token_in_path": path.rlike("(?i)[0-9a-f]{24,}"),
        "url_in_query": query.rlike("(?i)[?&][a-z_-]+=https?://"),
    }
    signals = present(F.array(*[F.when((url != "") & fired[s], s) for s, _, _ in SIGNALS]))
    return let(F.struct(signals.alias("s"), found.alias("f"), size.alias("n")), lambda x: F.struct(x["s"].alias("signals"), x["f"].alias("path_keywords"), x["n"].alias("path_length"), url_score(x["s"]).alias("score")))


def url_factors(signals: Column) -> Column:
    """Array of (key, points) of the signals that fired."""
    return present(F.array(*[F.when(F.array_contains(signals, s), F.struct(F.lit(k).alias("key"), F.lit(n).alias("points"))) for s, k, n in SIGNALS]))


def url_score(signals: Column) -> Column:
    return F.aggregate(url_factors(signals), F.lit(0), lambda a, x: a + x["points"])


#: Hosts that only wrap or count clicks; tested as equal or as an ending, without a dot before.
WRAPPER_SUFFIXES = tuple(
    """
    .safelinks.protection.outlook.com urldefense.com urldefense.proofpoint.com linkprotect.cudasvc.com
    protect.mimecast.com l.messenger.com l.facebook.com click.pstmrk.it click.email. r.email. links.sgiz.mobi
    u.wix.com mandrillapp.com mailchi.mp
    """.split()
)


def is_wrapper(url: Column) -> Column:
    return (text_or_empty(url) != "") & ends_with_any(F.lower(url_parts(url)["netloc"]), WRAPPER_SUFFIXES)


def gateway_name(url: Column) -> Column:
    host = F.lower(url_parts(url)["netloc"])
    return (
        F.when(F.contains(host, F.lit(".safelinks.protection.outlook.com")), "Microsoft SafeLinks")
        .when(contains_any(host, ("urldefense.com", "urldefense.proofpoint.com")), "Proofpoint URLDefense")
        .when(F.contains(host, F.lit("linkprotect.cudasvc.com")), "Barracuda LinkProtect")
        .when(F.contains(host, F.lit("mimecast.com")), "Mimecast Protect")
        .when(host.isin("l.messenger.com", "l.facebook.com"), "Meta Redirect")
        .otherwise("Security Gateway")
    )


def unwrapped_once(url: Column) -> Column:
    """One layer of a security gateway's or redirector's wrapping taken off; any other url as it is."""
    plain = percent_decoded(url)
    u = F.when(F.startswith(plain, F.lit("http")), plain).otherwise(url)
    whole = let(u, lambda x: let(url_parts(x), lambda p: F.struct(x.alias("u"), F.lower(p["netloc"]).alias("host"), query_pairs(p["query"]).alias("pairs"))))
    return let(F.struct(url.alias("url"), whole.alias("w")), lambda s: _inner(s["url"], s["w"]["u"], s["w"]["host"], s["w"]["pairs"]))


def _inner(url: Column, u: Column, host: Column, pairs: Column) -> Column:
    value = lambda name: percent_decoded(parameter(pairs, name))
    web = lambda v: F.when(F.startswith(v, F.lit("http")), v)
    defense = contains_any(host, ("urldefense.com", "urldefense.proofpoint.com"))
    v3 = F.regexp_extract(u, r"/v3/__(.+?)__(?=[A-Za-z0-9;!_-]{0,40}(?:!!|$))", 1)
    v2 = percent_decoded(F.translate(parameter(pairs, "u"), "-_", "%/"))
    generic = contains_any(host, ("redirect", "urldefense", "safelink", "linkprotect", "mimecast", "tracking", "click.", "links.", "go."))
    return F.coalesce(
        F.when(F.endswith(host, F.lit(".safelinks.protection.outlook.com")), value("url")),
        F.when(defense, F.coalesce(F.when(v3 != "", web(percent_decoded(v3))), web(v2))),
        F.when(host == "linkprotect.cudasvc.com", value("a")),
        F.when((host == "protect.mimecast.com") | host.rlike(r"^protect-\w+\.mimecast\.com$"), F.coalesce(web(value("p")), web(value("url")), web(value("u")))),
        F.when(host.isin("l.messenger.com", "l.facebook.com"), web(value("u"))),
        F.when(generic, F.coalesce(*[web(value(n)) for n in ("url", "u", "dest", "destination", "redirect", "to")])),
        url,
    )


def with_unwrapped(df, url_col: str, out_col: str = "unwrapped", layers: int = 5):
    """Adds the url behind up to five layers of wrapping.

    The layers are separate projections: one expression nested five times would grow
    with the fifth power.
    """
    df = df.withColumn(out_col, F.col(url_col))
    for _ in range(layers):
        step = F.when(F.startswith(F.col(out_col), F.lit("http")), unwrapped_once(F.col(out_col))).otherwise(F.col(out_col))
        df = df.withColumn("_step", F.explode(F.array(step))).drop(out_col).withColumnRenamed("_step", out_col)
    return df


def merged_chain(first: Column, second: Column, cap: int = 10) -> Column:
    """Two redirect chains as one: the longer (ties: the second) with the other's extra urls spliced in.

    An extra url goes after its nearest predecessor that is in the chain already, or
    to the end.
    """
    a, b = ordered_dedup(first), ordered_dedup(second)
    base, extra = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)

    def splice(chain: Column, item: Column) -> Column:
        before = F.slice(extra, 1, F.greatest(F.array_position(extra, item).cast("int") - 1, F.lit(0)))
        known = F.filter(before, lambda x: F.array_contains(chain, x))
        at = F.array_position(chain, F.get(known, F.size(known) - 1)).cast("int")
        return F.when(F.array_contains(chain, item), chain).when(at.isNull(), F.concat(chain, F.array(item))).otherwise(F.concat(F.slice(chain, 1, at), F.array(item), F.slice(chain, at + 1, F.size(chain))))

    merged = F.aggregate(extra, base, splice)
    return F.slice(F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(merged), 1, cap)


def chain_hosts(chain: Column, cap: int = 8) -> Column:
    """Distinct hosts of a chain in order."""
    hosts = F.transform(chain, lambda u: url_parts(u)["hostname"])
    return F.slice(F.array_distinct(F.filter(hosts, lambda h: h != "")), 1, cap)


