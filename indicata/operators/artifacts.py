"""Indicators inside texts, mail and files: extraction, filters, caps, scoring and its return to the sources.

Extraction is one expression per text (no explode): matches, filters, distinct and
caps work on the text's own array. Only scoring explodes: indicators are made
distinct over the whole batch, scored once, and joined back to where they came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DOMAIN as NAME
from ..functions.text import any_of, ends_with_any, let, matches, member, percent_decoded, pinned, text_or_empty
from ..functions.urls import gateway_name, is_wrapper, unwrapped_once, url_host, url_parts

#: Caps: urls shown, domains, addresses, hashes.
MAX_URLS, MAX_DOMAINS, MAX_IPS, MAX_HASHES = 10, 20, 20, 5
#: Fixed values from here to DOMAIN: names that are no indicators, and what the indicators look like.
NOISE_SUFFIXES = tuple(
    """
    w3.org schema.org example.com example.org localhost safelinks.protection.outlook.com urldefense.com
    urldefense.proofpoint.com linkprotect.cudasvc.com protect.mimecast.com
    """.split()
)
NOISE_TLDS = tuple(
    """
    png jpg jpeg gif svg webp ico bmp tiff css js woff woff2 ttf eot otf map html htm xhtml dtd xml json yaml yml
    pdf doc docx xls xlsx ppt pptx txt csv zip gz tar rar 7z exe dll bin sh php asp aspx cfm dotm dotx xlsm xltx
    xltm pptm potx potm odt ods odp rels vsd vsdx
    """.split()
)
HTML_TAGS = tuple(
    """
    div span li ul ol p a img table tr td th h1 h2 h3 h4 h5 h6 body html head meta link script style form input
    button select option textarea section article header footer nav main aside figure figcaption blockquote pre
    code strong em b i u br hr label
    """.split()
)
URL = r"""(?i)https?://[^\s"'<>\)\]]+"""
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
_GROUP = "[0-9a-fA-F]{1,4}"
IPV6 = (
    rf"(?<![:\w])(?:(?:{_GROUP}:){{2,7}}{_GROUP}|(?:{_GROUP}:){{2,6}}:|(?:{_GROUP}:){{1,5}}(?::{_GROUP}){{1,5}}"
    rf"|{_GROUP}::(?:{_GROUP}:?){{0,6}}|::(?:ffff(?::0{{1,4}})?:)?{_OCTET}(?:\.{_OCTET}){{3}}|::1)(?![:\w])"
)
DOMAIN = rf"\b{NAME}\b"


#: What every match of a pattern holds: one cheap search that most texts end with.
_HELD = {URL: "(?i)https?://", IPV4: r"\d\.\d{1,3}\.\d", IPV6: ":[0-9a-fA-F]{0,4}:", DOMAIN: r"[a-zA-Z0-9]\.[a-zA-Z]{2}"}


def _all(text: Column, pattern: str) -> Column:
    """All matches of one of the patterns above."""
    return matches(text, pattern, _HELD[pattern])


def is_private_ip(ip: Column) -> Column:
    """Reserved, local and noise addresses, by prefix."""
    low = F.lower(F.substring_index(ip, "%", 1))
    second = F.get(F.split(ip, r"\."), F.lit(1)).try_cast("int")
    return (
        ip.isin("127.0.0.1", "0.0.0.0", "255.255.255.255", "10.0.0.0", "192.168.0.0")
        | (low == "::1")
        | any_of([F.startswith(low, F.lit(p)) for p in ("fc", "fd")])
        | low.rlike("^fe[89ab].")
        | any_of([F.startswith(ip, F.lit(p)) for p in ("10.", "192.168.", "169.254.", "127.")])
        | F.startswith(ip, F.lit("172.")) & F.coalesce(second.between(16, 31), F.lit(False))
    )


def is_noise_domain(domain: Column) -> Column:
    tld, first = F.substring_index(domain, ".", -1), F.substring_index(domain, ".", 1)
    return (
        (F.length(domain) < 4)
        | ~F.contains(domain, F.lit("."))
        | ~tld.rlike("^[a-z]{2,6}$")
        | member(tld, NOISE_TLDS)
        | member(first, HTML_TAGS)
        | first.rlike("^(?i)[0-9a-f]{2}$")
        | ends_with_any(domain, NOISE_SUFFIXES)
    )


def urls_in(text: Column) -> Column:
    """Distinct urls of a text in order, without closing punctuation."""
    found = F.transform(_all(text_or_empty(text), URL), lambda u: F.regexp_replace(u, r"""[.,;)>"']+$""", ""))
    return F.array_distinct(F.filter(found, lambda u: u != ""))


def hrefs_in(html: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(html), F.lit(r"""(?i)href=["']?(https?://[^\s"'<>]+)"""), F.lit(1))


def ips_in(text: Column, cap: int = MAX_IPS) -> Column:
    """Distinct public addresses of a text: dotted ones, then the others, in order."""
    found = F.transform(F.concat(_all(text_or_empty(text), IPV4), _all(text_or_empty(text), IPV6)), lambda x: F.substring_index(x, "%", 1))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~is_private_ip(x))), 1, cap)


def domains_in(text: Column, url_hosts: Column, cap: int = MAX_DOMAINS) -> Column:
    """Sorted distinct host names of a text that aren't noise and aren't hosts of its urls."""
    found = F.transform(_all(text_or_empty(text), DOMAIN), lambda d: F.lower(F.rtrim(d, F.lit("."))))
    return F.slice(F.array_sort(F.array_except(F.filter(found, lambda d: ~is_noise_domain(d)), url_hosts)), 1, cap)


def ics_urls(payload: Column) -> Column:
    """Urls of an invitation's URL, LOCATION, DESCRIPTION and ATTACH lines; a folded line ends at its first line."""
    values = F.transform(F.regexp_extract_all(payload, F.lit(r"(?mi)^(?:URL|LOCATION|DESCRIPTION|ATTACH)[^:\n]*:(.+)$"), F.lit(1)), lambda v: F.trim(v))
    per_line = F.transform(values, lambda v: F.when(F.startswith(v, F.lit("http")), F.array(v)).otherwise(F.transform(_all(v, URL), lambda u: F.regexp_replace(u, r"""[.,;)>"']+$""", ""))))
    return F.array_distinct(F.filter(F.flatten(per_line), lambda u: u != ""))


def _unwrapped(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("http")), unwrapped_once(url)).otherwise(url)


def extract(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", html_col: str | None = None, layers: int = 2) -> DataFrame:
    """One row per text: id, urls (struct of original, url, gateway, displayed), domains, ips.

    Urls are unwrapped (``layers`` deep inside an array; see ``urls.with_unwrapped``
    for a column of single urls), those that only wrap are dropped, and the first ten
    are displayed; the rest are scored all the same.
    """
    c = F.col
    html = text_or_empty(c(html_col)) if html_col else F.lit("")

    def peeled(url: Column, left: int) -> Column:
        return url if not left else let(_unwrapped(url), lambda u: peeled(u, left - 1))

    def found(x: Column) -> Column:
        raw = F.array_distinct(F.concat(urls_in(x["full"]), F.transform(hrefs_in(x["h"]), lambda u: F.regexp_replace(u, r"""[.,;)>"']+$""", ""))))
        each = F.filter(F.transform(raw, lambda u: F.struct(u.alias("original"), peeled(u, layers).alias("url"))), lambda u: ~is_wrapper(u["url"]))
        return let(each, lambda us: let(F.struct(us.alias("us"), F.transform(us, lambda u: u["url"]).alias("keys")), lambda k: named(x, F.filter(k["us"], lambda u, i: F.array_position(k["keys"], u["url"]) == i + 1))))

    def named(x: Column, unique: Column) -> Column:
        shown = lambda us: F.transform(us, lambda u, i: F.struct(u["original"].alias("original"), u["url"].alias("url"), F.when(u["original"] != u["url"], gateway_name(u["original"])).alias("gateway"), (i < MAX_URLS).alias("displayed")))
        return let(unique, lambda us: F.struct(shown(us).alias("urls"), domains_in(x["t"], F.transform(us, lambda u: url_host(u["url"]))).alias("domains"), ips_in(x["full"]).alias("ips")))

    # one expression over the text: nothing of it is copied from stage to stage
    texts = let(F.struct(percent_decoded(text_or_empty(c(text_col))).alias("t"), html.alias("h")), lambda y: F.struct(y["t"].alias("t"), y["h"].alias("h"), F.when(y["h"] == "", y["t"]).otherwise(F.concat(y["t"], F.lit("\n"), y["h"])).alias("full")))
    out = df.select(c(id_col), F.explode(F.array(let(texts, found))).alias("_found"))
    return out.select(id_col, "_found.urls", "_found.domains", "_found.ips")


def long_form(extracted: DataFrame, id_col: str = "doc_id", source: str = "Email Body") -> DataFrame:
    """(id, pos, ioc, ioc_type, source, original, displayed): one row per indicator, in order."""
    one = lambda ioc, kind, original=None, shown=None: F.struct(ioc.alias("ioc"), F.lit(kind).alias("ioc_type"), F.lit(source).alias("source"), (ioc if original is None else original).alias("original"), (F.lit(True) if shown is None else shown).alias("displayed"))
    every = F.concat(
        F.transform("urls", lambda u: one(u["url"], "url", u["original"], u["displayed"])),
        F.transform("domains", lambda d: one(d, "domain")),
        F.transform("ips", lambda i: one(i, "ip")),
    )
    return extracted.select(id_col, F.posexplode(every).alias("pos", "x")).select(id_col, "pos", "x.*")


def without(rows: DataFrame, others: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Long artifacts without those whose indicator ``others`` has for the same message.

    Body urls give way to the same urls in QR codes and invitations, attachments' urls
    to those of the body.
    """
    return rows.join(others.select(id_col, "ioc").distinct(), [id_col, "ioc"], "left_anti")


def qr_type(payload: Column) -> Column:
    """url, domain (any other text with a dot, but for data:) or null."""
    web = F.startswith(payload, F.lit("http://")) | F.startswith(payload, F.lit("https://"))
    return F.when(web, "url").when(F.contains(payload, F.lit(".")) & ~F.startswith(payload, F.lit("data:")), "domain")


def attachments(messages: DataFrame, cap: int = MAX_HASHES) -> DataFrame:
    """(msg_id, ix, filename, content_type, size, sha256) of the first named or attached parts."""
    named = F.filter("parts", lambda p: F.contains(p["disposition"], F.lit("attachment")) | (p["filename"] != "unknown"))
    return messages.select("msg_id", F.explode(F.slice(named, 1, cap)).alias("p")).select("msg_id", "p.ix", "p.filename", "p.content_type", "p.size", "p.sha256")


def link_mismatches(links: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Anchors whose shown text names another host than the one they lead to, wrappers taken off."""
    rows = links.select(id_col, F.posexplode("links").alias("pos", "l")).select(id_col, "pos", "l.href", "l.display").where("display <> ''")
    rows = pinned(pinned(rows.withColumn("_one", _unwrapped(F.col("href")))).withColumn("unwrapped", _unwrapped(F.col("_one"))).drop("_one"))
    rows = rows.withColumn("href_domain", url_parts(F.col("unwrapped"))["hostname"])
    plain = lambda d: F.regexp_replace(F.lower(d), r"^www\.", "")
    named = F.transform(_all(F.col("display"), DOMAIN), lambda d: F.lower(F.rtrim(d, F.lit("."))))
    first = F.get(F.filter(named, lambda d: plain(d) != plain(F.col("href_domain"))), F.lit(0))
    rows = rows.withColumn("display_domain", first).where("display_domain is not null")
    return rows.select(id_col, "pos", F.substring("display", 1, 120).alias("display"), F.substring("href", 1, 200).alias("href"), F.when(F.col("unwrapped") != F.col("href"), F.substring("unwrapped", 1, 200)).otherwise("").alias("unwrapped_href"), "display_domain", "href_domain")


def score_fan_out(artifacts: DataFrame, feeds: dict[str, DataFrame], id_col: str = "msg_id") -> DataFrame:
    """Long artifacts with the score of their indicator: distinct indicators are scored once and joined back.

    Artifacts are read twice, for the distinct ones and for the join: write those that
    come from decoders to a table first.
    Certificate-log counts are left out, as they are for mail.
    """
    from ..plans.lookup import lookup

    distinct = artifacts.select("ioc", "ioc_type").distinct()
    scored = lookup(distinct, feeds, raw_col="ioc", with_subdomains=False).select(F.col("ioc").alias("_ioc"), F.coalesce("normalized_score", F.lit(0)).alias("score"), F.coalesce("severity", F.lit("LOW")).alias("severity"), F.coalesce("verdict", F.lit("LOW THREAT")).alias("verdict"), "factors", "error")
    return artifacts.join(scored, F.col("ioc") == F.col("_ioc")).drop("_ioc")


def artifact_counts(scored: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Per message: indicators of each type, how many are high and medium, and the worst."""
    kinds = {f"n_{k}": F.count_if(F.col("ioc_type") == k) for k in ("url", "domain", "ip", "hash")}
    return scored.groupBy(id_col).agg(*[v.alias(k) for k, v in kinds.items()], F.count_if(F.col("severity") == "HIGH").alias("total_high"), F.count_if(F.col("severity") == "MEDIUM").alias("total_medium"), F.max("score").alias("max_score"))
