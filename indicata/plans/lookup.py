"""Indicator lookup: classify, join the feed snapshots, enrich and score, for any number of rows.

``feeds`` maps names to DataFrames; all are optional and keyed by the lower-case
indicator or host. The plan dedups the feeds' keys, joins them on the left, and
does all the rest in projections: nothing is exploded, no order is lost, and rows
stay what they are (``row_id``). Where many rows ask for few indicators, ``asked_once``
has each looked up once. Spark broadcasts a feed that is small enough and
sorts and merges a large one; skewed hosts are split by adaptive execution.

* vt(ioc, malicious, suspicious, harmless, undetected, last_seen, not_found, error)
* abuseipdb(ip, abuse_confidence_score, is_tor, error)
* otx(ioc, pulse_count, malware_families, high_risk_tags, all_tags, malware_count,
  recent_activity_days, passive_dns_count, unique_ip_count, file_score, asn, error)
* whois(domain, age_days), tls(host, tls_age_days, issuer, issuer_cn, error)
* dns(domain, a_records, cname_records), asn(ip, org), ct(domain, subdomain_count, explosion_level, error)
* redirects(url, suspicious)
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import brands, hosts, infra, intel, urls
from ..functions.text import input_type, pinned, sanitize, strings
from ..sources.tables import dealt
from . import risk

SCHEMAS = {
    "vt": "ioc string, malicious int, suspicious int, harmless int, undetected int, last_seen long, not_found boolean, error string",
    "abuseipdb": "ip string, abuse_confidence_score int, is_tor boolean, error string",
    "otx": "ioc string, pulse_count int, malware_families array<string>, high_risk_tags array<string>, all_tags array<string>, malware_count int, recent_activity_days int, passive_dns_count int, unique_ip_count int, file_score double, asn string, error string",
    "whois": "domain string, age_days int",
    "tls": "host string, tls_age_days int, issuer string, issuer_cn string, error string",
    "dns": "domain string, a_records array<string>, cname_records array<string>",
    "asn": "ip string, org string",
    "ct": "domain string, subdomain_count int, explosion_level string, error string",
    "redirects": "url string, suspicious boolean",
}


def classify(rows: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds clean, input_type and host (of urls and domains); order and repeats stay."""
    rows = rows.withColumn("clean", sanitize(F.col(raw_col)))
    rows = rows.withColumn("input_type", input_type(F.col("clean")))
    host = F.when(F.col("input_type") == "url", urls.url_parts(F.col("clean"))["hostname"]).when(F.col("input_type") == "domain", F.col("clean"))
    return pinned(rows.withColumn("host", host))


def _names(feed: str) -> list[str]:
    return [f.split()[0] for f in SCHEMAS[feed].split(", ")]


def _kind(feed: str) -> str:
    return "struct<" + ",".join(f.replace(" ", ":", 1) for f in SCHEMAS[feed].split(", ")[1:]) + ">"


def _newest(feed: str, table: DataFrame) -> DataFrame:
    """(feed, key, and the struct named like the feed): a key's newest record (``as_of``, ``last_seen``), one without an error before others."""
    names = _names(feed)
    known = table.where(F.col(names[0]).isNotNull())
    newest = [F.col(x) for x in ("as_of", "last_seen") if x in known.columns] + ([F.col("error").isNull()] if "error" in names else [])
    one = known.groupBy(F.col(names[0]).alias("_key")).agg(F.max_by(F.struct(*names[1:]), F.struct(*newest, *names[1:])).cast(_kind(feed)).alias(f"_{feed}"))
    return one.select(F.lit(feed).alias("_feed"), "_key", f"_{feed}")


def _records(rows: DataFrame, feeds: dict[str, DataFrame], asked: dict[str, tuple[str, Column]], *, dear: bool = False) -> DataFrame:
    """(indicator, and a struct for each alias of ``asked``) of the indicators (clean, input_type, host) that some feed knows.

    ``asked`` has the feed and the key of each alias. Each distinct indicator asks all feeds in one narrow join by
    feed and key, and its answers are brought together by an aggregate; rows themselves aren't dealt for that.
    ``dear`` if the answers meet rows that are dealt over all cores by indicator.
    """
    keys = [F.struct(F.lit(a).alias("alias"), F.lit(feed).alias("_feed"), key.alias("_key")) for a, (feed, key) in asked.items()]
    long = rows.select("_indicator", F.explode(F.filter(F.array(*keys), lambda k: k["_key"].isNotNull())).alias("k")).select("_indicator", "k.*")
    every = None
    for feed in dict.fromkeys(feed for feed, _ in asked.values()):
        one = _newest(feed, feeds[feed])
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    met = long.join(every, ["_feed", "_key"])
    return (dealt(met, "_indicator") if dear else met).groupBy("_indicator").agg(*[F.any_value(F.when(F.col("alias") == a, F.col(f"_{feed}")), ignoreNulls=True).alias(a) for a, (feed, _) in asked.items()])


def enrich(rows: DataFrame, feeds: dict[str, DataFrame], *, with_subdomains: bool = True, repeated: bool = True) -> DataFrame:
    """Classified rows with one struct for each check; ``repeated`` if many of them may ask for the same indicator."""
    c = F.col
    low, is_url = F.lower("clean"), c("input_type") == "url"
    asked = {
        "vt_own": ("vt", F.when(is_url, c("clean")).otherwise(low)), "vt_host": ("vt", F.when(is_url, c("host"))), "abuse": ("abuseipdb", F.when(c("input_type") == "ip", c("clean"))),
        "otx": ("otx", F.coalesce("host", low)), "otx_root": ("otx", c("_root")), "whois": ("whois", c("host")), "tls": ("tls", c("host")), "dns": ("dns", c("host")), "ct": ("ct", c("host")), "redirects": ("redirects", F.when(is_url, c("clean"))),
    }
    present = {a: x for a, x in asked.items() if x[0] in feeds and (with_subdomains or a != "ct")}
    absent = {a: F.lit(None).cast(_kind(feed)) for a, (feed, _) in asked.items() if a not in present} | {"owner": F.lit(None).cast(_kind("asn"))}
    df = rows
    if present:
        # a text that is the same for the same indicator, and never null
        df = df.withColumn("_indicator", F.concat_ws("\x1f", c("input_type"), c("clean"), F.coalesce("host", F.lit("\0"))))
        root = F.when(is_url, hosts.host_context(c("host"))["registrable_domain"]) if "otx_root" in present else F.lit(None).cast("string")
        distinct = df.select("_indicator", "input_type", "clean", "host")
        distinct = (distinct.dropDuplicates(["_indicator"]) if repeated else distinct).withColumn("_root", root)
        told = _records(pinned(distinct), feeds, present, dear=not repeated)
        if not repeated:
            # indicators of few bytes, each with all checks to follow: more tasks than bytes would make
            df = dealt(df, "_indicator")
        if "asn" in feeds and "dns" in present:
            first = F.get(c("dns")["a_records"], F.lit(0))
            owners = _newest("asn", feeds["asn"]).select(F.col("_key").alias("_address"), F.col("_asn").alias("owner"))
            told = told.withColumn("_address", first).join(owners, "_address", "left").drop("_address")
            absent.pop("owner")
        df = df.join(told, "_indicator", "left").drop("_indicator")
    df = pinned(df.withColumns(absent))
    # a url's intelligence falls back to the registrable domain on an error only
    df = df.withColumn("otx", F.when(c("otx")["error"].isNotNull() & c("otx_root").isNotNull(), c("otx_root")).otherwise(c("otx"))).drop("otx_root")
    url = c("input_type") == "url"
    merged = intel.merged_verdict(c("vt_own"), c("vt_host"))
    df = df.withColumn("virustotal", F.when(url, F.struct(merged["malicious"].alias("malicious"), merged["last_seen"].alias("last_seen"), F.when(merged["source"] == "domain", c("vt_host")["error"]).otherwise(c("vt_own")["error"]).alias("error"), merged["source"].alias("source")))
        .otherwise(F.struct(c("vt_own")["malicious"].alias("malicious"), c("vt_own")["last_seen"].alias("last_seen"), c("vt_own")["error"].alias("error"), F.lit("own").alias("source"))))
    for columns in _checks(rows.sparkSession.sparkContext.applicationId):
        df = pinned(df.withColumns(columns))
    return df


@lru_cache(maxsize=4)
def _checks(application: str) -> tuple[dict[str, Column], ...]:
    """The checks that need no feed of their own, by stage; like the rules of the score, built once for an application."""
    c = F.col
    url = c("input_type") == "url"
    named = c("host").isNotNull() & (c("host") != "")
    owner = F.when(c("input_type") == "ip", c("otx")["asn"]).otherwise(c("owner")["org"])
    place = infra.infrastructure(F.coalesce("host", "clean"), c("dns")["cname_records"], owner, c("tls")["issuer"], c("tls")["issuer_cn"], c("tls")["error"])
    where = {"host_context": F.when(named, hosts.host_context(c("host"))), "infrastructure": F.when(c("input_type").isin("ip", "url", "domain"), place)}
    on_host = lambda x: F.when(named, x)
    checks = {
        "entropy": on_host(hosts.domain_entropy(c("host_context"))),
        "subdomain_entropy": on_host(hosts.subdomain_entropy(c("host_context"), moderate=False)),
        "subdomain_entropy_v2": on_host(hosts.subdomain_entropy(c("host_context"))),
        "tld_risk": on_host(hosts.tld_risk(c("host"))),
        "brand_similarity": on_host(brands.brand_similarity(c("host"))),
        "hostname_brand": on_host(brands.hostname_brand(c("host"))),
        "brand_tokens": on_host(hosts.brand_tokens(c("host_context"))),
        "lures": on_host(hosts.lure_keywords(c("host_context"))),
        "cdn_hosting": on_host(hosts.cdn_hosting(c("host_context"))),
        "abused_hosting": on_host(hosts.abused_hosting(c("host_context"))),
        "url_heuristics": F.when(url, urls.url_heuristics(c("clean"))),
    }
    return where, checks


def scored(enriched: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Enriched rows, or what to keep of them, with the columns of ``risk.score``."""
    inputs = _inputs(enriched.sparkSession.sparkContext.applicationId)
    # two sets of columns share names, so the checks travel in one struct of their own
    flat = enriched.select(F.struct(*(keep or enriched.columns)).alias("_checks"), F.col("input_type"), *[v.alias(k) for k, v in inputs.items()])
    out = risk.score(pinned(flat))
    return out.select("_checks.*", F.col("otx_tier").alias("confidence_tier"), "factors", "adjustment", "raw_score", "normalized_score", "severity", "verdict", "color")


@lru_cache(maxsize=4)
def _inputs(application: str) -> dict[str, Column]:
    """What the score reads, from the structs of the checks."""
    c = F.col
    otx, named = c("otx"), c("input_type").isin("domain", "url")
    malware = otx["malware_count"]
    tags = F.coalesce(otx["high_risk_tags"], strings([]))
    tier = intel.confidence_tier(malware, tags, otx["pulse_count"], otx["recent_activity_days"], F.coalesce(otx["passive_dns_count"], F.lit(0)), F.coalesce(otx["unique_ip_count"], F.lit(0)))
    tier = F.when(named, intel.dampened_tier(tier, c("whois")["age_days"], c("tls")["tls_age_days"])).otherwise("None")
    counts = intel.verdict_counts(c("vt_own"))
    file_score = F.when(c("input_type") == "hash", intel.derived_file_score(F.when(otx["file_score"] != 0, otx["file_score"]), counts))
    ctx, ent, sub, hb, sim, brand = c("host_context"), c("entropy"), c("subdomain_entropy_v2"), c("hostname_brand"), c("brand_similarity"), c("brand_tokens")
    return {
        "query": c("clean"), "vt_ok": c("virustotal")["malicious"].isNotNull() & c("virustotal")["error"].isNull(), "vt_malicious": c("virustotal")["malicious"],
        "abuse_ok": c("abuse").isNotNull() & c("abuse")["error"].isNull(), "abuse_confidence": c("abuse")["abuse_confidence_score"], "is_tor": c("abuse")["is_tor"],
        "age_days": c("whois")["age_days"], "tls_age_days": F.when(c("tls")["error"].isNull(), c("tls")["tls_age_days"]), "rapid_deploy": c("infrastructure")["rapid_deploy"], "provider": c("infrastructure")["provider"],
        "otx_ok": otx.isNotNull() & otx["error"].isNull(), "otx_tier": tier, "otx_reference_only": named & intel.reference_only(malware, otx["passive_dns_count"], tags), "otx_tags": tags, "otx_all_tags": otx["all_tags"], "otx_families": otx["malware_families"], "otx_pulses": otx["pulse_count"], "otx_file_score": file_score,
        "entropy_level": ent["entropy_level"], "entropy_score": ent["entropy_score"], "sub_level": sub["subdomain_entropy_level"], "sub_score": sub["subdomain_entropy_score"], "sub_label": sub["subdomain_label"], "sub_old_scored": c("subdomain_entropy")["scored"],
        "subdomain_labels": ctx["subdomain_labels"], "registrable_domain": ctx["registrable_domain"], "tld": c("tld_risk")["tld"], "tld_level": c("tld_risk")["risk_level"],
        "similar_flag": sim["brand_impersonation_flag"], "similar_confidence": sim["confidence"], "similar_brand": sim["matched_brand"], "similar_method": sim["method"],
        "hostname_brand_match": hb["brand_match_hostname"], "hostname_brand_confidence": hb["confidence"], "hostname_brand_context": hb["context"], "hostname_brand": hb["matched_brand"], "hostname_label": hb["matched_label"],
        "ct_ok": c("ct").isNotNull() & c("ct")["error"].isNull(), "ct_count": c("ct")["subdomain_count"], "ct_level": c("ct")["explosion_level"],
        "brand_count": brand["brand_count"], "brands": brand["matched_brands"], "brand_context": brand["context"], "lures": c("lures")["matched_lures"], "cdn_provider": c("cdn_hosting")["cdn_provider"], "abused_platform": c("abused_hosting")["platform"],
        "url_signals": c("url_heuristics")["signals"], "redirect_suspicious": c("redirects")["suspicious"],
    }


def asked_once(rows: DataFrame, answers: Callable[[DataFrame], DataFrame], raw_col: str = "raw") -> DataFrame:
    """``rows`` with the columns that ``answers`` tells of a table of their distinct indicators, in the same column.

    However many rows ask for an indicator, the dear work on it is done once and in a task
    like others; only what is told of it meets the rows. Keep that narrow.
    """
    told = answers(rows.select(raw_col).distinct()).withColumnRenamed(raw_col, "_asked")
    return rows.join(told, F.col(raw_col).eqNullSafe(F.col("_asked"))).drop("_asked")


def lookup(rows: DataFrame, feeds: dict[str, DataFrame], *, raw_col: str = "raw", with_subdomains: bool = True, repeated: bool = True, checks: bool = True) -> DataFrame:
    """Every row of ``rows`` with its type, checks and risk; empty and unknown ones get an error and no score.

    One indicator or many: a row's result doesn't depend on the others. Without ``checks``
    only the score and its factors join the rows, which are then carried on with little beside.
    """
    found = classify(rows, raw_col)
    error = F.when(F.col("clean") == "", "Empty query").when(F.col("input_type") == "unknown", "Unrecognised input type")
    keep = None if checks else found.columns
    out = scored(enrich(found, feeds, with_subdomains=with_subdomains, repeated=repeated), keep).withColumn("error", error)
    null_if_error = ["factors", "adjustment", "raw_score", "normalized_score", "severity", "verdict", "color"]
    return out.withColumns({k: F.when(F.col("error").isNull(), F.col(k)) for k in null_if_error})


#: Checks of each input type, with the struct that tells how a check went.
CHECKS = {
    "ip": (("VT", "virustotal"), ("OTX", "otx"), ("AbuseIPDB", "abuse"), ("Infrastructure", "infrastructure")),
    "domain": (("VT", "virustotal"), ("OTX", "otx"), ("Age", "whois"), ("TLD", "tld_risk"), ("Entropy", "entropy"), ("Infrastructure", "infrastructure"), ("TLS", "tls"), ("Subdomains", "ct")),
    "url": (("VT", "virustotal"), ("OTX", "otx"), ("Age", "whois"), ("TLD", "tld_risk"), ("Entropy", "entropy"), ("URL Heuristics", "url_heuristics"), ("Infrastructure", "infrastructure"), ("TLS", "tls"), ("Subdomains", "ct")),
    "hash": (("VT", "virustotal"), ("OTX", "otx")),
}


def check_status(enriched: DataFrame) -> DataFrame:
    """Adds passed, failed and skipped: names of the intended checks by how they went.

    No record, or nothing but an error, is failed; an error about a missing key is
    skipped, and so is the certificate of a plain http url that has none.
    """
    c = F.col

    def state(check: str, column: str, kind: str) -> Column:
        fields = enriched.schema[column].dataType.names
        data = [f for f in fields if f not in ("error", "source")]
        has = F.coalesce(*[F.when(c(column)[f].isNotNull(), F.lit(True)) for f in data], F.lit(False)) if data else F.lit(False)
        error = F.lower(c(column)["error"]) if "error" in fields else F.lit(None).cast("string")
        out = F.when(~has & (F.contains(error, F.lit("key not configured")) | F.contains(error, F.lit("api key not"))), "skipped")
        if check == "TLS" and kind == "url":
            out = out.when(~has & error.isNotNull() & c("clean").rlike("(?i)^http://"), "skipped")
        if check == "OTX":  # an error of this feed is an answer too
            has = has | error.isNotNull()
        return out.when(has, "passed").otherwise("failed")

    def named(want: str) -> Column:
        by_type = None
        for kind, checks in CHECKS.items():
            found = F.filter(F.array(*[F.when(state(n, col, kind) == want, n) for n, col in checks]), lambda x: x.isNotNull())
            by_type = F.when(c("input_type") == kind, found) if by_type is None else by_type.when(c("input_type") == kind, found)
        return by_type

    return enriched.withColumns({w: named(w) for w in ("passed", "failed", "skipped")})
