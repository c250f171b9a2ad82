"""Threat-intelligence snapshots: normal forms, pulses, confidence tiers and merges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import member, present, strings, text_or_empty

TIERS = ("None", "Contextual", "Suspicious", "Strong")


def verdict_counts(stats: Column) -> Column:
    """Engine counts without nulls, and their sum."""
    get = lambda k: F.coalesce(stats[k], F.lit(0))
    keys = ("malicious", "suspicious", "harmless", "undetected")
    total = get(keys[0])
    for k in keys[1:]:
        total = total + get(k)
    return F.struct(*[get(k).alias(k) for k in keys], total.alias("total"))


def url_id(url: Column) -> Column:
    """The id of a url in a verdict feed: URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(url, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def age_days(start: Column, as_of: Column) -> Column:
    """Whole days from one time to another, rounded down."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(start)) / F.lit(86_400_000_000)).cast("int")


def pulse_tags(pulses: Column) -> Column:
    """Sorted distinct tags, trimmed and in lower case."""
    tags = F.flatten(F.transform(pulses, lambda p: F.coalesce(p["tags"], strings([]))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(present(tags), lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def pulse_families(pulses: Column, cap: int = 10) -> Column:
    families = F.flatten(F.transform(pulses, lambda p: F.coalesce(p["malware_families"], strings([]))))
    return F.slice(F.array_distinct(F.filter(families, lambda x: x.isNotNull() & (x != ""))), 1, cap)


def adversaries(pulses: Column, cap: int = 10) -> Column:
    names = F.filter(F.transform(pulses, lambda p: F.trim(text_or_empty(p["adversary"]))), lambda x: x != "")
    return F.slice(F.array_sort(F.array_distinct(names)), 1, cap)


def recent_days(pulses: Column, as_of: Column) -> Column:
    """Days since the latest change; null if any of the times is malformed."""
    raw = F.filter(F.transform(pulses, lambda p: p["modified"]), lambda t: t.isNotNull() & (t != ""))
    times = F.transform(raw, lambda t: F.try_to_timestamp(t))
    return F.when(F.forall(times, lambda t: t.isNotNull()), age_days(F.array_max(times), as_of))


#: Tags that count as high risk.
HIGH_RISK_TAGS = tuple(
    """
    malware phishing ransomware trojan c2 botnet stealer spyware rat backdoor exploit infostealer dropper keylogger
    credential-theft apt campaign loader
    """.split()
)


def pulse_info(pulse_count: Column, nested_count: Column, pulses: Column, high_risk_tags=HIGH_RISK_TAGS) -> Column:
    """Struct of pulse_count (the largest told), malware_families, high_risk_tags and adversaries."""
    tags = F.filter(pulse_tags(pulses), lambda t: member(t, high_risk_tags))
    count = F.greatest(F.coalesce(pulse_count, F.lit(0)), F.coalesce(nested_count, F.lit(0)), F.size(pulses))
    return F.struct(count.alias("pulse_count"), pulse_families(pulses).alias("malware_families"), tags.alias("high_risk_tags"), adversaries(pulses, 5).alias("adversaries"))


def confidence_tier(malware_count: Column, high_risk_tags: Column, pulse_count: Column, days: Column, dns_count: Column, ip_count: Column) -> Column:
    pulsed = F.coalesce(pulse_count, F.lit(0)) > 0
    return (
        F.when((F.coalesce(malware_count, F.lit(0)) > 0) & F.coalesce(days < 90, F.lit(False)), "Strong")
        .when(pulsed & ((F.size(high_risk_tags) > 0) | (dns_count > 20) & (ip_count > 5)), "Suspicious")
        .when(pulsed, "Contextual")
        .otherwise("None")
    )


def dampened_tier(tier: Column, domain_age: Column, tls_age: Column) -> Column:
    """One tier lower for domains of more than ten years, but for Strong and for those with a fresh certificate."""
    old = F.coalesce(domain_age > 3650, F.lit(False)) & ~F.coalesce(tls_age < 90, F.lit(False))
    return F.when(old & (tier == "Suspicious"), "Contextual").when(old & (tier == "Contextual"), "None").otherwise(tier)


def reference_only(malware_count: Column, dns_count: Column, high_risk_tags: Column) -> Column:
    return (F.coalesce(malware_count, F.lit(0)) > 0) & (F.coalesce(dns_count, F.lit(0)) == 0) & (F.size(high_risk_tags) == 0)


def malware_summary(size: Column, data: Column) -> Column:
    """Struct of malware_count, malware_families and av_detections (null for none)."""
    names = F.filter(F.transform(data, lambda d: F.trim(text_or_empty(d["malware_family"]))), lambda x: x != "")
    total = F.aggregate(data, F.lit(0).cast("long"), lambda a, d: a + F.coalesce(d["detections_count"], F.lit(0)))
    return F.struct(F.coalesce(size, F.size(data).cast("long")).alias("malware_count"), F.slice(F.array_distinct(names), 1, 10).alias("malware_families"), F.when(total > 0, total).alias("av_detections"))


def passive_dns_summary(df):
    """(ioc, passive_dns_count, unique_ip_count, first_seen, last_seen); times compare as text."""
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return df.groupBy("ioc").agg(
        F.count("*").alias("passive_dns_count"),
        F.countDistinct(text(F.col("address"))).alias("unique_ip_count"),
        F.min(F.least(text(F.col("first")), text(F.col("last")))).alias("first_seen"),
        F.max(F.greatest(text(F.col("first")), text(F.col("last")))).alias("last_seen"),
    )


def merged_verdict(url: Column, domain: Column) -> Column:
    """The record of a url or of its domain, whichever more engines condemn (ties: the domain's), and its source."""
    bad = lambda x: F.when(F.coalesce(x["not_found"], F.lit(False)), 0).otherwise(F.coalesce(x["malicious"], F.lit(0)))
    by_domain = bad(domain) >= bad(url)
    return F.struct(F.when(by_domain, domain["malicious"]).otherwise(url["malicious"]).alias("malicious"), F.when(by_domain, F.coalesce(domain["last_seen"], url["last_seen"])).otherwise(url["last_seen"]).alias("last_seen"), F.when(by_domain, "domain").otherwise("url").alias("source"))


def derived_file_score(file_score: Column, counts: Column) -> Column:
    """A hash's own score, else 30 times the share of engines that condemn it, to one decimal; 0 counts as none."""
    share = F.bround(30.0 * counts["malicious"] / counts["total"], 1)
    return F.coalesce(file_score, F.when((counts["total"] > 0) & (counts["malicious"] > 0), share))


def dns_summary(df):
    """(domain, a_records, cname_records, ns, mx, spf, dmarc): long records (domain, rtype, value, pos) to one row each."""
    kind = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("rtype") == r, F.struct("pos", "value")))), lambda x: x["value"])
    first = lambda pattern, r: F.min_by(F.col("value"), F.when((F.col("rtype") == r) & F.col("value").rlike(pattern), F.col("pos")))
    return df.groupBy("domain").agg(
        kind("A").alias("a_records"), kind("CNAME").alias("cname_records"), kind("NS").alias("ns_records"), kind("MX").alias("mx_records"),
        F.coalesce(first(r"(?i)^v=spf1\b", "TXT"), first(r"(?i)^[^a-zA-Z0-9]*v=spf1\b", "TXT")).alias("spf"), first(r"(?i)^\s*v=dmarc1", "DMARC").alias("dmarc"), first("(?i)v=dkim1|p=", "DKIM").alias("dkim"),
    )


def ct_summary(df, cap: int = 50):
    """(domain, subdomain_count, explosion_level, subdomains) from certificate log rows of newline-joined names."""
    names = df.select(F.lower("domain").alias("domain"), F.explode(F.split("name_value", "\n")).alias("name"))
    names = names.select("domain", F.lower(F.trim("name")).alias("name")).where("name <> '' and name <> domain and not startswith(name, '*')").distinct()
    out = names.groupBy("domain").agg(F.count("*").alias("subdomain_count"))
    # the first names of each domain, never a whole domain's names in one row
    from pyspark.sql import Window as W

    first = names.withColumn("r", F.row_number().over(W.partitionBy("domain").orderBy("name"))).where(F.col("r") <= cap)
    top = first.groupBy("domain").agg(F.array_sort(F.collect_list("name")).alias("subdomains"))
    level = F.when(F.col("subdomain_count") > 25, "High").when(F.col("subdomain_count") > 10, "Elevated").otherwise("None")
    return out.join(top, "domain").withColumn("explosion_level", level)


def owner_of(record: Column) -> Column:
    """The owner in a pipe-delimited network record: its fifth field."""
    return F.trim(F.coalesce(F.try_element_at(F.split(record, r"\|"), F.lit(5)), F.lit("")))


def tls_freshness(not_before: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, not_before)
    return F.struct(age.alias("tls_age_days"), F.when(age < 7, "New").when(age < 30, "Recent").otherwise("Established").alias("level"))
