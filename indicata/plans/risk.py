"""The additive risk score, explained factor by factor.

Each rule is one nullable struct (key, reason, points); ``factors`` is the array of
those that fired, in the order of the rules. ``raw_score`` is their sum plus two
adjustments that have no factor and stand in ``adjustment``: 7 points off for
domains that are only referenced, and the 8 points of a hosting factor that gives way
to a stronger one but keeps its points. The score isn't clamped below 0.

The projection comes in stages; Spark leaves an expensive expression that a later stage
uses more than once in a projection of its own.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lists
from ..functions.text import contains_any, member, present, strings, text_or_empty
from ..functions.urls import url_factors
from .factors import FACTORS

#: Input columns and their types; a column that is missing counts as null.
INPUT = {
    "input_type": "string", "query": "string",
    "vt_ok": "boolean", "vt_malicious": "int",
    "abuse_ok": "boolean", "abuse_confidence": "int", "is_tor": "boolean",
    "age_days": "int", "tls_age_days": "int", "rapid_deploy": "boolean", "provider": "string",
    "otx_ok": "boolean", "otx_tier": "string", "otx_reference_only": "boolean", "otx_tags": "array<string>", "otx_all_tags": "array<string>", "otx_families": "array<string>", "otx_pulses": "int", "otx_file_score": "double",
    "entropy_level": "string", "entropy_score": "double", "sub_level": "string", "sub_score": "double", "sub_label": "string", "sub_old_scored": "boolean",
    "subdomain_labels": "array<string>", "registrable_domain": "string", "tld": "string", "tld_level": "string",
    "similar_flag": "boolean", "similar_confidence": "string", "similar_brand": "string", "similar_method": "string",
    "hostname_brand_match": "boolean", "hostname_brand_confidence": "string", "hostname_brand_context": "string", "hostname_brand": "string", "hostname_label": "string",
    "ct_ok": "boolean", "ct_count": "int", "ct_level": "string",
    "brand_count": "int", "brands": "array<string>", "brand_context": "string", "lures": "array<string>", "cdn_provider": "string", "abused_platform": "string",
    "url_signals": "array<string>", "redirect_suspicious": "boolean",
}

_FACTOR = "struct<key:string,reason:string,points:int>"


def factor(when: Column, key: str, points: int, detail: Column | str = "") -> Column:
    """The factor if the condition holds, else null; its reason is its label and the detail."""
    detail = F.lit(detail) if isinstance(detail, str) else text_or_empty(detail.cast("string"))
    reason = F.concat(F.lit(FACTORS[key][1]), F.when(detail != "", F.concat(F.lit(": "), detail)).otherwise(""))
    return F.when(when, F.struct(F.lit(key).alias("key"), reason.alias("reason"), F.lit(points).alias("points")))


def points(factors: Column) -> Column:
    return F.aggregate(factors, F.lit(0), lambda a, x: a + x["points"])


def _has(factors: Column, key: str) -> Column:
    return F.exists(factors, lambda x: x["key"] == key)


def _bands(value: Column, unit: str, *bands: tuple[int, int | None, str, int]) -> list[Column]:
    """One factor for each band (from, to, key, points) of a number."""
    out = []
    for low, high, key, n in bands:
        inside = value >= low if high is None else value.between(low, high)
        out.append(factor(inside, key, n, F.concat(value.cast("string"), F.lit(unit))))
    return out


def _words(values: Column, n: int) -> Column:
    return F.array_join(F.slice(values, 1, n), ", ")


def with_inputs(df: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in INPUT.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def score(df: DataFrame) -> DataFrame:
    """``df`` with factors, adjustment, raw_score, normalized_score, severity, verdict and color."""
    kept = df.columns
    rules = _rules(df.sparkSession.sparkContext.applicationId)
    df = with_inputs(df)
    for columns in rules:
        df = df.withColumns(columns)
    return df.select(*kept, "factors", "adjustment", "raw_score", "normalized_score", "severity", "verdict", "color")


@lru_cache(maxsize=4)
def _rules(application: str) -> tuple[dict[str, Column], ...]:
    """The stages of the score, each a set of named columns over those before it.

    They only name columns, so one set serves every table of an application: building
    some thousand expressions takes longer than planning them.
    """
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    empty = F.array().cast("array<string>")
    base = {
        "_vt": no(c("vt_ok")), "_mal": F.when(no(c("vt_ok")), F.coalesce("vt_malicious", F.lit(0))).otherwise(0),
        "_conf": F.when(no(c("abuse_ok")), F.coalesce("abuse_confidence", F.lit(0))).otherwise(0),
        "_otx": no(c("otx_ok")), "_tags": F.coalesce("otx_tags", empty), "_fam": F.coalesce("otx_families", empty), "_pulses": F.coalesce("otx_pulses", F.lit(0)),
        "_ip": c("input_type") == "ip", "_brands": F.coalesce("brands", empty), "_lures": F.coalesce("lures", empty),
        "_nb": F.coalesce("brand_count", F.size("brands"), F.lit(0)),
    }
    # a hash without a usable verdict goes by the rules of names
    kind = {
        "_hash": (c("input_type") == "hash") & c("_vt"),
        "_tier": F.when(~c("_otx"), "None").when(c("_ip") & (F.coalesce("otx_tier", F.lit("None")) == "None") & (F.size("_tags") > 0), "Suspicious").otherwise(F.coalesce("otx_tier", F.lit("None"))),
    }
    mal, conf, ip, tier, fam, tags, pulses, otx = (c(x) for x in ("_mal", "_conf", "_ip", "_tier", "_fam", "_tags", "_pulses", "_otx"))
    name = ~ip & (c("input_type") != "hash")
    nfam = F.size(fam)

    hit_tags = F.array_sort(F.array_intersect(tags, strings(lists.HASH_RISK_TAGS)))
    file_score = c("otx_file_score")
    of_hash = [
        *_bands(mal, " engines", (1, 2, "hash_low_detection", 20), (3, 10, "hash_medium_detection", 40), (11, 25, "hash_high_detection", 60), (26, 49, "hash_very_high_detection", 80), (50, None, "hash_confirmed_malware", 95)),
        *[factor(otx & (nfam >= a) & (nfam <= b), "hash_otx_malware_families", n, F.concat(nfam.cast("string"), F.lit(" families: "), _words(fam, 4))) for a, b, n in ((1, 1, 10), (2, 3, 15), (4, 1 << 30, 20))],
        *[factor(otx & pulses.between(a, b), "hash_otx_pulse_strength", n, F.concat(pulses.cast("string"), F.lit(" pulses"))) for a, b, n in ((1, 3, 5), (4, 10, 10), (11, 1 << 30, 15))],
        factor(otx & (F.size(hit_tags) > 0), "hash_otx_high_risk_tags", 10, F.concat(F.lit("Tags: "), F.array_join(hit_tags, ","))),
        *[factor(otx & (file_score >= a) & (file_score < b), "hash_otx_file_score", n, F.concat(F.lit("score "), file_score.cast("string"))) for a, b, n in ((1, 5, 5), (5, 10, 10), (10, 20, 20), (20, 1 << 30, 30))],
    ]

    asn = F.lower(F.trim(text_or_empty(c("provider"))))
    vt_rules = [
        factor(mal == 1, "vt_single_detection", 10, "1 engine flagged malicious"),
        *[factor(ip & mal.between(a, b), k, n, F.concat(mal.cast("string"), F.lit(" engines flagged malicious"))) for a, b, k, n in ((2, 3, "vt_medium_detection", 25), (4, 7, "vt_high_detection", 40), (8, 1 << 30, "vt_critical_detection", 45))],
        *[factor(~ip & mal.between(a, b), k, n, F.concat(mal.cast("string"), F.lit(" engines"))) for a, b, k, n in ((2, 4, "vt_domain_low", 25), (5, 9, "vt_domain_medium", 35), (10, 19, "vt_domain_high", 45), (20, 1 << 30, "vt_domain_critical", 55))],
    ]
    rapid = no(c("rapid_deploy"))
    early = [
        *vt_rules,
        *[factor(c("abuse_ok") & ip & conf.between(a, b), k, n, F.concat(conf.cast("string"), F.lit("% confidence"))) for a, b, k, n in ((51, 1 << 30, "abuse_high_band", 30), (21, 50, "abuse_mid_band", 20), (5, 20, "abuse_low_band", 10))],
        *[factor(c("abuse_ok") & ~ip & conf.between(a, b), k, n, F.concat(conf.cast("string"), F.lit("%"))) for a, b, k, n in ((51, 1 << 30, "high_abuse_confidence", 20), (6, 50, "low_abuse_confidence", 5))],
        factor(c("abuse_ok") & c("is_tor"), "tor_exit_node", 15, "TOR exit node confirmed"),
        *[factor((c("age_days") >= a) & (c("age_days") < b), k, n, F.concat(c("age_days").cast("string"), F.lit(" days old"))) for a, b, k, n in ((-(1 << 31), 30, "young_domain", 30), (30, 90, "young_domain_mid", 10), (90, 180, "young_domain_low", 5))],
        *[factor((c("tls_age_days") >= a) & (c("tls_age_days") < b), k, n, F.concat(c("tls_age_days").cast("string"), F.lit(" days old"))) for a, b, k, n in ((-(1 << 31), 7, "tls_very_new", 10), (7, 30, "tls_new", 5))],
        factor(rapid | c("abused_platform").isNotNull(), "rapid_deployment_host", 10, F.when(rapid, F.coalesce("provider", F.lit("Unknown"))).otherwise(c("abused_platform"))),
        factor(~asn.isin("", "unresolved", "unknown") & contains_any(asn, lists.ABUSED_PROVIDERS), "asn_abuse_context", 8, F.concat(F.lit("Provider: "), F.trim("provider"))),
        factor(tier == "Strong", "otx_strong", 20, "Recent malware activity linked"),
        factor(tier == "Suspicious", "otx_suspicious", 10, F.when(F.size(tags) > 0, F.concat(F.lit("High-risk tags: "), _words(tags, 4))).otherwise("High-risk threat intelligence tags")),
        factor(tier == "Contextual", "otx_contextual", 3, "Referenced in threat intelligence collections"),
    ]
    stage_early = {"_early": present(F.when(c("_hash"), F.array(*of_hash)).otherwise(F.array(*early)))}

    ransom = F.filter(fam, lambda f: contains_any(F.lower(f), lists.RANSOMWARE_WORDS))
    every_tag = F.array_sort(F.array_distinct(F.concat(tags, F.coalesce("otx_all_tags", empty))))
    ransom_tag = F.filter(every_tag, lambda t: contains_any(t, lists.RANSOMWARE_WORDS))
    confirmed = (mal >= 5) & (nfam >= 2)
    of_ip = ip & otx
    subnet = F.when(F.length(F.regexp_replace("query", r"[^.]", "")) == 3, F.substring_index(F.trim("query"), ".", 3)).otherwise("")
    malware = of_ip & (pulses > 0) & (nfam > 0)
    strong = tier.isin("Suspicious", "Strong")
    level, sub, tld = c("entropy_level"), c("sub_level"), c("tld_level")
    young = no(c("age_days") < 30)
    brand_hit, lure_hit = c("_nb") > 0, F.size("_lures") > 0
    hb, hb_conf, hb_cdn = no(c("hostname_brand_match")), c("hostname_brand_confidence"), no(c("hostname_brand_context") == "cdn_subdomain")
    similar = no(c("similar_flag"))
    looks = F.concat(F.lit("Resembles '"), text_or_empty(c("similar_brand")), F.lit("' ("), text_or_empty(c("similar_method")), F.lit(")"))
    label_looks = F.concat(F.lit("'"), text_or_empty(c("hostname_label")), F.lit("' resembles '"), text_or_empty(c("hostname_brand")), F.lit("'"))
    reg = F.when(text_or_empty(c("registrable_domain")) != "", c("registrable_domain")).otherwise(F.substring_index(F.lower(F.trim("query")), ".", -2))
    cdn_brand = hb & hb_cdn
    middle = [
        *[factor(malware & nfam.between(a, b), "otx_ip_malware", n, F.concat(nfam.cast("string"), F.lit(" malware families"))) for a, b, n in ((1, 1, 15), (2, 3, 20), (4, 1 << 30, 30))],
        factor(of_ip & (pulses > 5), "otx_ip_pulses", 10, F.concat(pulses.cast("string"), F.lit(" pulses"))),
        factor(of_ip & confirmed, "malware_infrastructure_confirmed", 20, F.concat(F.lit("VT("), mal.cast("string"), F.lit(") + "), nfam.cast("string"), F.lit(" families"))),
        factor(of_ip & ((F.size(ransom) > 0) | (F.size(ransom_tag) > 0)), "ransomware_infrastructure", 15, F.when(F.size(ransom) > 0, F.concat(F.lit("Ransomware family: "), F.get(ransom, F.lit(0)))).otherwise(F.concat(F.lit("Ransomware tag: "), F.get(ransom_tag, F.lit(0))))),
        factor(of_ip & (subnet != "") & (mal >= 3) & (pulses >= 2) & ~confirmed, "subnet_cluster_activity", 12, F.concat(F.lit("Malicious activity in subnet "), subnet, F.lit(".x"))),
        factor(otx & strong & c("_vt") & (mal >= 2), "otx_vt_correlation", 10, "OTX tier confirmed by VT detections"),
        factor(name & (mal >= 5) & strong, "vt_otx_corroboration", 15, F.concat(F.lit("VT("), mal.cast("string"), F.lit(" engines) + OTX("), tier, F.lit(")"))),
        factor(ip & (mal >= 2) & contains_any(asn, lists.CLOUD_PROVIDERS), "cloud_abuse_pattern", 10, F.concat(F.lit("Cloud-hosted ("), text_or_empty(c("provider")), F.lit(") with "), mal.cast("string"), F.lit(" VT detections"))),
        factor(ip & (mal >= 2) & (conf > 5) & (strong | malware), "multi_feed_consensus", 15, F.concat(F.lit("VT("), mal.cast("string"), F.lit(" engines) + AbuseIPDB("), conf.cast("string"), F.lit("%) + OTX corroboration"))),
        factor(level == "High", "high_entropy", 5, F.concat(F.lit("Score: "), c("entropy_score").cast("string"))),
        factor(level == "Moderate", "moderate_entropy", 2, F.concat(F.lit("Score: "), c("entropy_score").cast("string"))),
        factor(sub == "High", "subdomain_v2_high", 10, F.concat(F.lit("Subdomain '"), text_or_empty(c("sub_label")), F.lit("'"))),
        factor(sub == "Moderate", "subdomain_v2_moderate", 5, F.concat(F.lit("Subdomain '"), text_or_empty(c("sub_label")), F.lit("'"))),
        factor(~no(sub.isin("High", "Moderate")) & c("sub_old_scored"), "subdomain_high_entropy", 10, F.concat(F.lit("Subdomain '"), text_or_empty(c("sub_label")), F.lit("'"))),
        factor(F.size("subdomain_labels") >= 3, "subdomain_depth_signal", 5, F.concat(F.lit("depth="), F.size("subdomain_labels").cast("string"), F.lit(": "), F.array_join("subdomain_labels", "."))),
        factor(tld == "High", "tld_high_risk", 15, c("tld")),
        factor(tld.isin("Medium", "Moderate"), "tld_moderate_risk", 5, c("tld")),
        factor((tld == "High") & (brand_hit | lure_hit | young), "tld_high_corr", 10, F.concat(text_or_empty(c("tld")), F.lit(" + "), F.array_join(present(F.array(F.when(brand_hit, "brand detected"), F.when(lure_hit, "lure keywords present"), F.when(young, F.concat(F.lit("domain age "), c("age_days").cast("string"), F.lit("d"))))), ", "))),
        factor(similar & (c("similar_confidence") == "High"), "brand_impersonation_high", 15, looks),
        factor(similar & (c("similar_confidence") == "Medium"), "brand_impersonation_med", 8, looks),
        factor(hb & hb_cdn & (hb_conf == "High"), "hostname_brand_cdn", 20, F.concat(label_looks, F.lit(" on CDN"))),
        factor(hb & ~hb_cdn & (hb_conf == "High"), "hostname_brand_direct", 12, label_looks),
        factor(hb & (hb_conf == "Medium"), "hostname_brand_direct", 8, F.concat(label_looks, F.lit(" (medium conf.)"))),
        factor(cdn_brand | (mal >= 3) & no(member(reg, lists.CDNS)), "cdn_abuse_pattern", 15, F.concat(F.lit("CDN-hosted with "), F.when(cdn_brand, "brand impersonation in subdomain").otherwise(F.concat(F.lit("VT("), mal.cast("string"), F.lit(" engines)"))))),
        factor(c("ct_ok") & (c("ct_level") == "High"), "subdomain_explosion_high", 10, F.concat(c("ct_count").cast("string"), F.lit(" subdomains via CT logs"))),
        factor(c("ct_ok") & (c("ct_level") == "Elevated"), "subdomain_explosion_low", 5, F.concat(c("ct_count").cast("string"), F.lit(" subdomains via CT logs"))),
    ]
    none = F.array().cast(f"array<{_FACTOR}>")
    stage_middle = {
        "_minus": F.when(~c("_hash") & otx & no(c("otx_reference_only")) & (points(c("_early")) > 3), -7).otherwise(0),
        "_middle": F.when(c("_hash"), none).otherwise(present(F.array(*middle))),
    }

    cdn_hit, abused = c("cdn_provider").isNotNull(), c("abused_platform").isNotNull()
    triple = brand_hit & cdn_hit & lure_hit
    first = F.get("_brands", F.lit(0))
    high = similar & no(c("similar_confidence") == "High") | hb & no(hb_conf == "High")
    fresh = no(c("tls_age_days") < 30)
    late = [
        factor(triple, "token_brand_cdn_lure", 30, F.concat(F.lit("brands="), _words(c("_brands"), 3), F.lit(", CDN="), text_or_empty(c("cdn_provider")), F.lit(", lures="), _words(c("_lures"), 3))),
        factor(~triple & (c("_nb") >= 2), "token_multi_brand", 20, F.concat(c("_nb").cast("string"), F.lit(" brands: "), _words(c("_brands"), 4))),
        factor(~triple & brand_hit & c("brand_context").isin("subdomain", "cdn_subdomain"), "token_brand_subdomain", 10, F.concat(F.lit("brand '"), first, F.lit("' in "), c("brand_context"))),
        factor(~triple & lure_hit, "token_lure_detected", 8, F.concat(F.lit("lure tokens: "), _words(c("_lures"), 5))),
        factor(~triple & abused & ~brand_hit, "token_abused_hosting", 8, F.concat(F.lit("Hosted on known abused platform: "), c("abused_platform"))),
        factor(brand_hit & abused, "token_abused_hosting_brand", 15, F.concat(F.lit("brand '"), text_or_empty(first), F.lit("' hosted on "), c("abused_platform"))),
        factor(high & (fresh | young & c("tls_age_days").isNull()), "brand_tls_correlation", 15, F.when(fresh, F.concat(F.lit("Brand impersonation + "), c("tls_age_days").cast("string"), F.lit("-day-old TLS cert"))).otherwise(F.concat(F.lit("Brand impersonation + "), c("age_days").cast("string"), F.lit("-day-old domain (TLS check unavailable)")))),
        factor(high & level.isin("Moderate", "High"), "brand_entropy_correlation", 5, F.concat(F.lit("Brand impersonation + "), F.lower(level), F.lit(" entropy domain"))),
        factor(high & strong, "brand_otx_correlation", 10, F.concat(F.lit("Brand impersonation + OTX tier '"), tier, F.lit("'"))),
    ]
    stage_late = {"_late": F.when(c("_hash"), none).otherwise(present(F.array(*late)))}
    stage_all = {
        "_all": F.concat("_early", "_middle", "_late"),
        "_hidden": F.when(~c("_hash") & abused & brand_hit & ~triple, 8).otherwise(0),
    }
    stage_struct = {"_struct": F.when(c("_hash"), none).otherwise(F.filter("_all", lambda x: member(x["key"], lists.STRUCTURAL_FACTORS)))}

    total = points(c("_struct"))
    url = c("input_type") == "url"
    last = present(F.array(
        factor(total >= 20, "behavioral_pattern_detected", 10, F.concat(F.lit("Structural signal total: "), total.cast("string"), F.lit(" pts ("), F.size(F.array_distinct(F.transform("_struct", lambda x: x["key"]))).cast("string"), F.lit(" indicators)"))),
        factor(url & c("redirect_suspicious"), "redirect_chain_suspicious", 10),
    ))
    labels = F.create_map(*[F.lit(x) for k, v in FACTORS.items() if k.startswith("url_") for x in (k, v[1])])
    of_url = F.transform(url_factors(F.coalesce("url_signals", empty)), lambda x: F.struct(x["key"].alias("key"), labels[x["key"]].alias("reason"), x["points"].cast("int").alias("points")))
    stage_factors = {"factors": F.concat("_all", last, F.when(url, of_url).otherwise(none)), "adjustment": c("_minus") + c("_hidden")}
    sums = {"raw_score": F.when(c("_hash"), F.least(points(c("factors")), F.lit(100))).otherwise(points(c("factors")) + c("adjustment"))}
    capped = {"normalized_score": F.least("raw_score", F.lit(100))}
    level_of = {"severity": F.when(c("_hash"), hash_severity(c("normalized_score"))).otherwise(severity(c("normalized_score")))}
    seen = otx & ((pulses > 0) | (nfam > 0) | (F.size(tags) > 0))
    told = {"verdict": verdict(c("severity"), (mal >= 1) | seen | (~c("_hash") & (conf > 0))), "color": color(c("severity"))}
    return base, kind, stage_early, stage_middle, stage_late, stage_all, stage_struct, stage_factors, sums, capped, level_of, told


def severity(score_: Column) -> Column:
    return F.when(score_ <= 25, "LOW").when(score_ <= 60, "MEDIUM").otherwise("HIGH")


def hash_severity(score_: Column) -> Column:
    return F.when(score_ >= 70, "HIGH").when(score_ >= 30, "MEDIUM").otherwise("LOW")


def verdict(severity_: Column, corroborated: Column) -> Column:
    return F.when(severity_ == "LOW", "LOW THREAT").when(severity_ == "MEDIUM", "NEEDS REVIEW").when(corroborated, "HIGHLY MALICIOUS").otherwise("LIKELY MALICIOUS")


def color(severity_: Column) -> Column:
    return F.when(severity_ == "LOW", "green").when(severity_ == "MEDIUM", "yellow").otherwise("red")


def factor_breakdown(factors: Column) -> Column:
    """Factors for display: most points first (ties as told), with a share of the documented maximum and a weight."""
    maxima = F.create_map(*[F.lit(x) for k, (m, _) in FACTORS.items() for x in (k, m)])
    rows = F.transform(factors, lambda x, i: F.struct((-x["points"]).alias("o"), i.alias("i"), x["key"].alias("key"), x["points"].alias("points"),
        F.least(F.lit(100), F.floor(100.0 * x["points"] / maxima[x["key"]] + 0.5).cast("int")).alias("percent"), F.when(x["points"] >= 15, "high").when(x["points"] >= 8, "medium").otherwise("low").alias("weight")))
    return F.transform(F.array_sort(rows), lambda x: F.struct(x["key"].alias("key"), x["points"].alias("points"), x["percent"].alias("percent"), x["weight"].alias("weight")))
