"""Derivations for display: chips, totals, labels, links and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intel import url_id
from ..functions.text import present, text_or_empty


def signal_chips(signals: Column, entropy_level: Column, brand: Column, rapid: Column) -> Column:
    """Names of the chips that a row shows, in order."""
    any_ = lambda *names: F.exists(signals, lambda s: s.isin(*names))
    return present(F.array(
        F.when(entropy_level != "Low", F.concat(F.lit("entropy:"), entropy_level)), F.when(brand.isNotNull(), F.concat(F.lit("resembles:"), brand)), F.when(rapid, "rapid_deploy"),
        F.when(any_("path_keywords_high", "path_keywords_present"), "path_keywords"), F.when(any_("open_redirect_param"), "open_redirect"), F.when(any_("encoded_params", "base64_in_query"), "encoded_params"),
        F.when(any_("double_slash_path", "brand_in_path"), "path_confusion"), F.when(any_("ip_host"), "ip_host"), F.when(any_("very_long_path", "long_path"), "long_path"),
    ))


def severity_histogram(scored: DataFrame) -> DataFrame:
    """(severity, n): rows without a score count as ERROR."""
    return scored.groupBy(F.coalesce("severity", F.lit("ERROR")).alias("severity")).agg(F.count("*").alias("n"))


def verdict_label(verdict: Column) -> Column:
    return F.coalesce(*[F.when(verdict == v, label) for v, label in (("HIGHLY MALICIOUS", "Highly Malicious"), ("LIKELY MALICIOUS", "Likely Malicious"), ("NEEDS REVIEW", "Needs Review"), ("LOW THREAT", "Low Threat"))], verdict)


def indicator_guess(value: Column) -> Column:
    """url, ip or else domain."""
    return F.when(value.rlike("^(?i)https?://"), "url").when(value.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ip").otherwise("domain")


def _encoded(value: Column) -> Column:
    """Percent-encoded for a path, blanks as %20, marks that a browser leaves alone left alone."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for sign, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def external_links(value: Column, kind: Column) -> Column:
    """Struct of the pages about an indicator at three feeds."""
    v = _encoded(value)
    vt, otx = "https://www.virustotal.com/gui/", "https://otx.alienvault.com/"
    page = lambda base, part, x=v: F.concat(F.lit(f"{base}{part}/"), x)
    return F.struct(
        F.when(kind == "ip", page(vt, "ip-address")).when(kind == "domain", page(vt, "domain")).when(kind == "url", page(vt, "url", F.rtrim(F.translate(F.base64(F.encode(value, "UTF-8")), "\r\n", ""), F.lit("=")))).when(kind == "hash", page(vt, "file")).otherwise(page(vt, "search")).alias("virustotal"),
        F.when(kind == "ip", F.concat(F.lit("https://www.abuseipdb.com/check/"), v)).otherwise("https://www.abuseipdb.com/").alias("abuseipdb"),
        F.when(kind.isin("ip", "domain", "url"), F.concat(F.lit(f"{otx}indicator/"), kind, F.lit("/"), v)).when(kind == "hash", page(otx, "indicator/file")).otherwise(otx).alias("otx"),
        url_id(value).alias("url_id"),
    )


def format_bytes(size: Column) -> Column:
    kb = size / F.lit(1024.0)
    one = lambda x: F.format_string("%.1f", x)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(kb < 1024, F.concat(one(kb), F.lit(" KB"))).otherwise(F.concat(one(kb / 1024), F.lit(" MB")))


def format_date(value: Column) -> Column:
    """A date from epoch seconds or an ISO text; anything else stays."""
    v = text_or_empty(value)
    return F.when(v.rlike(r"^\d{9,}$"), F.date_format(F.timestamp_seconds(v.try_cast("long")), "yyyy-MM-dd")).otherwise(F.coalesce(F.date_format(F.try_to_timestamp(v), "yyyy-MM-dd"), v))


def artifact_total(df: DataFrame) -> DataFrame:
    """Adds total_artifacts, the sum of the counts by type."""
    return df.withColumn("total_artifacts", F.col("n_url") + F.col("n_domain") + F.col("n_ip") + F.col("n_hash"))


def source_badges(scored: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """(id, source, n, n_high, n_medium, worst): a badge for each source of a message's indicators."""
    high, medium = F.count_if(F.col("severity") == "HIGH"), F.count_if(F.col("severity") == "MEDIUM")
    return scored.groupBy(id_col, "source").agg(F.count("*").alias("n"), high.alias("n_high"), medium.alias("n_medium"), F.when(high > 0, "HIGH").when(medium > 0, "MEDIUM").otherwise("LOW").alias("worst"))


def factor_points(factors: Column, key: str) -> Column:
    """Points of the first factor of that key, else null."""
    return F.get(F.filter(factors, lambda x: x["key"] == key), F.lit(0))["points"]
