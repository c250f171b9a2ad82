"""Redirect chains from two snapshot sources, and what they mean for the urls that lead into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import member, ordered_dedup, pinned, text_or_empty
from ..functions.urls import chain_hosts, merged_chain, url_parts
from ..plans.risk import color, severity

#: Hosts that are no destination of a redirect.
NOISE_HOSTS = tuple(
    """
    www.google-analytics.com google-analytics.com www.googletagmanager.com googletagmanager.com cdn.amplitude.com
    api.amplitude.com www.facebook.com connect.facebook.net www.googleadservices.com pagead2.googlesyndication.com
    fonts.googleapis.com fonts.gstatic.com ajax.googleapis.com cdnjs.cloudflare.com static.cloudflareinsights.com
    """.split()
)


def _web(values: Column) -> Column:
    return F.filter(values, lambda u: F.startswith(text_or_empty(u), F.lit("http")))


def verdict_chain(url: Column, redirects: Column, last_final_url: Column, own_url: Column) -> Column:
    """The chain that a verdict feed knows: the url, its redirects, and its last url or else the feed's own."""
    end = F.when(text_or_empty(last_final_url) != "", last_final_url).when(own_url != url, own_url)
    return ordered_dedup(_web(F.concat(F.array(url), F.coalesce(redirects, F.array().cast("array<string>")), F.array(end))))


def scan_chain(url: Column, requests: Column, page_url: Column, listed: Column) -> Column:
    """The chain of a scan: each request's redirect (struct of redirect_url and location), then the page's url.

    A target that starts with / belongs to the host of the last absolute one. A scan
    without any redirect yields the root of the first listed url on another host.
    """

    def absolute(base: Column, target: Column) -> Column:
        p = url_parts(base)
        root = F.concat(p["scheme"], F.lit("://"), p["netloc"])
        return F.when(F.startswith(target, F.lit("//")), F.concat(p["scheme"], F.lit(":"), target)).when(F.startswith(target, F.lit("/")), F.concat(root, target)).otherwise(target)

    def step(state: Column, request: Column) -> Column:
        one, two = absolute(state["at"], text_or_empty(request["redirect_url"])), absolute(state["at"], text_or_empty(request["location"]))
        hit = F.when(F.startswith(one, F.lit("http")), one).when(F.startswith(two, F.lit("http")), two)
        return F.struct(F.coalesce(hit, state["at"]).alias("at"), F.when(hit.isNull(), state["chain"]).otherwise(F.concat(state["chain"], F.array(hit))).alias("chain"))

    start = F.struct(url.alias("at"), F.array(url).alias("chain"))
    walked = F.aggregate(F.coalesce(requests, F.array().cast("array<struct<redirect_url:string,location:string>>")), start, step)["chain"]
    chain = ordered_dedup(F.concat(walked, _web(F.array(page_url))))
    home = url_parts(url)["hostname"]
    other = F.get(F.filter(_web(F.coalesce(listed, F.array().cast("array<string>"))), lambda u: (url_parts(u)["hostname"] != "") & (url_parts(u)["hostname"] != home) & ~member(url_parts(u)["hostname"], NOISE_HOSTS)), F.lit(0))
    root = F.concat(url_parts(other)["scheme"], F.lit("://"), url_parts(other)["netloc"], F.lit("/"))
    return F.when((F.size(chain) == 1) & other.isNotNull(), F.concat(chain, F.array(root))).otherwise(chain)


def chains(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds url_chain, domains, has_redirects and final_url to rows with the columns of both sources.

    Columns: vt_redirects, vt_last_final_url, vt_url, us_requests, us_page_url,
    us_list_urls; nulls mean that a source knows nothing.
    """
    c = F.col
    known = c("us_page_url").isNotNull() | c("us_requests").isNotNull()
    df = df.withColumn("_vt", verdict_chain(c(url_col), c("vt_redirects"), c("vt_last_final_url"), c("vt_url")))
    df = df.withColumn("_us", F.when(known, scan_chain(c(url_col), c("us_requests"), c("us_page_url"), c("us_list_urls"))).otherwise(F.array().cast("array<string>")))
    df = pinned(df)
    df = pinned(df.withColumn("url_chain", merged_chain(c("_vt"), c("_us"))))
    df = df.withColumns({"domains": chain_hosts(c("url_chain")), "has_redirects": F.size("url_chain") > 1})
    final = F.coalesce(F.when(c("vt_last_final_url") != "", c("vt_last_final_url")), F.when(c("us_page_url") != "", c("us_page_url")), F.get("url_chain", F.size("url_chain") - 1))
    return df.withColumn("final_url", final).drop("_vt", "_us")


def hops(chained: DataFrame, id_col: str = "url") -> DataFrame:
    """(id, pos, domain, is_first, is_final): the hosts of a chain; only the final one is ever scored."""
    n = F.size("domains")
    return chained.select(id_col, n.alias("_n"), F.posexplode("domains").alias("pos", "domain")).select(id_col, "pos", "domain", (F.col("pos") == 0).alias("is_first"), (F.col("pos") == F.col("_n") - 1).alias("is_final"))


def chain_verdicts(chained: DataFrame, scored_hosts: DataFrame, id_col: str = "url") -> DataFrame:
    """Adds final_score, final_tld_level and chain_suspicious from scored hosts (domain, score, tld_level)."""
    last = F.get("domains", F.size("domains") - 1)
    joined = chained.withColumn("_last", last).join(scored_hosts.select(F.col("domain").alias("_last"), F.col("score").alias("final_score"), F.col("tld_level").alias("final_tld_level")), "_last", "left")
    return joined.withColumn("chain_suspicious", F.coalesce((F.coalesce("final_score", F.lit(0)) >= 60) | (F.col("final_tld_level") == "High"), F.lit(False))).drop("_last")


def elevated(scored_urls: DataFrame, verdicts: DataFrame, threshold: int = 25) -> DataFrame:
    """Scored urls with the chain of their origin; a url whose final host scores higher takes its score.

    Only urls above the threshold are looked at, one for each scheme and host (the
    first by ``pos``): its chain holds for all of them.
    """
    p = url_parts(F.col("ioc"))
    urls = scored_urls.withColumn("_origin", F.concat(p["scheme"], F.lit("://"), p["hostname"])).withColumn("_live", F.coalesce(F.col("score") > threshold, F.lit(False)))
    canon = urls.where("_live").groupBy("_origin").agg(F.min_by("ioc", F.struct("pos", "ioc")).alias("_canon"))
    chain = verdicts.select(F.col("url").alias("_canon"), "has_redirects", "chain_suspicious", "final_score", F.get("domains", F.size("domains") - 1).alias("_final"))
    out = urls.join(canon.join(chain, "_canon", "left"), "_origin", "left")
    out = out.withColumn("_up", F.coalesce(F.col("_live") & F.col("has_redirects") & (F.col("final_score") > F.col("score")), F.lit(False)))
    up = F.col("_up")
    reason = F.concat(F.lit("Redirects to '"), F.col("_final"), F.lit("' (score "), F.col("final_score").cast("string"), F.lit(") — parent score raised from "), F.col("score").cast("string"))
    out = out.withColumn("elevation", F.when(up, F.struct(F.lit("redirect_score_elevated").alias("key"), reason.alias("reason"), (F.col("final_score") - F.col("score")).alias("points"))))
    out = out.withColumn("score", F.when(up, F.col("final_score")).otherwise(F.col("score")))
    sev = severity(F.col("score"))
    out = out.withColumn("verdict", F.when(up, F.when(sev == "HIGH", "LIKELY MALICIOUS").when(sev == "MEDIUM", "NEEDS REVIEW").otherwise("LOW THREAT")).otherwise(F.col("verdict")))
    out = out.withColumn("severity", F.when(up, sev).otherwise(F.col("severity"))).withColumn("color", color(F.col("severity")))
    return out.withColumn("chain_suspicious", F.when(F.col("_live"), F.coalesce("chain_suspicious", F.lit(False)))).drop("_origin", "_canon", "_final", "_up")


def redirect_summary(elevated_urls: DataFrame) -> DataFrame:
    """How many urls there were, were analysed (distinct origins), were skipped, and lead to suspicious chains."""
    p = url_parts(F.col("ioc"))
    origin = F.concat(p["scheme"], F.lit("://"), p["hostname"])
    return elevated_urls.agg(F.countDistinct(F.when(F.col("_live"), origin)).alias("analysed"), F.count_if(~F.col("_live")).alias("skipped"), F.count("*").alias("total_url_results"), F.count_if("chain_suspicious").alias("suspicious_chains"))


#: Fixed value: urls of a chain at most.
MAX_CHAIN = 10


def _next_hops(edges: DataFrame) -> DataFrame:
    usable = edges.where(F.col("url").isNotNull() & F.col("target").isNotNull() & (F.col("url") != F.col("target")))
    return usable.groupBy("url").agg(F.min_by("target", F.struct("ord", "target")).alias("target"))


def _longer(ahead: DataFrame, further: DataFrame) -> DataFrame:
    """Paths (url, path), each followed by the path of its last url, if there is one."""
    more = further.select(F.col("url").alias("_last"), F.col("path").alias("_more"))
    joined = ahead.withColumn("_last", F.element_at("path", -1)).join(more, "_last", "left")
    return joined.select("url", F.concat("path", F.coalesce("_more", F.array().cast("array<string>"))).alias("path"))


def followed_chains(edges: DataFrame, cap: int = MAX_CHAIN) -> DataFrame:
    """All chains of a table of single hops at once: url, chain, final_url, n_hops, cyclic, capped.

    ``edges`` has the columns url, target and ord; of several hops from a url, the one of the
    least ord (then target) is taken, and one to itself is none. A chain ends
    where no hop leads on, before it meets one of its own urls again (``cyclic``), or with
    ``cap`` urls (``capped``). One row for each url that a hop starts from.

    Paths double in each round, as in binary powers of a step, so ``cap`` urls take about
    as many joins as its binary digits. A target that very many urls lead to is an ordinary skewed key of
    a join whose other side holds it once.
    """
    step = _next_hops(edges)
    power = step.select("url", F.array("target").alias("path"))
    walked, left = None, cap
    while left:
        if left & 1:
            walked = power if walked is None else _longer(walked, power)
        left >>= 1
        power = _longer(power, power) if left else power
    # cap hops were walked: one more than the chain may have, which tells whether it goes on
    every = F.concat(F.array("url"), "path")
    own = F.array_distinct(every)
    out = walked.select("url", every.alias("_every"), own.alias("_own")).withColumns({"cyclic": F.size("_own") < F.size("_every"), "capped": F.size("_own") > cap, "chain": F.slice("_own", 1, cap)})
    return out.select("url", "chain", F.element_at("chain", -1).alias("final_url"), (F.size("chain") - 1).alias("n_hops"), "cyclic", "capped")
