"""Accounting of API calls: batch summaries, and streaming counts as an extension of them.

Rows are (ts, session_id, api, method, violation). All counts are ordinary aggregates
that combine before they shuffle, so a session or API with a third of all calls is
no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import any_of, round2

#: Hosts of feeds, by ending or exactly, and other hosts that may be called.
ROUTES = (
    (r"(^|\.)virustotal\.com$", "virustotal"),
    (r"(^|\.)alienvault\.com$", "otx"),
    (r"(^|\.)abuseipdb\.com$", "abuseipdb"),
    (r"(^|\.)urlscan\.io$", "urlscan"),
    (r"^crt\.sh$", "crt_sh"),
    (r"(^|\.)team-cymru\.(com|net)$", "dns_whois"),
    (r"(^|\.)whois\.iana\.org$", "dns_whois"),
    (r"(^|\.)rdap\.(arin|ripe|apnic|lacnic|afrinic)\.net$", "dns_whois"),
)
ALLOWED = tuple(
    """
    www.virustotal.com virustotal.com otx.alienvault.com api.abuseipdb.com urlscan.io crt.sh team-cymru.com
    whois.team-cymru.com whois.iana.org rdap.arin.net rdap.ripe.net rdap.apnic.net rdap.lacnic.net rdap.afrinic.net
    """.split()
)
#: Names of the APIs as shown, and the seconds after its first call for which a session is kept.
NAMES = {"virustotal": "VirusTotal", "otx": "AlienVault OTX", "abuseipdb": "AbuseIPDB", "urlscan": "URLScan.io", "crt_sh": "crt.sh", "dns_whois": "DNS / WHOIS", "violation": "Direct Infra Contact", "other": "Other"}
SESSION_TTL = 3600


def call_class(host: Column) -> Column:
    """Struct of api and violation of a called host."""
    h = F.regexp_replace(F.lower(host), r"^www\.", "")
    api = F.coalesce(*[F.when(h.rlike(p), k) for p, k in ROUTES])
    allowed = any_of([(h == a) | F.endswith(h, F.lit("." + a)) for a in ALLOWED])
    return F.struct(F.coalesce(api, F.when(allowed, "other").otherwise("violation")).alias("api"), (api.isNull() & ~allowed).alias("violation"))


def calls_by_api(calls: DataFrame) -> DataFrame:
    """(session_id, api, name, calls, methods, ord): per session, most calls first and violations last; methods as method=count."""
    per = calls.groupBy("session_id", "api", "method").agg(F.count("*").alias("n"))
    out = per.groupBy("session_id", "api").agg(F.sum("n").alias("calls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "n"))), lambda x: F.concat(x["method"], F.lit("="), x["n"].cast("string"))), ",").alias("methods"))
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    order = W.partitionBy("session_id").orderBy((F.col("api") == "violation").cast("int"), F.desc("calls"), "api")
    return out.withColumns({"name": F.coalesce(names[F.col("api")], F.col("api")), "ord": F.row_number().over(order)})


def session_timeline(calls: DataFrame) -> DataFrame:
    """Calls with t, the seconds since their session's first, to two decimals; calls without a session are one session."""
    first = calls.groupBy(F.col("session_id").alias("_session")).agg(F.min("ts").alias("_t0"))
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / F.lit(1e6)
    same = F.col("session_id").eqNullSafe(F.col("_session"))
    return calls.join(first, same).withColumn("t", round2(t)).drop("_t0", "_session")


def session_views(calls: DataFrame, cap: int = 40) -> DataFrame:
    """(session_id, methods, timeline, more): methods as method=count, most calls first; a session's first calls as api@seconds; how many more there are.

    The first calls are a limit within each session, which Spark applies in every task before it deals rows.
    """
    per = calls.groupBy("session_id", "method").agg(F.count("*").alias("n"))
    methods = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "method")))
    totals = per.groupBy("session_id").agg(F.array_join(F.transform(methods, lambda m: F.concat(m["method"], F.lit("="), (-m["less"]).cast("string"))), ",").alias("methods"), F.sum("n").alias("calls"))
    order = W.partitionBy("session_id").orderBy("ts", "api", "method")
    first = session_timeline(calls).withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= cap)
    shown = first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "api", "t"))).alias("rows"))
    line = F.array_join(F.transform("rows", lambda r: F.concat(r["api"], F.lit("@"), F.format_string("%.2f", r["t"]))), ",")
    same = totals["session_id"].eqNullSafe(shown["session_id"])
    return totals.join(shown, same).select(totals["session_id"], "methods", line.alias("timeline"), F.greatest(F.col("calls") - cap, F.lit(0)).alias("more"))


def trailing_counts(calls: DataFrame, as_of: Column, seconds=(60, 3600, 86400)) -> DataFrame:
    """(api, last_60, last_3600, last_86400): calls within so many seconds before ``as_of``; api null is all together."""
    recent = {f"last_{n}": F.count_if((F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(n))) & (F.col("ts") <= as_of)) for n in seconds}
    return calls.rollup("api").agg(*[v.alias(k) for k, v in recent.items()])


def live_sessions(calls: DataFrame, as_of: Column, ttl: int = SESSION_TTL) -> DataFrame:
    """Sessions that aren't stale: those whose first call is no older than the limit."""
    return calls.groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("total")).where(F.col("first_ts") >= as_of - F.make_dt_interval(secs=F.lit(ttl)))


def windowed_counts(calls: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Streaming (or batch) counts of calls by api and time window; events later than ``late`` are dropped by the watermark."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return calls.withWatermark("ts", late).groupBy(span.alias("w"), "api").agg(F.count("*").alias("calls"), F.count_if("violation").alias("violations")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "api", "calls", "violations")


SESSION_STATE = "first_ts timestamp, total long, violations long"
SESSION_OUT = "session_id string, first_ts timestamp, total long, violations long, expired boolean"


def session_totals(calls: DataFrame, ttl: int = SESSION_TTL) -> DataFrame:
    """Streaming running totals of each session; a session's state goes ``ttl`` seconds after its first call."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, total, bad = state.get
            state.remove()
            yield pd.DataFrame([(key[0], first, total, bad, True)], columns=["session_id", "first_ts", "total", "violations", "expired"])
            return
        first, total, bad = state.get if state.exists else (None, 0, 0)
        for pdf in batches:
            low = pdf["ts"].min()
            first = low if first is None or low < first else first
            total, bad = total + len(pdf), bad + int(pdf["violation"].fillna(False).sum())
        state.update((first, total, bad))
        at = int((pd.Timestamp(first) + pd.Timedelta(seconds=ttl)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], first, total, bad, False)], columns=["session_id", "first_ts", "total", "violations", "expired"])

    stream = calls.withWatermark("ts", "10 minutes").select("session_id", "ts", "violation")
    return stream.groupBy("session_id").applyInPandasWithState(update, SESSION_OUT, SESSION_STATE, "update", "EventTimeTimeout")
